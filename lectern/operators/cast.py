"""Cast tables: labels, speaker resolution, merges and references.

Casts, segments, incoming rows and merges may have a `book_id`; names then mean members of the same book only. Tables
without the column are one book. Names are compared in lower case; a null name is in no match.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lectern.functions import text as X
from lectern.functions.constants import ALIAS_STOPWORDS, EMOTIONS, RETAINED_SPEAKERS
from lectern.functions.folds import let, rows_of

BOOK = "book_id"
#: Names that every cast has.
SPECIAL = ("Narrator", "Extra Female", "Extra Male", *RETAINED_SPEAKERS)


def _booked(df: DataFrame) -> DataFrame:
    return df if BOOK in df.columns else df.withColumn(BOOK, F.lit(0))


def _unbooked(out: DataFrame, *sources: DataFrame) -> DataFrame:
    """Without the column where no source has it."""
    return out if any(BOOK in df.columns for df in sources) else out.drop(BOOK)


def usable_aliases(aliases: Column, name: Column) -> Column:
    """Aliases that are neither empty, nor the own name, nor a pronoun."""

    def keep(a: Column) -> Column:
        norm = F.lower(F.regexp_replace(X.stripped(a), r"[.,;:]+$", ""))
        return (norm != "") & (norm != F.lower(name)) & ~norm.isin(*ALIAS_STOPWORDS)

    return F.filter(aliases, keep)


def _forms(cast: DataFrame) -> Column:
    return F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))


def labels(cast: DataFrame, books: DataFrame | None = None) -> DataFrame:
    """(book_id, norm, display): every normalised name and alias with its display name, special names first, then cast order.

    cast (name, aliases, ordinal); the special names are in every book of the cast, and of books (book_id) if given.
    """
    cast = _booked(cast)
    every_book = cast.select(BOOK) if books is None else cast.select(BOOK).unionByName(books.select(BOOK))
    display = X.shortest_label(F.col("name"), F.col("aliases"))
    own = cast.select(BOOK, "ordinal", display.alias("display"), F.posexplode(_forms(cast)).alias("place", "label"))
    special = every_book.distinct().select(BOOK, F.lit(-1).cast("long").alias("ordinal"), F.posexplode(F.array(*map(F.lit, SPECIAL))).alias("place", "label"))
    every = own.unionByName(special.withColumn("display", F.col("label")))
    return every.groupBy(BOOK, X.normalize_name(F.col("label")).alias("norm")).agg(F.min_by("display", F.struct("ordinal", "place")).alias("display"))


def resolve_speakers(segments: DataFrame, cast: DataFrame) -> DataFrame:
    """segments (speaker, ...) with resolved and problem: by display name, by normalised label, by the one cast member whose label contains the speaker or is contained in it.

    Only distinct speakers of a book are resolved, against its own cast: an equi-join on the book, so the work is a book's speakers times its members.
    """
    rows, members = _booked(segments), _booked(cast)
    speakers = rows.select(BOOK, "speaker").distinct().withColumn("norm", X.normalize_name(F.col("speaker")))
    index = labels(members, speakers)
    exact = speakers.join(index.select(BOOK, F.col("display").alias("speaker")).distinct(), [BOOK, "speaker"], "left_semi").select(BOOK, "speaker", F.col("speaker").alias("exact"))
    display = X.shortest_label(F.col("name"), F.col("aliases"))
    forms = members.select(BOOK, display.alias("member"), F.explode(_forms(members)).alias("label")).select(BOOK, "member", X.normalize_name(F.col("label")).alias("form")).distinct()
    inside = speakers.join(forms, BOOK).where(F.contains("norm", "form") | F.contains("form", "norm"))
    loose = inside.groupBy(BOOK, "speaker").agg(F.array_sort(F.collect_set("member")).alias("members"))
    found = speakers.join(exact, [BOOK, "speaker"], "left").join(index, [BOOK, "norm"], "left").join(loose, [BOOK, "speaker"], "left")
    n = F.coalesce(F.size("members"), F.lit(0))
    known = F.coalesce("exact", "display")
    resolved = found.select(
        BOOK,
        "speaker",
        F.when(known.isNotNull(), known).when(n == 1, F.get("members", F.lit(0))).alias("resolved"),
        F.when(known.isNotNull() | (n == 1), F.lit(None)).when(n > 1, F.concat(F.lit("ambiguous: "), F.array_join("members", ", "))).otherwise("unknown").alias("problem"),
    )
    return _unbooked(rows.join(resolved, [BOOK, "speaker"], "left"), segments)


def grouped_errors(rows: DataFrame, message: str, index: str, shown: int = 10) -> DataFrame:
    """(message, n, preview): indexes of each message, the first few written out."""
    g = rows.groupBy(message).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(index)).alias("at"))
    listed = F.array_join(F.transform(F.slice("at", 1, shown), lambda x: x.cast("string")), ", ")
    more = F.when(F.col("n") > shown, F.concat(F.lit(" (+"), (F.col("n") - shown).cast("string"), F.lit(" more)"))).otherwise("")
    return g.select(message, "n", F.concat(listed, more).alias("preview"))


def find_existing(incoming: DataFrame, cast: DataFrame) -> DataFrame:
    """(id, name, matched): the member that an incoming character (id, name, aliases) is: by name, else name as an alias, else its aliases in order."""
    asked, members = _booked(incoming), _booked(cast)
    names = members.select(BOOK, F.lower("name").alias("form"), F.col("name").alias("matched"), F.lit(0).alias("kind"))
    other = members.select(BOOK, F.explode("aliases").alias("form"), F.col("name").alias("matched")).select(BOOK, F.lower("form").alias("form"), "matched", F.lit(1).alias("kind"))
    forms = asked.select(BOOK, "id", F.posexplode(_forms(asked)).alias("place", "form")).withColumn("form", F.lower("form"))
    hits = forms.join(names.unionByName(other), [BOOK, "form"]).groupBy(BOOK, "id").agg(F.min_by("matched", F.struct("place", "kind", "matched")).alias("matched"))
    return _unbooked(asked.select(BOOK, "id", "name").join(hits, [BOOK, "id"], "left"), incoming)


def upsert(cast: DataFrame, incoming: DataFrame) -> DataFrame:
    """cast (name, description, voice, audition_line, aliases) with incoming rows of one batch, distinct names: new text replaces old, a line only fills a gap, aliases join without taking another member's.

    An incoming name that is an alias of one member is that member, and joins its aliases as it does already; of several incoming rows for one member the least name counts.
    """
    members, asked = _booked(cast), _booked(incoming)
    c = members.withColumn("key", F.lower("name"))
    none = F.array().cast("array<string>")
    named = asked.select(BOOK, F.lower("name").alias("key"), *(F.col(x).alias(f"new_{x}") for x in ("name", "description", "voice", "audition_line", "aliases")))
    direct = c.select(BOOK, "key").withColumn("own", F.lit(True))
    by_alias = c.select(BOOK, F.col("key").alias("member"), F.explode(F.coalesce("aliases", none)).alias("a")).groupBy(BOOK, F.lower("a").alias("key")).agg(F.min("member").alias("member"))
    found = named.join(direct, [BOOK, "key"], "left").join(by_alias, [BOOK, "key"], "left")
    i = found.withColumn("key", F.when(F.col("own").isNull(), F.coalesce("member", "key")).otherwise(F.col("key"))).drop("own", "member")
    i = i.groupBy(BOOK, "key").agg(F.min_by(F.struct(*(c for c in i.columns if c.startswith("new_"))), F.struct(F.lower("new_name") != F.col("key"), "new_name")).alias("x")).select(BOOK, "key", "x.*")
    owners = c.select(BOOK, "key", F.explode(_forms(c)).alias("form")).select(BOOK, F.col("key").alias("owner"), F.lower("form").alias("form"))
    fresh = i.select(BOOK, "key", F.explode(usable_aliases(F.coalesce("new_aliases", none), F.col("key"))).alias("alias")).withColumn("form", F.lower("alias"))
    taken = fresh.join(owners, [BOOK, "form"]).where("owner <> key").select(BOOK, "key", "alias")
    allowed = fresh.join(taken, [BOOK, "key", "alias"], "left_anti").groupBy(BOOK, "key").agg(F.collect_set("alias").alias("allowed"))
    both = c.join(i, [BOOK, "key"], "full_outer").join(allowed, [BOOK, "key"], "left")
    pick = lambda x: F.coalesce(F.nullif(F.col(f"new_{x}"), F.lit("")), F.col(x))
    aliases = F.array_sort(F.array_union(usable_aliases(F.coalesce("aliases", none), F.col("key")), F.coalesce("allowed", none)))
    description, voice = pick("description"), pick("voice")
    same = aliases.eqNullSafe(F.array_sort(F.coalesce("aliases", none))) & description.eqNullSafe(F.col("description")) & voice.eqNullSafe(F.col("voice"))
    outcome = F.when(F.col("name").isNull(), "added").when(F.col("new_name").isNull(), "kept").when(same, "unchanged").otherwise("updated")
    line = F.coalesce(F.nullif(F.col("audition_line"), F.lit("")), F.col("new_audition_line"), F.col("audition_line"))
    out = both.select(BOOK, F.coalesce("name", "new_name").alias("name"), description.alias("description"), voice.alias("voice"), line.alias("audition_line"), aliases.alias("aliases"), outcome.alias("outcome"))
    return _unbooked(out, cast, incoming)


def fold_merges(cast: DataFrame, merges: DataFrame) -> DataFrame:
    """(name, survivor, aliases): members after merges (into, source, ordinal if there is an order); a survivor holds the names and aliases of all that were folded into it.

    A name or alias means the member that holds it now, so a chain is followed to its end whatever the order of its
    links; a merge of a member into itself, which a cycle comes to, and one with an unknown name do nothing. Merges
    follow one another in a fold over a book's merges, whose state is every member's survivor; books are independent.
    Without an ordinal the order is that of the names. Members without a name are left out; merges with a null name do nothing.
    """
    members, links = _booked(cast).where("name is not null"), _booked(merges).where("into is not null and source is not null")
    links = links if "ordinal" in links.columns else links.withColumn("ordinal", F.lit(0).cast("long"))
    place = "ordinal" if "ordinal" in members.columns else "name"
    # whose is a name or alias: names go before aliases, earlier members before later ones
    own = members.withColumn("k", F.row_number().over(Window.partitionBy(BOOK).orderBy(place, "name")) - 1)
    forms = own.select(BOOK, "k", F.posexplode(_forms(own)).alias("at", "form")).groupBy(BOOK, F.lower("form").alias("form"))
    holders = forms.agg(F.min_by("k", F.struct((F.col("at") > 0).alias("alias"), "k")).alias("k"))
    named = links.select(BOOK, "ordinal", "into", "source", F.lower("into").alias("form")).join(holders, [BOOK, "form"]).withColumnRenamed("k", "to").drop("form")
    named = named.withColumn("form", F.lower("source")).join(holders, [BOOK, "form"]).withColumnRenamed("k", "gone")
    steps = named.groupBy(BOOK).agg(F.array_sort(F.collect_list(F.struct("ordinal", "into", "source", "to", "gone"))).alias("steps"))
    sizes = own.groupBy(BOOK).agg(F.max("k").alias("last")).join(steps, BOOK, "left")

    def merged(tops: Column, step: Column) -> Column:
        return let(F.struct(F.get(tops, step["to"]).alias("to"), F.get(tops, step["gone"]).alias("gone")), lambda x: F.transform(tops, lambda t: F.when(t == x["gone"], x["to"]).otherwise(t)))

    none = F.array().cast("array<struct<ordinal:bigint,into:string,source:string,to:int,gone:int>>")
    tops = F.aggregate(F.coalesce("steps", none), F.sequence(F.lit(0), "last"), merged)
    ends = rows_of(sizes, [BOOK], tops, "k", "top")
    joined = own.join(ends, [BOOK, "k"])
    heads = own.select(BOOK, F.col("k").alias("top"), F.col("name").alias("survivor"), F.coalesce("aliases", F.array().cast("array<string>")).alias("kept"))
    gained = joined.join(heads, [BOOK, "top"]).select(BOOK, "top", F.explode(F.when(F.col("k") == F.col("top"), F.coalesce("aliases", F.array().cast("array<string>"))).otherwise(_forms(joined))).alias("alias"), "survivor", "kept")
    held = gained.where((F.lower("alias") != F.lower("survivor")) | F.array_contains("kept", F.col("alias"))).groupBy(BOOK, "top").agg(F.array_sort(F.collect_set("alias")).alias("held"))
    out = joined.join(heads.drop("kept"), [BOOK, "top"]).join(held, [BOOK, "top"], "left")
    aliases = F.when(F.col("k") == F.col("top"), F.coalesce("held", F.array().cast("array<string>")))
    return _unbooked(out.select(BOOK, "name", "survivor", aliases.alias("aliases")), cast, merges)


_FIELDS = ("name", "description", "voice", "audition_line", "aliases")
#: Rows of a result that leave a task at once.
_OUT_ROWS = 4096


def _known_forms(forms: Column) -> Column:
    """(low, norm) of each form: in lower case, and as an alias is compared; norm is null where it can be nobody's alias."""

    def one(f: Column) -> Column:
        norm = F.lower(F.regexp_replace(X.stripped(f), r"[.,;:]+$", ""))
        return F.struct(f.alias("form"), F.lower(f).alias("low"), F.when((norm != "") & ~norm.isin(*ALIAS_STOPWORDS), norm).alias("norm"))

    return F.transform(forms, one)


def _empty(x: str | None) -> bool:
    return x is None or x == ""


class _Cast:
    """A book's members while rows come to them, found by name and by alias.

    A member that a row came to holds usable aliases only, all of them its own: no later row can take one away, so a row is looked
    up and joined by its own names and aliases, whatever the cast holds.
    """

    def __init__(self, overwrite: bool) -> None:
        self.overwrite = overwrite
        self.members: list[dict] = []
        self.by_name: dict[str, int] = {}
        #: The first member with an alias; all members of a cast as it came, of whom the first may lose it.
        self.by_alias: dict[str, list[int]] = {}

    def add(self, row: dict, forms: list[dict]) -> None:
        """A member with these aliases (form, low, norm)."""
        k = len(self.members)
        self.members.append({**row, "aliases": forms, "clean": False})
        self.by_name.setdefault(row["low"], k)
        for low in {f["low"] for f in forms}:
            if low is not None:
                self.by_alias.setdefault(low, []).append(k)

    def holder(self, low: str | None) -> int | None:
        """The first member of that name, else the first with that alias."""
        if low is None:
            return None
        return self.by_name[low] if low in self.by_name else next(iter(self.by_alias.get(low, ())), None)

    def take(self, e: dict, forms: list[dict]) -> tuple[str, str, list[str]]:
        """(member, outcome, rejected) of an incoming row with its forms, the name first."""
        k = next((h for f in forms if (h := self.holder(f["low"])) is not None), None)
        if k is None:
            self.add(e, [f for f in forms[1:] if f["norm"] is not None and f["norm"] != e["low"]])
            return e["name"], "added", []
        m = self.members[k]
        joined = m["low"] != e["low"]
        usable = lambda fs: {f["form"]: f for f in fs if f["norm"] is not None and f["norm"] != m["low"]}
        free = lambda f: self.holder(f["low"]) in (None, k)
        rejected: list[str] = []
        if not m["clean"]:
            old = usable(m["aliases"])
            held = {a: f for a, f in old.items() if free(f)}
            rejected = [a for a in old if a not in held]
            for low in {f["low"] for f in m["aliases"]} - {f["low"] for f in held.values()} - {None}:
                self.by_alias[low].remove(k)
            m["aliases"], m["clean"] = held, True
        new = {a: f for a, f in usable([*forms[1:], *forms[: 1 if joined else 0]]).items() if a not in m["aliases"]}
        gained = {a: f for a, f in new.items() if a not in rejected and free(f)}
        rejected += [a for a in new if a not in gained and a not in rejected]
        for a, f in gained.items():
            m["aliases"][a] = f
            if k not in (own := self.by_alias.setdefault(f["low"], [])):
                own.append(k)
        prompt = m["description"] if _empty(m["voice"]) else m["voice"]
        described = not _empty(e["description"]) and e["description"] != m["description"]
        voiced = not _empty(e["voice"]) and e["voice"] != prompt
        said = not _empty(e["audition_line"]) and e["audition_line"] != m["audition_line"] and (self.overwrite or _empty(m["audition_line"]))
        m |= {c: e[c] for c, changed in (("description", described), ("voice", voiced), ("audition_line", said)) if changed}
        changed = bool(gained) or described or voiced or said
        return m["name"], "merged" if joined else "updated" if changed else "unchanged", sorted(rejected)

    def rows(self) -> Iterator[tuple]:
        """(ordinal, name, description, voice, audition_line, aliases) of all members."""
        for k, m in enumerate(self.members):
            aliases = sorted(m["aliases"]) if m["clean"] else [f["form"] for f in m["aliases"]]
            yield (k, m["name"], m["description"], m["voice"], m["audition_line"], aliases)


def _batches_folded(cast: DataFrame, incoming: DataFrame, overwrite: bool, outcomes: bool) -> DataFrame:
    """A book's members after all incoming rows, or what became of each row: rows of a book come in order, its members are kept."""
    none = F.array().cast("array<string>")

    def side(df: DataFrame, kind: int) -> DataFrame:
        batch = F.col("batch").cast("long") if kind else F.lit(0).cast("long")
        aliases = F.coalesce(F.col("aliases").cast("array<string>"), none)
        texts = (F.col(c).cast("string").alias(c) for c in _FIELDS[:-1])
        return _booked(df).where("name is not null").select(BOOK, F.lit(kind).alias("kind"), batch.alias("batch"), F.col("ordinal").cast("long").alias("ordinal"), *texts, aliases.alias("aliases"))

    rows = side(cast, 0).unionByName(side(incoming, 1))
    book = rows.schema[BOOK]
    made = "batch long, ordinal long, name string, member string, outcome string, rejected array<string>" if outcomes else "ordinal long, name string, description string, voice string, audition_line string, aliases array<string>"
    schema = T.StructType([T.StructField(BOOK, book.dataType), *T.StructType.fromDDL(made).fields])

    def folded(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        at, state = None, None
        for batch in batches:
            for e in batch.to_pylist():
                # rows of no book: members and incoming rows have nothing to do with each other
                place = (e[BOOK], e["kind"] if e[BOOK] is None else None)
                if state is None or place != at:
                    if state is not None and not outcomes:
                        yield from ((at[0], *r) for r in state.rows())
                    at, state = place, _Cast(overwrite)
                forms = e.pop("forms")
                if e["kind"] == 0:
                    state.add(e, forms)
                    continue
                member, outcome, rejected = state.take(e, forms)
                if outcomes:
                    yield (e[BOOK], e["batch"], e["ordinal"], e["name"], member, outcome, rejected)
        if state is not None and not outcomes:
            yield from ((at[0], *r) for r in state.rows())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = to_arrow_schema(schema)
        found = folded(batches)
        while held := list(islice(found, _OUT_ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), kinds)], schema=kinds)

    # with a number, or books of few bytes and many rows would be put together into one task
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_order = rows.repartition(parts, BOOK).sortWithinPartitions(BOOK, "kind", "batch", "ordinal", *_FIELDS)
    # forms are made where the books are: before, a small file would make all of them in one task
    forms = F.when(F.col("kind") == 1, F.concat(F.array("name"), "aliases")).otherwise(F.col("aliases"))
    return in_order.withColumns({"low": F.lower("name"), "forms": _known_forms(forms)}).drop("aliases").mapInArrow(run, schema)


def upsert_batches(cast: DataFrame, incoming: DataFrame, overwrite_lines: bool = False) -> DataFrame:
    """The cast (ordinal, name, description, voice, audition_line, aliases) after incoming rows of several batches (batch, ordinal, and the same columns), in their order.

    A row is the member whose name it has, else the one whose alias its name is, else the one that one of its aliases names; else it is
    new. New text replaces old, a line only fills a gap unless overwrite_lines; aliases join but for those that another member has,
    among them members and aliases of earlier batches. A member keeps its place, new ones follow. A book's rows are folded one by
    one as they come sorted, its members are what is kept; rows without a name are left out. Members of a book have different names.
    """
    return _unbooked(_batches_folded(cast, incoming, overwrite_lines, False), cast, incoming)


def batch_outcomes(cast: DataFrame, incoming: DataFrame, overwrite_lines: bool = False) -> DataFrame:
    """(batch, ordinal, name, member, outcome, rejected) of every incoming row of `upsert_batches`: added, updated, merged or unchanged, and the aliases it did not get."""
    return _unbooked(_batches_folded(cast, incoming, overwrite_lines, True), cast, incoming)


def emote_tasks(cast: DataFrame) -> DataFrame:
    """Every member in every style: the styles are an array of fixed size, so no join is needed."""
    return cast.select("*", F.posexplode(F.array(*map(F.lit, EMOTIONS))).alias("emotion_idx", "emotion"))


def round_robin(cast: DataFrame, voices: list[str], key: str, existing: str) -> DataFrame:
    """Voices of members (key, name, ordinal, existing): the narrator has the first, the others take turns with the rest; existing ones stay, and keep their turn."""
    first, rest = voices[0], voices[1:] or voices[:1]
    narrator = F.lower("name") == "narrator"
    turn = F.sum(F.when(narrator, 0).otherwise(1)).over(Window.partitionBy(key).orderBy("ordinal")) - 1
    dealt = F.when(narrator, F.lit(first)).otherwise(F.get(F.array(*map(F.lit, rest)), (turn % len(rest)).cast("int")))
    return cast.withColumn("voice", F.coalesce(F.nullif(F.col(existing), F.lit("")), dealt))


def first_of(*options: Column) -> Column:
    """The first option that is neither null nor empty."""
    return F.coalesce(*(F.nullif(o, F.lit("")) for o in options))

