"""Review replies, split and fill edits, and the reports on them.

Defined results: a null or broken reply has no rows, or one that says what is wrong; parts of a report that are null are left
out; places (chapter_idx, seg_idx) must be unique in a script; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions.constants import EMOTIONS, RETAINED_SPEAKERS
from lectern.functions.folds import rows_of
from lectern.operators.script import speaker_islands

#: Keys under which a reply may hold its changes, in the order in which they count.
CHANGE_KEYS = ("changes", "segments", "seg")
#: Audit kinds that are shown without being asked for.
VISIBLE_KINDS = ("flag", "validation", "hallucination")
#: Keys by which an object is known to be a character.
CHARACTER_KEYS = ("name", "n", "description", "d", "voice", "v", "aliases", "a")


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _is_object(v: Column) -> Column:
    return _kind(v).startswith("OBJECT")


def _listed(v: Column) -> Column:
    """The items of a list; null for anything else."""
    return F.when(_kind(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))


def _part(v: Column, full: str, short: str) -> Column:
    """What an object has under its full key, else under its short one."""
    return F.coalesce(F.try_variant_get(v, f"$.{full}", "variant"), F.try_variant_get(v, f"$.{short}", "variant"))


def _string(v: Column) -> Column:
    return F.when(_kind(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _item(v: Column) -> Column:
    """Segment, speaker, instruction and text that an item of a reply names; what is of another type is null."""
    at = _part(v, "index", "i")
    fields = [_string(_part(v, full, short)).alias(full) for full, short in (("speaker", "s"), ("instruction", "in"), ("text", "t"))]
    return F.struct(F.when(_kind(at) == "BIGINT", F.try_variant_get(at, "$", "bigint")).alias("seg_idx"), *fields)


def change_list(v: Column, keys: Column) -> Column:
    """The changes of a reply: a list is they; of an object the list under the first change key, itself if it names a segment, else its first list; null for anything else."""
    named = [_listed(F.try_variant_get(v, f"$.{key}", "variant")) for key in CHANGE_KEYS]
    whole = F.try_variant_get(v, "$", "map<string,variant>")
    lists = F.filter(F.transform(keys, lambda k: _listed(F.try_element_at(whole, k))), lambda x: x.isNotNull())
    itself = F.when(F.try_variant_get(v, "$.index", "variant").isNotNull(), F.array(v))
    none = F.array().cast("array<variant>")
    return F.coalesce(_listed(v), F.when(_is_object(v), F.coalesce(*named, itself, F.get(lists, F.lit(0)), none)))


#: How a reply that is no list or object is called.
_TYPES = (("STRING", "str"), ("BIGINT", "int"), ("BOOLEAN", "bool"), ("VOID", "NoneType"))


def review_rows(parsed: DataFrame, key: str) -> DataFrame:
    """(key, kind, ordinal, seg_idx, speaker, instruction, text, reason) of parsed replies (key, json, keys): kind is change, flag, or problem with the reason.

    Items that are no objects or name no segment are left out, as are flags that are no list. A null json gives no rows.
    """
    keys = F.col("keys") if "keys" in parsed.columns else F.json_object_keys("json")
    rows = parsed.where("json is not null").select(key, F.try_parse_json("json").alias("v"), F.coalesce(keys, F.array().cast("array<string>")).alias("keys"))
    rows = rows.select(key, "v", change_list(F.col("v"), F.col("keys")).alias("changes"))
    called = F.coalesce(*(F.when(_kind(F.col("v")) == kind, name) for kind, name in _TYPES), F.lit("float"))
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("seg_idx", "long"), ("speaker", "string"), ("instruction", "string"), ("text", "string"))]
    problems = rows.where("changes is null").select(key, F.lit("problem").alias("kind"), F.lit(0).cast("long").alias("ordinal"), *nothing, F.concat(F.lit("no changes in a reply of type "), called).alias("reason"))
    changes = rows_of(rows, [key], F.col("changes"), "ordinal", "x").where(_is_object(F.col("x"))).select(key, "ordinal", _item(F.col("x")).alias("i"))
    changes = changes.where("i.seg_idx is not null").select(key, F.lit("change").alias("kind"), F.col("ordinal").cast("long").alias("ordinal"), "i.*", F.lit(None).cast("string").alias("reason"))
    listed = rows_of(rows.where(_is_object(F.col("v"))), [key], _listed(F.try_variant_get("v", "$.flags", "variant")), "ordinal", "x").where(_is_object(F.col("x")))
    inner = F.try_variant_get("x", "$.suggestion", "variant")
    said = _item(F.when(_is_object(inner), inner).otherwise(F.col("x")))
    text = lambda name: F.coalesce(F.nullif(F.try_variant_get("x", f"$.{name}", "string"), F.lit("")))
    flags = listed.select(key, "ordinal", _item(F.col("x"))["seg_idx"].alias("seg_idx"), said.alias("i"), F.coalesce(text("reason"), text("r"), F.lit("")).alias("reason")).where("seg_idx is not null")
    flags = flags.select(key, F.lit("flag").alias("kind"), F.col("ordinal").cast("long").alias("ordinal"), "seg_idx", "i.speaker", "i.instruction", "i.text", "reason")
    return problems.unionByName(changes).unionByName(flags)


def review_flags(reviews: DataFrame, segments: DataFrame) -> DataFrame:
    """Flags (chapter_idx, ordinal, seg_idx, reason, speaker, instruction, text_mutation) on segments that exist.

    What a flag suggests is what it says and the segment does not: an unknown style or what the segment has already is no
    suggestion; where there is one, the rest of it is the segment's own. text_mutation is a text it would change, which stays.
    """
    now = segments.select("chapter_idx", "seg_idx", F.col("speaker").alias("has_speaker"), F.col("instruction").alias("has_style"), F.col("text").alias("has_text"))
    f = reviews.where("kind = 'flag'").join(now, ["chapter_idx", "seg_idx"])
    speaker = F.when(~F.col("speaker").eqNullSafe(F.col("has_speaker")), F.col("speaker"))
    style = F.when(F.col("instruction").isin(*EMOTIONS) & ~F.col("instruction").eqNullSafe(F.col("has_style")), F.col("instruction"))
    suggests = speaker.isNotNull() | style.isNotNull()
    return f.select(
        "chapter_idx", "ordinal", "seg_idx", "reason",
        F.when(suggests, F.coalesce(F.nullif(speaker, F.lit("")), "has_speaker")).alias("speaker"),
        F.when(suggests, F.coalesce(style, "has_style")).alias("instruction"),
        F.when(X.stripped(F.col("text")) != X.stripped(F.col("has_text")), F.col("text")).alias("text_mutation"),
    )


def merge_rows(parsed: DataFrame, key: str) -> DataFrame:
    """(key, ordinal, place, into, source, reason, problem) of the merges in parsed cast replies (key, json), under full or short keys.

    A merge without a survivor or without sources is one row with the problem. Replies without merges have no rows.
    """
    item = "struct<into:string,i:string,from:string,f:string,reason:string>"
    outer = F.from_json("json", "struct<merges:string,m:string>")
    raw = parsed.select(key, F.coalesce(outer["merges"], outer["m"]).alias("raw"))
    rows = raw.select(key, F.posexplode(F.from_json("raw", f"array<{item}>")).alias("ordinal", "x"))
    into = F.trim(F.coalesce("x.into", "x.i", F.lit("")))
    sources = F.coalesce("x.from", "x.f", F.lit("[]"))
    listed = F.when(F.ltrim(sources).startswith("["), F.from_json(sources, "array<string>")).otherwise(F.array(sources))
    named = F.filter(F.transform(listed, lambda s: F.trim(s)), lambda s: s != "")
    rows = rows.select(key, F.col("ordinal").cast("long").alias("ordinal"), into.alias("into"), named.alias("sources"), F.coalesce("x.reason", F.lit("")).alias("reason"))
    problem = F.when(F.col("into") == "", "missing 'into'").when(F.size("sources") == 0, "'from' must be non-empty")
    rows = rows.withColumn("problem", problem)
    return rows.select(key, "ordinal", "into", F.posexplode_outer(F.when(F.col("problem").isNull(), F.col("sources"))).alias("place", "source"), "reason", "problem").withColumn("place", F.col("place").cast("long"))


def is_character(fields: Column) -> Column:
    """Whether an object of these keys is a character."""
    return F.arrays_overlap(fields, F.array(*map(F.lit, CHARACTER_KEYS)))


def visible_audit(entries: DataFrame, every: bool = False) -> DataFrame:
    return entries if every else entries.where(F.col("kind").isin(*VISIBLE_KINDS))


def is_unknown_voice(message: Column, voice: Column) -> Column:
    """Whether a service refused the voice because it does not know it."""
    low = F.lower(message)
    return low.contains("unknown voice") & low.contains(F.lower(voice))


def apply_splits(segments: DataFrame, splits: DataFrame, declined: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segments of mixed quotes replaced by their splits, numbered anew; and flags (chapter_idx, seg_idx, reason, text_hash) for what was declined now.

    segments (chapter_idx, seg_idx, speaker, text); splits (chapter_idx, seg_idx, parts array<struct<speaker, text>>, reason): a
    reason is a refusal. Segments that are retained, are not mixed, or whose text was declined before (declined: text_hash) stay,
    and so does one whose parts are fewer than two or do not say its text.
    """
    mixed = X.is_mixed_quote(F.col("text")) & ~F.col("speaker").isin(*RETAINED_SPEAKERS)
    asked = segments.where(mixed).withColumn("text_hash", F.sha2("text", 256)).join(declined.select("text_hash").distinct(), "text_hash", "left_anti")
    answered = asked.join(splits, ["chapter_idx", "seg_idx"])
    refused = answered.where("reason is not null").select("chapter_idx", "seg_idx", "reason", "text_hash")
    whole = X.without_space(F.array_join(F.transform("parts", lambda p: p["text"]), "")) == X.without_space(F.col("text"))
    good = answered.where(F.col("reason").isNull() & (F.size("parts") >= 2) & whole).select("chapter_idx", "seg_idx", "parts")
    itself = F.array(F.struct("speaker", "text"))
    pieces = segments.join(good, ["chapter_idx", "seg_idx"], "left").select("chapter_idx", "seg_idx", F.posexplode(F.coalesce("parts", itself)).alias("part", "p"))
    order = Window.partitionBy("chapter_idx").orderBy("seg_idx", "part")
    return pieces.select("chapter_idx", (F.row_number().over(order) - 1).cast("long").alias("seg_idx"), "p.speaker", "p.text"), refused


def fill_missing(segments: DataFrame, pieces: DataFrame, blank: str = r"\s") -> DataFrame:
    """Segments with the pieces (chapter_idx, before, offset, ordinal, speaker, text) that a script lacked, neighbours of one speaker joined, numbered anew.

    A piece stands before the segment it names, or inside it behind `offset` characters: the segment is cut there, and the cut
    pieces have no white space at the cut. An offset behind the segment's end means its start. Only chapters with pieces change.
    White space is what the class blank says, also where neighbours are joined; by default all of it.
    """
    touched = pieces.select("chapter_idx").distinct()
    cuts = pieces.groupBy("chapter_idx", F.col("before").alias("seg_idx")).agg(F.array_sort(F.collect_set("offset")).alias("cuts"))
    rows = segments.join(touched, "chapter_idx").join(cuts, ["chapter_idx", "seg_idx"], "left")
    size = F.length("text")
    inside = F.filter(F.coalesce("cuts", F.array().cast("array<long>")), lambda c: (c > 0) & (c < F.length("text")))
    edges = F.concat(F.array(F.lit(0).cast("long")), inside, F.array(size.cast("long")))
    parts = F.transform(F.slice(edges, 1, F.size(edges) - 1), lambda a, k: F.struct(a.alias("at"), F.substr("text", (a + 1).cast("int"), (F.get(edges, k + 1) - a).cast("int")).alias("t"), k.alias("k"), (F.size(edges) - 2).alias("last")))
    own = rows.select("chapter_idx", "seg_idx", "speaker", F.explode(parts).alias("p"))
    trimmed = F.when(F.col("p.k") > 0, F.regexp_replace("p.t", f"^{blank}+", "")).otherwise(F.col("p.t"))
    trimmed = F.when(F.col("p.k") < F.col("p.last"), F.regexp_replace(trimmed, f"{blank}+$", "")).otherwise(trimmed)
    kept = own.select("chapter_idx", F.col("seg_idx").alias("place"), F.col("p.at").alias("offset"), F.lit(1).alias("own"), F.lit(0).cast("long").alias("ordinal"), "speaker", trimmed.alias("text"))
    lengths = segments.select("chapter_idx", F.col("seg_idx").alias("before"), F.length("text").alias("n"))
    new = pieces.join(lengths, ["chapter_idx", "before"], "left")
    at = F.when(F.col("offset") < F.coalesce("n", F.lit(0)), F.col("offset")).otherwise(F.lit(0)).cast("long")
    new = new.select("chapter_idx", F.col("before").alias("place"), at.alias("offset"), F.lit(0).alias("own"), F.col("ordinal").cast("long").alias("ordinal"), "speaker", "text")
    order = Window.partitionBy("chapter_idx").orderBy("place", "offset", "own", "ordinal")
    whole = kept.unionByName(new).select("chapter_idx", (F.row_number().over(order) - 1).cast("long").alias("seg_idx"), "speaker", "text")
    joined = speaker_islands(whole, None if blank == r"\s" else blank).select("chapter_idx", F.col("seg_idx").cast("long").alias("seg_idx"), "speaker", "text")
    return joined.unionByName(segments.join(touched, "chapter_idx", "left_anti").select("chapter_idx", F.col("seg_idx").cast("long").alias("seg_idx"), "speaker", "text"))


def cast_list(cast: DataFrame, key: str, specials: bool = False) -> DataFrame:
    """(key, listing): a line per member (name, aliases, ordinal) under its shortest label, with its other names."""
    names = F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))
    short = X.shortest_label(F.col("name"), F.col("aliases"))
    others = F.filter(names, lambda n: n != short)
    line = F.when(F.size(others) > 0, F.concat(short, F.lit(" (also: "), F.array_join(others, "; "), F.lit(")"))).otherwise(short)
    lines = F.array_sort(F.collect_list(F.struct("ordinal", line.alias("line"))))["line"]
    if specials:
        also = ("Narrator (prose narration)", "Extra Female / Extra Male (unnamed minor characters)", f"{' / '.join(sorted(RETAINED_SPEAKERS))} (kept in the text, never spoken)")
        lines = F.concat(lines, F.array(*map(F.lit, also)))
    return cast.groupBy(key).agg(F.concat(F.lit("- "), F.array_join(lines, "\n- ")).alias("listing"))


def _quoted(label: str, text: Column, size: int, speaker: Column | None = None) -> Column:
    head = F.concat(F.lit(label), speaker, F.lit(': "')) if speaker is not None else F.lit(label + '"')
    return F.concat(head, X.truncate(text, size), F.lit('"'))


def missing_report(missing: DataFrame, segments: DataFrame) -> DataFrame:
    """(chapter_idx, seg_idx, offset, report) of missing fragments (chapter_idx, seg_idx, offset, text, line): what is missing and where it belongs."""
    at = segments.select("chapter_idx", "seg_idx", F.col("speaker").alias("next_speaker"), F.col("text").alias("next_text"))
    last = segments.select("chapter_idx", (F.col("seg_idx") + 1).alias("seg_idx"), F.col("speaker").alias("prev_speaker"), F.col("text").alias("prev_text"))
    rows = missing.join(at, ["chapter_idx", "seg_idx"], "left").join(last, ["chapter_idx", "seg_idx"], "left")
    number = F.row_number().over(Window.partitionBy("chapter_idx").orderBy("seg_idx", "offset", "text"))
    place = F.col("seg_idx").cast("string")
    behind = F.concat(F.lit("  insert after segment "), (F.col("seg_idx") - 1).cast("string"), _quoted(": ", F.col("prev_text"), 50, F.col("prev_speaker")))
    ahead = F.concat(F.lit("  insert before segment "), place, _quoted(": ", F.col("next_text"), 50, F.col("next_speaker")))
    where = F.when(F.col("seg_idx") == 0, "  insert at: beginning of script").when(F.col("prev_text").isNull(), "  insert at: end of empty script").otherwise(F.concat_ws("\n", behind, F.when(F.col("next_text").isNotNull(), ahead)))
    line = F.when((F.col("line") != "") & (F.col("line") != F.col("text")), _quoted("  full line: ", F.col("line"), 70))
    split = F.when(F.col("offset") > 0, F.concat(F.lit("  split offset: "), F.col("offset").cast("string"), F.lit(" chars into segment "), place))
    head = F.concat(F.lit("[missing #"), number.cast("string"), _quoted("] ", F.col("text"), 60))
    return rows.select("chapter_idx", "seg_idx", "offset", F.concat_ws("\n", head, line, where, split).alias("report"))


def metrics_report(rows: DataFrame) -> Column:
    """A line of checks of a take (label, categories, mean_abs, first_sample, last_sample, clip_run, duration_s), and whose it is (speaker, instruction, text) where that is known."""
    # formatting alone would round halves up
    number = lambda fmt, c: F.format_string(fmt, F.bround(F.col(c).cast("double"), int(fmt[-2])))
    head = F.concat(F.lit("["), F.rpad(F.array_join("categories", ","), 28, " "), F.lit("] "), F.substring("label", 1, 16), F.lit(" ma="), number("%.4f", "mean_abs"), F.lit(" fs="), number("%+.3f", "first_sample"), F.lit(" ls="), number("%+.3f", "last_sample"), F.lit(" cliprun="), F.col("clip_run").cast("string"), F.lit(" dur="), number("%.1f", "duration_s"), F.lit("s"))
    style = F.when(F.coalesce("instruction", F.lit("")) != "", F.concat(F.lit(" ("), F.col("instruction"), F.lit(")"))).otherwise("")
    who = F.when(F.col("text").isNotNull() | F.col("speaker").isNotNull(), F.concat(F.lit("    ["), F.coalesce(F.nullif("speaker", F.lit("")), F.lit("?")), F.lit("]"), style))
    said = F.replace(X.stripped(F.col("text")), F.lit("\n"), F.lit(" "))
    shown = F.when(F.length(said) > 100, F.concat(F.substring(said, 1, 97), F.lit("..."))).otherwise(said)
    return F.concat_ws("\n", head, who, F.when(F.coalesce("text", F.lit("")) != "", F.concat(F.lit("    text: "), shown)))


def segment_lines(segments: DataFrame) -> DataFrame:
    """(chapter_idx, log): a script with its styles, as it is logged."""
    style = F.when(F.coalesce("instruction", F.lit("")) != "", F.concat(F.lit("     instruction: "), F.col("instruction")))
    line = F.concat_ws("\n", F.concat(F.lit("["), F.col("seg_idx").cast("string"), F.lit("] "), F.col("speaker"), F.lit(": "), F.col("text")), style)
    return segments.groupBy("chapter_idx").agg(F.array_join(F.array_sort(F.collect_list(F.struct("seg_idx", line.alias("l"))))["l"], "\n").alias("log"))


def export_plan(chapters: DataFrame, sources: DataFrame, exports: DataFrame, state: DataFrame, force: bool = False) -> DataFrame:
    """(book_id, chapter_idx, phase, action): what an export has to do for each chapter that any phase rendered.

    chapters (book_id, chapter_idx, hash); sources (book_id, chapter_idx, phase): the first of perform and synthesize that has
    anything is a book's source; exports (book_id, chapter_idx, has_subtitles); state (book_id, chapter_idx, hash) as last exported.
    Action: export, back-fill (only the subtitles lack) or skip.
    """
    rank = F.when(F.col("phase") == "perform", 0).when(F.col("phase") == "synthesize", 1)
    first = sources.where(rank.isNotNull()).groupBy("book_id").agg(F.min_by("phase", rank).alias("phase"))
    there = sources.join(first, ["book_id", "phase"], "left_semi").select("book_id", "chapter_idx", "phase").distinct()
    done = exports.select("book_id", "chapter_idx", F.coalesce("has_subtitles", F.lit(False)).alias("subtitled"))
    rows = there.join(chapters, ["book_id", "chapter_idx"]).join(done, ["book_id", "chapter_idx"], "left").join(state.select("book_id", "chapter_idx", F.col("hash").alias("old")), ["book_id", "chapter_idx"], "left")
    fresh = F.col("subtitled").isNotNull() & (F.col("old") == F.col("hash")) & F.lit(not force)
    action = F.when(~F.coalesce(fresh, F.lit(False)), "export").when(~F.col("subtitled"), "back-fill").otherwise("skip")
    return rows.select("book_id", "chapter_idx", "phase", action.alias("action"))


def audio_tags(chapters: DataFrame) -> DataFrame:
    """(book_id, chapter_idx, title, album, artist, track) of chapters (book_id, chapter_idx, chapter_title, title, author): the tags of an exported file."""
    n = F.count(F.lit(1)).over(Window.partitionBy("book_id"))
    return chapters.select("book_id", "chapter_idx", F.col("chapter_title").alias("title"), F.col("title").alias("album"), F.col("author").alias("artist"), F.concat(F.col("chapter_idx").cast("string"), F.lit("/"), n.cast("string")).alias("track"))


def chapter_metadata(offsets: DataFrame) -> DataFrame:
    """(book_id, content): the chapter marks of an audiobook in the text form of its container. offsets (book_id, chapter_idx, chapter_title, title, author, start_ms, end_ms)."""
    mark = F.concat(F.lit("[CHAPTER]\nTIMEBASE=1/1000\nSTART="), F.col("start_ms").cast("string"), F.lit("\nEND="), F.col("end_ms").cast("string"), F.lit("\ntitle="), X.escape_metadata(F.col("chapter_title")))
    g = offsets.groupBy("book_id").agg(F.first("title").alias("title"), F.first("author").alias("author"), F.array_join(F.array_sort(F.collect_list(F.struct("chapter_idx", mark.alias("m"))))["m"], "\n").alias("marks"))
    head = F.concat(F.lit(";FFMETADATA1\ntitle="), X.escape_metadata(F.col("title")), F.lit("\nartist="), X.escape_metadata(F.col("author")))
    return g.select("book_id", F.concat_ws("\n", head, "marks").alias("content"))


def progress(tasks: DataFrame, key: str) -> DataFrame:
    """(key, n_segments, n_done, n_words, n_words_done) of tasks (key, text, done): how far a book is."""
    size = F.size(X.words(F.coalesce("text", F.lit("")))).cast("long")
    return tasks.groupBy(key).agg(F.count(F.lit(1)).alias("n_segments"), F.count_if("done").alias("n_done"), F.sum(size).alias("n_words"), F.coalesce(F.sum(F.when(F.col("done"), size)), F.lit(0)).alias("n_words_done"))
