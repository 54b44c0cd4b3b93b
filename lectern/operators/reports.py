"""Texts for people: what a validation, a merge check or an audit found, and the refusal of work on open flags.

Defined results: fields of an entry that are null are left out of its text, or shown as a question mark where one names a place;
entries that share a place are numbered by their reasons; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import incremental, reviews


def quoted(text: Column) -> Column:
    """A string as it is written in messages: single quotes, or double ones around a text that holds only single ones; control marks escaped."""
    pairs = (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"))
    plain = reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, text)
    double = F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'")))


def merge_problems(merges: DataFrame, key: str) -> DataFrame:
    """(key, ordinal, place, problem) of the merges in a reply (key, ordinal, into, sources): empty names, a source that is the survivor, a source that is folded twice.

    Names are compared normalised. A merge whose survivor has no name is one problem (place -1), and none of its sources counts.
    """
    into = X.normalize_name(F.coalesce("into", F.lit("")))
    head = F.concat(F.lit("merge "), F.col("ordinal").cast("string"), F.lit(": "))
    unnamed = merges.where(into == "").select(key, "ordinal", F.lit(-1).cast("long").alias("place"), F.concat(head, F.lit("'into' is empty after normalization")).alias("problem"))
    rows = merges.where(into != "").select(key, "ordinal", "into", into.alias("into_norm"), F.posexplode("sources").alias("place", "source"))
    rows = rows.withColumn("place", F.col("place").cast("long")).withColumn("norm", X.normalize_name(F.coalesce("source", F.lit(""))))
    empty = rows.where("norm = ''").select(key, "ordinal", "place", F.concat(head, F.lit("empty entry in 'from'")).alias("problem"))
    named = rows.where("norm <> ''")
    same = named.where("norm = into_norm").select(key, "ordinal", "place", F.concat(head, F.lit("'from' entry "), quoted(F.col("source")), F.lit(" equals 'into' "), quoted(F.col("into"))).alias("problem"))
    w = Window.partitionBy(key, "norm").orderBy("ordinal", "place")
    again = named.withColumn("n", F.row_number().over(w)).withColumn("first", F.first("into").over(w)).where("n > 1")
    twice = again.select(key, "ordinal", "place", F.concat(head, quoted(F.col("source")), F.lit(" already folded into "), quoted(F.col("first"))).alias("problem"))
    return unnamed.unionByName(empty).unionByName(same).unionByName(twice)


def hallucinated_report(found: DataFrame, segments: DataFrame) -> DataFrame:
    """(chapter_idx, seg_idx, report) of segments (chapter_idx, seg_idx) that the source does not have; places outside the script have no rows."""
    rows = found.select("chapter_idx", "seg_idx").distinct().join(segments.select("chapter_idx", "seg_idx", "speaker", "text"), ["chapter_idx", "seg_idx"])
    head = F.concat(F.lit("[hallucinated #"), F.col("seg_idx").cast("string"), F.lit("] "), F.coalesce("speaker", F.lit("")), F.lit(': "'), X.truncate(F.coalesce("text", F.lit("")), 60), F.lit('"'))
    return rows.select("chapter_idx", "seg_idx", F.concat_ws("\n", head, F.lit("  no matching text found in source")).alias("report"))


def validation_report(found: DataFrame, segments: DataFrame) -> DataFrame:
    """(chapter_idx, report): all that `validate_scripts` found in a chapter, missing fragments first, then made-up segments."""
    missing = reviews.missing_report(found.where("kind = 'missing'").select("chapter_idx", "seg_idx", "offset", "text", "line"), segments)
    invented = hallucinated_report(found.where("kind = 'hallucinated'"), segments)
    parts = missing.select("chapter_idx", F.lit(0).alias("kind"), "seg_idx", "offset", "report").unionByName(invented.select("chapter_idx", F.lit(1).alias("kind"), "seg_idx", F.lit(0).cast("long").alias("offset"), "report"))
    listed = F.array_sort(F.collect_list(F.struct("kind", "seg_idx", "offset", "report")))
    return parts.groupBy("chapter_idx").agg(F.array_join(listed["report"], "\n").alias("report"))


def _numbered(entries: DataFrame) -> DataFrame:
    """Entries (book_id, ordinal, ...) with their number and how many a book has."""
    order = Window.partitionBy("book_id").orderBy("ordinal", "kind", "reason")
    total = entries.groupBy("book_id").agg(F.count(F.lit(1)).alias("total"))
    return entries.withColumn("number", F.row_number().over(order)).join(total, "book_id")


def _or_mark(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("?"))


def _or_nothing(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def _count(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(0)).cast("string")


def _heads() -> tuple[Column, Column]:
    """The number of an entry and its kind, alone and with its place."""
    number = F.concat(F.lit("["), F.col("number").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit("] ("), F.coalesce("kind", F.lit("flag")), F.lit(") "))
    place = F.concat(F.coalesce("chapter", F.lit("None")), F.lit(" seg "), F.coalesce(F.col("segment").cast("string"), F.lit("None")))
    return number, F.concat(number, place)


def audit_summaries(entries: DataFrame) -> DataFrame:
    """(book_id, ordinal, summary): a line for each entry (book_id, ordinal, kind, chapter, segment, reason, suggested, batch, missing, hallucinated, field, before, after, into, sources); suggested tells whether there is a suggestion."""
    number, head = _heads()
    kind = F.coalesce("kind", F.lit("flag"))
    line = (
        F.when(kind == "cast_merge", F.concat(number, F.array_join("sources", ", "), F.lit(" -> "), _or_nothing("into")))
        .when(kind == "flag", F.concat(head, F.when(F.col("suggested"), " [+suggestion]").otherwise(""), F.lit(": "), _or_nothing("reason")))
        .when(kind == "validation", F.concat(head, F.lit(": batch "), _or_mark("batch"), F.lit(" rejected ("), _count("missing"), F.lit(" missing, "), _count("hallucinated"), F.lit(" hallucinated)")))
        .when(kind == "hallucination", F.concat(head, F.lit(": LLM tried to rewrite text")))
        .otherwise(F.concat(head, F.lit(": "), _or_mark("field"), F.lit(" "), quoted(_or_nothing("before")), F.lit(" -> "), quoted(_or_nothing("after"))))
    )
    return _numbered(entries).select("book_id", "ordinal", line.alias("summary"))


def _listed(name: str) -> Column:
    """A suggestion or a segment as indented JSON behind bars; null where there is none."""
    fields = ("speaker", "instruction", "text")
    # an array of one string is that string in brackets
    shown = [F.when(F.col(f"{name}.{f}").isNotNull(), F.concat(F.lit(f'  |   "{f}": '), F.expr(f"substring(to_json(array({name}.{f})), 2, length(to_json(array({name}.{f}))) - 2)"))) for f in fields]
    body = F.array_join(F.array_compact(F.array(*shown)), ",\n")
    return F.when(F.col(name).isNotNull(), F.concat(F.lit("  | {\n"), body, F.lit("\n  | }")))


def audit_texts(entries: DataFrame) -> DataFrame:
    """(book_id, ordinal, shown): each entry as a reviewer reads it.

    entries have the columns of `audit_summaries` (suggested and current as structs of speaker, instruction and text), and chunk,
    skipped, missing_text, attempted_text, text, context. At most three missing texts are shown.
    """
    number, head = _heads()
    kind = F.coalesce("kind", F.lit("flag"))
    part = lambda label, column: F.when(_or_nothing(column) != "", F.concat(F.lit(label), F.col(column)))
    merge = F.concat_ws(
        "\n", F.concat(number, F.lit("batch "), _or_mark("batch"), F.lit(" chunk "), _or_mark("chunk")), F.concat(F.lit("  into: "), _or_nothing("into")), F.concat(F.lit("  from: "), F.array_join("sources", ", ")),
        F.when(F.size("skipped") > 0, F.concat(F.lit("  skipped: "), F.array_join("skipped", ", "))), part("  reason: ", "reason"),
    )
    what = (
        F.when(kind == "flag", F.concat(F.lit("  reason: "), _or_nothing("reason")))
        .when(kind == "edit", F.concat(F.lit("  "), _or_mark("field"), F.lit(": "), quoted(_or_nothing("before")), F.lit(" -> "), quoted(_or_nothing("after"))))
        .when(kind == "validation", F.concat_ws("\n", F.concat(F.lit("  batch "), _or_mark("batch"), F.lit(" rejected: "), _count("missing"), F.lit(" missing, "), _count("hallucinated"), F.lit(" hallucinated")), F.transform(F.slice("missing_text", 1, 3), lambda t: F.concat(F.lit("    missing: "), X.truncate(t)))))
        .when(kind == "hallucination", F.concat_ws("\n", F.concat(F.lit("  reason: "), _or_nothing("reason")), part("  attempted_text: ", "attempted_text")))
    )
    current, suggested = _listed("current"), _listed("suggested")
    lines = F.transform(F.split("context", "\r\n|\n|\r", -1), lambda x: F.concat(F.lit("  | "), x))
    context = F.when(_or_nothing("context") != "", F.concat_ws("\n", F.lit("  --- source context ---"), lines, F.lit("  --- end source context ---")))
    shown = F.concat_ws("\n", head, what, part("  text: ", "text"), F.when(suggested.isNotNull() & current.isNotNull(), F.concat(F.lit("  current:\n"), current)), F.when(suggested.isNotNull(), F.concat(F.lit("  suggested:\n"), suggested)), context)
    return _numbered(entries).select("book_id", "ordinal", F.concat(F.lit("\n"), F.when(kind == "cast_merge", merge).otherwise(shown)).alias("shown"))


def refusals(audit: DataFrame, chapters: DataFrame) -> DataFrame:
    """(chapter_idx, n_flags, refused) of the chapters asked for: work on a chapter with open flags is refused."""
    open_flags = incremental.unresolved_flags(audit, chapters).withColumnRenamed("n", "n_flags")
    rows = chapters.select("chapter_idx").distinct().join(open_flags, "chapter_idx", "left").fillna(0, ["n_flags"])
    return rows.withColumn("refused", F.col("n_flags") > 0)


class OpenFlags(RuntimeError):
    """Work was refused because reviewers left flags open."""


def refuse_open_flags(audit: DataFrame, chapters: DataFrame, ignore: bool = False) -> int:
    """The number of open flags of the chapters; raises if there are any, unless they are to be ignored."""
    n = refusals(audit, chapters).agg(F.sum("n_flags")).first()[0] or 0
    if n and not ignore:
        raise OpenFlags(f"{n} unresolved review flag(s)")
    return n
