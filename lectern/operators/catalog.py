"""Chapter listings, metadata, voices, reports and quarantine rows.

Defined results: metadata that is null or no JSON has no chapters; a name without a number has a null one; a model that is null
or unknown has no voices; a null text has no lyrics; empty tables give empty results; rows that repeat give repeated
rows, except in listings of files and in phases, where they are one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as X


def list_chapters(metadata: DataFrame, files: DataFrame, wanted: list[int] | None, target: str) -> DataFrame:
    """Chapters (chapter_idx, base) whose source file (base) exists, those wanted (none given: all), with the path to write."""
    rows = metadata.join(files.select("base").distinct(), "base", "left_semi")
    if wanted:
        rows = rows.where(F.col("chapter_idx").isin(*wanted))
    return rows.withColumn("target", F.concat("base", F.lit(target)))


def chapter_number(name: Column) -> Column:
    """The number before the first underscore; null if there is none."""
    return F.split_part(name, F.lit("_"), F.lit(1)).try_cast("int")


def metadata_rows(df: DataFrame, content: str) -> DataFrame:
    """Chapters of metadata JSON of any age: missing file names are made from number and title, missing references are empty."""
    chapter = "struct<index:int,title:string,filename_base:string,href:string>"
    parsed = df.withColumn("m", F.from_json(content, f"struct<title:string,author:string,language:string,chapters:array<{chapter}>>"))
    rows = parsed.select(*[c for c in df.columns if c != content], F.coalesce("m.title", F.lit("")).alias("book"), F.coalesce("m.author", F.lit("Unknown")).alias("author"), F.coalesce("m.language", F.lit("en")).alias("language"), F.explode("m.chapters").alias("c"))
    title = F.coalesce("c.title", F.concat(F.lit("Chapter "), F.col("c.index").cast("string")))
    base = F.coalesce("c.filename_base", X.filename_base(F.col("c.index"), title))
    return rows.select(*[c for c in rows.columns if c != "c"], F.col("c.index").cast("long").alias("chapter_idx"), title.alias("title"), base.alias("base"), F.coalesce("c.href", F.lit("")).alias("href"))


def known_voices(models: DataFrame, table: dict[str, list[str]]) -> DataFrame:
    """models (model) with the voices of the first table entry whose name the model's contains; none otherwise. The table is small and fixed."""
    voices = F.coalesce(*(F.when(F.lower("model").contains(part), F.array(*map(F.lit, names))) for part, names in table.items()), F.array().cast("array<string>"))
    return models.withColumn("voices", voices)


def speech_body(text: Column, instruct: Column, inline: bool) -> Column:
    """What is sent to be spoken: the direction in brackets before the text, where the service has no field for it."""
    return F.when(F.coalesce(instruct, F.lit("")) != "", F.concat(F.lit("["), instruct, F.lit("] "), text)).otherwise(text) if inline else text


def synced_lyrics(timed: DataFrame) -> DataFrame:
    """(chapter_idx, seg_idx, body, start_ms) of the segments with text."""
    body = X.stripped(F.coalesce("text", F.lit("")))
    return timed.where(body != "").select("chapter_idx", "seg_idx", body.alias("body"), F.greatest(F.bround(F.col("start_s") * 1000), F.lit(0.0)).cast("long").alias("start_ms"))


def location_report(located: DataFrame) -> Column:
    """One line for a looked-up segment."""
    return F.concat(F.lit("segment "), F.col("seg_idx").cast("string"), F.lit(" ["), X.format_ts(F.col("start_s"), "."), F.lit(" - "), X.format_ts(F.col("end_s"), "."), F.lit("] "), F.coalesce(F.concat("speaker", F.lit(": ")), F.lit("")), X.truncate(F.col("text"), 40))


def rejects(metrics: DataFrame, label: Column) -> DataFrame:
    """Quarantine rows of faulty segments (categories not empty) under a safe label."""
    return metrics.where(F.size("categories") > 0).withColumn("label", X.safe_label(label)).withColumn("reason", F.array_join("categories", "+"))


def narrator_first(cast: DataFrame) -> DataFrame:
    """Cast rows (book_id, name, ordinal) with their place: the narrator first, the others as they came."""
    order = Window.partitionBy("book_id").orderBy((F.lower("name") != "narrator").cast("int"), "ordinal")
    return cast.withColumn("place", (F.row_number().over(order) - 1).cast("long"))


def redo_phase(files: DataFrame, phases: list[str]) -> DataFrame:
    """(book_id, phase): the last phase that has any file."""
    rank = F.array_position(F.array(*map(F.lit, phases)), F.col("phase"))
    return files.where(rank > 0).groupBy("book_id").agg(F.max_by("phase", rank).alias("phase"))


def restamped(current: DataFrame, artifacts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """State rows (key, hash, done) of current (key, hash) whose artifact exists, and the keys without one."""
    there = current.join(artifacts.select("key").distinct(), "key", "left_semi").select("key", "hash", F.lit(True).alias("done"))
    return there, current.join(artifacts.select("key").distinct(), "key", "left_anti").select("key")
