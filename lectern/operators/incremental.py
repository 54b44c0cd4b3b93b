"""Content-hash increments: freshness, deduplicated tasks, fingerprints, prefixes and audit replacement.

Defined results: a key or hash that is null equals none, so such a row is stale and never cached; rows that repeat a
key keep their number in `stale` and are one in `upsert_state` and `pending_tasks` (all null hashes are one task
there); a chapter without a count of waiting tasks does not wait; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def content_hash(*parts: Column) -> Column:
    """An id of content: parts joined by a control character; null counts as empty."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def stale(current: DataFrame, state: DataFrame) -> DataFrame:
    """Rows of current (key, hash, ...) that state (key, hash, done) does not hold as done with the same hash."""
    return current.join(state.where("done").select("key", "hash"), ["key", "hash"], "left_anti")


def upsert_state(state: DataFrame, updates: DataFrame) -> DataFrame:
    """The newest row per key (key, hash, done, version)."""
    newest = F.max_by(F.struct("hash", "done"), "version")
    return state.unionByName(updates).groupBy("key").agg(newest.alias("s"), F.max("version").alias("version")).select("key", "s.*", "version")


def pending_tasks(tasks: DataFrame, cached: DataFrame, order: list[str]) -> DataFrame:
    """The first task of every hash that is not in the cache; tasks (hash, order columns, ...)."""
    others = [c for c in tasks.columns if c != "hash"]
    first = tasks.groupBy("hash").agg(F.min_by(F.struct(*others), F.struct(*order)).alias("t")).select("hash", "t.*")
    return first.join(cached, "hash", "left_anti")


def chapter_fingerprint(segments: DataFrame) -> DataFrame:
    """(chapter_idx, fingerprint): of the ordered hashes and sound digests, of the hashes alone if a digest is missing."""
    g = segments.groupBy("chapter_idx").agg(F.sort_array(F.collect_list(F.struct("pos", "hash", "sha"))).alias("s"))
    whole = F.array_join(F.transform("s", lambda x: F.concat(x["hash"], F.lit(":"), x["sha"])), "|")
    hashes = F.array_join(F.transform("s", lambda x: x["hash"]), "|")
    return g.select("chapter_idx", F.sha2(F.when(F.exists("s", lambda x: x["sha"].isNull()), hashes).otherwise(whole), 256).alias("fingerprint"))


def ready_prefix(chapters: DataFrame, book: str = "book_id") -> DataFrame:
    """Chapters (book, chapter_idx, n_pending) before the first one that still waits."""
    first = chapters.where("n_pending > 0").groupBy(book).agg(F.min("chapter_idx").alias("first_open"))
    return chapters.join(first, book, "left").where(F.col("first_open").isNull() | (F.col("chapter_idx") < F.col("first_open"))).drop("first_open")


def voice_batches(tasks: DataFrame, size: int) -> DataFrame:
    """Batches within a voice (voice, needed, chapter_idx, ordinal): needed tasks first, then by chapter and order."""
    rank = F.row_number().over(Window.partitionBy("voice").orderBy(F.col("needed").desc(), "chapter_idx", "ordinal"))
    return tasks.withColumn("batch", F.floor((rank - 1) / size).cast("long"))


def fixed_batches(rows: DataFrame, keys: list[str], order: list[str], size: int) -> DataFrame:
    return rows.withColumn("batch", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1) / size).cast("long"))


def replace_reviewed(audit: DataFrame, fresh: DataFrame, reviewed: DataFrame, phase: str = "review") -> DataFrame:
    """Audit rows with the phase's rows of the reviewed chapters replaced."""
    gone = reviewed.select("chapter_idx").distinct().withColumn("phase", F.lit(phase))
    return audit.join(gone, ["chapter_idx", "phase"], "left_anti").unionByName(fresh, allowMissingColumns=True)


def unresolved_flags(audit: DataFrame, chapters: DataFrame) -> DataFrame:
    """(chapter_idx, n): open flags of the chapters asked for."""
    return audit.where("kind = 'flag'").join(chapters, "chapter_idx", "left_semi").groupBy("chapter_idx").agg(F.count(F.lit(1)).alias("n"))


def undismissed(flags: DataFrame, segments: DataFrame) -> DataFrame:
    """Flags (chapter_idx, seg_idx, suggested_speaker, suggested_instruction) whose suggestion differs from the segment; a field without a suggestion is equal."""
    cur = segments.select("chapter_idx", "seg_idx", F.col("speaker").alias("cur_speaker"), F.col("instruction").alias("cur_instruction"))
    same = (F.coalesce("suggested_speaker", "cur_speaker").eqNullSafe(F.col("cur_speaker"))) & (F.coalesce("suggested_instruction", "cur_instruction").eqNullSafe(F.col("cur_instruction")))
    none = F.col("suggested_speaker").isNull() & F.col("suggested_instruction").isNull()
    return flags.join(cur, ["chapter_idx", "seg_idx"], "left").where(none | ~same).drop("cur_speaker", "cur_instruction")
