"""Paths of what phases write, clean-up, configuration, package manifests, and subtitles from saved manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.operators import timing
from lectern.sources import workdir

#: Phases that keep a cache of segments, and the folder of it.
CACHING_PHASES = ("perform", "synthesize")
SEGMENTS = "segments"


def segment_path(folder: Column, phase: Column, segment_hash: Column) -> Column:
    return F.concat_ws("/", folder, phase, F.lit(SEGMENTS), F.concat(segment_hash, F.lit(".wav")))


#: Folders of phases and names of files in a work folder.
REJECTED, PRESETS = "rejected", "presets"
AUDIT_FILE, VOICES_FILE, CAST_FILE, STATE_FILE, METADATA_FILE, COVER_FILE = "audit.json", "voices.json", "characters.json", "state.json", "metadata.json", "cover.jpg"


def _joined(*parts: Column | str) -> Column:
    return F.concat_ws("/", *(F.lit(p) if isinstance(p, str) else p for p in parts))


def phase_folder(folder: Column, phase: Column) -> Column:
    return _joined(folder, phase)


def segments_folder(folder: Column, phase: Column) -> Column:
    """The cache of a phase's segments."""
    return _joined(folder, phase, SEGMENTS)


def segments_beside(sound: Column) -> Column:
    """The cache that a chapter's sound was put together from: it stands beside the sound."""
    above = F.regexp_extract(sound, "^(.*)/[^/]*$", 1)
    return F.when(F.contains(sound, F.lit("/")), _joined(above, SEGMENTS)).otherwise(SEGMENTS)


def rejects_folder(folder: Column, phase: Column) -> Column:
    """Where a phase keeps the takes that it threw out."""
    return _joined(folder, phase, REJECTED)


def preview_path(folder: Column, name: Column, voice: Column) -> Column:
    """The sound of a member in a voice that was tried for it."""
    return _joined(folder, "audition", PRESETS, F.concat(name, F.lit("__"), voice, F.lit(".wav")))


def file_paths(folder: Column) -> dict[str, Column]:
    """Files that a work folder has once, by what they hold."""
    return {"audit": _joined(folder, "audit", AUDIT_FILE), "voices": _joined(folder, "audition", VOICES_FILE), "cast": _joined(folder, "cast", CAST_FILE), "metadata": _joined(folder, "extract", METADATA_FILE), "cover": _joined(folder, "extract", COVER_FILE)}


def state_path(folder: Column, phase: Column) -> Column:
    return _joined(folder, phase, STATE_FILE)


def work_folder(book: Column, wanted: Column) -> Column:
    """The folder of a book's work: the one that is wanted, else one beside the book that has its name."""
    beside = F.concat(F.regexp_replace(book, r"(?<=[^/])\.[^./]*$", ""), F.lit("_output"))
    return F.coalesce(F.nullif(wanted, F.lit("")), beside)


def wide_subtitle_path(sound: Column) -> Column:
    """The sound's name with the ending of web subtitles."""
    return F.concat(F.regexp_replace(sound, r"\.[^./]*$", ""), F.lit(".vtt"))


def cached(tasks: DataFrame, files: DataFrame) -> DataFrame:
    """Tasks (folder, phase, hash, ...) with cached: whether the cache of the phase has the segment among the files (path)."""
    there = files.select(F.col("path").alias("_path")).distinct().withColumn("cached", F.lit(True))
    at = tasks.withColumn("_path", segment_path(F.col("folder"), F.col("phase"), F.col("hash")))
    return at.join(there, "_path", "left").withColumn("cached", F.coalesce("cached", F.lit(False))).drop("_path")


def manifest_path(sound: Column) -> Column:
    """Where the timing of a chapter's sound is kept."""
    return F.concat(sound, F.lit(".timing.json"))


def subtitle_path(sound: Column) -> Column:
    """The sound's name with the ending of subtitles."""
    return F.concat(F.regexp_replace(sound, r"\.[^./]*$", ""), F.lit(".srt"))


def cleanable(files: DataFrame) -> DataFrame:
    """Files (book_id, path) that are in a cache of segments: what a clean-up removes, and a dry run lists."""
    return files.where(F.col("path").rlike(rf"(^|/)({'|'.join(CACHING_PHASES)})/{SEGMENTS}/[^/]+$"))


def resolved_config(layers: DataFrame, order: list[str]) -> DataFrame:
    """(job, key, value, layer): each key from the first layer in order that sets it; empty values set nothing. layers (job, layer, key, value)."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("layer"))
    rows = layers.where((rank > 0) & (F.coalesce("value", F.lit("")) != ""))
    first = F.min_by(F.struct("value", "layer"), F.struct(rank, "value")).alias("x")
    return rows.groupBy("job", "key").agg(first).select("job", "key", "x.value", "x.layer")


def manifest_items(packages: DataFrame) -> DataFrame:
    """(book_id, ordinal, item_id, href) of the manifests in package documents (book_id, content); a null document has none."""
    item = "//*[local-name()='manifest']/*[local-name()='item' and @id and @href]"
    pairs = F.arrays_zip(F.xpath("content", F.lit(f"{item}/@id")).alias("id"), F.xpath("content", F.lit(f"{item}/@href")).alias("href"))
    rows = packages.where("content is not null").select("book_id", F.posexplode(pairs).alias("ordinal", "x"))
    return rows.select("book_id", F.col("ordinal").cast("long").alias("ordinal"), F.col("x.id").alias("item_id"), F.col("x.href").alias("href"))


def timing_files(timed: DataFrame) -> DataFrame:
    """(chapter_idx, content): timing manifests as they are saved, of timed chunks (chapter_idx, seg_idx, hash, start_s, end_s, script_idx, speaker, text)."""
    item = F.struct("hash", "start_s", "end_s", "script_idx", "speaker", "text")
    listed = timed.groupBy("chapter_idx").agg(F.array_sort(F.collect_list(F.struct(F.col("seg_idx").alias("at"), item.alias("x"))))["x"].alias("chunks"))
    return listed.select("chapter_idx", F.to_json(F.struct("chunks")).alias("content"))


def subtitles_of_manifests(files: DataFrame) -> DataFrame:
    """(chapter_idx, srt) of saved timing manifests (path, content), the path as chapter; a manifest without chunks has none."""
    rows = workdir.chunk_rows(files).select(F.col("path").alias("chapter_idx"), F.col("place").alias("seg_idx"), "start_s", "end_s", "speaker", "text")
    return timing.srt_text(timing.cues(rows))
