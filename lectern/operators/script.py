"""Scripts: islands, neighbours, positional lookups, review patches and set-based edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions.constants import EMOTIONS, RETAINED_SPEAKERS


def _order() -> WindowSpec:
    return Window.partitionBy("chapter_idx").orderBy("seg_idx")


def speaker_islands(segments: DataFrame, blank: str | None = None) -> DataFrame:
    """Adjacent segments of one speaker as one; where there are instructions, the first segment's is kept.

    The texts are joined by single spaces, each without white space at its ends (or without characters of the class blank).
    """
    text = X.stripped(F.col("text")) if blank is None else X.stripped_of(F.col("text"), blank)
    new = F.when(F.lag("speaker").over(_order()) == F.col("speaker"), 0).otherwise(1)
    island = segments.withColumn("new", new).withColumn("island", F.sum("new").over(_order().rowsBetween(Window.unboundedPreceding, 0)) - 1)
    first = [F.min_by("instruction", "seg_idx").alias("instruction")] * ("instruction" in segments.columns)
    g = island.groupBy("chapter_idx", "island").agg(F.first("speaker").alias("speaker"), F.count(F.lit(1)).alias("n_segments"), F.sort_array(F.collect_list(F.struct("seg_idx", text.alias("t")))).alias("t"), *first)
    return g.select("chapter_idx", F.col("island").alias("seg_idx"), "speaker", "n_segments", F.array_join("t.t", " ").alias("text"), *["instruction"] * len(first))


def neighbours(segments: DataFrame, before: int, after: int) -> DataFrame:
    """Each segment with the texts around it, as far as there are any."""
    frame = _order().rowsBetween(-before, after)
    return segments.withColumn("context", F.array_join(F.collect_list(F.concat("speaker", F.lit(": "), "text")).over(frame), "\n"))


def fold_wordless(segments: DataFrame) -> DataFrame:
    """Segments without words joined to a neighbour of the same speaker: the next one with words, else the one before, else they stay as one.

    Within a run of one speaker a segment belongs to as many segments with words as stand before it, the last ones to the last
    of those; the text of all that belong together is joined in order, and has the place of the one with words (of the last one
    where none has any). A null text is empty, a null speaker equals itself; rows that repeat a place keep the order of their texts.
    """
    order = Window.partitionBy("chapter_idx").orderBy("seg_idx", "text")
    before = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = segments.select("chapter_idx", "seg_idx", "speaker", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("worded", X.is_speakable(F.col("text")).cast("int"))
    first = F.row_number().over(order) == 1
    rows = rows.withColumn("run", F.sum(F.when(first | ~F.lag("speaker").over(order).eqNullSafe(F.col("speaker")), 1).otherwise(0)).over(before))
    run = Window.partitionBy("chapter_idx", "run")
    seen = F.sum("worded").over(run.orderBy("seg_idx", "text").rowsBetween(Window.unboundedPreceding, 0)) - F.col("worded")
    rows = rows.withColumn("part", F.greatest(F.lit(0), F.least(seen, F.sum("worded").over(run) - 1)))
    said = F.array_sort(F.collect_list(F.struct("seg_idx", "text")))
    place = F.coalesce(F.max(F.when(F.col("worded") == 1, F.col("seg_idx"))), F.max("seg_idx"))
    parts = rows.groupBy("chapter_idx", "run", "part").agg(place.alias("seg_idx"), F.first("speaker").alias("speaker"), F.array_join(said["text"], "").alias("text"))
    return parts.select("chapter_idx", "seg_idx", "speaker", "text")


def at_position(segments: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (chapter_idx, seg_idx, ...) with the segment there, null outside the script."""
    return asked.join(segments.select("chapter_idx", "seg_idx", F.col("speaker").alias("at_speaker"), F.col("text").alias("at_text")), ["chapter_idx", "seg_idx"], "left")


def audit_positions(entries: DataFrame, segments: DataFrame) -> DataFrame:
    """entries (entry_id, chapter_idx, seg_idx, text) with current_idx: the same place and text, else the only segment with the text, else the place if the script has it."""
    here = segments.select("chapter_idx", "seg_idx", F.col("text").alias("here"))
    unique = segments.groupBy("chapter_idx", "text").agg(F.count(F.lit(1)).alias("n"), F.min("seg_idx").alias("only")).where("n = 1").drop("n")
    e = entries.join(here, ["chapter_idx", "seg_idx"], "left").join(unique, ["chapter_idx", "text"], "left")
    return e.select("entry_id", "chapter_idx", "seg_idx", F.when(F.col("here") == F.col("text"), F.col("seg_idx")).otherwise(F.coalesce("only", F.when(F.col("here").isNotNull(), F.col("seg_idx")))).alias("current_idx"))


def apply_review(segments: DataFrame, changes: DataFrame) -> DataFrame:
    """Segments (chapter_idx, seg_idx, speaker, text, instruction) with sparse changes (…, ordinal, speaker, instruction, text): the last change of a segment counts, text never changes, retained segments stay so, unknown styles are ignored.

    Adds text_mutation, invalid_instruction and retained_edit, what was tried and ignored.
    """
    last = changes.groupBy("chapter_idx", "seg_idx").agg(F.max_by(F.struct("speaker", "instruction", "text"), "ordinal").alias("c"))
    retained = lambda c: c.isin(*RETAINED_SPEAKERS)
    p = segments.join(last, ["chapter_idx", "seg_idx"], "left")
    speaker = F.coalesce(F.nullif(F.col("c.speaker"), F.lit("")), F.col("speaker"))
    voiced = retained(F.col("speaker")) & ~retained(speaker)
    wanted = F.coalesce("c.instruction", "instruction")
    invalid = (wanted != "") & ~wanted.isin(*EMOTIONS)
    return p.select(
        "chapter_idx", "seg_idx", F.when(voiced, F.col("speaker")).otherwise(speaker).alias("speaker"), "text", F.when(invalid, F.col("instruction")).otherwise(wanted).alias("instruction"),
        F.when(X.stripped(F.col("c.text")) != X.stripped(F.col("text")), F.col("c.text")).alias("text_mutation"), F.when(invalid & F.col("c.instruction").isNotNull(), wanted).alias("invalid_instruction"), F.when(voiced, speaker).alias("retained_edit"),
    )


def without(segments: DataFrame, dropped: DataFrame) -> DataFrame:
    """Segments without the listed places (chapter_idx, seg_idx), numbered anew."""
    left = segments.join(dropped, ["chapter_idx", "seg_idx"], "left_anti")
    return left.withColumn("seg_idx", (F.row_number().over(_order()) - 1).cast("long"))


def inserted(segments: DataFrame, pieces: DataFrame) -> DataFrame:
    """Segments with pieces (chapter_idx, before, speaker, text) put in front of the places they name, numbered anew."""
    keep = segments.select("chapter_idx", F.col("seg_idx").alias("place"), F.lit(1).alias("after"), F.lit(0).cast("long").alias("ordinal"), "speaker", "text")
    new = pieces.select("chapter_idx", F.col("before").alias("place"), F.lit(0).alias("after"), F.col("ordinal").cast("long").alias("ordinal"), "speaker", "text")
    order = Window.partitionBy("chapter_idx").orderBy("place", "after", "ordinal")
    return keep.unionByName(new).select("chapter_idx", (F.row_number().over(order) - 1).cast("long").alias("seg_idx"), "speaker", "text")


def split_is_faithful(parts: Column, text: Column) -> Column:
    """Whether two or more parts say exactly the text, white space aside."""
    return (F.size(parts) >= 2) & (X.without_space(F.array_join(parts, "")) == X.without_space(text))
