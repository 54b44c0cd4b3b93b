"""Running offsets, cues, interval lookup and read-along pars over ordered segments.

Defined results: a null size or duration moves nothing and has no pause behind it, and its own end is null; cues
without text are left out, a null speaker is not named; times outside all segments are found nowhere; rows that repeat
a place come in any order, so places must differ within a group; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions.constants import PARAGRAPH_PAUSE_MS
from lectern.functions.folds import fold_list, rows_of


def running_start(size: Column, gap: float, keys: list[str], order: list[str]) -> Column:
    """Sum of the earlier sizes of a group, with a gap after each."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(size + F.lit(gap)).over(w), F.lit(0) if isinstance(gap, int) else F.lit(0.0))


def with_running_start(rows: DataFrame, name: str, size: Column, gap: float, key: str, order: str, width: int = 65_536) -> DataFrame:
    """Rows with the sum of the earlier sizes of their group, for groups too large to be sorted by one task.

    order is a whole number; a group is summed in blocks of `width` numbers, and the blocks' totals are summed after that.
    """
    block, before = f"{name}_block", f"{name}_before"
    sized = rows.withColumn(block, F.floor(F.col(order) / width))
    sums = sized.groupBy(key, block).agg(F.sum(size + F.lit(gap)).alias(before))
    earlier = Window.partitionBy(key).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(key, block, F.coalesce(F.sum(before).over(earlier), F.lit(0)).alias(before))
    inner = running_start(size, gap, [key, block], [order])
    return sized.withColumn(name, inner).join(starts, [key, block]).withColumn(name, F.col(name) + F.col(before)).drop(block, before)


def timing_manifest(chunks: DataFrame, pause_ms: int = PARAGRAPH_PAUSE_MS) -> DataFrame:
    """chunks (chapter_idx, seg_idx, duration_s, ...) with start_s and end_s; no pause after the last."""
    start = running_start(F.col("duration_s"), pause_ms / 1000, ["chapter_idx"], ["seg_idx"])
    return chunks.withColumn("start_s", start).withColumn("end_s", F.col("start_s") + F.col("duration_s"))


#: Places of a chapter that are clamped together.
CUE_BLOCK = 4_096
#: Seconds that a cue lasts at least.
LEAST_CUE = 0.001
_CUE = "struct<start_s:double,end_s:double,body:string>"


def _clamped(prev: Column, c: Column) -> Column:
    """A cue behind the end of the last."""
    end = F.when(c["end_s"] <= c["start_s"], c["start_s"] + LEAST_CUE).otherwise(c["end_s"])
    late = c["start_s"] < prev
    start = F.when(late, prev).otherwise(c["start_s"])
    end = F.when(late & (end <= start), start + LEAST_CUE).otherwise(end)
    return F.struct(start.alias("start_s"), end.alias("end_s"), c["body"].alias("body"))


def _summary(cues_: Column) -> Column:
    """What a block of cues does to the end before it, p: from `bound` on it is p plus `n` least cues, below it is `fixed`.

    A cue that ends at e makes of p the greater of e and a least cue more than p, so the cues of a block need p to be so far
    on that none of them is reached; else the last one that is decides, whatever p was. A cue without an end forgets p.
    """

    def step(s: Column, c: Column) -> Column:
        end = F.when(c["end_s"] <= c["start_s"], c["start_s"] + LEAST_CUE).otherwise(c["end_s"])
        open_end = end.isNull() | c["start_s"].isNull()
        bound = F.when(open_end, F.lit(float("inf"))).otherwise(F.greatest(s["bound"], end - s["n"] * LEAST_CUE))
        fixed = F.when(open_end, F.coalesce(end, F.lit(-1.0))).when(s["fixed"] < end, end).otherwise(s["fixed"] + LEAST_CUE)
        return F.struct(bound.alias("bound"), fixed.alias("fixed"), (s["n"] + 1).alias("n"))

    low = F.lit(float("-inf"))
    return F.aggregate(cues_, F.struct(low.alias("bound"), low.alias("fixed"), F.lit(0).alias("n")), step)


def cues(timed: DataFrame) -> DataFrame:
    """Subtitle cues of each chapter: blank texts skipped, numbered after that, no cue empty or before the end of the last.

    The clamp depends on the end that was emitted before. It is a scan: blocks of places are summed up by what they do to that
    end, the summaries of a chapter are passed through in order, and each block is then clamped from the end that it finds.
    """
    body = X.stripped(F.coalesce("text", F.lit("")))
    body = F.when(body != "", F.when(F.coalesce("speaker", F.lit("")) != "", F.concat(F.lit("["), "speaker", F.lit("] "), body)).otherwise(body))
    rows = timed.withColumn("body", body).where("body is not null").withColumn("block", F.floor(F.col("seg_idx") / CUE_BLOCK))
    blocks = rows.groupBy("chapter_idx", "block").agg(F.array_sort(F.collect_list(F.struct("seg_idx", "start_s", "end_s", "body"))).alias("c"))
    blocks = blocks.select("chapter_idx", "block", "c", _summary(F.col("c")).alias("s"))

    def through(state: Column, b: Column) -> tuple[Column, Column]:
        end = F.when(state["end"] < b["bound"], b["fixed"]).otherwise(state["end"] + b["n"] * LEAST_CUE)
        return F.struct(end.alias("end"), (state["n"] + b["n"]).alias("n")), F.struct(b["block"].alias("block"), state["end"].alias("end"), state["n"].alias("n"))

    listed = blocks.groupBy("chapter_idx").agg(F.array_sort(F.collect_list(F.struct("block", "s.bound", "s.fixed", "s.n"))).alias("bs"))
    start = F.struct(F.lit(-1.0).alias("end"), F.lit(0).cast("long").alias("n"))
    found = rows_of(listed, ["chapter_idx"], fold_list(F.col("bs"), start, through, "struct<block:bigint,end:double,n:bigint>")["made"], "k", "b")
    placed = blocks.select("chapter_idx", "block", "c").join(found.select("chapter_idx", F.col("b.block").alias("block"), F.col("b.end").alias("end"), F.col("b.n").alias("n")), ["chapter_idx", "block"])

    def one(prev: Column, c: Column) -> tuple[Column, Column]:
        cue = _clamped(prev, c)
        return cue["end_s"], cue

    clamped = rows_of(placed, ["chapter_idx", "n"], fold_list(F.col("c"), F.col("end"), one, _CUE)["made"], "pos", "cue")
    return clamped.select("chapter_idx", (F.col("n") + F.col("pos") + 1).cast("long").alias("cue_idx"), F.col("cue.start_s").alias("start_s"), F.col("cue.end_s").alias("end_s"), F.col("cue.body").alias("body"))


def srt_text(cue_rows: DataFrame) -> DataFrame:
    """One subtitle file per chapter."""
    block = F.concat(F.col("cue_idx").cast("string"), F.lit("\r\n"), X.format_ts(F.col("start_s")), F.lit(" --> "), X.format_ts(F.col("end_s")), F.lit("\r\n"), "body", F.lit("\r\n\r\n"))
    files = cue_rows.groupBy("chapter_idx").agg(F.sort_array(F.collect_list(F.struct("cue_idx", block.alias("block")))).alias("b"))
    return files.select("chapter_idx", F.array_join("b.block", "").alias("srt"))


def locate(times: DataFrame, timed: DataFrame) -> DataFrame:
    """The first chunk of a chapter that ends at or after a time; a time in a pause belongs to the next chunk.

    times (probe_id, chapter_idx, t); times outside the chapter have no row. Each chunk owns the interval from
    the end of the one before it, so the lookup is an equi-join on the chapter with a range condition.
    """
    w = Window.partitionBy("chapter_idx").orderBy("end_s", "seg_idx")
    owned = timed.withColumn("after_s", F.coalesce(F.lag("end_s").over(w), F.lit(-1e-300)))
    hit = (F.col("t") > F.col("after_s")) & (F.col("t") <= F.col("end_s")) & (F.col("t") >= 0)
    return times.join(owned, "chapter_idx").where(hit)


def interval_overlaps(spans: DataFrame, bounds: DataFrame, key: str, bin_size: int = 1000) -> DataFrame:
    """Pieces of spans (key, span_idx, start, end) in the bounds (key, para_idx, start_char, end_char) they overlap, with shares.

    Both sides are put into bins of positions, and the pair is reported from the bin in which the overlap begins.
    """
    s = spans.withColumn("bin", F.explode(F.sequence(F.floor(F.col("start") / bin_size), F.floor((F.col("end") - 1) / bin_size)))).where("end > start")
    b = bounds.where("end_char > start_char").withColumn("bin", F.explode(F.sequence(F.floor(F.col("start_char") / bin_size), F.floor((F.col("end_char") - 1) / bin_size))))
    low, high = F.greatest("start", "start_char"), F.least("end", "end_char")
    pairs = s.join(b, [key, "bin"]).where((high > low) & (F.floor(low / bin_size) == F.col("bin"))).withColumn("width", high - low)
    w = Window.partitionBy(key, "span_idx")
    seen = F.coalesce(F.sum("width").over(w.orderBy("para_idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("width").over(w)
    return pairs.select(key, "span_idx", "para_idx", "width", (seen / total).alias("from_share"), ((seen + F.col("width")) / total).alias("to_share"))


def merge_pars(placements: DataFrame) -> DataFrame:
    """Adjacent placements (chapter_idx, pos, fragment, clip_begin, clip_end) of one fragment as one par; each par ends where the next begins."""
    w = Window.partitionBy("chapter_idx").orderBy("pos")
    changed = F.when(F.lag("fragment").over(w) == F.col("fragment"), 0).otherwise(1)
    islands = placements.withColumn("changed", changed).withColumn("par_idx", F.sum("changed").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    pars = islands.groupBy("chapter_idx", "par_idx").agg(F.min_by("fragment", "pos").alias("fragment"), F.min_by("clip_begin", "pos").alias("clip_begin"), F.max_by("clip_end", "pos").alias("clip_end"))
    return pars.withColumn("clip_end", F.coalesce(F.lead("clip_begin").over(Window.partitionBy("chapter_idx").orderBy("par_idx")), "clip_end"))


def smil(pars: DataFrame, doc_href: Column, audio_href: Column) -> DataFrame:
    """A read-along document per chapter."""
    row = F.concat(
        F.lit('<par id="par'), F.col("par_idx").cast("string"), F.lit('"><text src="'), X.escape_markup(doc_href), F.lit("#"), X.escape_markup(F.col("fragment")),
        F.lit('"/><audio src="'), X.escape_markup(audio_href), F.lit('" clipBegin="'), X.clock(F.col("clip_begin")), F.lit('" clipEnd="'), X.clock(F.col("clip_end")), F.lit('"/></par>'),
    )
    rows = pars.withColumn("row", row).groupBy("chapter_idx").agg(F.sort_array(F.collect_list(F.struct("par_idx", "row"))).alias("r"))
    head = '<smil xmlns="http://www.w3.org/ns/SMIL" version="3.0"><body>'
    return rows.select("chapter_idx", F.concat(F.lit(head), F.array_join("r.row", ""), F.lit("</body></smil>")).alias("smil"))
