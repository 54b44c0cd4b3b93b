"""Checks and edits of sample arrays, as array expressions without any shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import constants as C


def longest_run(samples: Column, at_least: float) -> Column:
    """Longest run of samples whose absolute value reaches a level."""
    marks = F.array_join(F.transform(samples, lambda x: F.when(F.abs(x) >= at_least, "1").otherwise("0")), "")
    return F.coalesce(F.array_max(F.transform(F.split(marks, "0", -1), lambda r: F.length(r))), F.lit(0)).cast("long")


def median(values: Column) -> Column:
    s = F.array_sort(values)
    n = F.size(s)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def metrics(segments: DataFrame, samples: str = "samples", rate: int = C.SAMPLE_RATE, clip: float = C.CLIP_THRESHOLD) -> DataFrame:
    """Segments with duration, mean, peak, rms, crest, median, edge samples and clip run."""
    a = F.transform(samples, lambda x: x.cast("double"))
    absolute = F.transform(a, lambda x: F.abs(x))
    n = F.size(a)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v)
    rms = F.sqrt(total(F.transform(a, lambda x: x * x)) / n)
    out = segments.select(
        "*",
        (n / rate).alias("duration_s"),
        F.when(n > 0, total(absolute) / n).alias("mean_abs"),
        F.array_max(absolute).alias("peak"),
        F.when(n > 0, rms).alias("rms"),
        median(absolute).alias("median_abs"),
        F.get(a, F.lit(0)).alias("first_sample"),
        F.try_element_at(a, F.lit(-1)).alias("last_sample"),
        longest_run(a, clip).alias("clip_run"),
    )
    return out.withColumn("crest", F.when(F.col("rms") > 0, F.col("peak") / F.col("rms")).otherwise(F.lit(float("inf"))))


def categories(clip_samples: int = C.CLIP_RUN_SAMPLES, click: float = C.CLICK_FIRST_SAMPLE, truncated: float = C.TRUNC_LAST_SAMPLE, silence: float = C.SILENCE_MEAN_ABS, crest_tight: float = C.NOISY_CREST_TIGHT, median_tight: float = C.NOISY_MED_TIGHT) -> Column:
    """Faults of a segment with metrics; an empty one is silent."""
    noisy = ((F.col("crest") < crest_tight) & (F.col("median_abs") > median_tight)) | ((F.col("crest") < C.NOISY_CREST_LOOSE) & (F.col("median_abs") > C.NOISY_MED_LOOSE) & (F.col("duration_s") >= C.NOISY_LOOSE_MIN_DUR_S))
    checks = (("silent", F.col("mean_abs") < silence), ("click", F.abs("first_sample") > click), ("truncated", F.abs("last_sample") > truncated), ("clipping", F.col("clip_run") >= clip_samples), ("noisy", noisy))
    found = F.array_compact(F.array(*(F.when(test, name) for name, test in checks)))
    return F.when(F.col("mean_abs").isNull(), F.array(F.lit("silent"))).otherwise(found)


def mono(frames: Column) -> Column:
    """One channel of frames (array<array<double>>, a value per channel): their mean. A frame without channels is null, as is one with a null."""
    return F.transform(frames, lambda f: F.when(F.size(f) > 0, F.aggregate(f, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(f)))


def normalized(samples: Column, level: float = 0.95) -> Column:
    """Scaled so that the peak is the level; silence stays."""
    a = F.transform(samples, lambda x: x.cast("double"))
    peak = F.array_max(F.transform(a, lambda x: F.abs(x)))
    return F.when(peak > 0, F.transform(a, lambda x: x / peak * level)).otherwise(a)


def concatenated(segments: DataFrame, keys: list[str], order: str, samples: str, pause: int) -> DataFrame:
    """One array per group: its segments in order with zeros between them."""
    zeros = F.array_repeat(F.lit(0.0), pause)
    parts = segments.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order), F.transform(samples, lambda x: x.cast("double")).alias("a")))).alias("p"))
    return parts.select(*keys, F.flatten(F.transform("p", lambda x, i: F.when(i == 0, x["a"]).otherwise(F.concat(zeros, x["a"])))).alias("samples"))
