"""Timing, subtitles, interval lookup, read-along and audio queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import audio, timing
from lectern.plans.common import PARAGRAPHS_SQL, SEGMENTS_SQL, paragraphs, segments, table

_TS = lambda v: f"printf('%02d:%02d:%02d,%03d', ({v}) // 3600000, (({v}) // 60000) % 60, (({v}) // 1000) % 60, ({v}) % 1000)"
_MS = lambda v: f"CAST(round_even(greatest({v}, 0.0) * 1000, 0) AS BIGINT)"


def _timed(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d).where(X.is_speakable(F.col("text"))).withColumn("duration_s", F.length("text") / 16.0)
    return timing.timing_manifest(s)


TIMED_SQL = f"""{SEGMENTS_SQL}, timed AS (
  SELECT chapter_idx, seg_idx, speaker, text, d AS duration_s, s AS start_s, s + d AS end_s FROM (
    SELECT *, length(text) / 16.0::DOUBLE AS d, coalesce(sum(length(text) / 16.0::DOUBLE + 0.5::DOUBLE) OVER (PARTITION BY chapter_idx ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
    FROM segments WHERE regexp_matches(text, '[\\p{{L}}\\p{{N}}]')))"""


def timing_manifest(spark: SparkSession, d: str) -> DataFrame:
    return _timed(spark, d).select("chapter_idx", "seg_idx", "speaker", "start_s", "end_s", X.format_ts(F.col("start_s")).alias("start_ts"))


def _shaken(spark: SparkSession, d: str) -> DataFrame:
    """Timings with overlaps, empty cues and blank texts."""
    t = _timed(spark, d)
    return t.withColumn("start_s", F.col("start_s") - 0.75 * (F.col("seg_idx") % 3)).withColumn("end_s", F.when(F.col("seg_idx") % 4 == 1, F.col("start_s")).otherwise(F.col("end_s"))).withColumn("text", F.when(F.col("seg_idx") % 5 == 4, " ").otherwise(F.col("text")))


SHAKEN_SQL = f"""{TIMED_SQL}, moved AS (SELECT *, start_s - 0.75 * (seg_idx % 3) AS b FROM timed),
shaken AS (SELECT chapter_idx, seg_idx, b AS start_s, CASE WHEN seg_idx % 4 = 1 THEN b ELSE end_s END AS end_s, '[' || speaker || '] ' || trim(text, E' \\n\\t\\r') AS body FROM moved WHERE seg_idx % 5 <> 4),
numbered AS (SELECT *, row_number() OVER (PARTITION BY chapter_idx ORDER BY seg_idx) AS k FROM shaken),
cues AS (
  SELECT chapter_idx, k, body, start_s, CASE WHEN end_s <= start_s THEN start_s + 0.001 ELSE end_s END AS end_s FROM numbered WHERE k = 1
  UNION ALL
  SELECT chapter_idx, k, body, s, CASE WHEN start_s < p AND e <= s THEN s + 0.001 ELSE e END FROM (
    SELECT n.chapter_idx, n.k, n.body, n.start_s, c.end_s AS p, CASE WHEN n.start_s < c.end_s THEN c.end_s ELSE n.start_s END AS s,
      CASE WHEN n.end_s <= n.start_s THEN n.start_s + 0.001 ELSE n.end_s END AS e
    FROM cues c JOIN numbered n ON n.chapter_idx = c.chapter_idx AND n.k = c.k + 1))"""


def srt_cues(spark: SparkSession, d: str) -> DataFrame:
    c = timing.cues(_shaken(spark, d))
    return c.select("chapter_idx", "cue_idx", X.format_ts(F.col("start_s")).alias("start_ts"), X.format_ts(F.col("end_s")).alias("end_ts"), F.md5("body").alias("body_md5"))


def srt_files(spark: SparkSession, d: str) -> DataFrame:
    return timing.srt_text(timing.cues(_shaken(spark, d))).select("chapter_idx", F.md5("srt").alias("srt_md5"))


def _bounds(spark: SparkSession, d: str) -> DataFrame:
    p = paragraphs(spark, d)
    start = timing.running_start(F.length("text"), 2, ["doc_id"], ["para_idx"]).cast("long")
    return p.withColumn("start_char", start).withColumn("end_char", F.col("start_char") + F.length("text")).drop("text")


BOUNDS_SQL = f"""{PARAGRAPHS_SQL}, bounds AS (
  SELECT doc_id, para_idx, s AS start_char, s + n AS end_char FROM (
    SELECT doc_id, para_idx, length(text) AS n, CAST(coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id ORDER BY para_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s FROM paragraphs))"""


def paragraph_bounds(spark: SparkSession, d: str) -> DataFrame:
    return _bounds(spark, d)


def chapter_offsets(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("source", "doc_id", F.floor(F.col("n_chars") / 16.0 * 1000).alias("duration_ms"))
    t = timing.with_running_start(t, "start_ms", F.col("duration_ms"), 0, "source", "doc_id")
    return t.withColumn("start_ms", F.col("start_ms").cast("long")).withColumn("end_ms", F.col("start_ms") + F.col("duration_ms"))


def locate_segment(spark: SparkSession, d: str) -> DataFrame:
    timed = _timed(spark, d).select("chapter_idx", "seg_idx", "speaker", "start_s", "end_s")
    probes = table(spark, d, "events").select(F.col("event_id").alias("probe_id"), (F.col("user_id") % 200).alias("chapter_idx"), F.round(F.col("value") % 60, 3).alias("t"))
    return timing.locate(probes, timed).select("probe_id", "chapter_idx", "t", "seg_idx", "speaker", "start_s", "end_s")


def _spans(spark: SparkSession, d: str) -> DataFrame:
    b = _bounds(spark, d).groupBy("doc_id").agg(F.max("end_char").alias("n"))
    spans = b.where("n > 0").select("doc_id", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 300))).alias("span_idx"))
    return spans.select("doc_id", F.col("span_idx").cast("long").alias("span_idx"), (F.col("span_idx") * 300).cast("long").alias("start"), F.least(F.col("span_idx") * 300 + 300, "n").cast("long").alias("end"))


SPANS_SQL = f"""{BOUNDS_SQL}, spans AS (
  SELECT doc_id, span_idx, span_idx * 300 AS b, least(span_idx * 300 + 300, n) AS e
  FROM (SELECT doc_id, n, unnest(generate_series(0, (n - 1) // 300)) AS span_idx FROM (SELECT doc_id, max(end_char) AS n FROM bounds GROUP BY doc_id) WHERE n > 0)),
pieces AS (
  SELECT doc_id, span_idx, para_idx, width, coalesce(sum(width) OVER w, 0) / sum(width) OVER t AS from_share, (coalesce(sum(width) OVER w, 0) + width) / sum(width) OVER t AS to_share
  FROM (SELECT s.doc_id, span_idx, para_idx, least(e, end_char) - greatest(b, start_char) AS width FROM spans s JOIN bounds p ON s.doc_id = p.doc_id AND start_char < e AND end_char > b)
  WINDOW t AS (PARTITION BY doc_id, span_idx), w AS (PARTITION BY doc_id, span_idx ORDER BY para_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def paragraph_pieces(spark: SparkSession, d: str) -> DataFrame:
    p = timing.interval_overlaps(_spans(spark, d), _bounds(spark, d), "doc_id")
    return p.select("doc_id", "span_idx", "para_idx", "width", F.round("from_share", 6).alias("from_share"), F.round("to_share", 6).alias("to_share"))


def _pars(spark: SparkSession, d: str) -> DataFrame:
    p = timing.interval_overlaps(_spans(spark, d), _bounds(spark, d), "doc_id")
    begin = F.col("span_idx") * 4.0
    placed = p.select(F.col("doc_id").alias("chapter_idx"), F.struct("span_idx", "para_idx").alias("pos"), F.concat(F.lit("p"), F.col("para_idx").cast("string")).alias("fragment"), (begin + 3.5 * F.col("from_share")).alias("clip_begin"), (begin + 3.5 * F.col("to_share")).alias("clip_end"))
    return timing.merge_pars(placed)


PARS_SQL = f"""{SPANS_SQL}, placed AS (SELECT doc_id, span_idx, para_idx, span_idx * 4.0 + 3.5 * from_share AS b, span_idx * 4.0 + 3.5 * to_share AS e FROM pieces),
islands AS (SELECT *, sum(c) OVER (PARTITION BY doc_id ORDER BY span_idx, para_idx ROWS UNBOUNDED PRECEDING) - 1 AS par_idx FROM (
  SELECT *, CASE WHEN lag(para_idx) OVER (PARTITION BY doc_id ORDER BY span_idx, para_idx) = para_idx THEN 0 ELSE 1 END AS c FROM placed)),
pars AS (SELECT doc_id AS chapter_idx, CAST(par_idx AS BIGINT) AS par_idx, 'p' || min(para_idx) AS fragment, min(b) AS clip_begin, max(e) AS last_end FROM islands GROUP BY doc_id, par_idx)"""


def merge_pars(spark: SparkSession, d: str) -> DataFrame:
    return _pars(spark, d).select("chapter_idx", "par_idx", "fragment", F.round("clip_begin", 6).alias("clip_begin"), F.round("clip_end", 6).alias("clip_end"))


def smil_documents(spark: SparkSession, d: str) -> DataFrame:
    pars = _pars(spark, d).withColumn("clip_begin", F.round("clip_begin", 6)).withColumn("clip_end", F.round("clip_end", 6))
    return timing.smil(pars, F.lit("text.xhtml"), F.lit("a&b.mp3")).select("chapter_idx", F.length("smil").cast("long").alias("n_chars"), (F.size(F.split("smil", "<par ")) - 1).cast("long").alias("n_pars"))


_CLIP, _RUN = 0.1, 3


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    return audio.metrics(table(spark, d, "embeddings"), "embedding", clip=_CLIP)


METRICS_SQL = f"""m AS (SELECT vec_id, a, n, list_sum(list_transform(a, lambda x: abs(x))) / n AS mean_abs, list_max(list_transform(a, lambda x: abs(x))) AS peak,
  sqrt(list_sum(list_transform(a, lambda x: x * x)) / n) AS rms, (s[(n - 1) // 2 + 1] + s[n // 2 + 1]) / 2 AS median_abs, a[1] AS first_sample, a[-1] AS last_sample,
  list_max(list_transform(string_split(array_to_string(list_transform(a, lambda x: CASE WHEN abs(x) >= {_CLIP} THEN '1' ELSE '0' END), ''), '0'), lambda x: length(x))) AS clip_run, n / 24000 AS duration_s
  FROM (SELECT vec_id, a, len(a) AS n, list_sort(list_transform(a, lambda x: abs(x))) AS s FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS a FROM embeddings)))"""
_CATS = (
    f"list_filter([CASE WHEN mean_abs < 0.001 THEN 'silent' END, CASE WHEN abs(first_sample) > 0.05 THEN 'click' END, CASE WHEN abs(last_sample) > 0.05 THEN 'truncated' END, CASE WHEN clip_run >= {_RUN} THEN 'clipping' END, "
    "CASE WHEN (peak / rms < 3.5 AND median_abs > 0.08) OR (peak / rms < 4.5 AND median_abs > 0.07 AND duration_s >= 3.0) THEN 'noisy' END], lambda x: x IS NOT NULL)"
)


def segment_metrics(spark: SparkSession, d: str) -> DataFrame:
    names = ("duration_s", "mean_abs", "peak", "rms", "median_abs", "first_sample", "last_sample")
    return _metrics(spark, d).select("vec_id", *(F.round(c, 6).alias(c) for c in names), "clip_run")


def categorize_audio(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d).select("vec_id", F.array_join(audio.categories(clip_samples=_RUN), ",").alias("categories"))


def category_counts(spark: SparkSession, d: str) -> DataFrame:
    return _metrics(spark, d).select(F.explode(audio.categories(clip_samples=_RUN)).alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def audio_offenders(spark: SparkSession, d: str) -> DataFrame:
    found = _metrics(spark, d).select("vec_id", F.array_sort(audio.categories(clip_samples=_RUN)).alias("c")).where(F.size("c") > 0)
    return found.select("vec_id", F.size("c").cast("long").alias("n_categories"), F.array_join("c", "+").alias("label"))


def normalize_audio(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "embeddings").select("vec_id", audio.normalized(F.col("embedding")).alias("a"))
    return a.select("vec_id", F.posexplode("a").alias("i", "sample")).select("vec_id", F.col("i").cast("long").alias("i"), F.round("sample", 6).alias("sample"))


def concat_with_pause(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings").withColumn("chapter_idx", F.floor(F.col("vec_id") / 8))
    joined = audio.concatenated(e, ["chapter_idx"], "vec_id", "embedding", 12)
    return joined.select("chapter_idx", F.posexplode("samples").alias("i", "sample")).select("chapter_idx", F.col("i").cast("long").alias("i"), F.round("sample", 6).alias("sample"))


_CLOCK = lambda x: f"printf('%d:%02d:%02d.%03d', {_MS(x)} // 3600000, ({_MS(x)} // 60000) % 60, ({_MS(x)} // 1000) % 60, {_MS(x)} % 1000)"

QUERIES = {
    "timing_manifest": (timing_manifest, f"WITH {TIMED_SQL} SELECT chapter_idx, seg_idx, speaker, start_s, end_s, {_TS(_MS('start_s'))} AS start_ts FROM timed"),
    "srt_cues": (srt_cues, f"WITH RECURSIVE {SHAKEN_SQL} SELECT chapter_idx, k AS cue_idx, {_TS(_MS('start_s'))} AS start_ts, {_TS(_MS('end_s'))} AS end_ts, md5(body) AS body_md5 FROM cues"),
    "srt_files": (
        srt_files,
        f"WITH RECURSIVE {SHAKEN_SQL} SELECT chapter_idx, md5(string_agg(k || chr(13) || chr(10) || {_TS(_MS('start_s'))} || ' --> ' || {_TS(_MS('end_s'))} || chr(13) || chr(10) || body || chr(13) || chr(10) || chr(13) || chr(10), '' ORDER BY k)) AS srt_md5 FROM cues GROUP BY chapter_idx",
    ),
    "paragraph_bounds": (paragraph_bounds, f"WITH {BOUNDS_SQL} SELECT * FROM bounds"),
    "chapter_offsets": (
        chapter_offsets,
        "SELECT source, doc_id, ms AS duration_ms, s AS start_ms, s + ms AS end_ms FROM (SELECT *, CAST(coalesce(sum(ms) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s "
        "FROM (SELECT source, doc_id, CAST(floor(n_chars / 16.0 * 1000) AS BIGINT) AS ms FROM documents))",
    ),
    "locate_segment": (
        locate_segment,
        f"WITH {TIMED_SQL}, p AS (SELECT event_id AS probe_id, user_id % 200 AS chapter_idx, round(value % 60, 3) AS t FROM events) "
        "SELECT p.probe_id, p.chapter_idx, t, seg_idx, speaker, start_s, end_s FROM p JOIN timed USING (chapter_idx) WHERE t >= 0 AND end_s >= t QUALIFY row_number() OVER (PARTITION BY p.probe_id ORDER BY end_s) = 1",
    ),
    "paragraph_pieces": (paragraph_pieces, f"WITH {SPANS_SQL} SELECT doc_id, span_idx, para_idx, width, round(from_share, 6) AS from_share, round(to_share, 6) AS to_share FROM pieces"),
    "merge_pars": (
        merge_pars,
        f"WITH {PARS_SQL} SELECT chapter_idx, par_idx, fragment, round(clip_begin, 6) AS clip_begin, round(coalesce(lead(clip_begin) OVER (PARTITION BY chapter_idx ORDER BY par_idx), last_end), 6) AS clip_end FROM pars",
    ),
    "smil_documents": (
        smil_documents,
        f"WITH {PARS_SQL}, c AS (SELECT chapter_idx, par_idx, fragment, round(clip_begin, 6) AS b, round(coalesce(lead(clip_begin) OVER (PARTITION BY chapter_idx ORDER BY par_idx), last_end), 6) AS e FROM pars), "
        f"r AS (SELECT chapter_idx, '<par id=\"par' || par_idx || '\"><text src=\"text.xhtml#' || fragment || '\"/><audio src=\"a&amp;b.mp3\" clipBegin=\"' || {_CLOCK('b')} || '\" clipEnd=\"' || {_CLOCK('e')} || '\"/></par>' AS row FROM c) "
        "SELECT chapter_idx, sum(length(row))::BIGINT + 74 AS n_chars, count(*) AS n_pars FROM r GROUP BY 1",
    ),
    "segment_metrics": (
        segment_metrics,
        f"WITH {METRICS_SQL} SELECT vec_id, {', '.join(f'round({c}, 6) AS {c}' for c in ('duration_s', 'mean_abs', 'peak', 'rms', 'median_abs', 'first_sample', 'last_sample'))}, clip_run FROM m",
    ),
    "categorize_audio": (categorize_audio, f"WITH {METRICS_SQL} SELECT vec_id, array_to_string({_CATS}, ',') AS categories FROM m"),
    "category_counts": (category_counts, f"WITH {METRICS_SQL} SELECT category, count(*) AS n FROM (SELECT unnest({_CATS}) AS category FROM m) GROUP BY category"),
    "audio_offenders": (audio_offenders, f"WITH {METRICS_SQL}, c AS (SELECT vec_id, list_sort({_CATS}) AS c FROM m) SELECT vec_id, len(c) AS n_categories, array_to_string(c, '+') AS label FROM c WHERE len(c) > 0"),
    "normalize_audio": (
        normalize_audio,
        f"WITH {METRICS_SQL}, s AS (SELECT vec_id, list_transform(a, lambda x: round(CASE WHEN peak > 0 THEN x / peak * 0.95::DOUBLE ELSE x END, 6)) AS b FROM m) SELECT vec_id, generate_subscripts(b, 1) - 1 AS i, unnest(b) AS sample FROM s",
    ),
    "concat_with_pause": (
        concat_with_pause,
        "WITH e AS (SELECT vec_id // 8 AS chapter_idx, vec_id, row_number() OVER (PARTITION BY vec_id // 8 ORDER BY vec_id) AS k, list_transform(embedding, lambda x: round(x::DOUBLE, 6)) AS a FROM embeddings), "
        "f AS (SELECT chapter_idx, flatten(list(CASE WHEN k = 1 THEN a ELSE list_concat([0.0::DOUBLE, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0], a) END ORDER BY k)) AS b FROM e GROUP BY chapter_idx) "
        "SELECT chapter_idx, generate_subscripts(b, 1) - 1 AS i, unnest(b) AS sample FROM f",
    ),
}
