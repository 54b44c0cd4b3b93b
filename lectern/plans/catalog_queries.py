"""Chapter listings, metadata, voices, reports and quarantine queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import audio, catalog, timing
from lectern.operators.incremental import content_hash
from lectern.plans.common import SEGMENTS_SQL, segments, table

#: A stand-in table of built-in voices: part of a model's name -> voices.
VOICES = {"brushed": ["ada", "ben"], "steel": ["cy"], "tin": ["dot", "eve", "fay"]}


def list_chapters(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "documents").select(F.col("doc_id").alias("chapter_idx"), F.format_string("%02d_c", F.col("doc_id")).alias("base"))
    files = table(spark, d, "labels").select(F.format_string("%02d_c", F.col("doc_id")).alias("base"))
    return catalog.list_chapters(m, files, None, ".wav")


def wanted_chapters(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "documents").select(F.col("doc_id").alias("chapter_idx"), F.format_string("%02d_c", F.col("doc_id")).alias("base"))
    return catalog.list_chapters(m, m, [3, 5, 8, 13, 100_000], ".mp3").withColumn("number", catalog.chapter_number(F.col("base")).cast("long"))


def metadata_rows(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "customer").where("c_nationkey is not null")
    full = F.to_json(F.struct(F.col("c_name").alias("title"), F.array(F.struct((F.col("c_custkey") % 7).alias("index"), F.lit("A b").alias("title"), F.lit("x").alias("filename_base"), F.lit("h").alias("href"))).alias("chapters")))
    old = F.to_json(F.struct(F.lit("Ann").alias("author"), F.array(F.struct((F.col("c_custkey") % 7).alias("index"), F.lit("A/b c").alias("title"))).alias("chapters")))
    rows = o.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, full).otherwise(old).alias("content"))
    return catalog.metadata_rows(rows, "content")


def known_voices(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", F.col("p_type").alias("model"))
    return catalog.known_voices(p, VOICES).select("p_partkey", F.array_join("voices", ",").alias("voices"))


def speech_bodies(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d).withColumn("instruct", F.when(F.col("seg_idx") % 2 == 0, "softly").otherwise(""))
    return s.select("chapter_idx", "seg_idx", F.md5(catalog.speech_body(F.col("text"), F.col("instruct"), True)).alias("md5"))


def _timed(spark: SparkSession, d: str) -> DataFrame:
    return timing.timing_manifest(segments(spark, d).withColumn("duration_s", F.length("text") / 16.0))


def synced_lyrics(spark: SparkSession, d: str) -> DataFrame:
    return catalog.synced_lyrics(_timed(spark, d)).select("chapter_idx", "seg_idx", F.md5("body").alias("md5"), "start_ms")


def location_reports(spark: SparkSession, d: str) -> DataFrame:
    t = _timed(spark, d)
    return t.select("chapter_idx", "seg_idx", catalog.location_report(t).alias("line"))


def quarantine(spark: SparkSession, d: str) -> DataFrame:
    m = audio.metrics(table(spark, d, "embeddings"), "embedding").withColumn("categories", audio.categories())
    return catalog.rejects(m, F.concat(F.lit("take "), F.col("vec_id").cast("string"), F.lit("/"), F.col("label").cast("string"))).select("vec_id", "label", "reason")


def narrator_first(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("book_id"), F.when(F.col("c_custkey") % 60 == 7, "NARRATOR").otherwise(F.col("c_name")).alias("name"), F.col("c_custkey").alias("ordinal"))
    return catalog.narrator_first(c)


def redo_phases(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "orders").select(F.col("o_custkey").alias("book_id"), F.col("o_orderstatus").alias("phase"))
    return catalog.redo_phase(f, ["O", "F", "P"])


def restamped(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select(F.col("doc_id").alias("key"), content_hash(F.col("text")).alias("hash"))
    done, missing = catalog.restamped(t, table(spark, d, "labels").select(F.col("doc_id").alias("key")))
    return done.unionByName(missing.select("key", F.lit(None).cast("string").alias("hash"), F.lit(False).alias("done")))


_TS = lambda v: f"printf('%02d:%02d:%02d.%03d', ({v}) // 3600000, (({v}) // 60000) % 60, (({v}) // 1000) % 60, ({v}) % 1000)"
_MS = lambda v: f"CAST(round_even(greatest({v}, 0.0) * 1000, 0) AS BIGINT)"
_TIMED = f"""{SEGMENTS_SQL}, timed AS (SELECT *, s AS start_s, s + d AS end_s FROM (SELECT *, length(text) / 16.0::DOUBLE AS d,
  coalesce(sum(length(text) / 16.0::DOUBLE + 0.5::DOUBLE) OVER (PARTITION BY chapter_idx ORDER BY seg_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM segments))"""
_LINE = "trim(replace(text, chr(10), ' '))"

QUERIES = {
    "list_chapters": (list_chapters, "SELECT doc_id AS chapter_idx, printf('%02d_c', doc_id) AS base, printf('%02d_c', doc_id) || '.wav' AS target FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)"),
    "wanted_chapters": (wanted_chapters, "SELECT doc_id AS chapter_idx, printf('%02d_c', doc_id) AS base, printf('%02d_c', doc_id) || '.mp3' AS target, doc_id AS number FROM documents WHERE doc_id IN (3, 5, 8, 13, 100000)"),
    "metadata_rows": (
        metadata_rows,
        "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END AS book, CASE WHEN c_custkey % 2 = 0 THEN 'Unknown' ELSE 'Ann' END AS author, 'en' AS language, c_custkey % 7 AS chapter_idx, "
        "CASE WHEN c_custkey % 2 = 0 THEN 'A b' ELSE 'A/b c' END AS title, CASE WHEN c_custkey % 2 = 0 THEN 'x' ELSE printf('%02d_A_b_c', c_custkey % 7) END AS base, CASE WHEN c_custkey % 2 = 0 THEN 'h' ELSE '' END AS href FROM customer",
    ),
    "known_voices": (
        known_voices,
        "SELECT p_partkey, " + "CASE " + " ".join(f"WHEN contains(lower(p_type), '{k}') THEN '{','.join(v)}'" for k, v in VOICES.items()) + " ELSE '' END AS voices FROM part",
    ),
    "speech_bodies": (speech_bodies, f"WITH {SEGMENTS_SQL} SELECT chapter_idx, seg_idx, md5(CASE WHEN seg_idx % 2 = 0 THEN '[softly] ' || text ELSE text END) AS md5 FROM segments"),
    "synced_lyrics": (synced_lyrics, f"WITH {_TIMED} SELECT chapter_idx, seg_idx, md5(trim(text, E' \\n\\t\\r')) AS md5, {_MS('start_s')} AS start_ms FROM timed WHERE trim(text, E' \\n\\t\\r') <> ''"),
    "location_reports": (
        location_reports,
        f"WITH {_TIMED} SELECT chapter_idx, seg_idx, 'segment ' || seg_idx || ' [' || {_TS(_MS('start_s'))} || ' - ' || {_TS(_MS('end_s'))} || '] ' || speaker || ': ' || CASE WHEN length({_LINE}) > 40 THEN substr({_LINE}, 1, 37) || '...' ELSE {_LINE} END AS line FROM timed",
    ),
    "quarantine": (
        quarantine,
        "WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS a FROM embeddings), m AS (SELECT *, list_sort(list_transform(a, lambda x: abs(x))) AS s, list_max(list_transform(a, lambda x: abs(x))) / sqrt(list_sum(list_transform(a, lambda x: x * x)) / 64) AS crest FROM e), "
        "c AS (SELECT vec_id, label, list_filter([CASE WHEN abs(a[1]) > 0.05 THEN 'click' END, CASE WHEN abs(a[-1]) > 0.05 THEN 'truncated' END, CASE WHEN crest < 3.5 AND (s[32] + s[33]) / 2 > 0.08 THEN 'noisy' END], lambda x: x IS NOT NULL) AS c FROM m) "
        "SELECT vec_id, 'take_' || vec_id || '_' || label AS label, array_to_string(c, '+') AS reason FROM c WHERE len(c) > 0",
    ),
    "narrator_first": (
        narrator_first,
        "WITH c AS (SELECT c_nationkey::BIGINT AS book_id, CASE WHEN c_custkey % 60 = 7 THEN 'NARRATOR' ELSE c_name END AS name, c_custkey AS ordinal FROM customer) SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY lower(name) <> 'narrator', ordinal) - 1 AS place FROM c",
    ),
    "redo_phases": (redo_phases, "SELECT o_custkey AS book_id, ['O', 'F', 'P'][max(CASE o_orderstatus WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 3 END)] AS phase FROM orders WHERE o_orderstatus IN ('O', 'F', 'P') GROUP BY 1"),
    "restamped": (restamped, "SELECT doc_id AS key, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN sha256(text) END AS hash, doc_id IN (SELECT doc_id FROM labels) AS done FROM documents"),
}
