"""Queries of artifact paths, clean-up, configuration, manifests and review spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.folds import let
from lectern.operators import artifacts, locate
from lectern.plans import timing_queries
from lectern.plans.common import table


def artifact_paths(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    sound = F.concat(F.lit("b.1/"), "s_name", F.when(F.col("s_suppkey") % 2 == 0, ".wav").otherwise(""))
    return s.select("s_suppkey", artifacts.segment_path(F.lit("w"), F.lit("perform"), F.md5("s_name")).alias("segment"), artifacts.manifest_path(sound).alias("manifest"), artifacts.subtitle_path(sound).alias("subtitles"))


def cleanable_files(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    path = F.when(k % 5 == 0, F.concat(F.lit("w/perform/segments/"), k.cast("string"), F.lit(".wav"))).when(k % 5 == 1, F.concat(F.lit("synthesize/segments/"), k.cast("string"))).when(k % 5 == 2, "w/perform/chapter.wav").when(k % 5 == 3, "w/perform/segments/deep/x.wav").otherwise("w/xperform/segments/x.wav")
    return artifacts.cleanable(o.select(F.col("o_custkey").alias("book_id"), path.alias("path")))


def resolved_config(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    layer = F.element_at(F.array(F.lit("flag"), F.lit("env"), F.lit("file"), F.lit("unknown")), (F.col("p_partkey") % 4 + 1).cast("int"))
    layers = p.select((F.col("p_size") % 5).alias("job"), layer.alias("layer"), F.col("p_brand").alias("key"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_partkey").cast("string")).otherwise("").alias("value"))
    return artifacts.resolved_config(layers, ["flag", "env", "file"])


def manifest_items(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    items = F.array_join(F.array_sort(F.collect_list(F.struct("n_nationkey", F.concat(F.lit('<item id="i'), F.col("n_nationkey").cast("string"), F.lit('" href="'), "n_name", F.lit('.xhtml" media-type="x"/><item id="none"/>')).alias("x"))))["x"], "")
    packages = n.groupBy(F.col("n_regionkey").alias("book_id")).agg(F.concat(F.lit('<package xmlns="http://www.idpf.org/2007/opf"><metadata/><manifest>'), items, F.lit("</manifest></package>")).alias("content"))
    return artifacts.manifest_items(packages)


def subtitles_of_manifests(spark: SparkSession, d: str) -> DataFrame:
    """Timing manifests saved, read again, and written as subtitles."""
    t = timing_queries._shaken(spark, d).withColumn("hash", F.lit("h")).withColumn("script_idx", F.col("seg_idx").cast("long"))
    files = artifacts.timing_files(t).select(F.col("chapter_idx").alias("path"), "content")
    return artifacts.subtitles_of_manifests(files).select("chapter_idx", F.md5("srt").alias("srt_md5"))


_LOW = "abcdefghijklmnopqrstuvwxyz"


def review_spans(spark: SparkSession, d: str) -> DataFrame:
    """Batches of three lines of every document: as written, with other white space, and with other case and marks."""
    t = table(spark, d, "documents")
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.trim(x) != "")
    changed = F.transform(lines, lambda x, k: F.when(k % 7 == 2, F.concat(F.translate(x, _LOW, _LOW.upper()), F.lit("!"))).when(k % 5 == 3, F.replace(x, F.lit(" "), F.lit("  "))).otherwise(x))
    # the lines are made once, not for each batch
    batches = let(changed, lambda c: F.transform(F.filter(F.sequence(F.lit(0), F.size(c) - 1), lambda k: k % 3 == 0), lambda k: F.slice(c, k + 1, F.lit(3))))
    return locate.review_spans(t.where(F.size(lines) > 0).select(F.col("doc_id").alias("chapter_idx"), "text", batches.alias("batches")))


_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"
_TAIL = "text[cur + 1:]"
_LOOSE = r"regexp_replace({}, '[\s\x1c-\x1f\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g')"

# one text after the other as a recursion over a document's texts; common runs of words from runs of up to four equal ones
_REVIEW = rf"""
WITH RECURSIVE t AS (
  SELECT doc_id, text, list_transform(ls, lambda x, k: CASE WHEN (k - 1) % 7 = 2 THEN translate(x, '{_LOW}', '{_LOW.upper()}') || '!' WHEN (k - 1) % 5 = 3 THEN replace(x, ' ', '  ') ELSE x END) AS ls
  FROM (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ls FROM documents) WHERE len(ls) > 0
), own AS (
  SELECT DISTINCT doc_id, needle, {_WORDS.format("needle")} AS w FROM (SELECT doc_id, trim(unnest(ls), E' \n\t\r') AS needle FROM t)
), theirs AS (
  SELECT doc_id, unnest(w) AS x, unnest(list_transform(seps[:len(w)], lambda y: length(y))) AS before, generate_subscripts(w, 1) - 1 AS j
  FROM (SELECT doc_id, {_WORDS.format("text")} AS w, regexp_split_to_array(text, '[\p{{L}}\p{{N}}_]+') AS seps FROM t)
), placed AS (
  SELECT doc_id, x, j, sum(before + length(x)) OVER (PARTITION BY doc_id ORDER BY j) AS b FROM theirs
), ends AS (
  SELECT doc_id, list(b - length(x) ORDER BY j) AS starts, list(b ORDER BY j) AS ends FROM placed GROUP BY doc_id
), sized AS MATERIALIZED (
  SELECT doc_id, needle, w, row_number() OVER () AS id, len(w) AS n, least(4, ceil(0.7 * len(w) - 1e-9))::BIGINT AS size FROM own WHERE len(w) > 0
), mine AS (
  SELECT doc_id, id, n, size, i, hash(array_to_string(w[i + 1:i + size], ' ')) AS gram FROM (SELECT *, unnest(range(n - size + 1)) AS i FROM sized)
), grams AS (
  SELECT doc_id, j, unnest([1, 2, 3, 4]) AS size, hash(unnest([x, x || ' ' || lead(x) OVER o, x || ' ' || lead(x) OVER o || ' ' || lead(x, 2) OVER o, x || ' ' || lead(x) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o])) AS gram
  FROM theirs WINDOW o AS (PARTITION BY doc_id ORDER BY j)
), hits AS (
  SELECT id, n, size, i, j, i - row_number() OVER (PARTITION BY id, i - j ORDER BY i) AS island FROM mine JOIN grams USING (doc_id, size, gram)
), runs AS (
  SELECT id, n, min(i) AS i, min(j) AS j, count(*) + any_value(size) - 1 AS size FROM hits GROUP BY id, n, i - j, island HAVING count(*) + any_value(size) - 1 >= 0.7 * n
), listed AS (
  SELECT doc_id, needle, list({{'i': i, 'j': j, 'size': runs.size, 'n': runs.n}}) AS runs FROM runs JOIN sized USING (id) GROUP BY doc_id, needle
), texts AS (
  SELECT doc_id, list({{'needle': needle, 'runs': coalesce(runs, [])}} ORDER BY k) AS needles FROM (SELECT doc_id, trim(unnest(ls), E' \n\t\r') AS needle, generate_subscripts(ls, 1) AS k FROM t) LEFT JOIN listed USING (doc_id, needle) GROUP BY doc_id
), base AS MATERIALIZED (
  SELECT doc_id, text, needles, starts, ends FROM t JOIN texts USING (doc_id) LEFT JOIN ends USING (doc_id)
), s AS (
  SELECT doc_id, len(needles) AS most, length(text) AS size, 0 AS k, 0::BIGINT AS begin_, 0::BIGINT AS cur, NULL::BIGINT AS a FROM base
  UNION ALL
  SELECT doc_id, most, size, k + 1, begin_, coalesce(to_, cur), coalesce(a, CASE WHEN from_ IS NULL THEN begin_ WHEN from_ >= begin_ THEN from_ END)
  FROM (
    SELECT *, CASE WHEN exact > 0 THEN cur + exact - 1 WHEN loose > 0 THEN cur + loose - 1 ELSE starts[best.j + 1] END AS from_,
      CASE WHEN exact > 0 THEN cur + exact - 1 + length(needle) WHEN loose > 0 THEN cur + loose - 1 + length(needle) ELSE ends[best.j + best.size] END AS to_
    FROM (
      SELECT *, CASE WHEN exact = 0 THEN strpos({_LOOSE.format(_TAIL)}, {_LOOSE.format("needle")}) ELSE 0 END AS loose,
        CASE WHEN exact = 0 THEN list_sort(list_filter(list_transform(runs, lambda r: {{'short': -(r.size - greatest(0, first - r.j)), 'i': r.i + greatest(0, first - r.j), 'j': greatest(r.j, first), 'size': r.size - greatest(0, first - r.j), 'n': r.n}}), lambda r: r.size >= 0.7 * r.n))[1] END AS best
      FROM (
        SELECT *, strpos({_TAIL}, needle) AS exact, CASE WHEN strpos({_TAIL}, needle) = 0 THEN len(list_filter(starts, lambda x: x < cur)) END AS first
        FROM (
          SELECT doc_id, most, x.size, text, starts, ends, k, needles[k + 1].needle AS needle, needles[k + 1].runs AS runs,
            CASE WHEN k % 3 = 0 THEN b0 ELSE begin_ END AS begin_, CASE WHEN k % 3 = 0 THEN b0 ELSE cur END AS cur, CASE WHEN k % 3 = 0 THEN NULL ELSE a END AS a
          FROM (SELECT *, coalesce(a, begin_) AS b0 FROM s WHERE k < most) x JOIN base USING (doc_id)
        )
      )
    )
  )
)
SELECT doc_id AS chapter_idx, (k - 1) // 3 AS batch, coalesce(a, begin_) AS start_char, CASE WHEN cur > coalesce(a, begin_) THEN cur ELSE size END AS end_char
FROM s WHERE k > 0 AND (k % 3 = 0 OR k = most)"""

_SRT = timing_queries.QUERIES["srt_files"][1]

QUERIES = {
    "artifact_paths": (artifact_paths, "SELECT s_suppkey, 'w/perform/segments/' || md5(s_name) || '.wav' AS segment, 'b.1/' || s_name || CASE WHEN s_suppkey % 2 = 0 THEN '.wav' ELSE '' END || '.timing.json' AS manifest, 'b.1/' || s_name || '.srt' AS subtitles FROM supplier"),
    "cleanable_files": (cleanable_files, "SELECT o_custkey AS book_id, CASE o_orderkey % 5 WHEN 0 THEN 'w/perform/segments/' || o_orderkey || '.wav' ELSE 'synthesize/segments/' || o_orderkey END AS path FROM orders WHERE o_orderkey % 5 < 2"),
    "resolved_config": (resolved_config, "SELECT p_size % 5 AS job, p_brand AS key, arg_min(p_partkey::VARCHAR, (p_partkey % 4, p_partkey::VARCHAR)) AS value, ['flag', 'env', 'file'][min(p_partkey % 4) + 1] AS layer FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 4 < 3 GROUP BY ALL"),
    "manifest_items": (manifest_items, "SELECT n_regionkey AS book_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS ordinal, 'i' || n_nationkey AS item_id, n_name || '.xhtml' AS href FROM nation"),
    "subtitles_of_manifests": (subtitles_of_manifests, _SRT),
    "review_spans": (
        review_spans,
        _REVIEW,
    ),
}
