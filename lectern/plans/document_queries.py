"""Chunking, HTML and alignment queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import alignment, chunking, html, overlay
from lectern.plans.alignment_sql import validation_sql
from lectern.plans.common import SEGMENTS_SQL, segments, table

_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s, E' \n\t\r')), lambda s: s <> '')"


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    found = chunking.sentence_rows(table(spark, d, "documents"), "doc_id", "text")
    return found.select("doc_id", "chunk_idx", F.md5("chunk").alias("md5"))


def chunk_text_500(spark: SparkSession, d: str) -> DataFrame:
    found = chunking.sentence_chunks(table(spark, d, "documents"), "doc_id", "text")
    return found.select("doc_id", "chunk_idx", F.length("chunk").cast("long").alias("n_chars"), F.md5("chunk").alias("md5"))


def split_text_smart(spark: SparkSession, d: str) -> DataFrame:
    found = chunking.paragraph_chunks(table(spark, d, "documents"), "doc_id", "text", 60, "\n")
    return found.select("doc_id", "chunk_idx", F.md5("chunk").alias("md5"))


def overlapping_chunks(spark: SparkSession, d: str) -> DataFrame:
    found = chunking.overlapping_chunks(table(spark, d, "documents"), "doc_id", "text", 80, 15, "\n")
    return found.select("doc_id", "chunk_idx", F.md5("chunk").alias("md5"))


def chapter_batches(spark: SparkSession, d: str) -> DataFrame:
    """Three chapters at a time as one text with headers, cut into overlapping chunks."""
    t = table(spark, d, "documents").select((F.floor(F.col("doc_id") / 3)).alias("batch"), F.struct("doc_id", F.concat(F.lit("\n--- Chapter "), F.col("doc_id").cast("string"), F.lit(" ---\n"), "text").alias("t")).alias("c"))
    joined = t.groupBy("batch").agg(F.array_join(F.sort_array(F.collect_list("c"))["t"], "").alias("text"))
    found = chunking.overlapping_chunks(joined, "batch", "text", 400, 40, "\n")
    return found.select("batch", "chunk_idx", F.md5("chunk").alias("md5"))


def page_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return html.extract_paragraphs(table(spark, d, "pages"), "page_id", "html")


def page_texts(spark: SparkSession, d: str) -> DataFrame:
    return html.chapter_texts(page_paragraphs(spark, d), "page_id")


def page_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", html.title_column(F.col("html")).alias("title"))


def find_text_in_source(spark: SparkSession, d: str) -> DataFrame:
    """Whole benchmark passages and their first one to five words, looked for in all documents."""
    whole = table(spark, d, "benchmark")
    words = F.split("text", " ")
    needles = whole.select(F.explode(F.array(*(F.struct((F.col("item_id") * 10 + k).alias("item_id"), (F.array_join(F.slice(words, 1, k), " ") if k else F.col("text")).alias("text")) for k in range(6)))).alias("n")).select("n.*")
    return alignment.longest_shared_runs(needles, table(spark, d, "documents"), "item_id", "doc_id")


def validate_script(spark: SparkSession, d: str) -> DataFrame:
    """Scripts that lack their second segment and have one of the next chapter, against their sources."""
    s = segments(spark, d)
    sources = s.groupBy("chapter_idx").agg(F.array_join(F.sort_array(F.collect_list(F.struct("seg_idx", "text")))["text"], "\n").alias("text"))
    foreign = s.where("seg_idx = 1").select((F.col("chapter_idx") - 1).alias("chapter_idx"), F.lit(1000).cast("long").alias("seg_idx"), F.concat(F.lit("unheard "), "text").alias("text"))
    script = s.where("seg_idx <> 1").select("chapter_idx", "seg_idx", "text").unionByName(foreign)
    return alignment.validate_scripts(sources, script)


def read_along_placements(spark: SparkSession, d: str) -> DataFrame:
    """Documents as chapters in XHTML, their sentence chunks anchored to spans and paragraphs."""
    t = table(spark, d, "documents")
    lines = F.filter(F.split("text", "\n", -1), lambda x: X.is_speakable(x))
    body = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("<p>"), X.escape_markup(F.regexp_replace(x, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", " ")), F.lit("</p>"))), "")
    xhtml = t.select(F.col("doc_id").alias("chapter_idx"), F.concat(F.lit("<html><body>"), body, F.lit("</body></html>")).alias("xhtml"))
    chunks = chunking.sentence_chunks(t, "doc_id", "text", 300).groupBy(F.col("doc_id").alias("chapter_idx")).agg(F.sort_array(F.collect_list(F.struct("chunk_idx", "chunk")))["chunk"].alias("chunks"))
    return overlay.placements(xhtml.join(chunks, "chapter_idx"))


def strip_segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments as they are saved: wrapping quotes off, styles checked."""
    return segments(spark, d).select("chapter_idx", "seg_idx", "speaker", X.strip_wrapping_quotes(F.col("text")).alias("text"))


def _pack(items: str, key: str, cap: int, overlap: int) -> str:
    """Greedy packing as a recursion over the paragraphs of a text."""
    tail = f"(string_split_regex(trim(array_to_string(held, ' '), E' \\n\\t'), '\\s+'))[-{overlap}:]" if overlap else "[]"
    carried = f"[array_to_string({tail}, ' ')]" if overlap else "[]"
    return f"""
WITH RECURSIVE p AS ({items}), s AS (
  SELECT {key}, 1 AS k, 0 AS chunk_idx, [ps[1]] AS held, ns[1] AS n, NULL::VARCHAR AS done, ps, ns FROM p WHERE len(ps) > 0
  UNION ALL
  SELECT {key}, k + 1, CASE WHEN full_ THEN chunk_idx + 1 ELSE chunk_idx END, list_append(CASE WHEN full_ THEN {carried} ELSE held END, ps[k + 1]),
    ns[k + 1] + CASE WHEN full_ THEN {overlap and f'len({tail})' or 0} ELSE n END, CASE WHEN full_ THEN array_to_string(held, chr(10)) END, ps, ns
  FROM (SELECT *, n + ns[k + 1] > {cap} AS full_ FROM s WHERE k < len(ps)))
SELECT {key}, chunk_idx - 1 AS chunk_idx, md5(done) AS md5 FROM s WHERE done IS NOT NULL
UNION ALL SELECT {key}, chunk_idx, md5(array_to_string(held, chr(10))) FROM s WHERE k = len(ps)"""


_COUNTS = r"list_transform(ps, lambda x: len(list_filter(regexp_split_to_array(x, '[\s\x1c-\x1f\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda w: w <> '')))"
_LINES = f"SELECT doc_id, ps, {_COUNTS} AS ns FROM (SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents)"
_FULL_LINES = f"SELECT doc_id, ps, {_COUNTS} AS ns FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ps FROM documents)"
_BATCHES = f"SELECT batch, ps, {_COUNTS} AS ns FROM (SELECT batch, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS ps FROM (SELECT doc_id // 3 AS batch, string_agg(chr(10) || '--- Chapter ' || doc_id || ' ---' || chr(10) || text, '' ORDER BY doc_id) AS text FROM documents GROUP BY 1))"
_TAG = lambda t: f"nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<{t}[^>]*>(.*?)</{t}>', 1), '<[^>]+>', '', 'g'), '\\s+', ' ', 'g')), '')"

_SCRIPTS = f"""{SEGMENTS_SQL}, sources AS (SELECT chapter_idx, string_agg(text, chr(10) ORDER BY seg_idx) AS text FROM segments GROUP BY 1),
script AS (SELECT chapter_idx, row_number() OVER (PARTITION BY chapter_idx ORDER BY seg_idx, text) - 1 AS seg, text FROM (
  SELECT chapter_idx, seg_idx, text FROM segments WHERE seg_idx <> 1 UNION ALL SELECT chapter_idx - 1, 1000, 'unheard ' || text FROM segments WHERE seg_idx = 1))"""

# words of needle and document that are equal, runs of them along a diagonal, the longest run of each pair
_FIND = """
WITH t AS (SELECT item_id * 10 + k AS item_id, CASE WHEN k = 0 THEN text ELSE array_to_string(string_split(text, ' ')[:k], ' ') END AS text FROM benchmark, range(6) r(k)),
n AS (SELECT item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM t), d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents),
a AS (SELECT item_id, len(w) AS n, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS i FROM n), b AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS j FROM d),
h AS (SELECT item_id, doc_id, n, i, j FROM a JOIN b USING (x)),
r AS (SELECT item_id, doc_id, n, min(i) AS i, min(j) AS j, count(*) AS size FROM (SELECT *, i - row_number() OVER (PARTITION BY item_id, doc_id, i - j ORDER BY i) AS island FROM h) GROUP BY item_id, doc_id, n, i - j, island)
SELECT item_id, doc_id, size, i AS needle_at, j AS source_at FROM r WHERE size >= 0.7 * n QUALIFY row_number() OVER (PARTITION BY item_id, doc_id ORDER BY size DESC, i, j) = 1"""

# the packing of sentences as a recursion over them; words take the place of a sentence longer than a chunk
_PACKED = f"""
WITH RECURSIVE t AS (SELECT doc_id, {_SENTENCES} AS ss FROM documents),
p AS (SELECT doc_id, flatten(list_transform(ss, lambda x: CASE WHEN length(x) <= 500 THEN [{{'x': x, 'kind': 0}}] ELSE list_transform(string_split(x, ' '), lambda y, i: {{'x': y, 'kind': CASE WHEN i = 1 THEN 1 ELSE 2 END}}) END)) AS items FROM t),
s AS (
  SELECT doc_id, 0 AS k, items, NULL::VARCHAR AS held, 0 AS n, 0 AS base_, []::VARCHAR[] AS done FROM p WHERE len(items) > 0
  UNION ALL
  SELECT doc_id, k + 1, items, CASE WHEN ends_ OR held IS NULL THEN x ELSE held || ' ' || x END, length(x) + 1 + CASE WHEN ends_ THEN 0 ELSE n END, base_ + len(done),
    CASE WHEN ends_ AND held IS NOT NULL THEN [held] ELSE [] END || CASE WHEN kind = 1 AND length(x) >= 500 THEN [''] ELSE [] END
  FROM (SELECT *, items[k + 1].x AS x, items[k + 1].kind AS kind, CASE items[k + 1].kind WHEN 0 THEN n + length(items[k + 1].x) > 500 WHEN 1 THEN true ELSE n + length(items[k + 1].x) + 1 > 500 END AS ends_ FROM s WHERE k < len(items))),
e AS (SELECT doc_id, base_ + i - 1 AS chunk_idx, done[i] AS chunk FROM s, unnest(generate_series(1, len(done))) u(i) UNION ALL SELECT doc_id, base_ + len(done), held FROM s WHERE k = len(items))
SELECT doc_id, chunk_idx, length(chunk) AS n_chars, md5(chunk) AS md5 FROM e WHERE trim(chunk) <> ''"""

QUERIES = {
    "sentence_split": (sentence_split, f"SELECT doc_id, generate_subscripts(s, 1) - 1 AS chunk_idx, md5(unnest(s)) AS md5 FROM (SELECT doc_id, {_SENTENCES} AS s FROM documents)"),
    "chunk_text_500": (chunk_text_500, _PACKED),
    "split_text_smart": (split_text_smart, _pack(_LINES, "doc_id", 60, 0)),
    "overlapping_chunks": (overlapping_chunks, _pack(_FULL_LINES, "doc_id", 80, 15)),
    "chapter_batches": (chapter_batches, _pack(_BATCHES, "batch", 400, 40)),
    "page_paragraphs": (page_paragraphs, None),
    "page_texts": (page_texts, None),
    "page_titles": (page_titles, f"SELECT page_id, coalesce({_TAG('title')}, {_TAG('h1')}, {_TAG('h2')}, {_TAG('h3')}) AS title FROM pages"),
    "find_text_in_source": (find_text_in_source, _FIND),
    "validate_script": (validate_script, validation_sql(_SCRIPTS)),
    "read_along_placements": (read_along_placements, None),
    "strip_segments": (
        strip_segments,
        f"WITH {SEGMENTS_SQL} SELECT chapter_idx, seg_idx, speaker, CASE WHEN length(trim(text)) >= 2 AND regexp_matches(trim(text), '(?s)^(\".*\"|''.*''|“.*”|‘.*’)$') THEN trim(trim(text)[2:-2]) ELSE text END AS text FROM segments",
    ),
}
