"""Queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lectern.llm import license_scan as licenses
from lectern.llm.common import read_table
from lectern.llm.divergence import divergence
from lectern.llm.merkle import merkle_manifest
from lectern.llm.mixing import TARGETS, label_domain, mix
from lectern.llm.nn_descent import near_vectors
from lectern.llm.piece_bpe import encode_decode
from lectern.llm.quality import quality
from lectern.llm.secret_scan import secret_scan
from lectern.llm.simhash import near_duplicates
from lectern.llm.substring_dedup import substring_dedup
from lectern.llm.token_counts import token_counts
from lectern.llm.toxicity import toxicity
from lectern.llm.winnowing import fingerprint_edits

Query = Callable[[SparkSession, str], DataFrame]


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(read_table(spark, sf_dir, "documents"))


def op3_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(read_table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read_table(spark, sf_dir, "documents"))


def op5_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), label_domain(), TARGETS)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read_table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(read_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(read_table(spark, sf_dir, "documents")).drop("proof_shape", "proof")


def op12_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_token_counts": op1_token_counts,
    "op2_secret_scan": op2_secret_scan,
    "op3_winnowing": op3_winnowing,
    "op4_quality": op4_quality,
    "op5_piece_bpe": op5_piece_bpe,
    "op6_mixing": op6_mixing,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_simhash": op8_simhash,
    "op9_license_scan": op9_license_scan,
    "op10_toxicity": op10_toxicity,
    "op11_merkle": op11_merkle,
    "op12_nn_descent": op12_nn_descent,
    "op13_divergence": op13_divergence,
}

OP7_SQL = r"""
WITH w AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents)
), s AS (
  SELECT doc_id, i, word, array_to_string(list(word) OVER ahead, chr(10)) AS window_text, count(*) OVER ahead AS n
  FROM w WINDOW ahead AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
), f AS (
  SELECT doc_id, i, word,
         n = 20 AND row_number() OVER (PARTITION BY n = 20, window_text ORDER BY doc_id, i) > 1 AS again
  FROM s
), c AS (
  SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
  FROM f
), k AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
         sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
  FROM c GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256
FROM documents d LEFT JOIN k USING (doc_id)
"""


def _field(value: str) -> str:
    return f"coalesce(strlen({value})::VARCHAR || ':' || {value}, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(f"({x})::VARCHAR") for x in ("doc_id", "source", "lang", n_chars, "text")) + ")"


def _step(at: str) -> str:
    """The sibling of a node at a level, after the side on which it stands; a dash where there is none."""
    return f"CASE WHEN ({at} >> level) % 2 = 1 THEN 'L' || nodes[({at} >> level)] ELSE coalesce('R' || nodes[({at} >> level) + 2], '-') END"


_HALVED = "list_transform(range(1, len(nodes) + 1, 2), lambda i: sha256(nodes[i] || coalesce(nodes[i + 1], '')))"
#: CRC-32 of the decimal id, from the table of the reflected polynomial.
_CRC = "xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::UBIGINT)), lambda c, k: xor(entries[((xor(c, k) & 255) + 1)::BIGINT], c >> 8)), 4294967295::UBIGINT)"

OP11_SQL = f"""
WITH RECURSIVE codes AS (
  SELECT list(list_reduce(list_prepend(i::UBIGINT, list_transform(range(8), lambda z: z::UBIGINT)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) ORDER BY i) AS entries
  FROM range(256) t(i)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos
  FROM (SELECT doc_id, lang, {_leaf("n_chars")} AS leaf, CASE WHEN n_chars IS NOT NULL AND {_CRC} % 7 = 0 THEN {_leaf("n_chars + 1")} END AS changed FROM documents, codes)
), tree AS (
  SELECT 0 AS level, lang, list(leaf ORDER BY pos) AS nodes FROM placed GROUP BY lang
  UNION ALL SELECT level + 1, lang, {_HALVED} FROM tree WHERE len(nodes) > 1
), sub AS (
  SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS spot FROM tree WHERE len(nodes) = 1
), top AS (
  SELECT 0 AS level, list(subroot ORDER BY spot) AS nodes FROM sub
  UNION ALL SELECT level + 1, {_HALVED} FROM top WHERE len(nodes) > 1
), up AS (
  SELECT lang, subroot, list({_step("spot")} ORDER BY level) FILTER (len(nodes) > 1) AS steps FROM sub, top GROUP BY lang, subroot
), own AS (
  SELECT p.lang, pos, list({_step("pos")} ORDER BY level) AS steps
  FROM placed p JOIN tree t ON p.lang IS NOT DISTINCT FROM t.lang WHERE len(nodes) > 1 GROUP BY p.lang, pos
), joined AS (
  SELECT p.doc_id, leaf, subroot, (SELECT nodes[1] FROM top WHERE len(nodes) = 1) AS root, coalesce(changed, leaf) AS start,
         list_concat(coalesce(own.steps, []), coalesce(up.steps, [])) AS steps
  FROM placed p JOIN up ON p.lang IS NOT DISTINCT FROM up.lang LEFT JOIN own ON p.lang IS NOT DISTINCT FROM own.lang AND p.pos = own.pos
), back AS (
  SELECT doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(list_filter(steps, lambda x: x <> '-'), lambda x: x[2:]), '')) AS proof_sha256,
         list_reduce(list_prepend(start, steps), lambda a, x: CASE WHEN x = '-' THEN sha256(a) WHEN x[1] = 'L' THEN sha256(x[2:] || a) ELSE sha256(a || x[2:]) END) AS folded_root
  FROM joined
)
SELECT *, folded_root = root AS verified FROM back
"""

OP12_SQL = """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS k, vec_id, embedding::DOUBLE[] AS x FROM embeddings
), ok AS (
  SELECT * FROM v WHERE len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0
), linked AS (
  SELECT a.k AS a, b.k AS b FROM ok a JOIN ok b ON a.k <> b.k AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.9
), reached AS (
  SELECT k AS a, k AS b FROM v UNION SELECT r.a, l.b FROM reached r JOIN linked l ON r.b = l.a
), classes AS (SELECT a, min(v.vec_id) AS component_id FROM reached JOIN v ON v.k = b GROUP BY a),
degrees AS (SELECT a, count(*) AS n FROM linked GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN classes ON classes.a = k LEFT JOIN degrees ON degrees.a = k
"""

_SHARE = "1 + (1000000000::HUGEINT * ({} + 5)) // ({} + 5 * terms)"

OP13_SQL = rf"""
WITH d AS (
  SELECT coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS k FROM documents
), w AS (
  SELECT k, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS whole FROM w GROUP BY lang, term HAVING count(DISTINCT k) >= 30
), v AS (SELECT lang, count(*) AS terms, sum(whole) AS lang_total FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
cells AS (
  SELECT lang, source, term, coalesce(n, 0) AS n, {_SHARE.format("coalesce(n, 0)", "coalesce(total, 0)")} AS p, {_SHARE.format("whole", "lang_total")} AS q
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN t USING (lang, source) LEFT JOIN c USING (lang, source, term)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN cells x ON x.lang = a.lang AND x.source = a.source LEFT JOIN cells y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
  GROUP BY a.lang, a.source, b.source
), ranked AS (
  SELECT lang, source, 'pair' AS part, item, value, 1000000000 AS most FROM pairs
  UNION ALL SELECT lang, source, 'term', term, p - q, 50 FROM cells WHERE n > 0 AND p > q
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM ranked
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM numbered WHERE rank <= most
"""

ORACLE_SQL: dict[str, str] = {"op7_substring_dedup": OP7_SQL, "op9_license_scan": licenses.oracle(), "op11_merkle": OP11_SQL, "op12_nn_descent": OP12_SQL, "op13_divergence": OP13_SQL}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
