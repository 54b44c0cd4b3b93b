"""Queries of word places, cast checks, indexes, state, gates and assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import bookkeeping
from lectern.plans import script_queries
from lectern.plans.common import SEGMENTS_SQL, segments, table


def word_rows(spark: SparkSession, d: str) -> DataFrame:
    return bookkeeping.word_rows(table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("key"), "text"), "key")


def _members(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    k = F.col("n_nationkey")
    return n.select(F.col("n_regionkey").alias("book_id"), k.cast("long").alias("ordinal"), F.col("n_name").alias("name"), F.array(F.concat(F.upper("n_name"), F.lit(".")), F.concat(F.lit("shared "), (k % 2).cast("string")), F.lit("...")).alias("aliases"), F.when(k % 4 == 0, "").otherwise("d").alias("description"), F.when(k % 3 != 0, "v").alias("voice"))


def cast_problems(spark: SparkSession, d: str) -> DataFrame:
    return bookkeeping.cast_problems(_members(spark, d))


def named_members(spark: SparkSession, d: str) -> DataFrame:
    """Speakers by name, by aliases that several members have or that are another's name, in other letters, and unknown; some books have a narrator."""
    k = F.col("n_nationkey")
    n = table(spark, d, "nation")
    members = n.select(F.col("n_regionkey").alias("book_id"), k.cast("long").alias("ordinal"), F.col("n_name").alias("name"), F.array(F.concat(F.lit("shared "), (k % 2).cast("string")), F.when(k % 3 == 0, "FRANCE").when(k % 7 == 1, "Narrator").otherwise("old one")).alias("aliases"))
    s = table(spark, d, "supplier").join(n, F.col("s_nationkey") == k)
    which = F.col("s_suppkey") % 6
    asked = F.when(which == 0, F.col("n_name")).when(which == 1, F.concat(F.lit("shared "), (F.col("s_suppkey") % 2).cast("string"))).when(which == 2, F.lower("n_name")).when(which == 3, "FRANCE").when(which == 4, "old one")
    return bookkeeping.named_members(s.select("s_suppkey", F.col("n_regionkey").alias("book_id"), asked.alias("speaker")), members).select("s_suppkey", "speaker", "member")


def merge_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return script_queries.cast_upsert(spark, d).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def hash_index(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem")
    chunks = l.select(F.format_string("%08d", "l_orderkey").alias("path"), F.col("l_linenumber").alias("place"), F.when(F.col("l_partkey") % 9 != 0, F.concat(F.lit("h"), "l_partkey")).alias("hash"), F.when(F.col("l_suppkey") % 7 != 0, F.col("l_suppkey")).alias("script_idx"))
    return bookkeeping.hash_index(chunks)


def latest_changes(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return bookkeeping.latest_change(o.select(F.concat(F.lit("w/c"), (F.col("o_custkey") % 50).cast("string"), F.lit("/o"), "o_orderkey").alias("path"), F.col("o_orderkey").alias("changed_at")))


def changed_phases(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    phases = F.array(F.lit("extract"), F.lit("cast"), F.lit("script"), F.lit("other"))
    after = o.select(F.col("o_custkey").alias("book_id"), F.element_at(phases, (F.col("o_orderkey") % 4 + 1).cast("int")).alias("phase"), F.col("o_orderkey").cast("string").alias("path"), F.col("o_orderkey").alias("changed_at"))
    before = after.where("changed_at % 5 <> 0").withColumn("changed_at", F.when(F.col("changed_at") % 7 == 0, 0).otherwise(F.col("changed_at")))
    return bookkeeping.first_changed_phase(before, after, ["extract", "cast", "script"])


def _state(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("key"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderstatus")).alias("hash"), F.when(F.col("o_orderkey") % 3 == 0, True).when(F.col("o_orderkey") % 3 == 1, False).alias("done"))


def partial_states(spark: SparkSession, d: str) -> DataFrame:
    return bookkeeping.partial_state(_state(spark, d)).select("key", "hash")


def cleared_states(spark: SparkSession, d: str) -> DataFrame:
    s = _state(spark, d)
    return bookkeeping.without_partial(s, s.where("key % 2 = 0").select("key"))


def chapter_batches_by_voice(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    t = o.select(F.col("o_custkey").alias("book_id"), F.concat(F.lit("v"), (F.col("o_orderkey") % 3).cast("string")).alias("voice"), (F.col("o_orderkey") % 3).alias("voice_order"), F.col("o_orderkey").cast("string").alias("hash"), F.col("o_orderkey").alias("ordinal"), (F.col("o_orderkey") % 5 == 0).alias("needed"))
    return bookkeeping.chapter_batch(t, 2)


def validation_gate(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d)
    problems = s.where("chapter_idx % 2 = 0").select("chapter_idx", F.when(F.col("seg_idx") % 2 == 0, "missing").otherwise("hallucinated").alias("kind"))
    return bookkeeping.gate(problems, s)


def assembled_chapters(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem")
    sound = l.select((F.col("l_orderkey") % 40).alias("book_id"), F.col("l_orderkey").alias("chapter_idx"), F.concat_ws("-", "l_linenumber", "l_partkey", "l_quantity").alias("pos"), F.array_repeat(F.col("l_quantity"), 3).alias("samples"))
    chapters = l.groupBy((F.col("l_orderkey") % 40).alias("book_id"), F.col("l_orderkey").alias("chapter_idx")).agg(F.count_if(F.col("l_returnflag") == "R").alias("n_pending"))
    found = bookkeeping.assembled(chapters, sound, 2)
    return found.select("book_id", "chapter_idx", F.size("samples").cast("long").alias("n"), F.aggregate("samples", F.lit(0.0), lambda a, x: a + x).alias("total"))


def response_formats(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    wanted = F.when(F.col("s_suppkey") % 3 == 0, "mp3").when(F.col("s_suppkey") % 3 == 1, "")
    return s.select("s_suppkey", bookkeeping.response_format(wanted, F.when(F.col("s_suppkey") % 2 == 0, "openai").otherwise("qwen")).alias("format"))


def window_reports(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d).withColumn("instruction", F.when(F.col("seg_idx") % 2 == 0, "sad"))
    w = s.withColumn("flagged", F.col("seg_idx") == 1).withColumn("recorded", F.when(F.col("chapter_idx") % 3 == 0, F.col("seg_idx")).when(F.col("chapter_idx") % 3 == 1, F.col("seg_idx") + 2))
    return w.select("chapter_idx", "seg_idx", bookkeeping.window_lines(w).alias("lines"))


def merged_audit(spark: SparkSession, d: str) -> DataFrame:
    """Merge records appended to an audit log that has other columns."""
    a = script_queries._audit(spark, d)
    events = table(spark, d, "nation").select(F.col("n_regionkey").alias("chapter_idx"), F.lit("cast_merge").alias("kind"), F.col("n_name").alias("into"))
    return a.unionByName(events, allowMissingColumns=True)


def voice_keys(spark: SparkSession, d: str) -> DataFrame:
    """How many tasks share a voice."""
    p = table(spark, d, "part")
    preset = F.when(F.col("p_size") % 3 == 0, F.col("p_brand")).when(F.col("p_size") % 3 == 1, "")
    key = bookkeeping.voice_key(preset, F.col("p_type"), F.concat(F.lit("a"), (F.col("p_size") % 5).cast("string")), F.lit("said"))
    return p.select(key.alias("k")).groupBy("k.kind", "k.voice", "k.with").agg(F.count(F.lit(1)).alias("n"))


def reference_clips(spark: SparkSession, d: str) -> DataFrame:
    s, styles = table(spark, d, "supplier"), F.array(F.lit("sad"), F.lit("happy"))
    both = s.select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("k"), F.explode(styles).alias("emotion"))
    k = F.col("k")
    clips = both.where((k % 2 == 0) | (F.col("emotion") == "sad")).select("name", "emotion", F.concat_ws("__", "name", "emotion").alias("path"), F.md5("emotion").alias("sha"))
    base = s.where("s_suppkey % 5 <> 0").select(F.col("s_name").alias("name"), F.lit(None).cast("string").alias("emotion"), F.col("s_name").alias("path"), F.lit("base").alias("sha"))
    told = both.where(k % 3 == 0).select("name", "emotion", F.when(k % 2 == 0, "told").otherwise("").alias("ref_text"), F.when(k % 4 == 0, "told sha").alias("sha"))
    base_told = s.where("s_suppkey % 7 = 0").select(F.col("s_name").alias("name"), F.lit(None).cast("string").alias("emotion"), F.lit("base told").alias("ref_text"), F.lit("x").alias("sha"))
    lines = spark.createDataFrame([("sad", "a sad line"), ("happy", "")], "emotion string, line string")
    return bookkeeping.voice_references(both.select("name", "emotion"), clips.unionByName(base), told.unionByName(base_told), lines, "the sample")


def audit_contexts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select(F.col("doc_id").alias("chapter_idx"), "text")
    lines = F.split("text", "\n", -1)
    entries = t.select("chapter_idx", F.when(F.col("chapter_idx") % 10 == 0, F.element_at(lines, -1)).otherwise("not there").alias("text"), F.when(F.col("chapter_idx") % 3 == 0, "saved").alias("source_span"))
    return bookkeeping.audit_contexts(entries, t, 0, 1).select("chapter_idx", F.md5("context").alias("md5"))


_MEMBERS_SQL = "m AS (SELECT n_regionkey AS book_id, n_nationkey::BIGINT AS ordinal, n_name AS name, [upper(n_name) || '.', 'shared ' || (n_nationkey % 2), '...'] AS aliases, n_nationkey AS k FROM nation)"
_LABELS_SQL = f"{_MEMBERS_SQL}, l AS (SELECT book_id, ordinal, name, unnest(list_concat([name], aliases)) AS label, generate_subscripts(list_concat([name], aliases), 1) - 1 AS place FROM m), n AS (SELECT *, lower(trim(regexp_replace(label, '[.,;:]+$', ''))) AS norm FROM l)"
_STATE_SQL = "s AS (SELECT o_orderkey AS key, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS hash, CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS done FROM orders)"

QUERIES = {
    "word_rows": (
        word_rows,
        "WITH t AS (SELECT conv_id || '-' || turn AS key, regexp_extract_all(text, '[\\p{L}\\p{N}_]+') AS w, regexp_split_to_array(text, '[\\p{L}\\p{N}_]+') AS g FROM conversations), "
        "r AS (SELECT key, unnest(w) AS w, unnest(list_transform(w, lambda x, i: length(g[i]))) AS gap, generate_subscripts(w, 1) - 1 AS word_idx FROM t), "
        "e AS (SELECT *, CAST(sum(gap + length(w)) OVER (PARTITION BY key ORDER BY word_idx) AS BIGINT) AS end_char FROM r) SELECT key, word_idx, lower(w) AS word, end_char - length(w) AS start_char, end_char FROM e",
    ),
    "cast_problems": (
        cast_problems,
        f"WITH {_LABELS_SQL} SELECT book_id, ordinal, -2 AS place, 'character ' || ordinal || ' (' || name || '): missing ''description''' AS problem FROM m WHERE k % 4 = 0 "
        "UNION ALL SELECT book_id, ordinal, -1, 'character ' || ordinal || ' (' || name || '): missing ''voice''' FROM m WHERE k % 3 = 0 "
        "UNION ALL SELECT book_id, ordinal, place, 'character ''' || name || ''': alias ''' || label || ''' conflicts with its own name' FROM n WHERE place = 1 "
        "UNION ALL SELECT book_id, ordinal, place, 'character ''' || name || ''': alias ''' || label || ''' already used by ''' || owner || '''' FROM (SELECT *, first_value(name) OVER (PARTITION BY book_id, norm ORDER BY ordinal) AS owner FROM n WHERE place = 2) WHERE owner <> name",
    ),
    "named_members": (
        named_members,
        "WITH m AS (SELECT n_regionkey AS book_id, n_nationkey AS k, n_name AS name, ['shared ' || (n_nationkey % 2), CASE WHEN n_nationkey % 3 = 0 THEN 'FRANCE' WHEN n_nationkey % 7 = 1 THEN 'Narrator' ELSE 'old one' END] AS aliases FROM nation), "
        "e AS (SELECT book_id, k, 0 AS p, name AS form, name FROM m UNION ALL SELECT book_id, k, 1, aliases[1], name FROM m UNION ALL SELECT book_id, k, 2, aliases[2], name FROM m), "
        "x AS (SELECT book_id, form, name AS member FROM e QUALIFY row_number() OVER (PARTITION BY book_id, form ORDER BY k DESC, p DESC) = 1), "
        "s AS (SELECT s_suppkey, n_regionkey AS book_id, CASE s_suppkey % 6 WHEN 0 THEN n_name WHEN 1 THEN 'shared ' || (s_suppkey % 2) WHEN 2 THEN lower(n_name) WHEN 3 THEN 'FRANCE' WHEN 4 THEN 'old one' END AS speaker FROM supplier JOIN nation ON s_nationkey = n_nationkey) "
        "SELECT s_suppkey, speaker, coalesce(x.member, f.member, '') AS member FROM s LEFT JOIN x ON x.book_id = s.book_id AND x.form = s.speaker LEFT JOIN x f ON f.book_id = s.book_id AND f.form = 'Narrator'",
    ),
    "merge_outcomes": (merge_outcomes, "SELECT CASE WHEN n_nationkey % 3 <> 0 THEN 'kept' ELSE 'updated' END AS outcome, count(*) AS n FROM nation GROUP BY 1"),
    "hash_index": (hash_index, "SELECT 'h' || l_partkey AS hash, arg_min(printf('%08d', l_orderkey), (l_orderkey, l_linenumber)) AS path, arg_min(l_suppkey, (l_orderkey, l_linenumber)) AS script_idx FROM (SELECT * FROM lineitem WHERE l_partkey % 9 <> 0 AND l_suppkey % 7 <> 0 QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey) = 1) GROUP BY 1"),
    "latest_changes": (latest_changes, "SELECT 'w/c' || (o_custkey % 50) AS folder, max(o_orderkey) AS changed_at FROM orders GROUP BY 1"),
    "changed_phases": (changed_phases, "SELECT o_custkey AS book_id, ['extract', 'cast', 'script'][min(o_orderkey % 4) + 1] AS phase FROM orders WHERE (o_orderkey % 5 = 0 OR o_orderkey % 7 = 0) AND o_orderkey % 4 < 3 GROUP BY 1"),
    "partial_states": (partial_states, f"WITH {_STATE_SQL} SELECT key, hash FROM s WHERE hash IS NOT NULL AND NOT coalesce(done, false)"),
    "cleared_states": (cleared_states, f"WITH {_STATE_SQL} SELECT * FROM s WHERE coalesce(done, false) OR key % 2 <> 0"),
    "chapter_batches_by_voice": (
        chapter_batches_by_voice,
        "WITH t AS (SELECT o_custkey AS book_id, o_orderkey % 3 AS v, o_orderkey AS k, o_orderkey % 5 = 0 AS needed FROM orders), f AS (SELECT book_id, min(v) AS v FROM t WHERE needed GROUP BY 1) "
        "SELECT book_id, k::VARCHAR AS hash, 'v' || v AS voice, needed FROM t JOIN f USING (book_id, v) QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY needed DESC, k) <= 2",
    ),
    "validation_gate": (validation_gate, f"WITH {SEGMENTS_SQL}, n AS (SELECT chapter_idx, count(*) FILTER (chapter_idx % 2 = 0 AND seg_idx % 2 = 0) AS n_missing, count(*) FILTER (chapter_idx % 2 = 0 AND seg_idx % 2 <> 0) AS n_hallucinated FROM segments GROUP BY 1) SELECT *, n_missing + n_hallucinated = 0 AS passed FROM n"),
    "assembled_chapters": (
        assembled_chapters,
        "WITH c AS (SELECT l_orderkey % 40 AS book_id, l_orderkey AS chapter_idx, count(*) FILTER (l_returnflag = 'R') AS n_pending, count(*) AS parts, sum(l_quantity) * 3 AS total FROM lineitem GROUP BY ALL), "
        "f AS (SELECT book_id, min(chapter_idx) AS first_open FROM c WHERE n_pending > 0 GROUP BY 1) SELECT book_id, chapter_idx, 3 * parts + 2 * (parts - 1) AS n, total FROM c LEFT JOIN f USING (book_id) WHERE first_open IS NULL OR chapter_idx < first_open",
    ),
    "response_formats": (response_formats, "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'mp3' WHEN s_suppkey % 2 = 0 THEN 'pcm' ELSE 'wav' END AS format FROM supplier"),
    "window_reports": (
        window_reports,
        "SELECT conv_id AS chapter_idx, turn AS seg_idx, '  ' || CASE WHEN turn = 1 THEN '>' ELSE ' ' END || ' ' || lpad(turn::VARCHAR, 4, ' ') || ' (' || role || CASE WHEN turn % 2 = 0 THEN '/sad' ELSE '' END || '): ' || "
        "CASE WHEN length(trim(replace(text, chr(10), ' '))) > 80 THEN substr(trim(replace(text, chr(10), ' ')), 1, 77) || '...' ELSE trim(replace(text, chr(10), ' ')) END || CASE WHEN turn = 1 AND conv_id % 3 = 1 THEN chr(10) || '       (recorded as seg 3; script re-split since)' ELSE '' END AS lines FROM conversations",
    ),
    "voice_keys": (voice_keys, "SELECT CASE WHEN p_size % 3 = 0 THEN 'preset' ELSE 'reference' END AS kind, CASE WHEN p_size % 3 = 0 THEN p_brand ELSE 'a' || (p_size % 5) END AS voice, CASE WHEN p_size % 3 = 0 THEN p_type ELSE 'said' END AS \"with\", count(*) AS n FROM part GROUP BY ALL"),
    "reference_clips": (
        reference_clips,
        "WITH b AS (SELECT s_name AS name, s_suppkey AS k, e AS emotion, s_suppkey % 2 = 0 OR e = 'sad' AS styled FROM supplier, (SELECT unnest(['sad', 'happy']) AS e)) "
        "SELECT name, emotion, CASE WHEN styled THEN name || '__' || emotion WHEN k % 5 <> 0 THEN name END AS path, "
        "coalesce(CASE WHEN styled THEN CASE WHEN k % 6 = 0 THEN 'told' WHEN emotion = 'sad' THEN 'a sad line' END WHEN k % 7 = 0 THEN 'base told' END, 'the sample') AS ref_text, "
        "CASE WHEN k % 12 = 0 THEN 'told sha' WHEN styled THEN md5(emotion) WHEN k % 5 <> 0 THEN 'base' ELSE '' END AS sha FROM b",
    ),
    "audit_contexts": (
        audit_contexts,
        f"WITH t AS (SELECT doc_id AS chapter_idx, text, regexp_replace(string_split(text, chr(10))[-1], '^\\s+|\\s+$', '', 'g') AS w FROM documents), p AS (SELECT *, CASE WHEN chapter_idx % 10 = 0 AND w <> '' THEN strpos(text, w) ELSE 0 END AS k FROM t), "
        "c AS (SELECT chapter_idx, CASE WHEN k > 0 THEN string_split(text[1:k - 1], chr(10))[-1] || w || CASE WHEN contains(text[k + length(w):], chr(10)) THEN string_split(text[k + length(w):], chr(10))[1] || chr(10) ELSE text[k + length(w):] END END AS c, chapter_idx % 3 = 0 AS saved, k, length(string_split(text[1:k - 1], chr(10))[1]) AS h, len(string_split(text[1:k - 1], chr(10))) AS n FROM p) "
        "SELECT chapter_idx, md5(coalesce(CASE WHEN n = 2 AND h = 0 THEN chr(10) || c ELSE c END, CASE WHEN saved THEN 'saved' ELSE '' END)) AS md5 FROM c",
    ),
    "merged_audit": (merged_audit, f"WITH {script_queries.AUDIT_SQL} SELECT chapter_idx, seg_idx, kind, phase, NULL AS into FROM audit UNION ALL SELECT n_regionkey, NULL, 'cast_merge', NULL, n_name FROM nation"),
}
