"""Reports on validations, merges and audits, refusals, paths of a work folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import artifacts, reports
from lectern.plans import script_queries, workdir_queries
from lectern.plans.common import SEGMENTS_SQL, segments, table


def merge_problems(spark: SparkSession, d: str) -> DataFrame:
    """Merges that suppliers ask for, an answer per nation: empty names, a survivor among the sources, sources folded twice."""
    s = F.col("s_suppkey")
    name = lambda m: F.concat(F.lit("O'Neil "), (s % m).cast("string"))
    into = F.when(s % 7 == 0, " . ").when(s % 7 == 1, F.concat(F.lit("Name "), (s % 3).cast("string"))).otherwise(name(4))
    sources = F.array(F.concat(F.lit("name "), (s % 3).cast("string"), F.lit(".")), F.when(s % 5 == 0, " ").otherwise(name(5)), F.upper(name(4)))
    return reports.merge_problems(table(spark, d, "supplier").select("s_nationkey", F.col("s_suppkey").alias("ordinal"), into.alias("into"), sources.alias("sources")), "s_nationkey")


def hallucinated_reports(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d)
    found = s.select("chapter_idx", (F.col("seg_idx") * 2).alias("seg_idx"))
    return reports.hallucinated_report(found, s)


def _entries(spark: SparkSession, d: str) -> DataFrame:
    """Audit entries of conversations as books, of every kind and with fields left out."""
    s = segments(spark, d)
    k = F.col("seg_idx")
    both = F.col("chapter_idx") + k
    kind = F.element_at(F.array(*map(F.lit, ("flag", "edit", "validation", "hallucination", "cast_merge", "other"))), (both % 6 + 1).cast("int"))
    part = F.struct(F.when(k % 2 == 0, F.col("speaker")).alias("speaker"), F.lit("sad").alias("instruction"), F.when(k % 3 == 0, F.substring("text", 1, 30)).alias("text"))
    whole = F.struct(F.col("speaker").alias("speaker"), F.lit("happy").alias("instruction"), F.substring("text", 1, 12).alias("text"))
    return s.select(
        F.col("chapter_idx").alias("book_id"), k.alias("ordinal"), F.when(both % 13 != 0, kind).alias("kind"), F.concat(F.lit("ch"), k.cast("string")).alias("chapter"), k.alias("segment"),
        F.when(k % 5 != 0, F.substring("text", 1, 20)).alias("reason"), F.when(both % 4 == 0, part).alias("suggested"), F.when(both % 3 == 0, whole).alias("current"),
        F.when(k % 2 == 0, k).alias("batch"), F.lit(2).alias("missing"), F.when(k % 2 == 1, 1).alias("hallucinated"), F.when(k % 2 == 0, "speaker").alias("field"), F.lit("it's").alias("before"), F.lit("x\ny").alias("after"),
        F.lit("Ann").alias("into"), F.array(F.lit("Bo"), F.lit("Cy")).alias("sources"), F.when(k % 2 == 0, F.array(F.lit("Di"))).alias("skipped"), F.lit(None).cast("long").alias("chunk"),
        F.array(*(F.concat(F.lit(f"{n} "), F.substring("text", 1, 90)) for n in range(4))).alias("missing_text"), F.when(k % 2 == 0, "tried").alias("attempted_text"), F.when(k % 3 != 0, F.substring("text", 1, 25)).alias("text"), F.when(k % 4 == 1, "one\ntwo").alias("context"),
    )


def audit_summaries(spark: SparkSession, d: str) -> DataFrame:
    e = _entries(spark, d)
    return reports.audit_summaries(e.withColumn("suggested", F.col("suggested").isNotNull()))


def audit_texts(spark: SparkSession, d: str) -> DataFrame:
    return reports.audit_texts(_entries(spark, d)).select("book_id", "ordinal", "shown")


def refusals(spark: SparkSession, d: str) -> DataFrame:
    """Chapters that a performance asks for, refused where reviewers left flags."""
    a = script_queries._audit(spark, d)
    return reports.refusals(a.where("seg_idx % 8 = 0"), a.select("chapter_idx"))


def work_paths(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    book = F.concat(F.lit("in.d/"), F.when(k % 3 == 0, F.lit(".hidden")).when(k % 3 == 1, F.concat("s_name", F.lit(".v2.epub"))).otherwise(F.col("s_name")))
    folder = artifacts.work_folder(book, F.when(k % 4 == 0, "given").when(k % 4 == 1, ""))
    one = artifacts.file_paths(folder)
    phase = F.lit("perform")
    sound = F.when(k % 2 == 0, "ch.wav").otherwise(F.concat_ws("/", folder, phase, F.lit("ch.1")))
    return s.select(
        "s_suppkey", folder.alias("folder"), *(path.alias(name) for name, path in one.items()), artifacts.phase_folder(folder, phase).alias("phase"), artifacts.segments_folder(folder, phase).alias("segments"), artifacts.rejects_folder(folder, phase).alias("rejects"),
        artifacts.state_path(folder, phase).alias("state"), artifacts.preview_path(folder, F.col("s_name"), F.lit("v1")).alias("preview"), artifacts.segments_beside(sound).alias("beside"), artifacts.wide_subtitle_path(sound).alias("vtt"),
    )


def cached_segments(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    tasks = o.select("o_orderkey", F.lit("w").alias("folder"), F.when(F.col("o_orderkey") % 2 == 0, "perform").otherwise("synthesize").alias("phase"), F.md5("o_orderpriority").alias("hash"))
    files = o.where("o_orderkey % 7 = 0 and o_orderpriority < '3'").select(F.concat(F.lit("w/perform/segments/"), F.md5("o_orderpriority"), F.lit(".wav")).alias("path"))
    return artifacts.cached(tasks, files).select("o_orderkey", "cached")


_CUT = workdir_queries._CUT
_REPR = lambda x: f"""CASE WHEN contains({x}, '''') AND NOT contains({x}, '"') THEN '"' || replace({x}, chr(10), '\\n') || '"' ELSE '''' || replace(replace({x}, chr(10), '\\n'), '''', '\\''') || '''' END"""
_NORM = lambda x: f"lower(trim(regexp_replace(regexp_replace(trim({x}), '[.,;:]+$', ''), '\\s+', ' ', 'g')))"
_KINDS = "['flag', 'edit', 'validation', 'hallucination', 'cast_merge', 'other']"
_ENTRIES_SQL = f"""{SEGMENTS_SQL}, e AS (
  SELECT chapter_idx AS book_id, seg_idx AS ordinal, seg_idx AS k, coalesce(CASE WHEN (chapter_idx + seg_idx) % 13 <> 0 THEN {_KINDS}[(chapter_idx + seg_idx) % 6 + 1] END, 'flag') AS kind, speaker, text,
    CASE WHEN seg_idx % 5 <> 0 THEN substr(text, 1, 20) ELSE '' END AS reason, (chapter_idx + seg_idx) % 4 = 0 AS suggests, (chapter_idx + seg_idx) % 3 = 0 AS has_current,
    '[' || row_number() OVER (PARTITION BY chapter_idx ORDER BY seg_idx) || '/' || count(*) OVER (PARTITION BY chapter_idx) || '] (' AS num FROM segments
), h AS (SELECT *, num || kind || ') ' AS number, num || kind || ') ch' || k || ' seg ' || k AS head, CASE WHEN k % 2 = 0 THEN k::VARCHAR ELSE '?' END AS batch, CASE WHEN k % 2 = 1 THEN 1 ELSE 0 END AS made FROM e)"""
_JSON = lambda *fields: "'  | {' || chr(10) || array_to_string(list_filter([" + ", ".join(f"CASE WHEN {cond} THEN '  |   \"{name}\": ' || to_json({value})::VARCHAR END" for name, value, cond in fields) + "], lambda x: x IS NOT NULL), ',' || chr(10)) || chr(10) || '  | }'"
_CURRENT = _JSON(("speaker", "speaker", "true"), ("instruction", "'happy'::VARCHAR", "true"), ("text", "substr(text, 1, 12)", "true"))
_SUGGESTED = _JSON(("speaker", "speaker", "k % 2 = 0"), ("instruction", "'sad'::VARCHAR", "true"), ("text", "substr(text, 1, 30)", "k % 3 = 0"))

QUERIES = {
    "merge_problems": (
        merge_problems,
        "WITH m AS (SELECT s_nationkey, s_suppkey AS ordinal, CASE s_suppkey % 7 WHEN 0 THEN ' . ' WHEN 1 THEN 'Name ' || (s_suppkey % 3) ELSE 'O''Neil ' || (s_suppkey % 4) END AS into_, ['name ' || (s_suppkey % 3) || '.', CASE WHEN s_suppkey % 5 = 0 THEN ' ' ELSE 'O''Neil ' || (s_suppkey % 5) END, upper('O''Neil ' || (s_suppkey % 4))] AS sources FROM supplier), "
        f"r AS (SELECT s_nationkey, ordinal, into_, {_NORM('into_')} AS im, unnest(sources) AS source, generate_subscripts(sources, 1) - 1 AS place FROM m WHERE {_NORM('into_')} <> ''), n AS (SELECT *, {_NORM('source')} AS norm FROM r), "
        "w AS (SELECT *, row_number() OVER x AS k, first_value(into_) OVER x AS f FROM n WHERE norm <> '' WINDOW x AS (PARTITION BY s_nationkey, norm ORDER BY ordinal, place)) "
        f"SELECT s_nationkey, ordinal, -1 AS place, 'merge ' || ordinal || ': ''into'' is empty after normalization' AS problem FROM m WHERE {_NORM('into_')} = '' UNION ALL SELECT s_nationkey, ordinal, place, 'merge ' || ordinal || ': empty entry in ''from''' FROM n WHERE norm = '' "
        f"UNION ALL SELECT s_nationkey, ordinal, place, 'merge ' || ordinal || ': ''from'' entry ' || {_REPR('source')} || ' equals ''into'' ' || {_REPR('into_')} FROM n WHERE norm = im AND norm <> '' UNION ALL SELECT s_nationkey, ordinal, place, 'merge ' || ordinal || ': ' || {_REPR('source')} || ' already folded into ' || {_REPR('f')} FROM w WHERE k > 1",
    ),
    "hallucinated_reports": (
        hallucinated_reports,
        f"WITH {SEGMENTS_SQL} SELECT a.chapter_idx, a.seg_idx, '[hallucinated #' || a.seg_idx || '] ' || a.speaker || ': \"' || {_CUT('a.text', 60)} || '\"' || chr(10) || '  no matching text found in source' AS report FROM segments a WHERE a.seg_idx % 2 = 0 AND EXISTS (SELECT 1 FROM segments b WHERE b.chapter_idx = a.chapter_idx AND b.seg_idx * 2 = a.seg_idx)",
    ),
    "audit_summaries": (
        audit_summaries,
        f"WITH {_ENTRIES_SQL} SELECT book_id, ordinal, CASE kind WHEN 'cast_merge' THEN number || 'Bo, Cy -> Ann' WHEN 'flag' THEN head || CASE WHEN suggests THEN ' [+suggestion]' ELSE '' END || ': ' || reason WHEN 'validation' THEN head || ': batch ' || batch || ' rejected (2 missing, ' || made || ' hallucinated)' "
        f"WHEN 'hallucination' THEN head || ': LLM tried to rewrite text' ELSE head || ': ' || CASE WHEN k % 2 = 0 THEN 'speaker' ELSE '?' END || ' \"it''s\" -> ''x\\ny''' END AS summary FROM h",
    ),
    "audit_texts": (
        audit_texts,
        f"WITH {_ENTRIES_SQL} SELECT book_id, ordinal, chr(10) || CASE kind WHEN 'cast_merge' THEN concat_ws(chr(10), number || 'batch ' || batch || ' chunk ?', '  into: Ann', '  from: Bo, Cy', CASE WHEN k % 2 = 0 THEN '  skipped: Di' END, CASE WHEN reason <> '' THEN '  reason: ' || reason END) "
        f"ELSE concat_ws(chr(10), head, CASE kind WHEN 'flag' THEN '  reason: ' || reason WHEN 'edit' THEN '  ' || CASE WHEN k % 2 = 0 THEN 'speaker' ELSE '?' END || ': \"it''s\" -> ''x\\ny''' WHEN 'validation' THEN concat_ws(chr(10), '  batch ' || batch || ' rejected: 2 missing, ' || made || ' hallucinated', "
        + ", ".join(f"'    missing: ' || {_CUT(f"({chr(39)}{n} {chr(39)} || substr(text, 1, 90))", 80)}" for n in range(3))
        + ") WHEN 'hallucination' THEN concat_ws(chr(10), '  reason: ' || reason, CASE WHEN k % 2 = 0 THEN '  attempted_text: tried' END) END, "
        f"CASE WHEN k % 3 <> 0 AND text <> '' THEN '  text: ' || substr(text, 1, 25) END, CASE WHEN suggests AND has_current THEN '  current:' || chr(10) || {_CURRENT} END, CASE WHEN suggests THEN '  suggested:' || chr(10) || {_SUGGESTED} END, "
        "CASE WHEN k % 4 = 1 THEN concat_ws(chr(10), '  --- source context ---', '  | one', '  | two', '  --- end source context ---') END) END AS shown FROM h",
    ),
    "refusals": (refusals, f"WITH {script_queries.AUDIT_SQL} SELECT chapter_idx, count(*) FILTER (kind = 'flag' AND seg_idx % 8 = 0) AS n_flags, n_flags > 0 AS refused FROM audit GROUP BY 1"),
    "work_paths": (
        work_paths,
        "WITH f AS (SELECT s_suppkey, s_name, CASE WHEN s_suppkey % 4 = 0 THEN 'given' ELSE 'in.d/' || CASE s_suppkey % 3 WHEN 0 THEN '.hidden' WHEN 1 THEN s_name || '.v2' ELSE s_name END || '_output' END AS folder FROM supplier) "
        "SELECT s_suppkey, folder, folder || '/audit/audit.json' AS audit, folder || '/audition/voices.json' AS voices, folder || '/cast/characters.json' AS cast, folder || '/extract/metadata.json' AS metadata, folder || '/extract/cover.jpg' AS cover, folder || '/perform' AS phase, folder || '/perform/segments' AS segments, "
        "folder || '/perform/rejected' AS rejects, folder || '/perform/state.json' AS state, folder || '/audition/presets/' || s_name || '__v1.wav' AS preview, CASE WHEN s_suppkey % 2 = 0 THEN 'segments' ELSE folder || '/perform/segments' END AS beside, CASE WHEN s_suppkey % 2 = 0 THEN 'ch.vtt' ELSE folder || '/perform/ch.vtt' END AS vtt FROM f",
    ),
    "cached_segments": (
        cached_segments,
        "SELECT o_orderkey, o_orderkey % 2 = 0 AND o_orderpriority IN (SELECT o_orderpriority FROM orders WHERE o_orderkey % 7 = 0 AND o_orderpriority < '3') AS cached FROM orders",
    ),
}
