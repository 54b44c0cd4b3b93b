"""Scalar text and predicate queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions.constants import EMOTIONS, RETAINED_SPEAKERS
from lectern.operators import timing
from lectern.plans.common import PARAGRAPHS_SQL, SEGMENTS_SQL, paragraphs, segments, table

_WS = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_STRIP = lambda x: f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def is_speakable(spark: SparkSession, d: str) -> DataFrame:
    return paragraphs(spark, d).select("doc_id", "para_idx", X.is_speakable(F.col("text")).alias("speakable"))


def voiced_segments(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d).withColumn("speaker", F.when(F.col("speaker") == "system", "Retained").otherwise(F.col("speaker")))
    return s.where(X.is_voiced(F.col("speaker")) & X.is_speakable(F.col("text")))


def normalize_tts_text(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d).withColumn("line", F.concat(F.element_at(F.array(F.lit("-- "), F.lit("— "), F.lit(" ‒− "), F.lit("")), (F.col("seg_idx") % 4 + 1).cast("int")), "text"))
    return s.select("chapter_idx", "seg_idx", X.normalize_tts_text(F.col("line")).alias("spoken"), X.normalize_tts_text(F.lit(" -- ")).alias("dashes"))


def quotes(spark: SparkSession, d: str) -> DataFrame:
    forms = F.array(F.concat(F.lit(' "'), "text", F.lit('" ')), F.concat(F.lit("“"), "text", F.lit("”")), F.concat(F.lit("'"), "text"), F.concat(F.lit("‘ "), "text", F.lit(" ’")), F.concat(F.lit('He said "'), "text", F.lit('" twice')))
    s = segments(spark, d).withColumn("line", F.element_at(forms, (F.col("seg_idx") % 5 + 1).cast("int")))
    line = F.col("line")
    return s.select("chapter_idx", "seg_idx", X.strip_wrapping_quotes(line).alias("unwrapped"), X.strip_boundary_quotes(line).alias("bare"), X.is_mixed_quote(line).alias("mixed"))


def titles(spark: SparkSession, d: str) -> DataFrame:
    title = F.substring_index("text", "\n", 1)
    return table(spark, d, "documents").select(
        "doc_id",
        X.filename_base(F.col("doc_id"), title).alias("filename_base"),
        X.book_slug(title).alias("slug"),
        X.safe_title(title).alias("safe_title"),
        X.safe_label(title).alias("safe_label"),
        X.truncate(title).alias("truncated"),
    )


def escapes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(X.escape_metadata(F.col("text"))).alias("metadata_md5"), F.md5(X.escape_markup(F.col("text"))).alias("markup_md5"))


def word_counts(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.size(X.words(text)).cast("long").alias("n_words"), F.size(X.word_tokens(text)).cast("long").alias("n_tokens"), F.md5(X.collapsed(text)).alias("collapsed_md5"), F.md5(X.without_space(text)).alias("packed_md5"))


def timestamps(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", X.format_ts(F.col("value")).alias("srt"), X.clock(F.col("value") * 97).alias("clock"), X.format_ts(F.col("value") - 20, ".").alias("clamped"))


def parsed_times(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("s", F.concat((F.col("user_id") % 50).cast("string"), F.element_at(F.array(F.lit(":05"), F.lit(".5"), F.lit(":7.25"), F.lit(":00:01"), F.lit("s")), (F.col("event_id") % 5 + 1).cast("int"))))
    return e.select("event_id", X.parse_time(F.col("s")).alias("seconds"))


def emotions(spark: SparkSession, d: str) -> DataFrame:
    raw = F.element_at(F.array(*map(F.lit, ("Happy", "very sad tone", "", "whisper", "grim", " STERN ", "angry and excited"))), (F.col("event_id") % 7 + 1).cast("int"))
    e = table(spark, d, "events").withColumn("instruction", raw)
    return e.select("event_id", X.resolve_emotion(F.col("instruction")).alias("emotion"), X.valid_instruction(F.col("instruction")).alias("fixed"))


def names(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").withColumn("label", F.concat(F.lit("  "), F.col("c_name"), F.lit(" .,;"))).withColumn("aliases", F.array(F.col("c_mktsegment"), F.substring("c_mktsegment", 1, 3), F.lit("x")))
    return c.select("c_custkey", X.normalize_name(F.col("label")).alias("normal"), X.shortest_label(F.col("c_name"), F.col("aliases")).alias("display"))


def thinking(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d).withColumn("reply", F.concat(F.lit("<think> weigh\nit </think>"), "text", F.lit("<reasoning>b</reasoning> ")))
    return s.select("chapter_idx", "seg_idx", X.without_thinking(F.col("reply")).alias("answer"), X.thinking(F.col("reply")).alias("reasons"))


def chapter_ranges(spark: SparkSession, d: str) -> DataFrame:
    spec = F.concat_ws(",", F.concat(F.col("p_size") % 4, F.lit("-"), F.col("p_size") % 7), F.col("p_size").cast("string"), F.lit("2"))
    return table(spark, d, "part").select("p_partkey", F.posexplode(X.chapter_range(spec)).alias("pos", "chapter")).select("p_partkey", F.col("pos").cast("long").alias("pos"), F.col("chapter").cast("long").alias("chapter"))


def context_windows(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    lines = F.split("text", "\n", -1)
    # literal last lines, first lines with other white space, and what does not occur
    needle = F.when(F.col("doc_id") % 3 == 0, F.element_at(lines, -1)).when(F.col("doc_id") % 3 == 1, F.replace(F.get(lines, F.lit(0)), F.lit(" "), F.lit("\n "))).otherwise("no such words")
    return t.select("doc_id", F.md5(X.focused_context(F.col("text"), needle, 1, 1)).alias("context_md5"))


def long_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents with enough words to be chapters, numbered densely."""
    t = table(spark, d, "documents").where(F.size(X.words(F.col("text"))) >= 50)
    numbered = timing.with_running_start(t.select("source", "doc_id"), "before", F.lit(1), 0, "source", "doc_id")
    return numbered.select("source", "doc_id", (F.col("before") + 1).cast("long").alias("chapter_idx"))


_TS = lambda v, hour, mark: f"printf('{hour}:%02d:%02d{mark}%03d', ({v}) // 3600000, (({v}) // 60000) % 60, (({v}) // 1000) % 60, ({v}) % 1000)"
_MS = lambda v: f"CAST(round_even(greatest({v}, 0.0) * 1000, 0) AS BIGINT)"
_EMO = "[" + ", ".join(f"'{e}'" for e in EMOTIONS) + "]"
_TITLE = "split_part(text, chr(10), 1)"

TITLES_SQL = rf"""
WITH t AS (SELECT doc_id, {_TITLE} AS t FROM documents),
c AS (SELECT *, regexp_replace(t, '[<>:"/\\|?*\x00-\x1f]', '_', 'g') AS safe, regexp_replace(t, '[^\p{{L}}\p{{N}} _-]', '', 'g') AS kept, {_STRIP('t')} AS line FROM t)
SELECT doc_id, printf('%02d_', doc_id) || substr(replace({_STRIP('safe')}, ' ', '_'), 1, 50) AS filename_base,
  coalesce(nullif(regexp_replace(lower({_STRIP('kept')}), '[\s_]+', '-', 'g'), ''), 'untitled') AS slug,
  kept AS safe_title, substr(regexp_replace(t, '[^\p{{L}}\p{{N}}_-]', '_', 'g'), 1, 64) AS safe_label,
  CASE WHEN length(line) > 80 THEN substr(line, 1, 77) || '...' ELSE line END AS truncated
FROM c"""

QUERIES = {
    "is_speakable": (is_speakable, f"WITH {PARAGRAPHS_SQL} SELECT doc_id, para_idx, regexp_matches(text, '[\\p{{L}}\\p{{N}}]') AS speakable FROM paragraphs"),
    "voiced_segments": (
        voiced_segments,
        f"WITH {SEGMENTS_SQL}, r AS (SELECT * REPLACE (CASE WHEN speaker = 'system' THEN 'Retained' ELSE speaker END AS speaker) FROM segments) "
        f"SELECT * FROM r WHERE speaker NOT IN {RETAINED_SPEAKERS} AND regexp_matches(text, '[\\p{{L}}\\p{{N}}]')",
    ),
    "normalize_tts_text": (
        normalize_tts_text,
        f"WITH {SEGMENTS_SQL}, l AS (SELECT *, ['-- ', '— ', ' ‒− ', ''][seg_idx % 4 + 1] || text AS line FROM segments) "
        r"SELECT chapter_idx, seg_idx, coalesce(nullif(regexp_replace(line, '^[\s\-\x{2010}-\x{2015}\x{2212}]+', ''), ''), line) AS spoken, ' -- ' AS dashes FROM l",
    ),
    "quotes": (
        quotes,
        f"WITH {SEGMENTS_SQL}, l AS (SELECT *, [' \"' || text || '\" ', '“' || text || '”', '''' || text, '‘ ' || text || ' ’', 'He said \"' || text || '\" twice'][seg_idx % 5 + 1] AS line FROM segments), "
        f"s AS (SELECT *, {_STRIP('line')} AS st FROM l) "
        f"SELECT chapter_idx, seg_idx, CASE WHEN length(st) >= 2 AND ((st[1] = '\"' AND st[-1] = '\"') OR (st[1] = '''' AND st[-1] = '''') OR (st[1] = '“' AND st[-1] = '”') OR (st[1] = '‘' AND st[-1] = '’')) THEN {_STRIP('st[2:-2]')} ELSE line END AS unwrapped, "
        "regexp_replace(line, '^[\\s\"''“”‘’]+|[\\s\"''“”‘’]+$', '', 'g') AS bare, "
        "regexp_matches(line, '\"[^\"]*\"|“[^”]*”') AND regexp_matches(regexp_replace(line, '\"[^\"]*\"|“[^”]*”', '', 'g'), '[\\p{L}\\p{N}_]') AS mixed FROM s",
    ),
    "titles": (titles, TITLES_SQL),
    "escapes": (
        escapes,
        "SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '=', '\\='), ';', '\\;'), '#', '\\#'), '\\', '\\\\'), chr(10), '\\' || chr(10))) AS metadata_md5, "
        "md5(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')) AS markup_md5 FROM documents",
    ),
    "word_counts": (
        word_counts,
        f"SELECT doc_id, len(list_filter(regexp_split_to_array(text, '{_WS}+'), lambda x: x <> '')) AS n_words, len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS n_tokens, "
        f"md5(trim(regexp_replace(text, '{_WS}+', ' ', 'g'))) AS collapsed_md5, md5(regexp_replace(text, '{_WS}+', '', 'g')) AS packed_md5 FROM documents",
    ),
    "timestamps": (timestamps, f"SELECT event_id, {_TS(_MS('value'), '%02d', ',')} AS srt, {_TS(_MS('value * 97'), '%d', '.')} AS clock, {_TS(_MS('value - 20'), '%02d', '.')} AS clamped FROM events"),
    "parsed_times": (
        parsed_times,
        "WITH e AS (SELECT event_id, CAST(user_id % 50 AS VARCHAR) || [':05', '.5', ':7.25', ':00:01', 's'][event_id % 5 + 1] AS s FROM events) "
        r"SELECT event_id, CASE WHEN regexp_matches(s, '^(?:(\d+):)?(\d+(?:\.\d+)?)$') THEN coalesce(TRY_CAST(nullif(regexp_extract(s, '^(?:(\d+):)?(\d+(?:\.\d+)?)$', 1), '') AS DOUBLE), 0) * 60 + TRY_CAST(regexp_extract(s, '^(?:(\d+):)?(\d+(?:\.\d+)?)$', 2) AS DOUBLE) END AS seconds FROM e",
    ),
    "emotions": (
        emotions,
        "WITH e AS (SELECT event_id, ['Happy', 'very sad tone', '', 'whisper', 'grim', ' STERN ', 'angry and excited'][event_id % 7 + 1] AS i FROM events), l AS (SELECT *, lower(trim(i)) AS low FROM e) "
        f"SELECT event_id, CASE WHEN low = '' THEN 'neutral' WHEN list_contains({_EMO}, low) THEN low ELSE coalesce(list_filter({_EMO}, lambda e: contains(low, e) OR contains(e, low))[1], 'neutral') END AS emotion, "
        f"CASE WHEN i <> '' AND NOT list_contains({_EMO}, i) THEN 'neutral' ELSE i END AS fixed FROM l",
    ),
    "names": (
        names,
        "WITH c AS (SELECT *, '  ' || c_name || ' .,;' AS label, [c_name, c_mktsegment, c_mktsegment[1:3], 'x'] AS ls FROM customer) "
        "SELECT c_custkey, lower(trim(regexp_replace(regexp_replace(trim(label), '[.,;:]+$', ''), '\\s+', ' ', 'g'))) AS normal, "
        "list_filter(ls, lambda x: length(x) = list_min(list_transform(list_filter(ls, lambda y: length(y) >= 2), lambda y: length(y))))[1] AS display FROM c",
    ),
    "thinking": (thinking, f"WITH {SEGMENTS_SQL} SELECT chapter_idx, seg_idx, {_STRIP('text')} AS answer, 'weigh' || chr(10) || 'it' || chr(10) || 'b' AS reasons FROM segments"),
    "chapter_ranges": (
        chapter_ranges,
        "WITH s AS (SELECT p_partkey, list_concat(CASE WHEN p_size % 4 <= p_size % 7 THEN generate_series(p_size % 4, p_size % 7) ELSE [] END, [p_size, 2]) AS cs FROM part) "
        "SELECT p_partkey, generate_subscripts(cs, 1) - 1 AS pos, CAST(unnest(cs) AS BIGINT) AS chapter FROM s",
    ),
    "context_windows": (
        context_windows,
        rf"WITH t AS (SELECT doc_id, text, {_STRIP("CASE doc_id % 3 WHEN 0 THEN string_split(text, chr(10))[-1] WHEN 1 THEN replace(string_split(text, chr(10))[1], ' ', chr(10) || ' ') ELSE 'no such words' END")} AS w, doc_id % 3 = 0 AND string_split(text, chr(10))[-1] = '' OR doc_id % 3 = 1 AND string_split(text, chr(10))[1] = '' AS none FROM documents), "
        r"p AS (SELECT *, CASE WHEN strpos(text, w) > 0 THEN strpos(text, w) ELSE strpos(regexp_replace(text, '\s+', ' ', 'g'), regexp_replace(w, '\s+', ' ', 'g')) END AS k FROM t), "
        "h AS (SELECT *, string_split(text[1:k - 1], chr(10)) AS up, string_split(text[k + length(w):], chr(10)) AS down FROM p) "
        "SELECT doc_id, md5(CASE WHEN k = 0 OR none OR text = '' THEN '' ELSE CASE WHEN len(up) = 3 AND up[1] = '' THEN chr(10) ELSE '' END || array_to_string(up[-2:], chr(10)) || text[k:k + length(w) - 1] || CASE WHEN len(down) <= 1 THEN down[1] ELSE down[1] || chr(10) END END) AS context_md5 FROM h",
    ),
    "long_documents": (
        long_documents,
        f"SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS chapter_idx FROM documents WHERE len(list_filter(regexp_split_to_array(text, '{_WS}+'), lambda x: x <> '')) >= 50",
    ),
}
