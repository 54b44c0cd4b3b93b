"""Model reply, generation, package and streaming queries."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import audio, generation, replies
from lectern.operators.incremental import content_hash
from lectern.operators.script import split_is_faithful
from lectern.plans.common import SEGMENTS_SQL, segments, table
from lectern.sources import epub
from lectern.streaming import narration


def _script_replies(spark: SparkSession, d: str) -> DataFrame:
    """Replies that hold the segments of a conversation: fenced or bare, full or short keys, some with a trailing comma."""
    s = segments(spark, d)
    full = F.to_json(F.struct("speaker", "text", F.lit("sad").alias("instruction")))
    short = F.to_json(F.struct(F.col("speaker").alias("s"), F.col("text").alias("t")))
    rows = s.withColumn("item", F.when(F.col("chapter_idx") % 2 == 0, full).otherwise(short)).groupBy("chapter_idx").agg(F.sort_array(F.collect_list(F.struct("seg_idx", "item"))).alias("i"))
    body = F.array_join("i.item", ",\n")
    forms = F.array(F.concat(F.lit('```json\n{"segments": ['), body, F.lit("]}\n```")), F.concat(F.lit("["), body, F.lit(",]")), F.concat(F.lit('<think>so</think>{"script": ['), body, F.lit("]} done")))
    return rows.select("chapter_idx", F.element_at(forms, (F.col("chapter_idx") % 3 + 1).cast("int")).alias("content"))


def script_replies(spark: SparkSession, d: str) -> DataFrame:
    parsed = replies.parsed_replies(_script_replies(spark, d), "chapter_idx", "content")
    return replies.script_rows(parsed, "chapter_idx").select("chapter_idx", "seg_idx", "speaker", F.md5("text").alias("md5"), "instruction")


def repair_commas(spark: SparkSession, d: str) -> DataFrame:
    r = table(spark, d, "events").select("event_id", F.concat(F.lit("[1, 2,"), F.repeat(F.lit(" "), (F.col("event_id") % 3).cast("int")), F.lit("]"), F.lit(' {"a": [3,\n], }')).alias("content"))
    return r.select("event_id", replies.without_trailing_commas(F.col("content")).alias("repaired"))


def cast_replies(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    full = F.to_json(F.struct(F.col("n_name").alias("name"), F.lit("d").alias("description"), F.lit("v").alias("voice"), F.array(F.substring("n_name", 1, 3)).alias("aliases")))
    short = F.to_json(F.struct(F.col("n_name").alias("n"), F.lit("d").alias("d"), F.lit("v").alias("v"), F.array(F.substring("n_name", 1, 3)).alias("a")))
    rows = n.withColumn("item", F.when(F.col("n_regionkey") % 2 == 0, full).otherwise(short)).groupBy(F.col("n_regionkey").cast("long").alias("batch")).agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "item"))).alias("i"))
    content = F.concat(F.lit('{"characters": ['), F.array_join("i.item", ","), F.lit("]}"))
    parsed = replies.parsed_replies(rows.select("batch", content.alias("content")), "batch", "content")
    return replies.cast_rows(parsed, "batch").select("batch", "ordinal", "name", "description", "voice", F.array_join("aliases", "|").alias("aliases"))


def label_collisions(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.array(F.substring("n_name", 1, 2)).alias("aliases"))
    return replies.label_collisions(n).select("norm", F.array_join("names", "|").alias("names"))


def faithful_splits(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d).withColumn("parts", F.filter(F.split("text", r"(?<=[.!?])\s+"), lambda x: (F.col("seg_idx") % 4 != 3) | ~x.startswith("I")))
    return s.select("chapter_idx", "seg_idx", split_is_faithful(F.col("parts"), F.col("text")).alias("faithful"))


def retry_plan(spark: SparkSession, d: str) -> DataFrame:
    codes = F.array(*(F.lit(c) for c in (200, 400, 408, 425, 429, 500, 501, 504)))
    e = table(spark, d, "events").select("event_id", F.element_at(codes, (F.col("event_id") % 8 + 1).cast("int")).alias("status"), (F.col("user_id") % 5).alias("attempts"))
    return e.select("event_id", replies.retryable(F.col("status")).alias("again"), replies.backoff(F.col("attempts")).alias("waited_s"))


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """A speech event stream per user: deltas, comments, broken payloads and an end."""
    e = table(spark, d, "events").select(F.col("user_id").alias("stream_id"), "event_id", F.base64(F.encode("event_type", "utf-8")).alias("b"))
    good = F.array(F.lit(": keep-alive"), F.lit("event: speech.audio.delta"), F.concat(F.lit('data: {"audio": "'), "b", F.lit('"}')), F.lit(""))
    bad = F.array(F.lit("event: speech.audio.delta"), F.lit("data: {broken"), F.lit(""))
    done = F.array(F.lit("event: speech.audio.done"), F.lit('data: {"usage": {}}'), F.lit("\r\n"))
    lines = F.when(F.col("event_id") % 7 == 0, bad).when(F.col("event_id") % 11 == 0, done).otherwise(good)
    return e.select("stream_id", "event_id", F.posexplode(lines).alias("k", "line")).select("stream_id", F.struct("event_id", "k").alias("line_no"), "line")


def speech_events(spark: SparkSession, d: str) -> DataFrame:
    return replies.stream_events(_lines(spark, d)).groupBy("stream_id", "event").agg(F.count(F.lit(1)).alias("n"))


def speech_audio(spark: SparkSession, d: str) -> DataFrame:
    found = replies.audio_deltas(replies.stream_events(_lines(spark, d)))
    return found.groupBy("stream_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("audio")).alias("n_bytes"))


def synthesized(spark: SparkSession, d: str) -> DataFrame:
    """Every distinct line of the scripts spoken by the stand-in, takes with faults spoken again."""
    s = segments(spark, d).where(X.is_speakable(F.col("text"))).select(content_hash(F.col("speaker"), F.col("text")).alias("hash"), "text", F.col("speaker").alias("voice"), F.lit(0).alias("seed")).dropDuplicates(["hash"])

    def save(df: DataFrame) -> DataFrame:
        path = narration.shared_folder(spark)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    def generate(tasks: DataFrame) -> DataFrame:
        made = generation.synthesize(tasks, lambda: generation.tone_voice(rate=800))
        return audio.metrics(made, rate=800).withColumn("categories", audio.categories())

    spoken = generation.until_clean(s, generate, F.exists("categories", lambda c: c.isin("silent", "click", "truncated", "clipping")), save)
    return spoken.select("hash", F.size("samples").cast("long").alias("n_samples"))


def written_scripts(spark: SparkSession, d: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            made = generation.script_writer([t or "" for t in batch.column("text").to_pylist()])
            rows = [(c, k, i, s, t) for c, k, parts in zip(batch.column("chapter_idx").to_pylist(), batch.column("seg_idx").to_pylist(), made) for i, (s, t) in enumerate(parts)]
            if rows:
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:3]] + [pa.array(c) for c in columns[3:]], names=["chapter_idx", "seg_idx", "part", "speaker", "text"])

    return segments(spark, d).select("chapter_idx", "seg_idx", "text").mapInArrow(run, "chapter_idx long, seg_idx long, part long, speaker string, text string")


def book_covers(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array(F.lit("image/jpeg"), F.lit("text/css"), F.lit("image/png"))
    p = table(spark, d, "part").select(
        (F.col("p_partkey") % 200).alias("book_id"), F.col("p_partkey").alias("ordinal"),
        F.when(F.col("p_partkey") % 13 == 0, "cover-image").otherwise(F.concat(F.lit("i"), F.col("p_partkey").cast("string"))).alias("item_id"),
        F.when(F.col("p_size") % 9 == 0, "img/Cover.jpg").otherwise("img/a.jpg").alias("href"), F.element_at(kinds, (F.col("p_size") % 3 + 1).cast("int")).alias("media_type"), (F.col("p_size") == 7).alias("is_meta_cover"),
    )
    return epub.pick_cover(p).select("book_id", "ordinal", "rank")


def hosts(spark: SparkSession, d: str) -> DataFrame:
    host = F.parse_url("url", F.lit("HOST"))
    return table(spark, d, "pages").select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.when(host.contains("example"), "plain").otherwise("open").alias("dialect"))


def wav_durations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", epub.duration_ms(F.col("n_chars") * 7, F.lit(24000)).alias("ms"))


def seeds(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_id")).alias("flag"), F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("1"), F.col("user_id").cast("string"))).when(F.col("event_id") % 5 == 1, "none").alias("env"), F.when(F.col("event_id") % 2 == 0, F.lit(0)).alias("stored"))
    return e.select("event_id", F.coalesce("flag", F.col("env").try_cast("long"), F.col("stored").cast("long")).alias("seed"))


def package_parts(spark: SparkSession, d: str) -> DataFrame:
    """A package copied with parts replaced and added: an added part hides the one it is named like."""
    o = table(spark, d, "orders")
    source = o.select(F.col("o_orderkey").alias("part"), F.col("o_orderpriority").alias("body"))
    changed = o.where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("part"), F.lit("replaced").alias("new"))
    added = o.where("o_orderkey % 4 = 0").select((F.col("o_orderkey") * 2).alias("part"), F.lit("added").alias("extra"))
    joined = source.join(changed, "part", "left").join(added, "part", "full_outer")
    return joined.select("part", F.coalesce("extra", "new", "body").alias("body"))


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    found = narration.run_to_table(narration.event_windows(narration.file_stream(spark, d, "events"), "1 hour", "2 hours"))
    return found.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_completeness(spark: SparkSession, d: str) -> DataFrame:
    e = narration.file_stream(spark, d, "events")
    tasks = e.select((F.col("user_id") % 50).alias("chapter_idx"), (F.col("event_id") % 5).alias("pos"), F.lit(5).cast("long").alias("n_tasks"))
    return narration.run_to_table(narration.completeness(tasks))


def batch_windows(spark: SparkSession, d: str) -> DataFrame:
    """The same windows over the whole table at once."""
    e = table(spark, d, "events")
    g = e.groupBy(F.date_trunc("hour", "ts").alias("window_start"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


_DONE = "CASE WHEN event_id % 7 = 0 THEN 'bad' WHEN event_id % 11 = 0 THEN 'done' ELSE 'good' END"

QUERIES = {
    "script_replies": (script_replies, f"WITH {SEGMENTS_SQL} SELECT chapter_idx, seg_idx, speaker, md5(text) AS md5, CASE WHEN chapter_idx % 2 = 0 THEN 'sad' ELSE '' END AS instruction FROM segments"),
    "repair_commas": (repair_commas, "SELECT event_id, '[1, 2' || repeat(' ', event_id % 3) || '] {\"a\": [3' || chr(10) || '] }' AS repaired FROM events"),
    "cast_replies": (
        cast_replies,
        "SELECT n_regionkey::BIGINT AS batch, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS ordinal, n_name AS name, 'd' AS description, 'v' AS voice, substr(n_name, 1, 3) AS aliases FROM nation",
    ),
    "label_collisions": (
        label_collisions,
        "WITH f AS (SELECT n_name, lower(n_name) AS norm FROM nation UNION SELECT n_name, lower(trim(substr(n_name, 1, 2))) FROM nation) SELECT norm, array_to_string(list_sort(list(DISTINCT n_name)), '|') AS names FROM f GROUP BY norm HAVING count(DISTINCT n_name) > 1",
    ),
    "faithful_splits": (
        faithful_splits,
        f"WITH {SEGMENTS_SQL}, p AS (SELECT *, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS ps FROM segments), q AS (SELECT *, list_filter(ps, lambda x: seg_idx % 4 <> 3 OR NOT starts_with(x, 'I')) AS parts FROM p) "
        "SELECT chapter_idx, seg_idx, len(parts) >= 2 AND regexp_replace(array_to_string(parts, ''), '\\s+', '', 'g') = regexp_replace(text, '\\s+', '', 'g') AS faithful FROM q",
    ),
    "retry_plan": (
        retry_plan,
        "SELECT event_id, [200, 400, 408, 425, 429, 500, 501, 504][event_id % 8 + 1] IN (408, 425, 429, 500, 502, 503, 504) AS again, CASE WHEN user_id % 5 > 1 THEN 2.0 * (pow(2.0, user_id % 5 - 1) - 1) ELSE 0.0 END AS waited_s FROM events",
    ),
    "speech_events": (speech_events, f"SELECT user_id AS stream_id, CASE WHEN {_DONE} = 'done' THEN 'speech.audio.done' ELSE 'speech.audio.delta' END AS event, count(*) AS n FROM events GROUP BY 1, 2"),
    "speech_audio": (speech_audio, f"SELECT user_id AS stream_id, count(*) AS n, CAST(sum(length(event_type)) AS BIGINT) AS n_bytes FROM events WHERE {_DONE} = 'good' GROUP BY 1"),
    "synthesized": (
        synthesized,
        f"WITH {SEGMENTS_SQL} SELECT DISTINCT sha256(speaker || chr(31) || text) AS hash, CAST(greatest(1, floor(length(text) * 0.002::DOUBLE * 800)) AS BIGINT) AS n_samples FROM segments WHERE regexp_matches(text, '[\\p{{L}}\\p{{N}}]')",
    ),
    "written_scripts": (
        written_scripts,
        f"WITH {SEGMENTS_SQL}, p AS (SELECT chapter_idx, seg_idx, unnest(ps) AS t, generate_subscripts(ps, 1) AS k FROM (SELECT *, string_split(replace(replace(text, '”', '\"'), '“', '\"'), '\"') AS ps FROM segments)) "
        "SELECT chapter_idx, seg_idx, row_number() OVER (PARTITION BY chapter_idx, seg_idx ORDER BY k) - 1 AS part, CASE WHEN k % 2 = 0 THEN 'Extra Female' ELSE 'Narrator' END AS speaker, trim(t, E' \\n\\t\\r') AS text FROM p WHERE trim(t, E' \\n\\t\\r') <> ''",
    ),
    "book_covers": (
        book_covers,
        "WITH m AS (SELECT p_partkey % 200 AS book_id, p_partkey AS ordinal, CASE WHEN p_partkey % 13 = 0 THEN 1 WHEN p_size = 7 THEN 2 WHEN p_size % 3 <> 1 AND p_size % 9 = 0 THEN 3 WHEN p_size % 3 <> 1 THEN 4 END AS rank FROM part) "
        "SELECT book_id, ordinal, rank FROM m WHERE rank IS NOT NULL QUALIFY row_number() OVER (PARTITION BY book_id ORDER BY rank, ordinal) = 1",
    ),
    "hosts": (hosts, "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1) AS host, CASE WHEN contains(regexp_extract(url, '^[a-z]+://([^/:?#]*)', 1), 'example') THEN 'plain' ELSE 'open' END AS dialect FROM pages"),
    "wav_durations": (wav_durations, "SELECT doc_id, CAST(floor(n_chars * 7 / 24000 * 1000) AS BIGINT) AS ms FROM documents"),
    "seeds": (
        seeds,
        "SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN event_id END, CASE WHEN event_id % 5 = 0 THEN CAST('1' || user_id AS BIGINT) END, CASE WHEN event_id % 2 = 0 THEN 0 END) AS seed FROM events",
    ),
    "package_parts": (
        package_parts,
        "SELECT coalesce(s.o_orderkey, a.part) AS part, coalesce(a.extra, CASE WHEN s.o_orderkey % 3 = 0 THEN 'replaced' END, o_orderpriority) AS body FROM orders s FULL JOIN (SELECT o_orderkey * 2 AS part, 'added' AS extra FROM orders WHERE o_orderkey % 4 = 0) a ON s.o_orderkey = a.part",
    ),
    "stream_windows": (
        stream_windows,
        "SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2 HAVING date_trunc('hour', ts)::TIMESTAMP + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)",
    ),
    "stream_completeness": (
        stream_completeness,
        "SELECT user_id % 50 AS chapter_idx, 5 AS n_tasks FROM events GROUP BY 1 HAVING count(DISTINCT event_id % 5) = 5",
    ),
    "batch_windows": (batch_windows, "SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"),
}
