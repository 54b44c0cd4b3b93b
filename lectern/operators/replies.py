"""Model replies: tolerant JSON, shape-tolerant rows and checks; and the lines of a speech event stream."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions.constants import RETRYABLE_STATUS

#: A string that a line end cuts off before the next key; matched without going back, so long strings do no harm.
_CUT_STRING = r'(:\s*+"(?:[^"\\\n]++|\\.)*+)\n(\s*+"[A-Za-z_]+"\s*+:)'
_FENCE = "```"


def reply_body(content: Column) -> Column:
    """What a reply says: without thinking and the fence around code."""
    said = X.without_thinking(F.coalesce(content, F.lit("")))
    inside = F.regexp_replace(F.regexp_replace(said, f"^{_FENCE}(?:json)?", ""), f"{_FENCE}$", "")
    return X.stripped(F.when(said.startswith(_FENCE), inside).otherwise(said))


def reply_text(body: Column) -> Column:
    """The JSON text of a reply's body: as it is, else with cut-off strings closed and trailing commas dropped; null where neither is JSON. Text behind the value does not matter."""
    mended = without_trailing_commas(F.regexp_replace(body, _CUT_STRING, '$1",\n$2'))
    return F.when(F.try_parse_json(body).isNotNull(), body).when(F.try_parse_json(mended).isNotNull(), mended)


def parsed_replies(replies: DataFrame, key: str, content: str) -> DataFrame:
    """(key, json, keys, problem): each reply as JSON with its keys in order, the keys of an object as the reply has them, or what is wrong with it.

    A reply in which an object has one key twice is broken, as is an empty or null one.
    """
    body = replies.select(key, reply_body(F.col(content)).alias("body"))
    rows = body.withColumn("json", reply_text(F.col("body")))
    problem = F.when(F.col("json").isNull(), F.when(F.col("body") == "", "no content").otherwise(F.concat(F.lit("no JSON: "), X.truncate(F.col("body"), 120))))
    return rows.select(key, F.to_json(F.try_parse_json("json")).alias("json"), F.json_object_keys("json").alias("keys"), problem.alias("problem"))


def broken_replies(replies: DataFrame, key: str, content: str, radius: int = 60) -> DataFrame:
    """(key, line, place, shown) of the replies that are no JSON: where reading stops, and the text around it with a mark below.

    Only these replies are read by Python, whose reader tells the place.
    """
    kind = replies.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                try:
                    json.JSONDecoder().raw_decode(text)
                    rows.append((None, None, None))
                except json.JSONDecodeError as error:
                    first = max(error.pos - radius, 0)
                    parts = (text[first : error.pos], text[error.pos : error.pos + radius])
                    before, behind = (("..." if cut else "") + part.replace("\n", "\\n") for part, cut in zip(parts, (first > 0, False)))
                    more = "..." if error.pos + radius < len(text) else ""
                    rows.append((error.lineno, error.pos, f"{before}{behind}{more}\n{'^':>{len(before) + 1}}"))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string())))], names=[key, "line", "place", "shown"])

    broken = replies.select(key, reply_body(F.col(content)).alias("body")).where(reply_text(F.col("body")).isNull())
    return broken.mapInArrow(run, f"{key} {kind}, line long, place long, shown string")


def without_trailing_commas(content: Column) -> Column:
    return F.regexp_replace(content, r",(\s*[}\]])", "$1")


def script_rows(parsed: DataFrame, key: str) -> DataFrame:
    """(key, seg_idx, speaker, text, instruction) of replies, wrapped in "segments" or "script" or bare, with full or short keys."""
    item = "struct<speaker:string,s:string,text:string,t:string,instruction:string,in:string>"
    wrapped = F.from_json("json", f"struct<segments:array<{item}>,script:array<{item}>>")
    rows = F.when(F.ltrim("json").startswith("["), F.from_json("json", f"array<{item}>")).otherwise(F.coalesce(wrapped["segments"], wrapped["script"]))
    out = parsed.select(key, F.posexplode(rows).alias("seg_idx", "r"))
    pick = lambda full, short: F.coalesce(F.col(f"r.{full}"), F.col(f"r.{short}"))
    return out.select(key, F.col("seg_idx").cast("long").alias("seg_idx"), pick("speaker", "s").alias("speaker"), pick("text", "t").alias("text"), F.coalesce(pick("instruction", "in"), F.lit("")).alias("instruction")).where("speaker is not null and text is not null")


def cast_rows(parsed: DataFrame, key: str) -> DataFrame:
    """(key, ordinal, name, description, voice, aliases) of replies, wrapped or bare."""
    item = "struct<name:string,n:string,description:string,d:string,voice:string,v:string,aliases:array<string>,a:array<string>>"
    wrapped = F.from_json("json", f"struct<characters:array<{item}>,cast:array<{item}>>")
    rows = F.when(F.ltrim("json").startswith("["), F.from_json("json", f"array<{item}>")).otherwise(F.coalesce(wrapped["characters"], wrapped["cast"]))
    out = parsed.select(key, F.posexplode(rows).alias("ordinal", "r"))
    pick = lambda full, short: F.coalesce(F.col(f"r.{full}"), F.col(f"r.{short}"))
    return out.select(key, F.col("ordinal").cast("long").alias("ordinal"), *(pick(full, full[0]).alias(full) for full in ("name", "description", "voice", "aliases")))


def label_collisions(cast: DataFrame) -> DataFrame:
    """(norm, names): labels that more than one member goes by."""
    forms = cast.select("name", F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("label"))
    g = forms.groupBy(X.normalize_name(F.col("label")).alias("norm")).agg(F.array_sort(F.collect_set("name")).alias("names"))
    return g.where(F.size("names") > 1)


def retryable(status: Column) -> Column:
    return status.isin(*RETRYABLE_STATUS)


def backoff(attempts: Column, first: float = 2.0) -> Column:
    """Seconds waited before attempts, each wait twice the one before."""
    return F.when(attempts > 1, F.lit(first) * (F.pow(F.lit(2.0), attempts - 1) - 1)).otherwise(0.0)


def stream_events(lines: DataFrame) -> DataFrame:
    """(stream_id, event_no, event, payload) of stream lines (stream_id, line_no, line): fields up to a blank line are one event, comments are none."""
    w = Window.partitionBy("stream_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    line = F.rtrim(F.regexp_replace("line", r"[\r\n]+$", ""))
    rows = lines.withColumn("line", line).withColumn("event_no", F.coalesce(F.sum(F.when(F.col("line") == "", 1).otherwise(0)).over(w), F.lit(0)))
    fields = rows.where((F.col("line") != "") & ~F.col("line").startswith(":"))
    name = F.when(F.col("line").startswith("event:"), F.trim(F.substring("line", 7, 1 << 30)))
    data = F.when(F.col("line").startswith("data:"), F.ltrim(F.substring("line", 6, 1 << 30)))
    g = fields.withColumn("name", name).withColumn("data", data).groupBy("stream_id", "event_no").agg(
        F.max_by("name", F.when(F.col("name").isNotNull(), F.col("line_no"))).alias("name"),
        F.sort_array(F.collect_list(F.when(F.col("data").isNotNull(), F.struct("line_no", "data")))).alias("d"),
    )
    return g.select("stream_id", "event_no", F.coalesce("name", F.lit("message")).alias("event"), F.array_join("d.data", "").alias("payload"))


def audio_deltas(events: DataFrame) -> DataFrame:
    """(stream_id, event_no, audio): bytes of the delta events, each decoded alone; payloads that are no JSON are ignored."""
    audio = F.get_json_object("payload", "$.audio")
    return events.where("event = 'speech.audio.delta'").select("stream_id", "event_no", F.try_to_binary(audio, F.lit("base64")).alias("audio")).where("audio is not null")
