"""Pluggable generators and the bounded loop around them.

A generator maps a list of requests to a list of results and is created once
per task. The offline stand-ins need no network: a rule-based script writer
and a tone generator.
"""

from __future__ import annotations

import hashlib
import json
import math
from array import array
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.constants import PARAGRAPH_PAUSE_MS, SAMPLE_RATE
from lectern.operators import audio, chunking
from lectern.operators.replies import parsed_replies

Voice = Callable[[list[tuple[str, str, int]]], list[list[float]]]


def tone_voice(rate: int = SAMPLE_RATE, per_char: float = 0.002) -> Voice:
    """A stand-in speaker: a tone per text, its pitch from the voice, its length from the text."""

    def speak(requests: list[tuple[str, str, int]]) -> list[list[float]]:
        out = []
        for text, voice, seed in requests:
            digest = hashlib.sha256(f"{voice}\x1f{seed}".encode()).digest()
            pitch = 120 + digest[0]
            n = max(1, int(len(text) * per_char * rate))
            out.append([0.3 * math.sin(2 * math.pi * pitch * i / rate) * min(1.0, i / 32, (n - 1 - i) / 32) for i in range(n)])
        return out

    return speak


def script_writer(texts: list[str]) -> list[list[tuple[str, str]]]:
    """A stand-in script model: quoted parts are spoken by a speaker, the rest by the narrator."""
    out = []
    for text in texts:
        parts, quoted = [], False
        for piece in text.replace("”", '"').replace("“", '"').split('"'):
            if piece.strip():
                parts.append(("Extra Female" if quoted else "Narrator", piece.strip()))
            quoted = not quoted
        out.append(parts)
    return out


def synthesize(tasks: DataFrame, make: Callable[[], Voice], batch_size: int = 16) -> DataFrame:
    """(hash, samples) of tasks (hash, text, voice, seed); the voice is made once per task of the cluster, and batches hold one voice."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speak = make()
        for batch in batches:
            rows = sorted(zip(*(batch.column(c).to_pylist() for c in ("voice", "hash", "text", "seed"))))
            for i in range(0, len(rows), batch_size):
                part = rows[i : i + batch_size]
                sound = speak([(t or "", v or "", s) for v, _, t, s in part])
                yield pa.RecordBatch.from_arrays([pa.array([h for _, h, _, _ in part], pa.string()), pa.array(sound, pa.list_(pa.float32()))], names=["hash", "samples"])

    return tasks.select("voice", "hash", "text", "seed").mapInArrow(run, "hash string, samples array<float>")


class UnknownVoice(ValueError):
    """A voice that the service does not know (any more)."""


def cloned_voice(register: Callable[[str, str], str], say: Callable[[str, str, int], list[float]]) -> Callable[[list[tuple[str, str, str, int]]], list[list[float]]]:
    """A speaker of (text, reference audio, reference text, seed): a reference is registered once per worker, and once more if its voice is not known any longer."""
    known: dict[tuple[str, str], str] = {}

    def one(text: str, audio: str, spoken: str, seed: int) -> list[float]:
        fresh = (audio, spoken) not in known
        if fresh:
            known[audio, spoken] = register(audio, spoken)
        try:
            return say(text, known[audio, spoken], seed)
        except UnknownVoice:
            if fresh:
                raise
            known[audio, spoken] = register(audio, spoken)
            return say(text, known[audio, spoken], seed)

    return lambda requests: [one(*request) for request in requests]


def clone(tasks: DataFrame, make: Callable[[], Callable[[list[tuple[str, str, str, int]]], list[list[float]]]], batch_size: int = 16) -> DataFrame:
    """(hash, samples) of tasks (hash, text, ref_audio, ref_text, seed), a reference's tasks next to one another in each batch of rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speak = make()
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("ref_audio", "ref_text", "hash", "text", "seed"))
            rows = sorted(zip(*columns), key=lambda r: (r[0] or "", r[1] or "", r[2]))
            for i in range(0, len(rows), batch_size):
                part = rows[i : i + batch_size]
                sound = speak([(t or "", a or "", r or "", s) for a, r, _, t, s in part])
                yield pa.RecordBatch.from_arrays([pa.array([h for _, _, h, _, _ in part], pa.string()), pa.array(sound, pa.list_(pa.float32()))], names=["hash", "samples"])

    return tasks.select("ref_audio", "ref_text", "hash", "text", "seed").mapInArrow(run, "hash string, samples array<float>")


def synthesize_long(texts: DataFrame, make: Callable[[], Voice], rate: int = SAMPLE_RATE, pause_ms: int = PARAGRAPH_PAUSE_MS) -> DataFrame:
    """(hash, samples) of long texts (hash, text, voice, seed): cut at sentence ends, spoken piece by piece, and put together with pauses. A blank text is silence of no length."""
    chunks = chunking.sentence_chunks(texts, "hash", "text")
    tasks = chunks.join(texts.select("hash", "voice", "seed"), "hash").select(F.concat_ws("/", "hash", F.format_string("%09d", "chunk_idx")).alias("piece"), F.col("chunk").alias("text"), "voice", "seed")
    spoken = synthesize(tasks.withColumnRenamed("piece", "hash"), make)
    pieces = spoken.select(F.expr("left(hash, length(hash) - 10)").alias("text_hash"), F.col("hash").alias("piece"), "samples")
    whole = audio.concatenated(pieces, ["text_hash"], "piece", "samples", rate * pause_ms // 1000)
    return texts.select("hash").join(whole.withColumnRenamed("text_hash", "hash"), "hash", "left").withColumn("samples", F.coalesce("samples", F.array().cast("array<double>")))


#: Makers of speakers by the name that a configuration gives; more can be added.
ENGINES: dict[str, Callable[[dict], Voice]] = {"tone": lambda config: tone_voice(int(config.get("rate", SAMPLE_RATE)), float(config.get("per_char", 0.002)))}


def engine(config: dict) -> Voice:
    """The speaker that a configuration names under `engine`, the stand-in if it names none."""
    name = config.get("engine") or "tone"
    if name not in ENGINES:
        raise ValueError(f"unknown engine {name!r}; known are {', '.join(sorted(ENGINES))}")
    return ENGINES[name](config)


#: Gives a reply to each of some conversations, lists of (role, content).
Writer = Callable[[list[list[tuple[str, str]]]], list[str]]
_TALK = "array<struct<role:string,content:string>>"


def _said(role: str, content: Column) -> Column:
    return F.array(F.struct(F.lit(role).alias("role"), content.alias("content")))


def _answered(talks: DataFrame, key: str, make: Callable[[], Writer]) -> DataFrame:
    """Conversations (key, talk) with the reply to each."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        write = make()
        for batch in batches:
            talks = [[(m["role"], m["content"]) for m in talk] for talk in batch.column("talk").to_pylist()]
            if talks:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(write(talks), pa.string())], names=[*batch.schema.names, "reply"])

    kind = talks.schema[key].dataType.simpleString()
    return talks.select(key, "talk").mapInArrow(run, f"{key} {kind}, talk {_TALK}, reply string")


def converse(prompts: DataFrame, key: str, make: Callable[[], Writer], problems: Callable[[Column], Column], save: Callable[[DataFrame], DataFrame], attempts: int = 6) -> DataFrame:
    """(key, json, n_attempts, problem) of prompts (key, system, prompt): a row's reply once it is JSON without problems; a reply that fails is answered with what is wrong with it.

    problems gives the array of problems that a reply's JSON has, as a column. A round is one job over the rows that are still
    open; its replies are saved before they are judged. After the last round a row has its last problem. Null texts are empty;
    keys must differ, as rows are joined by them.
    """
    text = lambda c: F.coalesce(c, F.lit(""))
    talks = prompts.select(key, F.concat(_said("system", text(F.col("system"))), _said("user", text(F.col("prompt")))).alias("talk"))
    done = None
    for attempt in range(1, attempts + 1):
        spoken = save(_answered(talks, key, make))
        judged = spoken.join(parsed_replies(spoken, key, "reply").drop("keys"), key)
        wrong = F.when(F.col("json").isNull(), F.array("problem")).otherwise(problems(F.col("json")))
        judged = judged.withColumn("wrong", F.coalesce(wrong, F.array().cast("array<string>")))
        last = attempt == attempts
        closed = judged if last else judged.where(F.size("wrong") == 0)
        told = F.when(F.size("wrong") > 0, F.array_join("wrong", "; "))
        found = closed.select(key, F.when(told.isNull(), F.col("json")).alias("json"), F.lit(attempt).cast("long").alias("n_attempts"), told.alias("problem"))
        done = found if done is None else done.unionByName(found)
        if last:
            break
        ask = F.concat(F.lit("This is wrong with the reply:"), F.array_join(F.transform("wrong", lambda w: F.concat(F.lit("\n* "), w)), ""), F.lit("\nWrite all of it again, as JSON."))
        talks = judged.where(F.size("wrong") > 0).select(key, F.concat("talk", _said("assistant", text(F.col("reply"))), _said("user", ask)).alias("talk"))
        if talks.isEmpty():
            break
    return done


def until_clean(tasks: DataFrame, generate: Callable[[DataFrame], DataFrame], faulty: Column, save: Callable[[DataFrame], DataFrame], attempts: int = 5) -> DataFrame:
    """Results of tasks, those with faults generated anew with the next seed; raises if some stay faulty.

    Each round is saved before it is judged, so a paid call is never repeated by a retried task of a later round.
    """
    done, todo = None, tasks
    for _ in range(attempts):
        made = save(generate(todo))
        good = made.where(~faulty)
        done = good if done is None else done.unionByName(good)
        todo = todo.join(made.where(faulty).select("hash"), "hash", "left_semi").withColumn("seed", F.col("seed") + 1)
        todo = save(todo)
        if todo.isEmpty():
            return done
    raise RuntimeError(f"{todo.count()} tasks are still faulty after {attempts} attempts")


def pcm_bytes(samples: list[float]) -> bytes:
    """Signed 16-bit little-endian samples."""
    return array("h", (max(-32768, min(32767, round(x * 32768))) for x in samples)).tobytes()


def pcm_samples(data: bytes) -> list[float]:
    return [x / 32768 for x in array("h", data[: len(data) // 2 * 2])]
