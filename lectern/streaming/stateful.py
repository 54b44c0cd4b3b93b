"""Stateful streams: chapters in their order as tasks come in, speech events as lines come in, and a sink that may be replayed.

State lives in RocksDB by key and entry: a task touches the entry of its own
chapter, a line its own, and neither rewrites what a key holds otherwise. There
are no timers, so a run over what is there ends; of a key that is finished a
number or two stay. `with_state` makes a session with the state store that
such streams need; the given session keeps its own.

Defined results: rows without a key, and tasks outside a chapter's tasks, are
left out; a repeated row changes nothing; rows may come in any order, and what
comes after its key is finished is ignored; empty streams give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lectern.store import shared_folder

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def with_state(spark: SparkSession) -> SparkSession:
    """A session like this one, with the state store that these streams need; the given one keeps its own."""
    own = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.checkpoint.dir", "spark.sql.session.timeZone"):
        # what cannot be changed is the same in all sessions
        if (value := spark.conf.get(key, None)) is not None and own.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set(_PROVIDER, _STORE)
    return own


class _Assembly(StatefulProcessor):
    """Per book: which tasks of each open chapter have come, as a bitmap, and the chapter that is next."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getMapState("open", "chapter_idx long", "seen binary, missing long")
        self.next = handle.getValueState("next", "chapter_idx long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        first = at = self.next.get()[0] if self.next.exists() else 0
        total = 0
        for batch in rows:
            total = max(total, int(batch["n_chapters"].max()))
            for chapter, tasks in batch.groupby("chapter_idx"):
                if chapter >= at and chapter >= 0:
                    self._take(int(chapter), tasks)
        ready = []
        while self.open.containsKey((at,)) and self.open.getValue((at,))[1] == 0:
            ready.append(at)
            self.open.removeKey((at,))
            at += 1
        if at > first or not self.next.exists():
            self.next.update((at,))
        if at >= total and ready:
            # the book is whole; its number of chapters stays, so that late tasks are known
            self.open.clear()
        if ready:
            yield pd.DataFrame({"book_id": [key[0]] * len(ready), "chapter_idx": ready})

    def _take(self, chapter: int, tasks: pd.DataFrame) -> None:
        n = int(tasks["n_tasks"].max())
        seen, missing = self.open.getValue((chapter,)) if self.open.containsKey((chapter,)) else (bytes(-(-n // 8)), n)
        bits = bytearray(seen)
        for pos in tasks["pos"].tolist():
            if 0 <= pos < n and not bits[pos >> 3] >> (pos & 7) & 1:
                bits[pos >> 3] |= 1 << (pos & 7)
                missing -= 1
        self.open.updateValue((chapter,), (bytes(bits), missing))

    def close(self) -> None:
        pass


def ready_chapters(tasks: DataFrame) -> DataFrame:
    """(book_id, chapter_idx) of chapters, from 0, as soon as all their tasks and those of all chapters before have come, each once.

    tasks (book_id, chapter_idx, pos from 0, n_tasks of the chapter, n_chapters of the book). A chapter's tasks are forgotten when it is told.
    """
    known = tasks.select(*(F.col(c).cast("long") for c in ("book_id", "chapter_idx", "pos", "n_tasks", "n_chapters"))).na.drop()
    return known.groupBy("book_id").transformWithStateInPandas(_Assembly(), "book_id long, chapter_idx long", "Append", "None")


class _Events(StatefulProcessor):
    """Per stream: lines that wait for earlier ones, the line that is next, and the fields of the event that is open."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getMapState("waiting", "line_no long", "line string")
        self.place = handle.getValueState("place", "line_no long, event_no long, name string, ended boolean, held long, parts long")
        self.data = handle.getListState("data", "payload string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        # how many lines wait and how many fields are open: nothing is looked up that is not there
        at, event, name, ended, held, parts = self.place.get() if self.place.exists() else (0, 0, None, False, 0, 0)
        if ended:
            return
        fresh: dict[int, str | None] = {}
        for batch in rows:
            fresh |= {int(n): x for n, x in zip(batch["line_no"], batch["line"]) if n >= at}
        data = [r[0] for r in self.data.get()] if parts else []
        kept, out = len(data), []
        while at in fresh or (held and self.waiting.containsKey((at,))):
            if held and self.waiting.containsKey((at,)):
                line = self.waiting.getValue((at,))[0]
                self.waiting.removeKey((at,))
                fresh.pop(at, None)
                held -= 1
            else:
                line = fresh.pop(at)
            at += 1
            ended = line is None
            text = "" if ended else line.rstrip("\r\n").rstrip(" ")
            if not text:
                if name is not None or data:
                    out.append((key[0], event, name or "message", "".join(data)))
                event, name, data, kept = event + 1, None, [], -1
                if ended:
                    break
            elif text.startswith("event:"):
                name = text[6:].strip(" ")
            elif text.startswith("data:"):
                data.append(text[5:].lstrip(" "))
        for n, line in fresh.items():
            if not ended:
                held += not self.waiting.containsKey((n,))
                self.waiting.updateValue((n,), (line,))
        if (kept == -1 or ended) and parts:
            self.data.clear()
        kept = max(0, kept) if not ended else len(data)
        if data[kept:]:
            self.data.appendList([(x,) for x in data[kept:]])
        if ended and held:
            self.waiting.clear()
            held = 0
        self.place.update((at, event, name, ended, held, 0 if ended else len(data)))
        if out:
            yield pd.DataFrame(out, columns=["stream_id", "event_no", "event", "payload"])

    def close(self) -> None:
        pass


def speech_events(lines: DataFrame) -> DataFrame:
    """(stream_id, event_no, event, payload) as the lines of speech streams (stream_id, line_no from 0, line) come in: an event as soon as its blank line has come.

    A null line ends its stream and the event that is open. event_no counts blank lines, as `replies.stream_events` does for whole streams.
    """
    known = lines.where("stream_id is not null and line_no is not null").select(F.col("stream_id").cast("long"), F.col("line_no").cast("long"), F.col("line").cast("string"))
    return known.groupBy("stream_id").transformWithStateInPandas(_Events(), "stream_id long, event_no long, event string, payload string", "Append", "None")


def replayable_sink(folder: str) -> Callable[[DataFrame, int], None]:
    """A sink for `foreachBatch` that writes a batch into the partition that names it: a batch that is delivered again takes its own place and nothing else."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return write


def run_stateful(stream: DataFrame, folder: str | None = None, each: Callable | None = None) -> DataFrame:
    """All that came so far, with the number of the batch that brought it (batch), through a stream that keeps its state in the folder (a new one by default), where a later call goes on.

    each(write, rows, number) may stand between a batch and its sink.
    """
    spark = stream.sparkSession
    folder = folder or shared_folder(spark)
    write = replayable_sink(f"{folder}/out")
    sink = write if each is None else lambda batch, number: each(write, batch, number)
    stream.writeStream.foreachBatch(sink).outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


_HELD = "stream_id long, line_no long, line string, marker boolean, base long, events long"


def _lines_read(fresh: DataFrame, held: DataFrame, ended: DataFrame) -> DataFrame:
    """Lines that streams hold after a batch, once each and none behind a stream's end: whether all before have come (ready), and the event they are in.

    A stream's marker tells where its open event begins (base) and its number; it is a row without a place among the lines.
    """
    new = fresh.join(ended, "stream_id", "left_anti").select("stream_id", "line_no", "line", F.lit(False).alias("marker"), F.lit(None).cast("long").alias("base"), F.lit(None).cast("long").alias("events"), F.lit(1).alias("src"))
    stream = Window.partitionBy("stream_id")
    rows = new.unionByName(held.withColumn("src", F.lit(0)))
    rows = rows.withColumn("again", F.lag("line_no").over(stream.orderBy("line_no", "src", "line")).eqNullSafe(F.col("line_no")))
    rows = rows.where("not again").withColumn("base", F.coalesce(F.max("base").over(stream), F.lit(0))).withColumn("events", F.coalesce(F.max("events").over(stream), F.lit(0)))
    order = stream.orderBy("line_no")
    rows = rows.where("marker or line_no >= base").withColumn("place", F.sum(F.when(F.col("marker"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1 + F.col("base"))
    rows = rows.withColumn("ready", ~F.col("marker") & (F.col("line_no") == F.col("place")))
    rows = rows.withColumn("end", F.min(F.when(F.col("ready") & F.col("line").isNull(), F.col("line_no"))).over(stream)).where("end is null or line_no <= end")
    text = F.rtrim(F.rtrim(F.coalesce("line", F.lit("")), F.lit("\r\n")))
    rows = rows.withColumn("text", text).withColumn("blank", F.col("ready") & (F.col("text") == ""))
    before = F.coalesce(F.count_if("blank").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.select("stream_id", "line_no", "line", "marker", "base", "events", "ready", "end", "text", "blank", (F.col("events") + before).alias("event_no"))


def _events_closed(read: DataFrame) -> DataFrame:
    """(stream_id, event_no, event, payload) of events whose blank line has come."""
    name, data = F.when(F.col("text").startswith("event:"), F.trim(F.substring("text", 7, 2**31 - 1))), F.when(F.col("text").startswith("data:"), F.ltrim(F.substring("text", 6, 2**31 - 1)))
    told = read.where("ready").select("stream_id", "event_no", "line_no", "blank", name.alias("name"), data.alias("data"))
    g = told.groupBy("stream_id", "event_no").agg(F.bool_or("blank").alias("closed"), F.max(F.when(F.col("name").isNotNull(), F.struct("line_no", "name")))["name"].alias("name"), F.array_sort(F.collect_list(F.when(F.col("data").isNotNull(), F.struct("line_no", "data")))).alias("data"))
    whole = g.where(F.col("closed") & (F.col("name").isNotNull() | (F.size("data") > 0)))
    return whole.select("stream_id", "event_no", F.coalesce(F.nullif("name", F.lit("")), F.lit("message")).alias("event"), F.array_join("data.data", "").alias("payload"))


def _lines_held(read: DataFrame) -> DataFrame:
    """What streams that go on keep: the lines of the open event and those that wait, and a marker."""
    open_ = read.where("end is null")
    places = open_.groupBy("stream_id").agg(F.max(F.when(F.col("blank"), F.col("line_no") + 1)).alias("next"), F.max("base").alias("was"), (F.max("events") + F.count_if("blank")).alias("events"))
    places = places.select("stream_id", F.coalesce("next", "was").alias("base"), "events")
    none = F.lit(None).cast("long")
    lines = open_.where("not marker").select("stream_id", "line_no", "line").join(places.select("stream_id", "base"), "stream_id").where("line_no >= base")
    lines = lines.select("stream_id", "line_no", "line", F.lit(False).alias("marker"), none.alias("base"), none.alias("events"))
    return lines.unionByName(places.select("stream_id", (F.col("base") - 1).alias("line_no"), F.lit(None).cast("string").alias("line"), F.lit(True).alias("marker"), "base", "events"))


def run_speech_events(lines: DataFrame, folder: str | None = None, each: Callable | None = None) -> DataFrame:
    """The events of `speech_events`, with their batch, of all lines that came so far: for many streams, a batch at a time instead of a stream at a time.

    What open streams hold is a table that every batch reads and writes anew; of streams that ended the ids stay. Both are kept by
    batch, so a batch that is delivered again starts from what the one before left. A later call with the folder goes on where this stopped.
    """
    spark = lines.sparkSession
    folder = folder or shared_folder(spark)
    write = replayable_sink(f"{folder}/out")
    known = lines.where("stream_id is not null and line_no is not null").select(F.col("stream_id").cast("long"), F.col("line_no").cast("long"), F.col("line").cast("string"))

    def sink(batch: DataFrame, number: int) -> None:
        own = batch.sparkSession
        ended = own.read.schema("stream_id long, batch int").option("basePath", f"{folder}/ended").parquet(f"{folder}/ended").where(F.col("batch") < number).select("stream_id") if number else own.createDataFrame([], "stream_id long")
        held = own.read.schema(_HELD).parquet(f"{folder}/held/batch={number - 1}") if number else own.createDataFrame([], _HELD)
        found = _lines_read(batch, held, ended)
        found.write.mode("overwrite").parquet(f"{folder}/read")
        read = own.read.schema(found.schema).parquet(f"{folder}/read")
        replayable_sink(f"{folder}/held")(_lines_held(read), number)
        replayable_sink(f"{folder}/ended")(read.where("line_no = end").select("stream_id"), number)
        events = _events_closed(read)
        if each is None:
            write(events, number)
        else:
            each(write, events, number)

    known.writeStream.foreachBatch(sink).outputMode("append").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("stream_id long, event_no long, event string, payload string, batch int").parquet(f"{folder}/out")
