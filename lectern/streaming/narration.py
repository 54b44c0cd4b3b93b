"""Structured Streaming forms: event windows, task completeness and incremental state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.store import shared_folder


def file_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A stream of the files of a table in a folder."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def event_windows(events: DataFrame, size: str, late: str) -> DataFrame:
    """Counts and sums per kind and window of event time; rows later than allowed are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    g = timed.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n", "total")


def completeness(tasks: DataFrame) -> DataFrame:
    """(chapter_idx, n_tasks) of chapters as soon as all their tasks have come; tasks (chapter_idx, pos, n_tasks). A repeated task counts once."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, told = (set(state.get[0]), state.get[1]) if state.exists else (set(), False)
        total = 0
        for batch in batches:
            seen.update(batch["pos"].tolist())
            total = max(total, int(batch["n_tasks"].max()))
        whole = len(seen) >= total
        state.update((sorted(seen), told or whole))
        if whole and not told:
            yield pd.DataFrame({"chapter_idx": [key[0]], "n_tasks": [total]})

    return tasks.groupBy("chapter_idx").applyInPandasWithState(step, "chapter_idx long, n_tasks long", "seen array<long>, told boolean", "append", GroupStateTimeout.NoTimeout)


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All that is there now, written exactly once as a table in the shared folder."""
    spark = stream.sparkSession
    folder = shared_folder(spark)
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None]) -> None:
    """All that is there now, batch by batch; the batch number lets a sink ignore what it already has."""
    folder = shared_folder(stream.sparkSession)
    stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
