"""Helpers shared by the corpus operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Code points handled at once inside a Python worker; bounds its memory whatever the Arrow batch holds.
SLICE_CHARS = 4_000_000
#: Bytes that one bucket of a packed exchange holds about; a worker loads a bucket whole.
BUCKET_BYTES = 64_000_000


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions; packed exchanges use it as their number of buckets."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def buckets(spark: SparkSession, size: int) -> int:
    """Buckets for a packed exchange of so many bytes: the session's number, and more where a bucket would outgrow BUCKET_BYTES."""
    return max(shuffle_partitions(spark), -(-int(size) // BUCKET_BYTES))


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts, and some per row; one narrow scan."""
    row = docs.agg(F.sum(F.octet_length(F.col(text_col))).alias("n"), F.count(F.lit(1)).alias("rows")).first()
    return (row["n"] or 0) + 64 * row["rows"]


def free_name(df: DataFrame, name: str) -> str:
    """The name, or a longer one that no column of df has; Spark compares names without case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; one of its own only where it is unset and all runs on this machine (tests, local runs)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = "/tmp/checkpoints"
        spark.sparkContext.setCheckpointDir(path)
    return path


#: The folder of the piece of work that runs now, where it has one of its own; a thread sees its own only.
_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)


def free_folder(spark: SparkSession) -> str:
    """A path that nothing uses yet, in the folder of the work that runs now, else in the shared one."""
    return f"{(_SCRATCH.get() or checkpoint_dir(spark)).rstrip('/')}/lectern-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Whatever this block materialises goes to a folder of its own, which `remove` can delete as a whole."""
    folder = free_folder(spark)
    token = _SCRATCH.set(folder)
    try:
        yield folder
    finally:
        _SCRATCH.reset(token)


def materialise(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write a result to the shared folder as Parquet and reread it, which cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = path or free_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that nothing will read again; the caller knows when that is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def by_bucket(df: DataFrame, n: int, bucket: str | Column = "bucket") -> DataFrame:
    """Send every row to the partition that its bucket number names: no hash collisions between buckets."""
    return df.repartitionById(n, F.col(bucket) if isinstance(bucket, str) else bucket)


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that none holds much more than `limit` bytes of text; one long row stays whole."""
    for batch in batches:
        column = batch.column(text)
        sizes = [n or 0 for n in pa.compute.binary_length(column).to_pylist()]
        start = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield batch.slice(start)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


def annotate(docs: DataFrame, make: Callable[[], Callable[[list[str]], list[pa.Array]]], fields: list[T.StructField], text_col: str = "text") -> DataFrame:
    """All rows and columns of docs, and columns computed from their texts: make() runs once per task and gives a function of a list of texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in slices(batches, text_col):
            yield pa.RecordBatch.from_arrays([*batch.columns, *compute(texts(batch, text_col))], names=[*batch.schema.names, *(f.name for f in fields)])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *fields]))
