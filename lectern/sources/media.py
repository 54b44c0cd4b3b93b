"""Sound files and packages as a Spark data source: one row is one file.

    spark.dataSource.register(Media)
    rows.write.format("lectern_media").option("kind", "sound").mode("append").save(folder)
    spark.read.format("lectern_media").option("kind", "sound").load(folder)

Rows (name, data) are files of any content; kind `sound` packs and unpacks
rows (name, rate, samples) as 16-bit WAV. A task writes its files under a
name of its own in a staging folder beside the results, and commit moves the
files of the tasks that succeeded to their names; abort, and tasks that failed
or were run twice, leave nothing that a reader sees. Paths are URIs of any file
system that Arrow opens (local, HDFS, S3, GCS).

The source is for folders that the driver can list: the names of a job's files
reach it on commit, those of a folder on reading. `write_files` and `read_files`
do the same for any number of files: names stay in tables, and tasks find names
that were given twice, move the files and open them.

Defined results: rows without a name are an error, as are two rows of one
name; a null content is an empty file, null samples a sound of no length; a
file that cannot be unpacked is a row with nulls; an empty table writes no
files, an empty folder gives no rows. Overwriting replaces files of the same
names and leaves others.
"""

from __future__ import annotations

import posixpath
import uuid
import wave
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from lectern.sources.epub import wav_bytes, wav_samples
from lectern.store import kept

#: Bytes of files that a reading task opens, about.
PART_BYTES = 64_000_000
#: Files and bytes of them that leave a reading task at once, about.
_BATCH_FILES, _BATCH_BYTES = 256, 4_000_000
STAGING = "_staging"
_SCHEMAS = {"file": "name string, data binary", "sound": "name string, rate int, samples array<double>"}


def _columns(kind: str) -> list[str]:
    return [c.split()[0] for c in _SCHEMAS[kind].split(", ")]


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _contents(names: Iterator[str], path: str, kind: str, suffix: str) -> Iterator[pa.RecordBatch]:
    """Files of a folder by their names, some at a time."""
    store, root = _opened(path)
    rows, held = [], 0

    def batch() -> pa.RecordBatch:
        kinds = [pa.string(), pa.binary()] if kind == "file" else [pa.string(), pa.int32(), pa.list_(pa.float64())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=_columns(kind))

    for name in names:
        with store.open_input_file(posixpath.join(root, name + suffix)) as f:
            data = f.read()
        held += len(data)
        if kind == "file":
            rows.append((name, data))
        else:
            try:
                samples, rate = wav_samples(data)
            except (wave.Error, EOFError, ValueError):
                samples, rate = None, None
            rows.append((name, rate, samples))
        if len(rows) >= _BATCH_FILES or held >= _BATCH_BYTES:
            yield batch()
            rows, held = [], 0
    if rows:
        yield batch()


def _staged(batches: Iterator[pa.RecordBatch], path: str, kind: str, suffix: str, job: str) -> Iterator[tuple[str, str, int]]:
    """Where each row's file waits, its name and size; every attempt of a task has a folder of its own, and none makes the job's folder anew."""
    store, root = _opened(path)
    own, n = posixpath.join(root, STAGING, job, uuid.uuid4().hex), 0
    for batch in batches:
        for row in batch.to_pylist():
            name = row["name"]
            if not name or name.startswith(("/", "_")) or ".." in name.split("/"):
                raise ValueError(f"{name!r} is no name of a file in the folder")
            data = (row["data"] or b"") if kind == "file" else wav_bytes(row["samples"] or [], row["rate"] or 24_000)
            waiting = posixpath.join(own, str(n))
            if not n:
                store.create_dir(own, recursive=False)
            with store.open_output_stream(waiting) as f:
                f.write(data)
            n += 1
            yield waiting, name + suffix, len(data)


def _begun(path: str) -> str:
    """A new job, with the folder that its tasks stage in."""
    job = uuid.uuid4().hex
    store, root = _opened(path)
    store.create_dir(posixpath.join(root, STAGING, job), recursive=True)
    return job


def _swept(path: str, job: str) -> None:
    """Everything that this job staged goes, also what failed attempts left; attempts that still run find their folder gone."""
    store, root = _opened(path)
    own, above = posixpath.join(root, STAGING, job), posixpath.join(root, STAGING)
    for again in (True, True, False):
        try:
            if store.get_file_info(own).type != fs.FileType.NotFound:
                store.delete_dir(own)
            break
        except OSError:
            # a running attempt wrote into it meanwhile
            if not again:
                raise
    if store.get_file_info(above).type != fs.FileType.NotFound and not store.get_file_info(fs.FileSelector(above)):
        store.delete_dir(above)


def write_files(rows: DataFrame, path: str, kind: str = "file", suffix: str = "", overwrite: bool = False) -> DataFrame:
    """(name, size) of rows (see the kinds above) that are files of a folder now, in a table.

    Tasks stage their files; the table of those that succeeded says what waits. Names that were given twice or are taken are an
    error, and nothing is moved then; else tasks move what waits, and a repeated one finds its files moved. A job that fails while it
    stages leaves nothing, one that fails while it moves leaves whole files under their names.
    """
    job = _begun(path)

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _staged(batches, path, kind, suffix, job)
        while held := list(islice(found, 4096)):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*held)], names=["waiting", "file", "size"])

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _opened(path)
        for batch in batches:
            files = batch.column("file").to_pylist()
            there = store.get_file_info([posixpath.join(root, f) for f in files])
            yield pa.RecordBatch.from_arrays([pa.array([f for f, i in zip(files, there) if i.type != fs.FileType.NotFound], pa.string())], names=["file"])

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _opened(path)
        made: set[str] = set()
        for batch in batches:
            for waiting, file in zip(batch.column("waiting").to_pylist(), batch.column("file").to_pylist()):
                target = posixpath.join(root, file)
                if (folder := posixpath.dirname(target)) not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                try:
                    store.move(waiting, target)
                except OSError:
                    gone, there = store.get_file_info([waiting, target])
                    if gone.type != fs.FileType.NotFound or there.type == fs.FileType.NotFound:
                        raise
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    try:
        waiting = kept(rows.select(*_columns(kind)).mapInArrow(stage, "waiting string, file string, size long"))
        again = waiting.groupBy("file").count().where("count > 1").select("file").limit(1).collect()
        if not again and not overwrite:
            again = waiting.mapInArrow(taken, "file string").limit(1).collect()
        if again:
            raise ValueError(f"files of one name: {again[0].file}")
        waiting.mapInArrow(move, "n long").agg(F.sum("n")).collect()
    finally:
        _swept(path, job)
    return waiting.select(F.substring("file", F.lit(1), F.length("file") - len(suffix)).alias("name"), "size")


def read_files(files: DataFrame, path: str, kind: str = "file", suffix: str = "") -> DataFrame:
    """The rows of files (name, size) of a folder, which is not listed; a task opens some PART_BYTES of them."""
    spark = files.sparkSession
    total = files.agg(F.sum("size")).first()[0] or 0
    parts = max(total // PART_BYTES + 1, spark.sparkContext.defaultParallelism)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _contents((name for batch in batches for name in batch.column("name").to_pylist()), path, kind, suffix)

    return files.select("name").repartition(parts, "name").mapInArrow(opened, _SCHEMAS[kind])


class Media(DataSource):
    """Files of a folder, one to a row."""

    @classmethod
    def name(cls) -> str:
        return "lectern_media"

    @property
    def kind(self) -> str:
        return self.options.get("kind", "file")

    def schema(self) -> str:
        return _SCHEMAS[self.kind]

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self.kind, self.options.get("suffix", ""))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        wanted = _columns(self.kind)
        if schema.fieldNames() != wanted:
            raise ValueError(f"rows of kind {self.kind} have the columns {', '.join(wanted)}")
        return _Writer(self.options["path"], self.kind, self.options.get("suffix", ""), overwrite)


@dataclass
class _Files(InputPartition):
    paths: list[str] = field(default_factory=list)


class _Reader(DataSourceReader):
    def __init__(self, path: str, kind: str, suffix: str) -> None:
        self.path, self.kind, self.suffix = path, kind, suffix

    def partitions(self) -> list[InputPartition]:
        store, root = _opened(self.path)
        found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        parts, held = [_Files([])], 0
        for info in sorted(found, key=lambda i: i.path):
            inner = posixpath.relpath(info.path, root)
            if info.type != fs.FileType.File or inner.startswith(STAGING) or not inner.endswith(self.suffix):
                continue
            if held and held + info.size > PART_BYTES:
                parts.append(_Files([]))
                held = 0
            parts[-1].paths.append(inner)
            held += info.size
        return parts

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return _contents((inner.removesuffix(self.suffix) for inner in partition.paths), self.path, self.kind, self.suffix)


@dataclass
class _Written(WriterCommitMessage):
    #: Where each file of a task waits, and its name.
    files: list[tuple[str, str]] = field(default_factory=list)


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, kind: str, suffix: str, overwrite: bool) -> None:
        self.path, self.kind, self.suffix, self.overwrite = path, kind, suffix, overwrite
        self.job = _begun(path)

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        return _Written([(waiting, name) for waiting, name, _ in _staged(batches, self.path, self.kind, self.suffix, self.job)])

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = _opened(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        names = [name for _, name in files]
        there = store.get_file_info([posixpath.join(root, name) for name in names])
        taken = [] if self.overwrite else [i.path for i in there if i.type != fs.FileType.NotFound]
        if len(set(names)) < len(names) or taken:
            self.abort(messages)
            raise ValueError(f"files of one name: {(taken or sorted(n for n in names if names.count(n) > 1))[0]}")
        for folder in {posixpath.dirname(posixpath.join(root, name)) for name in names}:
            store.create_dir(folder, recursive=True)
        for waiting, name in files:
            store.move(waiting, posixpath.join(root, name))
        _swept(self.path, self.job)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        _swept(self.path, self.job)
