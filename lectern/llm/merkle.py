"""Merkle manifest of a dataset over an external node store.

Every row is a leaf, every language a binary tree of its leaves in the order
of doc_id, and the roots of the languages are the leaves of one last tree.
No tree is ever held whole. Leaves are sorted into runs by a range exchange
and get their coordinates (tree, position) from the run's offsets. A band of
`LEVELS` levels is then built at once: a task streams the sorted nodes of a
block of 2**LEVELS positions, holds that block only, and writes each level
into the partition `level` of a Parquet store; the next band reads the last
level of that. Proofs come back down by merge-scans: the stored nodes of a
band and the paths of the nodes above it are sorted by coordinate and read
together, which gives the paths of the nodes below.

A path is the siblings from a node to the root: `shape` has a letter per
level (L or R: the sibling stands left or right; -: there is none) and
`siblings` their digests, 64 hex digits each.

Defined results: null and empty are different in every column; leaves with
equal ids are ordered by their digests, a null id comes first; repeated rows
are leaves of their own; a null language is a tree of its own, ordered first;
extra columns are ignored; an empty table gives an empty result. A null id is
never tampered with.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import free_folder, materialise, shuffle_partitions

#: Levels that one task builds from one block of positions; a block has 2**LEVELS nodes.
LEVELS = 8
#: Columns of a leaf, in the order in which they are hashed.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_BATCH = 20_000


def digest(data: str) -> str:
    return hashlib.sha256(data.encode()).hexdigest()


def _field(value: Column) -> Column:
    """A dash for null, else the length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(columns: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*(_field(columns[name]) for name in FIELDS)).cast("binary"), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """tree, id, digest and tampered (the digest after tampering, null where there is none) of every row."""
    columns = {name: docs[name] for name in FIELDS}
    hit = (F.crc32(docs["doc_id"].cast("string").cast("binary")) % 7 == 0) & docs["n_chars"].isNotNull()
    changed = leaf_digest(columns | {"n_chars": docs["n_chars"] + 1})
    return docs.select(docs["lang"].alias("tree"), docs["doc_id"].cast("long").alias("id"), leaf_digest(columns).alias("digest"), F.when(hit, changed).alias("tampered"))


def positioned(nodes: DataFrame, order: list[str]) -> DataFrame:
    """nodes with pos, the place of a node in its tree by order, and n, the nodes of that tree; on disk, as sorted runs.

    A range exchange makes the runs; rows that are alike in all of order are told apart by where they were read,
    so no run outgrows its share. The offsets of runs are sums over a row per run and tree.
    """
    origin = nodes.withColumn("_origin", F.monotonically_increasing_id())
    keys = ["tree", *order, "_origin"]
    runs = origin.repartitionByRange(shuffle_partitions(nodes.sparkSession), *keys).sortWithinPartitions(*keys).drop("_origin")
    schema = T.StructType([*runs.schema.fields, T.StructField("run", T.IntegerType()), T.StructField("place", T.LongType())])

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, tree, place = TaskContext.get().partitionId(), None, -1
        for batch in batches:
            places = []
            for name in batch.column("tree").to_pylist():
                place = place + 1 if name == tree and place >= 0 else 0
                tree = name
                places.append(place)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([run] * len(places), pa.int32()), pa.array(places, pa.int64())], names=[*batch.schema.names, "run", "place"])

    stored = materialise(runs.mapInArrow(number, schema))
    sizes = materialise(stored.groupBy("tree", "run").agg(F.count(F.lit(1)).alias("own")))
    # a row per run and tree: a tree has at most as many here as there are runs
    by_run = Window.partitionBy("tree").orderBy("run")
    offsets = sizes.select("tree", "run", (F.sum("own").over(by_run) - F.col("own")).alias("offset"), F.sum("own").over(Window.partitionBy("tree")).alias("n"))
    placed = stored.alias("s").join(offsets.alias("o"), (F.col("s.run") == F.col("o.run")) & F.col("s.tree").eqNullSafe(F.col("o.tree")))
    return placed.select(*(F.col(f"s.{c}") for c in nodes.columns), (F.col("place") + F.col("offset")).alias("pos"), "n")


def rows_by(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        yield from batch.to_pylist()


def levels_above(n: int) -> int:
    """Levels that a tree of n nodes has above them."""
    return (n - 1).bit_length()


def _grown(block: list[str], count: int) -> list[list[str]]:
    """The block and count levels above it; a node that is left over stands alone."""
    out = [block]
    for _ in range(count):
        below = out[-1]
        out.append([digest("".join(below[k : k + 2])) for k in range(0, len(below), 2)])
    return out


def _flushed(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    while chunk := list(itertools.islice(rows, _BATCH)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*chunk), schema)], schema=schema)


_NODE = pa.schema([("level", pa.int32()), ("tree", pa.string()), ("pos", pa.int64()), ("digest", pa.string()), ("n", pa.int64())])


def build(base: DataFrame, store: str) -> int:
    """Write all levels of all trees of base (tree, pos, n, digest) into the store, a band at a time; returns the number of bands."""
    spark = base.sparkSession
    deepest = levels_above(base.agg(F.max("n")).first()[0] or 1)
    base.select(F.lit(0).alias("level"), "tree", "pos", "digest", "n").write.partitionBy("level").parquet(store)
    bands = -(-deepest // LEVELS)
    for band in range(bands):
        below = nodes_at(spark, store, band * LEVELS, band * LEVELS)

        def grow(batches: Iterable[pa.RecordBatch], low: int = band * LEVELS) -> Iterator[pa.RecordBatch]:
            def made() -> Iterator[tuple]:
                for (tree, block), members in itertools.groupby(rows_by(batches), lambda r: (r["tree"], r["pos"] >> LEVELS)):
                    held = list(members)
                    n = held[0]["n"]
                    grown = _grown([r["digest"] for r in held], min(LEVELS, levels_above(n) - low))
                    for k, row in enumerate(grown[1:], 1):
                        for place, name in enumerate(row):
                            yield low + k, tree, (block << (LEVELS - k)) + place, name, n

            return _flushed(made(), _NODE)

        # trees that end below this band have no levels here
        wanted = below.where(F.col("n") > F.lit(1 << (band * LEVELS)))
        dealt = wanted.withColumn("block", F.shiftright("pos", LEVELS)).repartition("tree", "block")
        made = dealt.sortWithinPartitions("tree", "pos").drop("block").mapInArrow(grow, "level int, tree string, pos long, digest string, n long")
        made.write.mode("append").partitionBy("level").parquet(store)
    return bands


def nodes_at(spark: SparkSession, store: str, low: int, high: int) -> DataFrame:
    """The stored nodes of the levels low to high; other partitions are not read."""
    return spark.read.schema("tree string, pos long, digest string, n long, level int").parquet(store).where(F.col("level").between(low, high))


def roots(spark: SparkSession, store: str) -> DataFrame:
    """tree, digest of the root of every tree."""
    height = F.when(F.col("n") < 2, 0).otherwise(F.length(F.bin(F.col("n") - 1)))
    return spark.read.schema("tree string, pos long, digest string, n long, level int").parquet(store).where(F.col("level") == height).select("tree", "digest")


def _paths_in(grown: list[list[str]], place: int) -> tuple[str, str]:
    """shape and siblings of a node of the lowest row of a block, up to the block's top."""
    shape, siblings = [], []
    for row in grown[:-1]:
        other = place ^ 1
        if other < len(row):
            shape.append("R" if other > place else "L")
            siblings.append(row[other])
        else:
            shape.append("-")
        place >>= 1
    return "".join(shape), "".join(siblings)


_PATH = "tree string, pos long, digest string, n long, shape string, siblings string"


def paths(spark: SparkSession, store: str, bands: int, top: DataFrame) -> DataFrame:
    """tree, pos, digest, n, shape, siblings of every leaf of the store, continued by the path (shape, siblings) that top gives each tree's root."""
    above = top.select("tree", F.lit(0).cast("long").alias("pos"), "shape", "siblings")
    schema = pa.schema([("tree", pa.string()), ("pos", pa.int64()), ("digest", pa.string()), ("n", pa.int64()), ("shape", pa.string()), ("siblings", pa.string())])
    for band in range(max(bands, 1) - 1, -1, -1):
        low, high = band * LEVELS, (band + 1) * LEVELS

        def extract(batches: Iterable[pa.RecordBatch], low: int = low) -> Iterator[pa.RecordBatch]:
            def made() -> Iterator[tuple]:
                for (tree, block), members in itertools.groupby(rows_by(batches), lambda r: (r["tree"], r["block"])):
                    rows: list[list[str]] = []
                    over = n = None
                    for r in members:
                        if r["level"] is None:
                            over = r
                            continue
                        n = r["n"]
                        while len(rows) <= r["level"] - low:
                            rows.append([])
                        rows[r["level"] - low].append(r["digest"])
                    if not rows or not rows[0]:
                        continue  # a path to a tree that has no nodes in this band
                    for place, name in enumerate(rows[0]):
                        shape, siblings = _paths_in(rows, place)
                        yield tree, (block << LEVELS) + place, name, n, shape + over["shape"], siblings + over["siblings"]

            return _flushed(made(), schema)

        reached = nodes_at(spark, store, low, high).where(F.col("level") <= F.when(F.col("n") < 2, 0).otherwise(F.length(F.bin(F.col("n") - 1))))
        # a node of level low + k belongs to the block of its descendants; the top node of a full band too
        scan = reached.select("tree", F.expr(f"shiftright(pos, {high} - level)").alias("block"), "level", "pos", "digest", "n", F.lit(None).cast("string").alias("shape"), F.lit(None).cast("string").alias("siblings"))
        nothing = [F.lit(None).cast(t).alias(c) for c, t in (("level", "int"), ("at", "long"), ("digest", "string"), ("n", "long"))]
        given = above.select("tree", F.col("pos").alias("block"), *nothing, "shape", "siblings").withColumnRenamed("at", "pos").select(*scan.columns)
        merged = scan.unionByName(given).repartition("tree", "block").sortWithinPartitions("tree", "block", "level", "pos")
        found = merged.mapInArrow(extract, _PATH)
        if band == 0:
            return found
        found = materialise(found)
        # trees that end below this band keep the path of their root for the bands below
        ended = above.join(found.select("tree").distinct().withColumnRenamed("tree", "_tree"), F.col("tree").eqNullSafe(F.col("_tree")), "left_anti")
        above = found.select("tree", "pos", "shape", "siblings").unionByName(ended)
    raise AssertionError("the lowest band returns")


def folded(node: str, shape: str, siblings: str) -> str:
    """The root that a node and its path give."""
    at = 0
    for side in shape:
        if side == "-":
            node = digest(node)
            continue
        other, at = siblings[at : at + 64], at + 64
        node = digest(other + node if side == "L" else node + other)
    return node


def merkle_manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, and the proof itself (shape, siblings) of every row."""
    spark = docs.sparkSession
    base = materialise(positioned(leaves(docs), ["id", "digest"]))
    store = free_folder(spark)
    bands = build(base.select("tree", "pos", "n", "digest"), store)
    subroots = materialise(roots(spark, store))

    # the last tree: its leaves are the roots of the languages, which name themselves in `own`
    named = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("own"), "digest")
    over = materialise(positioned(named, ["own"]))
    top_store = free_folder(spark)
    top_bands = build(over.select("tree", "pos", "n", "digest"), top_store)
    end = spark.createDataFrame([("", "", "")], "tree string, shape string, siblings string")
    top = paths(spark, top_store, top_bands, end)
    tops = materialise(over.join(top.select("pos", "shape", "siblings"), "pos").select(F.col("own").alias("tree"), "digest", "shape", "siblings"))
    root = roots(spark, top_store).select(F.col("digest").alias("root"))

    proofs = paths(spark, store, bands, tops)
    named = tops.select(F.col("tree").alias("_tree"), F.col("digest").alias("subroot"))
    found = base.select("tree", "pos", "id", "tampered").alias("b").join(proofs.alias("p"), F.col("b.tree").eqNullSafe(F.col("p.tree")) & (F.col("b.pos") == F.col("p.pos")))
    found = found.join(named, F.col("b.tree").eqNullSafe(F.col("_tree"))).select("id", "tampered", "digest", "subroot", "shape", "siblings")

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = {name: batch.column(name).to_pylist() for name in batch.schema.names}
            back = [folded(t or d, s, o) for t, d, s, o in zip(r["tampered"], r["digest"], r["shape"], r["siblings"])]
            names = [*batch.schema.names, "folded_root"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.string())], names=names)

    checked = found.mapInArrow(fold, T.StructType([*found.schema.fields, T.StructField("folded_root", T.StringType())]))
    # one row: the digest of everything
    whole = root.first()
    total = F.lit(whole["root"] if whole else None).cast("string")
    return checked.select(
        F.col("id").alias("doc_id"),
        F.col("digest").alias("leaf"),
        "subroot",
        total.alias("root"),
        F.sha2(F.col("siblings").cast("binary"), 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == total).alias("verified"),
        F.col("shape").alias("proof_shape"),
        F.col("siblings").alias("proof"),
    )
