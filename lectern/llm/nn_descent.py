"""Near-duplicate vectors by NN-descent over a neighbour graph.

1. Equal unit vectors are one point. Points that stand close together become
   balls: rows in the order of their signs against random planes are cut into
   blocks, and in a block whatever lies within a quarter of the linking angle
   of a centre joins it. This is repeated over the balls until few join, so a
   group of any size shrinks by a factor of a block's rows each time. Any two
   vectors of a ball link, which nobody has to compare or list.
2. A neighbour graph over the balls starts from a few such orders and is
   refined by NN-descent: whatever meets at a common neighbour is compared,
   where one of the two is new, and enters a list that it improves. A list
   holds the nearest `WIDTH`; where all of these may link it is saturated and
   is enlarged to hold every neighbour found that may link. What meets at a
   hub is compared in bounded parts, dealt anew every round.
3. An audit compares a sample of balls (`AUDIT`) with all others. Links that
   it misses go into the graph, and below `RECALL` further orders and rounds
   follow.
4. Edges near enough are decided in double precision: two balls link wholly
   where their centres' angle and radii leave no doubt, else their vectors are
   compared, first with the other centre, then one by one in bounded blocks.
   Components come from star steps over the links.

The graph finds candidates and nothing below the threshold is ever linked;
links that it does not find are the method's only error, measured by the audit.

Defined results: null and zero vectors and those with null or non-finite
components link with nothing and are components of their own, as are vectors
of different lengths to each other; a repeated row is one more vector at
cosine 1; rows that share an id are counted one by one; a null id names no
component unless all its members are null, and it is kept where the component
is null; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import buckets, materialise
from lectern.llm.components import components

#: Least cosine of a link.
COSINE = 0.9
#: Neighbours in a list that is not saturated, random orders at the start, rows of an order that are compared with each other.
WIDTH, ORDERS, BLOCK = 12, 5, 256
#: Neighbours of a node that are compared with each other at once.
MEETING = 64
#: Balls that the audit compares with all others, the least share of their links that the graph must hold, further tries.
AUDIT, RECALL, TRIES = 2_000, 0.999, 3
#: A round that changes fewer than this share of the lists' entries is the last; most rounds in a row.
SETTLED, ROUNDS = 0.005, 6
#: Points of a ball that are compared with others at once.
PACK = 512
#: What single precision may be off by, in cosine, and what an angle may be off by.
_SLACK, _TURN = 1e-5, 1e-7

_BALL = "ball long, centre binary, radius double, weight long, size long"
_EDGE = "node long, nbr long, sim float, close boolean, fresh boolean"


def units(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and unit, the vector at length 1 as packed doubles; null where it links with nothing."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for values in batch.column("vector").to_pylist():
                unit = None
                if values and None not in values:
                    x = np.array(values, np.float64)
                    if np.isfinite(x).all() and (most := np.abs(x).max()) > 0:
                        x /= most  # no square overflows
                        unit = (x / math.sqrt(float(x @ x)) + 0.0).tobytes()
                out.append(unit)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(out, pa.binary())], names=["vec_id", "unit"])

    return vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].alias("vector")).mapInArrow(run, "vec_id long, unit binary")


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.float64).reshape(len(values), -1)


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1.0, 1.0))


def _bytes(balls: DataFrame) -> int:
    """Bytes of all balls, about."""
    return balls.agg(F.sum(F.octet_length("centre") + 64)).first()[0] or 0


def _ordered(balls: DataFrame, seeds: list[int], *columns: str) -> DataFrame:
    """The balls once per seed, in the order of their signs against 63 random planes; no partition outgrows its share whatever the vectors."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("centre"))
            for seed in seeds:
                if (seed, x.shape[1]) not in planes:
                    planes[seed, x.shape[1]] = np.random.default_rng(seed).standard_normal((x.shape[1], 63))
                signs = x @ planes[seed, x.shape[1]] > 0
                code = signs @ (np.int64(1) << np.arange(62, -1, -1, dtype=np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), seed), pa.int32()), pa.array(code, pa.int64()), *batch.columns], names=["seed", "code", *batch.schema.names])

    types = {f.split()[0]: f for f in _BALL.split(", ")}
    placed = balls.select(*columns).mapInArrow(run, ", ".join(["seed int", "code long", *(types[c] for c in columns)]))
    n = buckets(balls.sparkSession, _bytes(balls) * len(seeds))
    return placed.repartitionByRange(n, "seed", "code", "ball").sortWithinPartitions("seed", "code", "ball")


def _blocks(batches: Iterable[pa.RecordBatch], size: int, keys: list[str]) -> Iterator[pa.Table]:
    """Rows in their order, cut at every change of the keys and after `size` rows."""
    held: list[pa.RecordBatch] = []
    rows, current = 0, None
    for batch in batches:
        marks = list(zip(*(batch.column(k).to_pylist() for k in keys))) if keys else [()] * batch.num_rows
        start = 0
        for mark, run in itertools.groupby(marks):
            length = sum(1 for _ in run)
            if mark != current and rows:
                yield pa.Table.from_batches(held)
                held, rows = [], 0
            current = mark
            while length:
                part = min(length, size - rows)
                held.append(batch.slice(start, part))
                start, length, rows = start + part, length - part, rows + part
                if rows == size:
                    yield pa.Table.from_batches(held)
                    held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held)


def merged(x: np.ndarray, radius: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Balls of a block: which row each joins, and centres and radii of those that others join."""
    angle = _angles(x @ x.T)
    np.fill_diagonal(angle, 0)
    ok = angle + radius <= most
    into, centre, reach, free = np.arange(len(x)), x.copy(), radius.copy(), np.ones(len(x), bool)
    crowd = ok.sum(axis=1)
    for i in np.argsort(-crowd, kind="stable"):
        if crowd[i] < 2:
            break
        members = np.flatnonzero(ok[i] & free)
        if not free[i] or len(members) < 2:
            continue
        middle = x[members].mean(axis=0)
        middle /= np.linalg.norm(middle)
        r = float((_angles(x[members] @ middle) + radius[members]).max()) + _TURN
        if r > most:
            middle, r = x[i], float((angle[i, members] + radius[members]).max()) + _TURN
        free[members] = False
        into[members], centre[i], reach[i] = i, middle, r
    return into, centre, reach


def _contracted(balls: DataFrame, seed: int, most: float) -> DataFrame:
    """ball and into for every ball, with the data of the new ball where it is its first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches, BLOCK, ["seed"]):
            x, ids = _matrix(table.column("centre")), table.column("ball").to_numpy()
            into, centre, reach = merged(x, table.column("radius").to_numpy(), most)
            weight, size = (np.bincount(into, table.column(c).to_numpy(), len(ids)).astype(np.int64) for c in ("weight", "size"))
            head = into == np.arange(len(ids))
            data = [c.tobytes() if h else None for c, h in zip(centre, head)]
            arrays = [pa.array(ids), pa.array(ids[into]), pa.array(data, pa.binary()), pa.array(reach), pa.array(weight), pa.array(size)]
            yield pa.RecordBatch.from_arrays(arrays, names=["was", "ball", "centre", "radius", "weight", "size"])

    return _ordered(balls, [seed], "ball", "centre", "radius", "weight", "size").mapInArrow(run, f"was long, {_BALL}")


def balls_of(points: DataFrame, most: float) -> tuple[DataFrame, DataFrame]:
    """Balls of at most that radius, and the ball of each point (point, ball)."""
    balls = points.select(F.col("point").alias("ball"), F.col("unit").alias("centre"), F.lit(0.0).alias("radius"), "weight", F.lit(1).cast("long").alias("size"))
    home = points.select("point", F.col("point").alias("ball"))
    left = points.count()
    for level in itertools.count():
        moved = materialise(_contracted(balls, 1_000 + level, most))
        balls = moved.where(F.col("centre").isNotNull()).select("ball", "centre", "radius", "weight", "size")
        home = materialise(home.withColumnRenamed("ball", "was").join(moved.select("was", "ball"), "was").select("point", "ball"))
        before, left = left, balls.count()
        if left > 0.98 * before:
            return balls, home


def _found(ids: np.ndarray, x: np.ndarray, radius: np.ndarray, floor: np.ndarray, fresh: np.ndarray, angle: float, width: int | None) -> Iterator[tuple[np.ndarray, ...]]:
    """Edges among rows that are compared with each other: the nearest `width` of each, or what lies above a row's floor, and all that may link."""
    sims = x @ x.T
    np.fill_diagonal(sims, -3)
    close = sims >= np.cos(np.minimum(np.pi, angle + radius[:, None] + radius)) - _SLACK
    np.fill_diagonal(close, False)
    if width is None:
        good = ((sims > floor[:, None]) | close) & (fresh[:, None] | fresh)
        np.fill_diagonal(good, False)
    else:
        good = close.copy()
        if len(ids) > width:
            np.put_along_axis(good, np.argpartition(-sims, width, axis=1)[:, :width], True, axis=1)
        else:
            good[:] = True
        np.fill_diagonal(good, False)
    a, b = np.nonzero(good)
    if len(a):
        yield ids[a], ids[b], sims[a, b], close[a, b]


def _edges(found: Iterable[tuple[np.ndarray, ...]], fresh: bool = True) -> Iterator[pa.RecordBatch]:
    names, types = ["node", "nbr", "sim", "close"], [pa.int64(), pa.int64(), pa.float32(), pa.bool_()]
    held: list[tuple] = []
    rows = 0

    def batch() -> pa.RecordBatch:
        arrays = [pa.array(np.concatenate(c), t) for c, t in zip(zip(*held), types)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(np.full(rows, fresh))], names=[*names, "fresh"])

    for part in found:
        held.append(part)
        rows += len(part[0])
        if rows > 100_000:
            yield batch()
            held, rows = [], 0
    if held:
        yield batch()


def _from_orders(balls: DataFrame, seeds: list[int], angle: float, width: int) -> DataFrame:
    """Edges between balls that stand in a block of a random order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[np.ndarray, ...]]:
            for table in _blocks(batches, BLOCK, ["seed"]):
                ids = table.column("ball").to_numpy()
                yield from _found(ids, _matrix(table.column("centre")).astype(np.float32), table.column("radius").to_numpy(), ids, ids, angle, width)

        return _edges(found())

    return _ordered(balls, seeds, "ball", "centre", "radius").mapInArrow(run, _EDGE)


def _lists(edges: DataFrame, width: int) -> DataFrame:
    """The neighbour lists: the nearest of each node, and all that may link. An edge that was there is not fresh."""
    once = edges.groupBy("node", "nbr").agg(F.max("sim").alias("sim"), F.bool_or("close").alias("close"), F.bool_and("fresh").alias("fresh"))
    near = Window.partitionBy("node").orderBy(F.desc("sim"), "nbr")
    return once.withColumn("place", F.row_number().over(near)).where((F.col("place") <= width) | F.col("close")).select("node", "nbr", "sim", "close", "fresh", "place")


def _descended(balls: DataFrame, lists: DataFrame, angle: float, width: int, seed: int) -> DataFrame:
    """Edges between neighbours of a common node, at least one of them new there, that improve a list."""
    meet = lists.select(F.col("node").alias("at"), F.col("nbr").alias("ball"), "fresh")
    meet = meet.unionByName(lists.select(F.col("nbr").alias("at"), F.col("node").alias("ball"), "fresh")).groupBy("at", "ball").agg(F.bool_or("fresh").alias("fresh"))
    meet = meet.join(meet.where("fresh").select("at").distinct(), "at", "left_semi")
    # the least similarity that still enters a full list
    floor = lists.groupBy("node").agg(F.min(F.when(F.col("place") == width, F.col("sim"))).alias("floor"))
    held = balls.join(floor.withColumnRenamed("node", "ball"), "ball", "left").select("ball", "centre", "radius", F.coalesce("floor", F.lit(-2.0)).cast("double").alias("floor"))
    # a ball stands at each neighbour that has it, and at each that it has
    n = buckets(balls.sparkSession, 2 * width * _bytes(balls))
    turn = F.xxhash64("ball", F.lit(seed))
    dealt = meet.join(held, "ball").withColumn("turn", turn).repartitionByRange(n, "at", "turn").sortWithinPartitions("at", "turn")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[np.ndarray, ...]]:
            for table in _blocks(batches, MEETING, ["at"]):
                if table.num_rows > 1:
                    columns = (table.column(c).to_numpy() for c in ("radius", "floor", "fresh"))
                    yield from _found(table.column("ball").to_numpy(), _matrix(table.column("centre")).astype(np.float32), *columns, angle, None)

        return _edges(found())

    return dealt.select("at", "ball", "fresh", "centre", "radius", "floor").mapInArrow(run, _EDGE)


def _audit(balls: DataFrame, angle: float, sample: int, seed: int) -> DataFrame:
    """All edges that may link of a sample of the balls, by comparing them with every ball."""
    chosen = balls.orderBy(F.xxhash64("ball", F.lit(seed)), "ball").limit(sample).select("ball", "centre", "radius").collect()
    ids = np.array([r["ball"] for r in chosen], np.int64)
    x = np.frombuffer(b"".join(bytes(r["centre"]) for r in chosen)).reshape(len(ids), -1).astype(np.float32) if chosen else np.zeros((0, 1), np.float32)
    radius = np.array([r["radius"] for r in chosen])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[tuple[np.ndarray, ...]]:
            for table in _blocks(batches, 2_048, []):
                other, r = table.column("ball").to_numpy(), table.column("radius").to_numpy()
                sims = x @ _matrix(table.column("centre")).astype(np.float32).T
                a, b = np.nonzero((sims >= np.cos(np.minimum(np.pi, angle + radius[:, None] + r)) - _SLACK) & (ids[:, None] != other))
                if len(a):
                    yield ids[a], other[b], sims[a, b], np.ones(len(a), bool)

        return _edges(found())

    return balls.select("ball", "centre", "radius").mapInArrow(run, _EDGE)


def neighbour_graph(balls: DataFrame, angle: float, width: int = WIDTH, orders: int = ORDERS, audit: int = AUDIT) -> tuple[DataFrame, float]:
    """Edges (node, nbr) of all balls found that may hold links, and the share of the audited ones that descent had found."""
    seeds = itertools.count(1)
    entries = max(1, balls.count()) * width
    lists = materialise(_lists(_from_orders(balls, [next(seeds) for _ in range(orders)], angle, width), width))
    for last in range(TRIES + 1):
        for _ in range(ROUNDS):
            found = _descended(balls, lists, angle, width, next(seeds))
            old = lists.drop("place").withColumn("fresh", F.lit(False))
            lists = materialise(_lists(old.unionByName(found), width))
            if lists.where("fresh").count() < SETTLED * entries:
                break
        truth = materialise(_audit(balls, angle, audit, next(seeds)))
        total = truth.count()
        missed = truth.join(lists.where("close").select("node", "nbr"), ["node", "nbr"], "left_anti")
        recall = 1 - missed.count() / total if total else 1.0
        more = missed.unionByName(missed.select(F.col("nbr").alias("node"), F.col("node").alias("nbr"), "sim", "close", "fresh"))
        old = lists.drop("place").withColumn("fresh", F.lit(False))
        if recall >= RECALL or last == TRIES:
            return old.unionByName(more).where("close").select("node", "nbr").distinct(), recall
        fresh = _from_orders(balls, [next(seeds) for _ in range(orders)], angle, width)
        lists = materialise(_lists(old.unionByName(more).unionByName(fresh), width))
    raise AssertionError("the last try returns")


def _decided(pairs: DataFrame, cosine: float, angle: float) -> DataFrame:
    """all (every vector of one links with every one of the other) and some (unknown) for pairs of balls with their centres and radii."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cosines = np.einsum("ij,ij->i", _matrix(batch.column("x")), _matrix(batch.column("y")))
            r, turn = batch.column("rx").to_numpy() + batch.column("ry").to_numpy(), _angles(cosines)
            whole = np.where(r == 0, cosines >= cosine, turn + r <= angle - _TURN)
            some = ~whole & (r > 0) & (turn - r <= angle + _TURN)
            keep = np.flatnonzero(whole | some)
            rest = batch.drop_columns(["x", "y", "rx", "ry"]).take(pa.array(keep))
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(whole[keep])], names=[*rest.schema.names, "whole"])

    out = [f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema if f.name not in ("x", "y", "rx", "ry")]
    return pairs.mapInArrow(run, ", ".join([*out, "whole boolean"]))


def _packed(rows: DataFrame, keys: list[str], size: str | Column) -> DataFrame:
    """Points (point, unit, weight) in packs of about PACK under their keys."""
    parts = F.greatest(F.ceil(F.col(size) / PACK) if isinstance(size, str) else size, F.lit(1))
    packs = rows.withColumn("pack", F.pmod(F.xxhash64("point"), parts))
    return packs.groupBy(*keys, "pack").agg(F.collect_list(F.struct("point", "unit", "weight")).alias("held"))


def _compared(pairs: DataFrame, cosine: float) -> DataFrame:
    """point and n, the rows of the other pack that it links with, for packs `mine` and `theirs`; a and b name the balls."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for mine, theirs, a, b in zip(*(batch.column(c).to_pylist() for c in ("mine", "theirs", "a", "b"))):
                x, y = (np.frombuffer(b"".join(r["unit"] for r in side)).reshape(len(side), -1) for side in (mine, theirs))
                n = (x @ y.T >= cosine) @ np.array([r["weight"] for r in theirs], np.int64)
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([mine[k]["point"] for k in at.tolist()], pa.int64()), pa.array([a] * len(at), pa.int64()), pa.array([b] * len(at), pa.int64()), pa.array(n[at])], names=["point", "a", "b", "n"])

    return pairs.select("mine", "theirs", "a", "b").mapInArrow(run, "point long, a long, b long, n long")


def _linked(points: DataFrame, balls: DataFrame, home: DataFrame, edges: DataFrame, cosine: float, angle: float) -> tuple[DataFrame, DataFrame]:
    """Links of each point beyond its ball (point, n), and links between balls (u, v)."""
    side = balls.select("ball", "centre", "radius")
    pairs = edges.select(F.least("node", "nbr").alias("a"), F.greatest("node", "nbr").alias("b")).distinct()
    pairs = pairs.join(side.toDF("a", "x", "rx"), "a").join(side.toDF("b", "y", "ry"), "b")
    known = materialise(_decided(pairs, cosine, angle))
    both = known.unionByName(known.select(F.col("b").alias("a"), F.col("a").alias("b"), "whole"))
    load = balls.select(F.col("ball").alias("b"), "weight")
    sums = both.where("whole").join(load, "b").groupBy("a").agg(F.sum("weight").alias("n"))
    wholly = home.join(sums.withColumnRenamed("a", "ball"), "ball").select("point", "n")

    # pairs in doubt: each vector against the other centre
    members = home.join(points, "point").select("point", "ball", "unit", "weight")
    doubt = both.where("not whole").select("a", "b").join(balls.select(F.col("ball").alias("b"), F.col("centre").alias("y"), F.col("radius").alias("ry"), F.col("weight").alias("load"), "size"), "b")
    single = doubt.join(members.select(F.col("ball").alias("a"), "point", F.col("unit").alias("x"), "unit", "weight"), "a").withColumn("rx", F.lit(0.0))
    single = materialise(_decided(single, cosine, angle))
    outright = single.where("whole").select("point", "a", "b", F.col("load").alias("n"))
    # and what is still in doubt one by one
    unsure = single.where("not whole")
    crowds = unsure.groupBy("a", "b").agg(F.count(F.lit(1)).alias("crowd"))
    mine = _packed(unsure.select("a", "b", "point", "unit", "weight").join(crowds, ["a", "b"]), ["a", "b"], "crowd").select("a", "b", F.col("held").alias("mine"))
    wanted = members.join(unsure.select(F.col("b").alias("ball")).distinct(), "ball", "left_semi").join(balls.select("ball", "size"), "ball")
    theirs = _packed(wanted, ["ball"], "size").select(F.col("ball").alias("b"), F.col("held").alias("theirs"))
    one_by_one = materialise(_compared(mine.join(theirs, "b"), cosine))
    partly = outright.unionByName(one_by_one.select("point", "a", "b", "n"))
    n = wholly.unionByName(partly.select("point", "n")).groupBy("point").agg(F.sum("n").alias("n"))
    return n, known.where("whole").select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(partly.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct())


def _classes(points: DataFrame, cosine: float, note: Callable[[float], None] | None) -> DataFrame:
    """unit, n_links, component_id of points of one length."""
    angle = math.acos(cosine)
    balls, home = balls_of(points, angle / 4)
    edges, recall = neighbour_graph(balls, angle)
    if note is not None:
        note(recall)
    more, links = _linked(points, balls, home, materialise(edges), cosine, angle)
    roots = materialise(components(materialise(links)))
    placed = home.join(points, "point").join(balls.select("ball", F.col("weight").alias("load")), "ball")
    placed = placed.join(roots.withColumnRenamed("node", "ball"), "ball", "left").join(more, "point", "left")
    placed = materialise(placed.select("unit", "least", F.coalesce("root", "ball").alias("root"), (F.col("load") - 1 + F.coalesce("n", F.lit(0))).alias("n_links")))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return placed.join(named, "root").select("unit", "n_links", "component_id")


def near_vectors(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", note: Callable[[float], None] | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row; note is called with each audit's recall."""
    rows = materialise(units(vectors, id_col, vector_col))
    points = rows.where(F.col("unit").isNotNull()).groupBy("unit").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least"))
    points = materialise(points.withColumn("point", F.monotonically_increasing_id()))
    # vectors of different lengths never meet; a table has one length, or a few
    lengths = [r[0] for r in points.select(F.octet_length("unit")).distinct().collect()]
    found = [_classes(points.where(F.octet_length("unit") == n), cosine, note) for n in lengths]
    alone = rows.where(F.col("unit").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    for part in found:
        alone = alone.unionByName(rows.join(materialise(part), "unit").select("vec_id", "n_links", "component_id"))
    return alone.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
