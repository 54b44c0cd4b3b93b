"""SimHash near-duplicates with an exact check of similarity.

Two texts are near-duplicates if the Jaccard similarity of their sets of
5-word shingles is 0.8 or more; groups are the chains of such pairs. One
64-bit fingerprint of all shingles cannot decide that (such pairs differ in
about 5 to 13 of 64 bits), so a text gets PRINTS fingerprints, each the
SimHash of a consistent sample of its shingles: those with the least hash
under SAMPLE permutations of its own. Every fingerprint is embedded by its
bits per segment and joined over a grid as in `simhash`.

1. Equal texts are one point. Two texts of similarity s draw the same sample
   with probability s**SAMPLE, and meet with 1 - (1 - s**SAMPLE)**PRINTS at
   least: 0.9997 at 0.8, more for closer pairs.
2. Members of a cell that pass the Manhattan bound, the Hamming distance and
   a bound on the share of equal minima (4.5 standard deviations below 0.8)
   are candidates. A cell reports candidates that connect what is connected
   by candidates, not all of them; so connected texts are a family.
3. Inside a family every pair that no chain of links joins yet is verified on
   whole shingle sets, which travel once per family and not once per pair. A
   family reports links that connect its groups. So rows grow with the
   number of texts whatever the size of a group, and nothing is capped.

Cells and families too large for one task are cut into blocks, and every
pair of blocks is a task of its own.

Defined results: a null or empty text has no shingles and is similar to any
other such text only; a text of fewer than five words has one shingle;
repeated rows are one; of a group the row with the least id stays, a null id
only where there is no other, the least hash of the text among equal ids; an
empty table gives an empty result. Equal 64-bit hashes are taken as equal
shingles and as equal texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import free_name, materialise, slices
from lectern.llm.components import components
from lectern.llm.simhash import _cells, chosen_rows, embedded, projections, shingle_hashes, unchanged_groups

SHINGLE = 5
#: Least similarity, as a fraction.
LEAST = (4, 5)
PRINTS, SAMPLE = 20, 5
#: Differing bits of two fingerprints that still make a candidate.
MAX_BITS = 1
#: Least share of equal minima of a candidate.
LEAST_AGREEMENT = 0.62
#: Members of a cell, and of a family, that one task holds at most of each of two blocks.
CELL_BLOCK, FAMILY_BLOCK = 20_000, 1_000
#: Shingles whose minima are taken at once; keeps them in the processor's cache.
_AT_ONCE = 16_000
_FACTORS, _TERMS = np.random.default_rng(7).integers(0, 1 << 63, (2, PRINTS * SAMPLE), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def shingle_set(text: bytes) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, SHINGLE), np.uint64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have the least similarity; two empty ones have."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return LEAST[1] * both >= LEAST[0] * (len(a) + len(b) - both)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """One row of PRINTS * SAMPLE minima per set; an empty set has the largest values."""
    out = np.full((len(sets), PRINTS * SAMPLE), np.uint64(0xFFFFFFFFFFFFFFFF))
    full = [i for i, s in enumerate(sets) if len(s)]
    start = 0
    while start < len(full):
        end, size = start, 0
        while end < len(full) and (end == start or size + len(sets[full[end]]) <= _AT_ONCE):
            size += len(sets[full[end]])
            end += 1
        part = full[start:end]
        flat = np.concatenate([sets[i] for i in part])
        counts = np.array([len(sets[i]) for i in part])
        heads = np.cumsum(counts) - counts
        for k, (factor, term) in enumerate(zip(_FACTORS, _TERMS)):
            out[part, k] = np.minimum.reduceat((flat ^ term) * factor, heads)
        start = end
    return out


def fingerprints(found: np.ndarray) -> np.ndarray:
    """PRINTS fingerprints per row of minima: a bit is set where over half of a sample's shingles have it."""
    x = found ^ (found >> np.uint64(32))
    x = (x * _MIX) ^ ((x * _MIX) >> np.uint64(29))
    bits = np.unpackbits((x * _MIX).astype(">u8").view(np.uint8)).reshape(len(found), PRINTS, SAMPLE, 64)
    return np.packbits(2 * bits.sum(axis=2, dtype=np.uint8) > SAMPLE, axis=2).view(">u8").reshape(len(found), PRINTS).astype(np.uint64)


def sketches(found: np.ndarray) -> list[bytes]:
    """The fingerprints, and a byte of every minimum."""
    prints, codes = fingerprints(found), (found >> np.uint64(56) ^ found >> np.uint64(23)).astype(np.uint8)
    return [p.tobytes() + c.tobytes() for p, c in zip(prints, codes)]


def _opened(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints and bytes of minima of sketches."""
    raw = np.frombuffer(b"".join(rows), np.uint8).reshape(len(rows), PRINTS * (8 + SAMPLE))
    return np.ascontiguousarray(raw[:, : 8 * PRINTS]).view(np.uint64), raw[:, 8 * PRINTS :]


def candidates(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Where some fingerprint is within the Manhattan bound and then the Hamming distance, and enough minima agree."""
    ok = (a[1] == b[1]).mean(axis=1) >= LEAST_AGREEMENT
    one, two = a[0][ok], b[0][ok]
    near = (np.bitwise_count(embedded(one) ^ embedded(two)) <= MAX_BITS) & (np.bitwise_count(one ^ two) <= MAX_BITS)
    ok[ok] = near.any(axis=1)
    return ok


def grid(prints: np.ndarray, masks: list[int]) -> np.ndarray:
    """Cells of every row of fingerprints, one per fingerprint and projection."""
    codes = embedded(prints)
    return np.stack([_cells(codes[:, k], k * len(masks) + m, mask) for k in range(PRINTS) for m, mask in enumerate(masks)], axis=1)


def grid_masks(points: int) -> list[int]:
    return projections(MAX_BITS, unchanged_groups(MAX_BITS, points))


def _sketched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        found = minima([shingle_set((t or "").encode()) for t in batch.column("text").to_pylist()])
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("node"), pa.array(sketches(found), pa.binary())], names=["key", "node", "sketch"])


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([shingle_set((t or "").encode()).tobytes() for t in batch.column("text").to_pylist()], pa.binary())], names=["key", "shingles"])


def _met(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (cell, key) by cell and key, those of cells with several members."""
    last: tuple[int, int] | None = None
    lone = True
    for batch in batches:
        if not batch.num_rows:
            continue
        cell, key = (batch.column(c).to_numpy() for c in ("cell", "key"))
        new = np.concatenate(([last is None or cell[0] != last[0]], cell[1:] != cell[:-1]))
        before = np.concatenate(([last[1] if last else 0], key[:-1]))
        # a first member goes out with its second one, which may come in the next batch
        opened = np.flatnonzero(~new & np.concatenate(([lone and last is not None], new[:-1])))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((cell[~new], cell[opened]))), pa.array(np.concatenate((key[~new], before[opened])))], names=["cell", "key"])
        lone, last = bool(new[-1]), (int(cell[-1]), int(key[-1]))


def _grouped(batches: Iterable[pa.RecordBatch], names: tuple[str, ...], value: str) -> Iterator[tuple[list[np.ndarray], list[bytes]]]:
    """Whole groups (equal in the first two columns) of rows that come group by group: their number columns, and their binary one."""
    held: list[tuple[list[np.ndarray], list[bytes]]] = []

    def whole() -> tuple[list[np.ndarray], list[bytes]]:
        return [np.concatenate(c) for c in zip(*(columns for columns, _ in held))], [v for _, values in held for v in values]

    for batch in batches:
        if not batch.num_rows:
            continue
        columns, values = [batch.column(c).to_numpy() for c in names], batch.column(value).to_pylist()
        group, part = columns[0], columns[1]
        begin = [0, *(np.flatnonzero((group[1:] != group[:-1]) | (part[1:] != part[:-1])) + 1).tolist(), len(group)]
        for a, b in zip(begin, begin[1:]):
            if a == 0 and held and (held[-1][0][0][-1] != group[0] or held[-1][0][1][-1] != part[0]):
                yield whole()
                held = []
            elif a:
                yield whole()
                held = []
            held.append(([c[a:b] for c in columns], values[a:b]))
    if held:
        yield whole()


def _open(labels: np.ndarray, block: np.ndarray, i: int, crossing: bool) -> np.ndarray:
    """Members behind the i-th that no chain joins to it yet; where a group is of two blocks, those of the other block."""
    open_ = labels[i + 1 :] != labels[i]
    if crossing:
        open_ &= block[i + 1 :] != block[i]
    return np.flatnonzero(open_) + i + 1


def _connected(key: np.ndarray, block: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of keys that connect what is connected by near pairs: near(i, js) says which of the js are near the i-th."""
    labels = np.arange(len(key))
    crossing = bool((block != block[0]).any())
    out = []
    for i in range(len(key) - 1):
        at = _open(labels, block, i, crossing)
        for j in at[near(i, at)].tolist() if len(at) else ():
            if labels[j] != labels[i]:
                out.append((int(min(key[i], key[j])), int(max(key[i], key[j]))))
                labels[labels == labels[j]] = labels[i]
    return out


def cell_candidates(key: np.ndarray, block: np.ndarray, rows: list[bytes]) -> list[tuple[int, int]]:
    """Candidates that connect the members of a cell."""
    opened = _opened(rows)
    take = lambda at: (opened[0][at], opened[1][at])
    return _connected(key, block, lambda i, at: candidates(take(np.full(len(at), i)), take(at)))


def family_links(key: np.ndarray, block: np.ndarray, rows: list[bytes]) -> list[tuple[int, int]]:
    """Links that connect the members of a family, each verified on the whole sets."""
    sets = [np.frombuffer(r, np.uint64) for r in rows]
    size = np.array(list(map(len, sets)))
    ends = np.cumsum(size)
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    marked = np.zeros(len(flat) + 1, bool)

    def near(i: int, at: np.ndarray) -> np.ndarray:
        # the share of the smaller set bounds the similarity
        fits = LEAST[1] * np.minimum(size[at], size[i]) >= LEAST[0] * np.maximum(size[at], size[i])
        own = flat[ends[i] - size[i] : ends[i]]
        marked[own] = True
        both = np.zeros(len(at), np.int64)
        for k in np.flatnonzero(fits).tolist():
            both[k] = np.count_nonzero(marked[flat[ends[at[k]] - size[at[k]] : ends[at[k]]]])
        marked[own] = False
        return fits & (LEAST[1] * both >= LEAST[0] * (size[at] + size[i] - both))

    return _connected(key, block, near)


def _linked(group: str, value: str, links: Callable[[np.ndarray, np.ndarray, list[bytes]], list[tuple[int, int]]]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, int]] = []
        for (_, _, key, block), rows in _grouped(batches, (group, "part", "key", "block"), value):
            found += links(key, block, rows) if len(key) > 1 else []
            if len(found) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["u", "v"])
                found = []
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["u", "v"])

    return run


def _blocked(rows: DataFrame, group: str, most: int) -> DataFrame:
    """Rows (group, key) with block and part: a group of more than `most` rows is cut into blocks, and a row is in a part for every block that its own meets."""
    large = materialise(rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(group, F.ceil(F.col("n") / most).cast("long").alias("n")))
    if large.isEmpty():
        return rows.withColumns({"block": F.lit(0).cast("long"), "part": F.lit(0).cast("long")})
    cut = rows.join(large, group, "left").withColumn("n", F.coalesce("n", F.lit(1).cast("long")))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("key", F.lit("block")), F.col("n")))
    parts = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda o: F.least(o, "block") * F.col("n") + F.greatest(o, "block"))
    return cut.withColumn("part", F.explode(parts)).drop("n")


def _links(rows: DataFrame, of: DataFrame, group: str, value: str, most: int, links: Callable) -> DataFrame:
    """Links (u, v) inside the groups of rows (group, key), by the values of the keys."""
    valued = materialise(_blocked(rows, group, most)).join(of.select("key", value), "key").select(group, "part", "key", "block", value)
    return valued.repartition(group, "part").sortWithinPartitions(group, "part").mapInArrow(_linked(group, value, links), "u long, v long").distinct()


def _key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def groups(docs: DataFrame) -> DataFrame:
    """(key, least, root) of every distinct text: its hash, its least id (null where all are), and the least key of its group."""
    rows = docs.select(_key(F.col("text")).alias("key"), F.col("doc_id").cast("long").alias("node"), "text")
    found = rows.mapInArrow(_sketched, "key long, node long, sketch binary")
    points = materialise(found.groupBy("key").agg(F.min("node").alias("least"), F.first("sketch").alias("sketch")))
    masks = grid_masks(points.count())

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 5_000):
                part = batch.slice(start, 5_000)
                cells = grid(_opened(part.column("sketch").to_pylist())[0], masks)
                yield pa.RecordBatch.from_arrays([pa.array(cells.view(np.int64).reshape(-1)), pa.array(np.repeat(part.column("key").to_numpy(), cells.shape[1]))], names=["cell", "key"])

    placed = points.select("key", "sketch").mapInArrow(deal, "cell long, key long")
    met = materialise(placed.repartition("cell").sortWithinPartitions("cell", "key").mapInArrow(_met, "cell long, key long"))
    families = materialise(components(materialise(_links(met, points, "cell", "sketch", CELL_BLOCK, cell_candidates))).withColumnRenamed("node", "key"))
    involved = families.select("key").join(points.select("key", F.col("least").alias("id")), "key")
    same = (rows["key"] == involved["key"]) & rows["node"].eqNullSafe(involved["id"])
    texts = rows.join(involved, same).groupBy(involved["key"].alias("key")).agg(F.first("text").alias("text"))
    sets = texts.mapInArrow(_sets, "key long, shingles binary")
    links = materialise(_links(families.withColumnRenamed("root", "family"), sets, "family", "shingles", FAMILY_BLOCK, family_links))
    roots = materialise(components(links).withColumnRenamed("node", "key"))
    return materialise(points.select("key", "least").join(roots, "key", "left").select("key", "least", F.coalesce("root", "key").alias("root")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and component_id, the least doc_id of its group, of every row."""
    source = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    found = groups(source)
    named = materialise(found.join(found.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("key", "component_id"))
    return source.select("doc_id", _key(F.col("text")).alias("key")).join(named, "key").select("doc_id", "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of every group of near-duplicates, the one with the least doc_id, with all columns of docs."""
    # a struct with a null id would come first
    first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "key")).alias("first")
    chosen = groups(docs).groupBy("root").agg(first).select("first.key", "first.least")
    key = free_name(docs, "_key")
    return chosen_rows(docs.withColumn(key, _key(F.col("text"))), key, chosen)
