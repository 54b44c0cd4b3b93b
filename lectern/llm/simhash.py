"""SimHash near-duplicates by segment-popcount embedding.

A fingerprint is cut into 32 segments of two bits; the number of set bits
per segment embeds it in a grid of 32 coordinates, where the Manhattan
distance of two points never exceeds the Hamming distance of their
fingerprints. All pairs within Manhattan distance d are found by a range
join over the grid: the coordinates form d + s groups, of which a distance
of at most d leaves s unchanged, so every point goes into one cell per
choice of s groups and partners are looked for inside cells only. Results
do not depend on s; it grows with the number of points, which keeps the
expected number of chance partners per point small at any size.
Pairs in a cell pass the Manhattan bound, then the exact Hamming distance.

Equal fingerprints are one point, whatever their number; the fingerprint
itself names it, so ids may repeat or be null. A cell reports links that
connect its members, not all pairs: in a large cell a member already reached
is never compared again, so a dense group costs about its size, and cells
that are larger still are first cut along their other coordinates. Links are
joined to components by star steps over the link table.

Defined results: a null or empty text has fingerprint zero and is linked
like any other; rows with equal texts share a component whatever their ids;
rows that share an id but not a text are grouped each by its own text; a
null id takes part but never names a component unless all its members are
null (then null); extra columns are ignored; an empty table gives an empty
result. Where one row of each component is chosen, it is the one with the
least id, the least fingerprint among equal ids, a null id only where there
is no other; of rows that are alike in both any one stays.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import annotate, buckets, by_bucket, free_name, materialise, slices
from lectern.llm.components import components

SHINGLE, MAX_BITS, SEED = 4, 4, 42
NULL_ID = (1 << 63) - 1
#: Cells of up to so many points compare all pairs at once; larger ones grow components from seeds.
SMALL_CELL = 48
#: Cells of more points are cut along their other coordinates before that.
LARGE_CELL = 4_096
_EVEN = np.uint64(0x5555555555555555)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def shingle_hashes(text: bytes, width: int = SHINGLE) -> list[int]:
    """XXH64 of every run of `width` lower-cased words; of all words where there are fewer."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = [0, *ends[:-1].tolist()]
    digest = xxhash.xxh64_intdigest
    if n <= width:
        return [digest(joined, SEED)]
    view = memoryview(joined)
    return [digest(view[a:b], SEED) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())]


def fingerprints_of(data: list[bytes], width: int = SHINGLE) -> np.ndarray:
    """64-bit fingerprints: a bit is set where over half of the shingle hashes have it."""
    hashes = [shingle_hashes(t, width) for t in data]
    counts = np.fromiter(map(len, hashes), np.int64, len(data))
    out = np.zeros(len(data), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    flat = np.array([h for hs in hashes for h in hs], np.uint64)
    bits = np.unpackbits(flat.astype(">u8").view(np.uint8)).reshape(-1, 64)
    starts = np.cumsum(counts[full]) - counts[full]
    ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    out[full] = np.packbits(ones * 2 > counts[full][:, None], axis=1).view(">u8").reshape(-1)
    return out


def fingerprints(docs: DataFrame, width: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every whole text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data = [(t or "").encode() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fingerprints_of(data, width).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, fp long")


def embedded(fp: np.ndarray) -> np.ndarray:
    """Counts of set bits per two-bit segment in unary code (0, 1, 2 as 00, 01, 11): differing bits of two codes are their Manhattan distance."""
    high = fp >> np.uint64(1)
    return (fp & high & _EVEN) << np.uint64(1) | ((fp | high) & _EVEN)


#: Chance that two random segments have equal counts, and the cost of comparing a pair in parts of the cost of placing a point.
_EQUAL, _PAIR_COST = 0.375, 0.05
#: Points times projections that a worker places at once; bounds its memory.
_PLACED = 1_500_000


def unchanged_groups(max_bits: int, points: int) -> int:
    """Groups per projection at which placing the points and comparing those that meet by chance costs least."""
    return min(range(2, 9), key=lambda s: comb(max_bits + s, s) * (1 + _PAIR_COST * points * _EQUAL ** (32 * s / (max_bits + s))))


def projections(max_bits: int, same: int = 3) -> list[int]:
    """Masks over the unary code: one per choice of `same` of max_bits + same groups of coordinates."""
    groups = np.array_split(np.arange(32), max_bits + same)
    masks = [sum(3 << (2 * int(s)) for s in g) for g in groups]
    return [sum(chosen) for chosen in combinations(masks, same)]


def _cells(codes: np.ndarray, projection: int, mask: int) -> np.ndarray:
    x = (codes & np.uint64(mask)) + np.uint64(projection + 1)
    for _ in range(2):
        x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(32))


def _near(a: np.ndarray, b: np.ndarray, codes_a: np.ndarray, codes_b: np.ndarray, max_bits: int) -> np.ndarray:
    """Where the Manhattan bound holds and then the exact distance does."""
    ok = np.bitwise_count(codes_a ^ codes_b) <= max_bits
    ok[ok] = np.bitwise_count((a ^ b)[ok]) <= max_bits
    return ok


def _seeded_links(fp: np.ndarray, codes: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect a large cell's members: from each member that was reached, to those not reached yet."""
    left, right = [], []
    rest = np.arange(len(fp))
    frontier: list[int] = []
    while len(rest):
        if not frontier:
            frontier, rest = [int(rest[0])], rest[1:]
            continue
        k = frontier.pop()
        ok = np.bitwise_count(codes[rest] ^ codes[k]) <= max_bits
        ok[ok] = np.bitwise_count(fp[rest[ok]] ^ fp[k]) <= max_bits
        new = rest[ok]
        if len(new):
            left.append(np.full(len(new), k))
            right.append(new)
            frontier += new.tolist()
            rest = rest[~ok]
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def _cut_links(fp: np.ndarray, codes: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for a cell too large for that: partners differ in at most max_bits of max_bits + 1 parts of the coordinates that vary, so they share a part."""
    varies = np.bitwise_or.reduce(codes ^ codes[0])
    bits = [np.uint64(1 << b) for b in range(64) if int(varies) >> b & 1]
    left, right = [], []
    for chosen in np.array_split(np.array(bits, np.uint64), max_bits + 1):
        shared = codes & np.bitwise_or.reduce(chosen) if len(chosen) else np.zeros(len(codes), np.uint64)
        order = np.argsort(shared, kind="stable")
        heads = np.flatnonzero(np.concatenate(([True], shared[order][1:] != shared[order][:-1])))
        for part in np.split(order, heads[1:]):
            if len(part) > 1:
                a, b = _seeded_links(fp[part], codes[part], max_bits)
                left.append(part[a])
                right.append(part[b])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(left), np.concatenate(right)


def cell_links(cells: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that connect, within each cell, all points joined by chains of at most max_bits per step."""
    order = np.argsort(cells, kind="stable")
    cells, fp = cells[order], fp[order]
    codes = embedded(fp)
    heads = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
    sizes = np.diff(np.concatenate((heads, [len(cells)])))
    left, right = [], []
    small = np.repeat(sizes <= SMALL_CELL, sizes)
    for step in range(1, int(sizes[sizes <= SMALL_CELL].max(initial=1))):
        at = np.flatnonzero((cells[step:] == cells[:-step]) & small[step:])
        if len(at):
            at = at[_near(fp[at], fp[at + step], codes[at], codes[at + step], max_bits)]
            left.append(at)
            right.append(at + step)
    for k in np.flatnonzero(sizes > SMALL_CELL):
        part = slice(heads[k], heads[k] + sizes[k])
        a, b = (_cut_links if sizes[k] > LARGE_CELL else _seeded_links)(fp[part], codes[part], max_bits)
        left.append(a + heads[k])
        right.append(b + heads[k])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return order[np.concatenate(left)], order[np.concatenate(right)]


def _stars(u: list[int], v: list[int]) -> tuple[list[int], list[int]]:
    """The same components as links from every node to the least node of its component."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (up := root.setdefault(top, top)) != top:
            top = up
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for a, b in zip(u, v):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    nodes = [x for x in root if find(x) != x]
    return nodes, [find(x) for x in nodes]


def links(points: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (u, v) that connect distinct fingerprints (fp) at max_bits or fewer differing bits; the fingerprints name themselves."""
    size = points.count()
    masks = projections(max_bits, unchanged_groups(max_bits, size))
    n = buckets(points.sparkSession, 10 * size * len(masks))

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, _PLACED // len(masks))
            for start in range(0, batch.num_rows, step):
                yield dealt(batch.slice(start, step))

    def dealt(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
        codes = embedded(fp)
        choice = np.repeat(np.arange(len(masks), dtype=np.uint16), len(fp))
        cells = np.concatenate([_cells(codes, k, mask) for k, mask in enumerate(masks)])
        bucket = (cells % np.uint64(n)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        full, begin = np.unique(bucket[order], return_index=True)
        payload = [choice[part].tobytes() + fp[part % len(fp)].tobytes() for part in np.split(order, begin[1:])]
        return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(payload, pa.binary())], names=["bucket", "payload"])

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        choice, fp = [], []
        for batch in batches:
            for payload in batch.column("payload").to_pylist():
                k = len(payload) // 10
                choice.append(np.frombuffer(payload, np.uint16, k))
                fp.append(np.frombuffer(payload, np.uint64, k, 2 * k))
        if not choice:
            return
        choice, fp = np.concatenate(choice), np.concatenate(fp)
        codes = embedded(fp)
        cells = np.zeros(len(fp), np.uint64)
        for k, mask in enumerate(masks):
            own = choice == k
            cells[own] = _cells(codes[own], k, mask)
        a, b = cell_links(cells, fp, max_bits)
        signed = fp.view(np.int64)
        u, v = _stars(signed[a].tolist(), signed[b].tolist())
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    placed = points.select("fp").mapInArrow(deal, "bucket int, payload binary")
    return by_bucket(placed, n).mapInArrow(search, "u long, v long")


def _groups(prints: DataFrame, max_bits: int) -> DataFrame:
    """(fp, least, root) of every distinct fingerprint: its least id, null where all are, and the least fingerprint of its component."""
    points = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = materialise(components(links(points, max_bits)).withColumnRenamed("node", "fp"))
    return materialise(points.join(found, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame, width: int = SHINGLE, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every row. Ids must be integers."""
    prints = materialise(fingerprints(docs, width, id_col, text_col))
    groups = _groups(prints, max_bits)
    named = materialise(groups.join(groups.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id"))
    # both sides are plain scans, so adaptive execution can split a fingerprint that many rows share
    return prints.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def chosen_rows(docs: DataFrame, key: str, chosen: DataFrame) -> DataFrame:
    """The rows of docs whose key and id chosen (key, least) names, one row for each; docs also has the key as a column that goes."""
    node = free_name(docs, "_node")
    marked = docs.withColumn(node, F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)))
    named = chosen.select(F.col("key").alias(key), F.coalesce("least", F.lit(NULL_ID)).alias(node))
    return marked.join(named, [key, node], "left_semi").dropDuplicates([key, node]).drop(key, node)


def one_of_each(docs: DataFrame, width: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of every group of near-duplicates, the one with the least doc_id, with all columns of docs."""
    groups = _groups(materialise(fingerprints(docs, width)), max_bits)
    first = F.min(F.struct(F.coalesce("least", F.lit(NULL_ID)).alias("least"), "fp")).alias("first")
    chosen = groups.groupBy("root").agg(first).select(F.col("first.fp").alias("key"), F.col("first.least").alias("least"))
    key = free_name(docs, "_fp")

    def make():
        return lambda whole: [pa.array(fingerprints_of([t.encode() for t in whole], width).view(np.int64))]

    return chosen_rows(annotate(docs, make, [T.StructField(key, T.LongType())]), key, chosen)
