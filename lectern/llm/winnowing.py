"""Document fingerprints by winnowing.

Every k-gram of code points gets a rolling hash (a polynomial over all
prefixes, so any span's hash is one subtraction and one multiplication);
of each window of consecutive k-grams the least hash is kept, the rightmost
where several are equal, with its position. Two texts that share a passage
of `gram + window - 1` characters therefore share at least one kept hash.

A text shorter than a window gives the least of the k-grams it has; one
shorter than a k-gram gives the hash of the whole text; an empty or null
text has no hashes. Equal texts have equal fingerprints.

`fingerprints` is per row. `fingerprint_edits` also pairs each document
with the next one in descending id order (the last with the first). Ids are
cut into ranges whose number follows the bytes of the texts, an id that fills
more than a range by the hash of its texts; the first document of a range is
also sent to the range before it, so one exchange brings every pair together.
A range is sorted by the engine, which may spill, and read as a stream: a
worker holds two texts at a time.

Defined results: a null text is empty; repeated ids are ordered by the hash
of their text, then by the text; a null id comes last and stays null; a lone
document follows itself; extra columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import buckets, by_bucket, materialise, slices, texts

GRAM, WINDOW = 24, 48
#: An odd base, so that it has an inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
_LOW = np.uint64(0xFFFFFFFF)


class Powers:
    """Powers of the base, grown to the longest text seen."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 4096)
            steps = np.full(size, BASE, np.uint64)
            steps[0] = 1
            self.up = np.multiply.accumulate(steps)
            steps[1:] = pow(BASE, -1, 1 << 64)
            self.down = np.multiply.accumulate(steps)
        return self.up, self.down


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def winnow(codes: np.ndarray, powers: Powers, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Kept 32-bit hashes and their positions, in text order, of a text given as code points."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    up, down = powers.get(n + 1)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(mixed(codes.astype(np.uint64) + np.uint64(1)) * up[:n], out=prefix[1:])
    gram = min(gram, n)
    hashes = mixed((prefix[gram:] - prefix[:-gram]) * down[: n + 1 - gram]) >> np.uint64(32)
    m = len(hashes)
    # the hash above, the complement of the position below: a minimum is the least hash, rightmost among equals
    keys = hashes << np.uint64(32) | (_LOW - np.arange(m, dtype=np.uint64))
    width, least = min(window, m), keys
    have = 1
    while have < width:
        step = min(have, width - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    kept = least[np.concatenate(([True], least[1:] != least[:-1]))]
    return (kept >> np.uint64(32)).astype(np.uint32), (_LOW - (kept & _LOW)).astype(np.int64)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def written(hashes: np.ndarray, positions: np.ndarray) -> str:
    """The fingerprint as text: hash@position, joined by a space."""
    return " ".join(f"{h:08x}@{p}" for h, p in zip(hashes.tolist(), positions.tolist()))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Shared distinct hashes over all distinct hashes; 1 if both texts are empty."""
    a, b = np.unique(a), np.unique(b)
    both = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - both
    return both / union if union else 1.0


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, hashes array<bigint>, positions array<bigint> of every whole text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in slices(batches):
            found = [winnow(code_points(t), powers, gram, window) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([h.astype(np.int64) for h, _ in found], pa.list_(pa.int64())), pa.array([p for _, p in found], pa.list_(pa.int64()))],
                names=["doc_id", "hashes", "positions"],
            )

    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, f"doc_id {kind}, hashes array<long>, positions array<long>")


#: Stands in for a null id: it orders before every other, so last in descending order.
_NULL_ID = -(1 << 63)
#: Where a row stands: descending ids, then ascending hashes of the text.
Place = tuple[int, int]


def _cuts(places: DataFrame, n: int) -> list[Place]:
    """Places that deal the rows (doc_id, hash) out to about n ranges; an id of more rows than a range holds is cut by its hashes, which are even."""
    if n < 2:
        return []
    row = places.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n).alias("q"), F.count(F.lit(1)).alias("n")).first()
    if not row["n"]:
        return []
    cuts = {(-int(q), -(1 << 63)) for q in row["q"]}
    # at most n ids have more than an n-th of the rows
    for r in places.groupBy("doc_id").count().where(F.col("count") > row["n"] / n).collect():
        parts = -(-r["count"] * n // row["n"])
        cuts |= {(-r["doc_id"], -(1 << 63) + (k << 64) // parts) for k in range(parts)}
    return sorted(cuts)


def fingerprint_edits(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each document and of its edited text, and how alike they and the next document's are.

    The edited text is the document with its last floor(n/2) code points replaced by the first as many
    of the next document. Ids must be integers.
    """
    source = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(_NULL_ID)).alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text")).withColumn("hash", F.xxhash64("text"))
    places = materialise(source.select("doc_id", "hash", F.octet_length("text").alias("size")))
    total = places.agg(F.sum("size").alias("n")).first()["n"] or 0
    cuts = _cuts(places, buckets(docs.sparkSession, total))

    def ranges(ids: pa.Array, hashes: pa.Array) -> list[int]:
        return [bisect_right(cuts, (-i, h)) for i, h in zip(ids.to_pylist(), hashes.to_pylist())]

    def firsts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, Place] = {}
        for batch in batches:
            ids, hashes = batch.column("doc_id"), batch.column("hash")
            for k, i, h in zip(ranges(ids, hashes), ids.to_pylist(), hashes.to_pylist()):
                least[k] = min(least.get(k, (-i, h)), (-i, h))
        if least:
            yield pa.RecordBatch.from_arrays([pa.array(list(least), pa.int32()), pa.array([-p[0] for p in least.values()], pa.int64()), pa.array([p[1] for p in least.values()], pa.int64())], names=["bucket", "doc_id", "hash"])

    # a row per range: as many as the exchange has partitions
    first = F.min(F.struct((-F.col("doc_id").cast("decimal(20,0)")).alias("id"), "hash")).alias("first")
    tops = {r["bucket"]: (int(r["first"]["id"]), r["first"]["hash"]) for r in places.select("doc_id", "hash").mapInArrow(firsts, "bucket int, doc_id long, hash long").groupBy("bucket").agg(first).collect()}
    filled = sorted(tops)
    # the first of a range also follows the last of the range before; the first of all follows the last of all
    before = {tops[b]: filled[k - 1] for k, b in enumerate(filled)}

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "lent", "doc_id", "text", "hash"]
        for batch in batches:
            ids, hashes = batch.column("doc_id"), batch.column("hash")
            yield pa.RecordBatch.from_arrays([pa.array(ranges(ids, hashes), pa.int32()), pa.array([False] * len(ids)), *batch.columns], names=names)
            at = [k for k, place in enumerate(zip(ids.to_pylist(), hashes.to_pylist())) if (-place[0], place[1]) in before]
            if at:
                part = batch.take(pa.array(at))
                to = [before[-i, h] for i, h in zip(part.column("doc_id").to_pylist(), part.column("hash").to_pylist())]
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), pa.array([True] * len(at)), *part.columns], names=names)

    def pair(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        rows: list[tuple] = []
        held = 0
        current: tuple[int, str] | None = None
        mine = None
        for batch in batches:
            for lent, i, text in zip(batch.column("lent").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                theirs = winnow(code_points(text), powers, gram, window)
                if current is not None:
                    rows.append(_paired(*current, mine, text, theirs, powers, gram, window))
                    held += rows[-1][1]
                if held > 2_000_000 or len(rows) == 5_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _OUT.values())], names=list(_OUT))
                    rows, held = [], 0
                # the first lent row follows the last own one; copies of it are not looked at
                current, mine = (None if lent else (i, text)), theirs
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _OUT.values())], names=list(_OUT))

    dealt = source.mapInArrow(deal, "bucket int, lent boolean, doc_id long, text string, hash long")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    ordered = by_bucket(dealt, len(cuts) + 1).sortWithinPartitions("bucket", "lent", F.desc("doc_id"), "hash", "text")
    return ordered.select("lent", "doc_id", "text").mapInArrow(pair, schema)


_OUT = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}


def _paired(doc_id: int, text: str, mine: tuple, following: str, theirs: tuple, powers: Powers, gram: int, window: int) -> tuple:
    """A result row of a document and the next one's text, both with their kept hashes."""
    size = len(text)
    edited = text[: size - size // 2] + following[: size // 2]
    changed = winnow(code_points(edited), powers, gram, window)
    return (None if doc_id == _NULL_ID else doc_id, size, hashlib.sha256(edited.encode()).hexdigest(), written(*mine), written(*changed), likeness(mine[0], changed[0]), likeness(mine[0], theirs[0]))
