"""Removal of repeated word passages with fixed-block anchors.

A window is `width` consecutive words of one document. Every word that is
covered by a window whose words also start earlier (smaller id, or the same
document and an earlier start) is removed; windows are judged on the input.

1. Anchors. Documents are cut into non-overlapping reference blocks of
   `width // 2` words. Any window holds a whole block, so a window that
   recurs anywhere recurs with one of its blocks. All blocks are indexed and
   probed with every rolling window of block length: hashes are dealt out by
   value, packed into one binary row per slice and bucket, and a hash seen
   twice within a slice is a hit already and travels once, so a block that
   is everywhere costs one entry per slice and not one per occurrence.
2. Extension. Around hits all full windows are hashed (two independent
   hashes, 128 bits in all, taken as the words) and dealt out again; in each
   bucket the first start of every window is kept and all later ones are
   repeats. Runs of repeated windows are the maximal exact repeats; their
   words go.

Texts are dealt out by their own hash with their least id, and copies inside
a slice travel once, so exact copies meet in one place: the copy with the
least id is judged, every other copy of `width` or more words is a repeat as
a whole. Rows find their text's result by a join on its hash, which adaptive
execution may split, so many copies of one text, or many empty ones, are no
load on one task. The number of buckets follows the bytes of the texts.

Defined results: a null or empty text has no words; rows that share an id
are one document to the order of starts: of equal windows under one id those
at the least place are the first, in whichever of its rows (rows of equal
texts so get equal results); a null id orders after all others, and all null
ids are one; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import buckets, by_bucket, text_bytes

WIDTH = 20
#: Bytes of text that are hashed at once in a worker; bounds its memory.
SLICE_BYTES = 6_000_000
NULL_ID = (1 << 63) - 1
_EXCHANGE = "bucket int, kind int, origin long, payload binary"
_ENTRIES, _TABLE, _HITS, _TEXTS, _REPEATS = range(5)
_B1, _B2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
_MASK = (1 << 64) - 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


_BYTE_VALUE = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_B2))


def word_hashes(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, in order, and the number of words of each text."""
    joined = b" ".join(data) + b" "
    raw = np.frombuffer(joined, np.uint8)
    gap = (raw == 32) | ((raw >= 9) & (raw <= 13))
    first = ~gap
    first[1:] &= gap[:-1]
    starts = np.flatnonzero(first)
    ends = np.cumsum(np.fromiter((len(d) + 1 for d in data), np.int64, len(data)))
    counts = np.diff(np.searchsorted(starts, np.concatenate(([0], ends))))
    if not len(starts):
        return np.zeros(0, np.uint64), counts
    bounds = np.concatenate((starts, [len(raw)]))
    offset = np.arange(len(raw), dtype=np.int32)
    offset[starts[0] :] -= np.repeat(starts, np.diff(bounds)).astype(np.int32)
    offset[gap] = 0
    steps = np.full(int(offset.max()) + 1, _B1, np.uint64)
    steps[0] = 1
    powers = np.multiply.accumulate(steps)
    value = _BYTE_VALUE[raw] * powers[offset]
    value[gap] = 0
    return _mixed(np.add.reduceat(value, starts)), counts


def rolling(words: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hashes of all runs of `width` words, by doubling; shorter at the end of the array."""
    out, have, rest, done = None, 1, width, 0
    power = words
    while rest:
        if rest & 1:
            tail = power[done:]
            out = power if out is None else out[: len(tail)] + np.uint64(pow(base, done, 1 << 64)) * tail
            done += have
        rest >>= 1
        if rest:
            power = power[: max(0, len(power) - have)] + np.uint64(pow(base, have, 1 << 64)) * power[have:]
            have *= 2
    return out[: max(0, len(words) - width + 1)]


def _inside(counts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Starts of runs of `width` words that do not leave their text, among the first n starts."""
    left = np.repeat(np.cumsum(counts), counts) - np.arange(int(counts.sum()))
    return np.flatnonzero(left[:n] >= width)


def _planes(x: np.ndarray) -> bytes:
    """Integers as byte planes: high bytes of small numbers become runs of zeros that shuffle compression removes."""
    x = np.ascontiguousarray(x)
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _unplaned(data: bytes, kind: type, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8, n * size).reshape(size, n).T).view(kind).reshape(n)


def _delta(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=x[:1] * 0)


def _batch(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    buckets, kinds, origins, payloads = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(buckets, pa.int32()), pa.array(kinds, pa.int32()), pa.array(origins, pa.int64()), pa.array(payloads, pa.binary())],
        names=["bucket", "kind", "origin", "payload"],
    )


def _emit(rows: Iterable[tuple[int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    """Batches of a few MB each."""
    held: list[tuple[int, int, int, bytes]] = []
    size = 0
    for row in rows:
        held.append(row)
        size += len(row[3])
        if size > 4_000_000 or len(held) >= 5_000:
            yield _batch(held)
            held, size = [], 0
    if held:
        yield _batch(held)


def _by_bucket(bucket: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by bucket, and where each bucket begins in it."""
    order = np.argsort(bucket.astype(np.uint16) if n < 65536 else bucket, kind="stable")
    return order, np.concatenate(([0], np.cumsum(np.bincount(bucket, minlength=n))))


def _documents(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
    """Slices of (ids, texts) of bounded size."""
    for batch in batches:
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        column = batch.column("text")
        held: list[bytes] = []
        size = start = 0
        for i in range(len(ids)):
            text = column[i].as_buffer()
            text = text.to_pybytes() if text is not None else b""
            if held and size + len(text) > SLICE_BYTES:
                yield ids[start:i], held
                held, size, start = [], 0, i
            held.append(text)
            size += len(text)
        if held:
            yield ids[start:], held


def _probes(batches: Iterable[pa.RecordBatch], n: int, block: int) -> Iterator[tuple[int, int, int, bytes]]:
    """Entries (hash, place, is it a reference block) of each slice by bucket, its table of texts, and its own hits."""
    for _, data in _documents(batches):
        data = list(dict.fromkeys(data))
        keys = np.fromiter(map(xxhash.xxh64_intdigest, data), np.uint64, len(data))
        words, counts = word_hashes(data)
        hashes = rolling(words, block, _B1)
        at = _inside(counts, block, len(hashes))
        if not len(at):
            continue
        hashes = _mixed(hashes[at])
        first = np.cumsum(counts) - counts
        aligned = (at - np.repeat(first, counts)[at]) % block == 0
        uid = int(xxhash.xxh64_intdigest(keys.tobytes())) - (1 << 63)
        home = uid % n
        yield home, _TABLE, uid, keys.tobytes() + counts.astype(np.uint32).tobytes()
        order = np.argsort(hashes)
        sorted_ = hashes[order]
        fresh = np.concatenate(([True], sorted_[1:] != sorted_[:-1]))
        heads = np.flatnonzero(fresh)
        many = np.diff(np.concatenate((heads, [len(order)]))) > 1
        any_aligned = np.logical_or.reduceat(aligned[order], heads)
        local = np.repeat(many, np.diff(np.concatenate((heads, [len(order)]))))
        if local.any():
            yield home, _HITS, uid, _packed(np.sort(at[order[local]]))
        pick = order[heads]
        back = np.argsort(pick)
        pick, flag = pick[back], any_aligned[back]
        kept, place = hashes[pick], at[pick].astype(np.uint32)
        bucket = ((kept >> np.uint64(32)) % np.uint64(n)).astype(np.int64)
        low = kept.astype(np.uint32)
        order, begin = _by_bucket(bucket, n)
        for b in range(n):
            part = order[begin[b] : begin[b + 1]]
            if len(part):
                yield b, _ENTRIES, uid, len(part).to_bytes(4, "little") + low[part].tobytes() + _planes(_delta(place[part])) + np.packbits(flag[part]).tobytes()


def _packed(places: np.ndarray) -> bytes:
    return _planes(_delta(places.astype(np.uint32)))


def _unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(_unplaned(data, np.uint32, len(data) // 4), dtype=np.int64)


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    for batch in batches:
        yield from zip(batch.column("kind").to_pylist(), batch.column("origin").to_pylist(), batch.column("payload").to_pylist())


def _match(batches: Iterable[pa.RecordBatch], n: int) -> Iterator[tuple[int, int, int, bytes]]:
    """Hits of a bucket: entries whose hash another entry has, one of them a reference block."""
    uids: list[int] = []
    lows, places, flags, owners = [], [], [], []
    for kind, uid, payload in _rows(batches):
        if kind != _ENTRIES:
            yield uid % n, kind, uid, payload
            continue
        size = int.from_bytes(payload[:4], "little")
        lows.append(np.frombuffer(payload, np.uint32, size, 4))
        places.append(np.cumsum(_unplaned(payload[4 + 4 * size : 4 + 8 * size], np.uint32, size), dtype=np.uint32))
        flags.append(np.unpackbits(np.frombuffer(payload, np.uint8, offset=4 + 8 * size), count=size).astype(bool))
        owners.append(np.full(size, len(uids), np.int32))
        uids.append(uid)
    if not uids:
        return
    low, place, flag, owner = map(np.concatenate, (lows, places, flags, owners))
    del lows, places, flags, owners
    order = np.argsort(low)
    low = low[order]
    heads = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
    sizes = np.diff(np.concatenate((heads, [len(low)])))
    hit = order[np.repeat((sizes > 1) & np.logical_or.reduceat(flag[order], heads), sizes)]
    owner, place = owner[hit], place[hit]
    order = np.lexsort((place, owner))
    owner, place = owner[order], place[order]
    begin = np.searchsorted(owner, np.arange(len(uids) + 1))
    for k, uid in enumerate(uids):
        if begin[k + 1] > begin[k]:
            yield uid % n, _HITS, uid, _packed(place[begin[k] : begin[k + 1]])


def _spread(batches: Iterable[pa.RecordBatch], n: int) -> Iterator[tuple[int, int, int, bytes]]:
    """Hits of slices as hits of texts, sent to where the text goes."""
    tables: dict[int, bytes] = {}
    hits: dict[int, list[bytes]] = defaultdict(list)
    for kind, uid, payload in _rows(batches):
        if kind == _TABLE:
            tables[uid] = payload
        else:
            hits[uid].append(payload)
    for uid, parts in hits.items():
        table = tables[uid]
        size = len(table) // 12
        keys, counts = np.frombuffer(table, np.uint64, size), np.frombuffer(table, np.uint32, size, 8 * size).astype(np.int64)
        places = np.unique(np.concatenate(list(map(_unpacked, parts))))
        ends = np.cumsum(counts)
        begin = np.searchsorted(places, np.concatenate(([0], ends)))
        for k in np.flatnonzero(np.diff(begin)):
            key = int(keys[k])
            yield key % n, _HITS, key - (1 << 63), _packed(places[begin[k] : begin[k + 1]] - (ends[k] - counts[k]))


def _texts_out(batches: Iterable[pa.RecordBatch], n: int) -> Iterator[tuple[int, int, int, bytes]]:
    """Texts by their hash, compressed together per slice and bucket; a text that repeats in the slice goes once with its least id."""
    packer = zstandard.ZstdCompressor(level=3)
    for ids, data in _documents(batches):
        least: dict[bytes, int] = {}
        for i, text in zip(ids.tolist(), data):
            least[text] = min(i, least.get(text, i))
        dealt: dict[int, list[tuple[int, bytes]]] = defaultdict(list)
        for text, i in least.items():
            dealt[xxhash.xxh64_intdigest(text) % n].append((i, text))
        for b, rows in dealt.items():
            head = len(rows).to_bytes(4, "little") + np.array([i for i, _ in rows], np.int64).tobytes() + np.array([len(t) for _, t in rows], np.uint32).tobytes()
            yield b, _TEXTS, 0, packer.compress(head + b"".join(t for _, t in rows))


def _texts_in(payloads: Iterable[bytes]) -> list[tuple[int, bytes]]:
    """(least id, text) of all distinct texts of a partition, in an order that depends on nothing else."""
    unpacker = zstandard.ZstdDecompressor()
    least: dict[bytes, int] = {}
    for payload in payloads:
        data = unpacker.decompress(payload)
        size = int.from_bytes(data[:4], "little")
        ids = np.frombuffer(data, np.int64, size, 4).tolist()
        lengths = np.frombuffer(data, np.uint32, size, 4 + 8 * size).tolist()
        at = 4 + 12 * size
        for i, length in zip(ids, lengths):
            text = data[at : at + length]
            least[text] = min(i, least.get(text, i))
            at += length
    return sorted((i, text) for text, i in least.items())


def _windows(batches: Iterable[pa.RecordBatch], n: int, width: int, block: int) -> Iterator[tuple[int, int, int, bytes]]:
    """Full windows around hits, by hash; those repeated within the partition are settled here."""
    payloads: list[bytes] = []
    hits: dict[int, list[bytes]] = defaultdict(list)
    for kind, key, payload in _rows(batches):
        if kind == _TEXTS:
            payloads.append(payload)
        else:
            hits[key + (1 << 63)].append(payload)
    if not hits or not payloads:
        return
    found = _texts_in(payloads)
    del payloads
    todo: list[tuple[int, int, bytes, np.ndarray]] = []
    origin = size = 0
    for ordinal, (least, text) in enumerate(found):
        key = xxhash.xxh64_intdigest(text)
        if key in hits:
            origin = key % n
            todo.append((ordinal, least, text, np.unique(np.concatenate(list(map(_unpacked, hits[key]))))))
            size += len(text)
        if todo and (size > SLICE_BYTES or ordinal == len(found) - 1):
            yield from _judge(todo, n, width, block, origin)
            todo, size = [], 0


def _judge(todo: list[tuple[int, int, bytes, np.ndarray]], n: int, width: int, block: int, origin: int) -> Iterator[tuple[int, int, int, bytes]]:
    words, counts = word_hashes([t for _, _, t, _ in todo])
    first = np.cumsum(counts) - counts
    hit = np.zeros(len(words) + 1, np.int64)
    for base, (_, _, _, places) in zip(first, todo):
        hit[places + base + 1] = 1
    seen = np.cumsum(hit)
    one = rolling(words, width, _B1)
    at = _inside(counts, width, len(one))
    at = at[seen[at + width - block + 1] > seen[at]]
    if not len(at):
        return
    one, two = _mixed(one[at]), _mixed(rolling(words, width, _B2)[at])
    owner = np.searchsorted(first, at, side="right") - 1
    # empty texts share their start with the next one; the last of equal starts holds the words
    place = (at - first[owner]).astype(np.uint32)
    ordinal = np.fromiter((o for o, *_ in todo), np.uint32, len(todo))[owner]
    ids = np.fromiter((i for _, i, *_ in todo), np.int64, len(todo))[owner]
    # texts come by id, so the first of equal hashes is the earliest here
    order = np.lexsort((two, one))
    fresh = np.concatenate(([True], (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])))
    head = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]
    # different texts under one id: of starts at one place none is later than the others, so all go on to be judged
    same = (ids[order] == ids[head]) & (place[order] == place[head])
    later = order[~same]
    if len(later):
        later.sort()
        yield origin, _REPEATS, origin, _ordinals(ordinal[later], place[later])
    pick = np.sort(order[same])
    bucket = (two[pick] % np.uint64(n)).astype(np.int64)
    order, begin = _by_bucket(bucket, n)
    for b in range(n):
        part = pick[order[begin[b] : begin[b + 1]]]
        if len(part):
            yield b, _ENTRIES, origin, len(part).to_bytes(4, "little") + one[part].tobytes() + two[part].tobytes() + _planes(_delta(ids[part])) + _planes(_delta(ordinal[part])) + _planes(place[part])


def _ordinals(ordinal: np.ndarray, place: np.ndarray) -> bytes:
    return _planes(_delta(ordinal.astype(np.uint32))) + _planes(place.astype(np.uint32))


def _first_starts(batches: Iterable[pa.RecordBatch], n: int) -> Iterator[tuple[int, int, int, bytes]]:
    """Of equal windows all but the earliest are repeats; they are reported to where their text is."""
    parts: list[tuple[np.ndarray, ...]] = []
    for kind, origin, payload in _rows(batches):
        if kind != _ENTRIES:
            yield origin, kind, origin, payload
            continue
        size = int.from_bytes(payload[:4], "little")
        at = 4 + 16 * size
        parts.append(
            (
                np.frombuffer(payload, np.uint64, size, 4),
                np.frombuffer(payload, np.uint64, size, 4 + 8 * size),
                np.cumsum(_unplaned(payload[at : at + 8 * size], np.int64, size)),
                np.cumsum(_unplaned(payload[at + 8 * size : at + 12 * size], np.uint32, size), dtype=np.uint32),
                _unplaned(payload[at + 12 * size :], np.uint32, size),
                np.full(size, origin, np.int32),
            )
        )
    if not parts:
        return
    one, two, ids, ordinal, place, origin = (np.concatenate(c) for c in zip(*parts))
    del parts
    order = np.lexsort((place, ids, two, one))
    one, two, ids, ordinal, place, origin = one[order], two[order], ids[order], ordinal[order], place[order], origin[order]
    fresh = np.concatenate(([True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])))
    head = np.maximum.accumulate(np.where(fresh, np.arange(len(one)), 0))
    later = np.flatnonzero(~fresh & ((ids != ids[head]) | (place != place[head])))
    order = later[np.lexsort((place[later], ordinal[later], origin[later]))]
    origin = origin[order]
    for o in np.unique(origin).tolist():
        part = order[np.searchsorted(origin, o) : np.searchsorted(origin, o, side="right")]
        yield o, _REPEATS, o, _ordinals(ordinal[part], place[part])


def _results(batches: Iterable[pa.RecordBatch], width: int, keep_text: bool) -> Iterator[tuple]:
    payloads: list[bytes] = []
    starts: dict[int, list[np.ndarray]] = defaultdict(list)
    for kind, _, payload in _rows(batches):
        if kind == _TEXTS:
            payloads.append(payload)
            continue
        size = len(payload) // 8
        ordinal = np.cumsum(_unplaned(payload[: 4 * size], np.uint32, size), dtype=np.uint32)
        place = _unplaned(payload[4 * size :], np.uint32, size)
        cuts = np.flatnonzero(np.concatenate(([True], ordinal[1:] != ordinal[:-1])))
        for a, b in zip(cuts, [*cuts[1:], size]):
            starts[int(ordinal[a])].append(place[a:b])
    for ordinal, (least, text) in enumerate(_texts_in(payloads)):
        words = text.split()
        size, removed = len(words), 0
        if ordinal in starts:
            edge = np.zeros(size + 1, np.int32)
            for places in starts[ordinal]:
                np.add.at(edge, places, 1)
                np.add.at(edge, places + width, -1)
            covered = np.cumsum(edge[:-1]) > 0
            removed = int(covered.sum())
            words = [w for w, c in zip(words, covered.tolist()) if not c]
        left = b" ".join(words)
        row = (_signed(xxhash.xxh64_intdigest(text, 42)), zlib.crc32(text), len(text), least, size, removed, hashlib.sha256(left).hexdigest())
        yield (*row, left) if keep_text else row


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def substring_dedup(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every whole text; with keep_text also the kept words as text. Ids must be integers."""
    block = width // 2
    source = docs.select(F.coalesce(docs[id_col].cast("long"), F.lit(NULL_ID)).alias("doc_id"), docs[text_col].alias("text"))
    # the entries of the probes are about as large as the texts
    n = buckets(docs.sparkSession, 2 * text_bytes(source))

    def stage(df: DataFrame, step, *args) -> DataFrame:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _emit(step(batches, *args))

        return df.mapInArrow(run, _EXCHANGE)

    names = ["h", "crc", "size", "least", "n_words", "n_removed", "kept_sha256"] + ["kept_text"] * keep_text

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 6 + [pa.string()] * (1 + keep_text)
        rows: list[tuple] = []
        for row in _results(batches, width, keep_text):
            rows.append((*row[:7], row[7].decode()) if keep_text else row)
            if len(rows) >= (500 if keep_text else 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    matched = stage(by_bucket(stage(source, _probes, n, block), n), _match, n)
    hits = stage(by_bucket(matched, n), _spread, n)
    packed = stage(source, _texts_out, n)
    windows = stage(by_bucket(hits.unionByName(packed), n), _windows, n, width, block)
    repeats = stage(by_bucket(windows, n), _first_starts, n)
    schema = "h long, crc long, size long, least long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text
    judged = by_bucket(repeats.unionByName(packed), n).mapInArrow(finish, schema)
    text = F.coalesce("text", F.lit(""))
    rows = source.select("doc_id", F.xxhash64(text).alias("h"), F.crc32(text.cast("binary")).alias("crc"), F.octet_length(text).cast("long").alias("size"))
    # a later copy of a whole text is a repeat, unless the text is shorter than a window
    own = (F.col("doc_id") == F.col("least")) | (F.col("n_words") < width)
    return rows.join(judged, ["h", "crc", "size"]).select(
        F.nullif("doc_id", F.lit(NULL_ID)).alias("doc_id"),
        "n_words",
        F.when(own, F.col("n_removed")).otherwise(F.col("n_words")).alias("n_removed"),
        F.when(own, F.col("kept_sha256")).otherwise(F.sha2(F.lit(""), 256)).alias("kept_sha256"),
        *([F.when(own, F.col("kept_text")).otherwise("").alias("kept_text")] * keep_text),
    )
