"""Source divergence audit: how far the sources of a language are apart in their words, and which words set each apart.

Terms are found in bytes: the UTF-8 buffers of many texts are put in a row
with a gap after each, a lookup table lower-cases A-Z and marks the bytes of
terms (letters, and all bytes of characters beyond ASCII), and the places
where the mark changes are the boundaries. The slices are grouped by their
xxHash; every slice of a group is compared with the group's first byte for
byte, and a group that is no single term is taken apart by its bytes.

Counts leave a task once per (language, source, term) and slice of text, are
summed before and after the exchange, and terms in too few documents of their
language go. Each language's terms are then dealt into buckets by their hash;
a task holds a bucket's counts as a sparse matrix of sources by terms and sums
the differences of all pairs of sources by `numpy.add.reduceat` over its rows.
What a bucket's absent entries add follows from each row's constant.

All arithmetic is in whole numbers: a term's share is
1 + floor(SCALE * (count + SMOOTH) / (N + SMOOTH * V)).

Defined results: a null text, language or source is empty; rows count as
often as they occur; a group without terms has the shares of no counts at
all; where a language has no kept term its pairs are 0 apart; a language
with one source has no pairs; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import materialise, slices

#: Documents of a language that a term must occur in; terms listed per source; scale and smoothing of shares.
MIN_DOCS, TOP, SCALE, SMOOTH = 30, 50, 1_000_000_000, 5
#: Bytes of a row of a bucket in a worker, about: a term, a source and two numbers.
_ROW_BYTES = 160
#: Pairs of sources that a worker reports at once.
_PAIRS = 1_000_000
#: Bytes of text that are looked at together, and of a bucket's rows.
_PIECE, _BUCKET = 3_000_000, 8_000_000

_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_IN_TERM = np.array([0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)])


def boundaries(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the terms of a lower-cased buffer start and end."""
    marks = np.zeros(len(buffer) + 2, np.int8)
    marks[1:-1] = _IN_TERM[np.frombuffer(buffer, np.uint8)]
    change = np.diff(marks)
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def grouped(buffer: bytes, starts: np.ndarray, ends: np.ndarray, hashed=xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, list[bytes]]:
    """The number of each slice's term, and the terms: slices with equal hashes whose bytes are equal too."""
    if not len(starts):
        return np.zeros(0, np.int64), []
    view = memoryview(buffer)
    hashes = np.fromiter((hashed(view[a:b]) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))
    _, first, term = np.unique(hashes, return_index=True, return_inverse=True)
    terms = [bytes(view[a:b]) for a, b in zip(starts[first].tolist(), ends[first].tolist())]
    # every slice against the first of its group, all bytes in one go
    sizes, heads = ends - starts, starts[first][term]
    same = sizes == (ends - starts)[first][term]
    at = np.flatnonzero(same)
    if len(at):
        data, steps = np.frombuffer(buffer, np.uint8), sizes[at]
        offsets = np.cumsum(steps) - steps
        within = np.arange(int(steps.sum())) - np.repeat(offsets, steps)
        differs = data[np.repeat(starts[at], steps) + within] != data[np.repeat(heads[at], steps) + within]
        same[at] = ~np.logical_or.reduceat(differs, offsets)
    if not same.all():
        numbers = {t: k for k, t in enumerate(terms)}
        for k in np.flatnonzero(~same).tolist():
            word = bytes(view[starts[k] : ends[k]])
            if word not in numbers:
                numbers[word] = len(terms)
                terms.append(word)
            term[k] = numbers[word]
    return term, terms


def counted(texts: list[bytes], groups: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray, np.ndarray]:
    """Group, term, occurrences and documents of all terms of the texts; groups has each text's group."""
    buffer = b"\n".join(texts).translate(_LOWER)
    starts, ends = boundaries(buffer)
    term, terms = grouped(buffer, starts, ends)
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
    doc = np.searchsorted(begin, starts, side="right") - 1
    many = max(1, len(terms))
    pairs, times = np.unique(doc * many + term, return_counts=True)
    keys, inverse = np.unique(groups[pairs // many] * many + pairs % many, return_inverse=True)
    counts = np.zeros(len(keys), np.int64)
    np.add.at(counts, inverse, times)
    return keys // many, [terms[k] for k in (keys % many).tolist()], counts, np.bincount(inverse, minlength=len(keys))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents) of every term of docs (text, lang, source)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices([batch], limit=_PIECE):
                texts = [t.encode() for t in piece.column("text").to_pylist()]
                names: dict[tuple[str, str], int] = {}
                groups = np.array([names.setdefault(g, len(names)) for g in zip(piece.column("lang").to_pylist(), piece.column("source").to_pylist())], np.int64)
                group, terms, n, seen = counted(texts, groups)
                langs, sources = (pa.array([g[k] for g in names], pa.string()).take(pa.array(group)) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([langs, sources, pa.array([t.decode() for t in terms], pa.string()), pa.array(n, pa.int64()), pa.array(seen, pa.int64())], names=["lang", "source", "term", "n", "docs"])

    found = docs.select("text", "lang", "source").mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """A term's share in whole numbers; decimals hold every step exactly."""
    over = F.lit(SCALE).cast("decimal(12,0)") * (count + SMOOTH).cast("decimal(19,0)")
    below = (total + terms * SMOOTH).cast("decimal(19,0)")
    return F.lit(1).cast("long") + F.call_function("div", over, below)


def shares_of(counts: np.ndarray, below: np.ndarray) -> np.ndarray:
    """The same for arrays; counts beyond what 64 bits can scale go by Python's whole numbers."""
    if len(counts) and counts.max() >= 9_000_000_000:
        return np.array([1 + SCALE * (c + SMOOTH) // b for c, b in zip(counts.tolist(), below.tolist())], np.int64)
    return 1 + SCALE * (counts + SMOOTH) // below


def pair_sums(row: np.ndarray, col: np.ndarray, shares: np.ndarray, bases: np.ndarray, width: int, wanted: Iterable[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each wanted row of a sparse matrix, its summed differences to all rows; row is sorted, an absent entry has its row's base.

    Sums of one bucket fit 64 bits: a row's shares sum to about SCALE.
    """
    sizes = np.bincount(row, minlength=len(bases))
    heads = np.cumsum(sizes) - sizes
    full = np.flatnonzero(sizes)
    dense = np.empty(width, np.int64)
    for s in wanted:
        own = slice(heads[s], heads[s] + sizes[s])
        dense.fill(bases[s])
        dense[col[own]] = shares[own]
        # as if no other row had any entry, then what each row's entries change
        mine, times = np.unique(shares[own], return_counts=True)
        sums = np.abs(bases - bases[s]) * (width - sizes[s])
        for value, k in zip(mine.tolist(), times.tolist()):
            sums += np.abs(bases - value) * k
        change = np.abs(shares - dense[col]) - np.abs(bases[row] - dense[col])
        if len(full):
            sums[full] += np.add.reduceat(change, heads[full])
        yield s, sums


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: the other sources of a source's language by distance, and the terms that set it apart."""
    empty = F.lit("")
    rows = docs.select(*(F.coalesce(docs[c].cast("string"), empty).alias(c) for c in ("text", "lang", "source")))
    counts = materialise(term_counts(rows))
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("whole")).where(F.col("docs") >= min_docs)
    kept = materialise(kept.select("lang", "term", "whole"))
    entries = materialise(counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"]))
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    sizes = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("whole").alias("lang_total"))
    groups = rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    groups = materialise(groups.select("lang", "source", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "terms", "lang_total"))))

    # the terms that set a source apart
    own, all_of = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("whole"), F.col("lang_total"), F.col("terms"))
    apart = entries.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), (own - all_of).cast("long").alias("value")).where("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = apart.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")

    # distances of all pairs of sources: a bucket of a language's terms at a time, and where there are many sources a share of them
    # every bucket reports each pair once, so their number follows the entries and not the cluster
    n = max(1, -(-_ROW_BYTES * entries.count() // _BUCKET))
    dealt = entries.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(n)).cast("int")).drop("whole")
    crowd = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) * F.count(F.lit(1)) / _PAIRS).cast("int").alias("blocks"))
    block = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    live = dealt.select("lang", "bucket").distinct()
    # every source of a language stands in each of its buckets, with entries or without
    heads = groups.join(live, "lang").join(crowd, "lang").select("lang", "bucket", block, "blocks", "source", F.lit(None).cast("string").alias("term"), F.lit(None).cast("long").alias("n"), "total", "terms")
    heads = heads.withColumn("wanted", F.pmod(F.xxhash64("source"), "blocks") == F.col("block")).drop("blocks")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("total", "long"), ("terms", "long"), ("wanted", "boolean"))]
    body = dealt.join(crowd, "lang").select("lang", "bucket", block, "source", "term", "n", *nothing)

    def sums(key: tuple, table: pa.Table) -> pa.Table:
        is_head = pc.is_null(table.column("term"))
        head, entry = table.filter(is_head), table.filter(pc.invert(is_head))
        sources = head.column("source").to_pylist()
        below = head.column("total").to_numpy() + SMOOTH * head.column("terms").to_numpy()
        place = {name: k for k, name in enumerate(sources)}
        row = np.fromiter((place[x] for x in entry.column("source").to_pylist()), np.int64, entry.num_rows)
        words = entry.column("term").combine_chunks().dictionary_encode()
        order = np.argsort(row, kind="stable")
        row, col = row[order], words.indices.to_numpy()[order]
        shares = shares_of(entry.column("n").to_numpy()[order], below[row])
        bases = shares_of(np.zeros(len(sources), np.int64), below)
        wanted = np.flatnonzero(head.column("wanted").to_numpy(zero_copy_only=False)).tolist()
        left, right, values = [], [], []
        for s, found in pair_sums(row, col, shares, bases, len(words.dictionary), wanted):
            others = np.flatnonzero(np.arange(len(sources)) != s)
            left.append(np.full(len(others), s))
            right.append(others)
            values.append(found[others])
        if not left:
            return pa.table({c: pa.array([], t) for c, t in zip(("lang", "source", "item", "value"), (*[pa.string()] * 3, pa.int64()))})
        names = pa.array(sources, pa.string())
        left, right, values = map(np.concatenate, (left, right, values))
        return pa.table({"lang": pa.array([key[0].as_py()] * len(left), pa.string()), "source": names.take(pa.array(left)), "item": names.take(pa.array(right)), "value": pa.array(values, pa.int64())})

    partial = heads.unionByName(body).groupBy("lang", "bucket", "block").applyInArrow(sums, "lang string, source string, item string, value long")
    others = groups.select("lang", F.col("source").alias("item"))
    # no kept term, so no bucket
    alike = groups.where("terms = 0").select("lang", "source").join(others, "lang").where("source <> item").withColumn("value", F.lit(0).cast("long"))
    distances = partial.unionByName(alike).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = distances.withColumn("rank", F.row_number().over(order)).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    return pairs.unionByName(terms)
