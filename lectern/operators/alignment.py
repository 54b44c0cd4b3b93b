"""Alignment of scripts with their sources.

Two texts are aligned by what is rare in them. Runs of `RUN` words that occur
once on either side are joined; those that follow each other on both sides
form blocks, and of a chapter's blocks the heaviest chain is kept that rises
on both sides (ties go to the earlier block). Between two blocks of the chain
is a gap, aligned alone: words that agree at its ends, then single words that
occur once on either side of the gap, chained alike, then words that agree at
the ends of what is left. What is not matched then is missing or made up.

The joins, blocks and gaps are DataFrames; Python picks chains and aligns the
words of single gaps, streamed in their order. It costs n log n in the words
of a chapter, and a task holds the blocks of one chapter or the words of one
gap at a time.

Defined results: a null text is empty and has no words; rows without a
chapter are left out; of rows that share a chapter the least text counts;
segments that share an index are read in the order of their texts, repeated
ones as often as they are there; a chapter without segments is missing as a
whole, one without a source has no rows; empty tables give empty results.
"""

from __future__ import annotations

import itertools
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions.folds import let, rows_of
from lectern.store import kept

#: Share of a needle's words that a match needs; words of an anchor run.
ACCEPT, RUN = 0.7, 3
_EDGE = r"[.,;:?!\"'()\[\]-]"
_ROWS = 50_000

Block = tuple[int, int, int]  # place in the source, place in the script, words


def heaviest_chain(blocks: list[Block]) -> list[Block]:
    """Of blocks in the order of the source those of the heaviest rising chain, without the words that the one before already covers."""
    places = sorted(b[1] for b in blocks)
    # a Fenwick tree of the best chain that ends at or before a place: its words, and its last block (earlier ones win ties)
    best = [(0, 1)] * (len(blocks) + 1)
    before: list[int] = []
    end = (0, 1)
    for k, (_, j, n) in enumerate(blocks):
        at = bisect_left(places, j)
        top, x = (0, 1), at
        while x:
            top = max(top, best[x])
            x &= x - 1
        before.append(-top[1])
        own = (top[0] + n, -k)
        end = max(end, own)
        x = at + 1
        while x <= len(blocks):
            best[x] = max(best[x], own)
            x += x & -x
    chain, k = [], -end[1]
    while k >= 0:
        chain.append(blocks[k])
        k = before[k]
    out = []
    for last, (i, j, n) in zip([None, *chain[:0:-1]], chain[::-1]):
        cut = max(0, last[0] + last[2] - i, last[1] + last[2] - j) if last else 0
        if cut < n:
            out.append((i + cut, j + cut, n - cut))
    return out


def _ends(a: list[str], b: list[str], i0: int, i1: int, j0: int, j1: int) -> Iterator[Block]:
    """Words that agree at the start and at the end of a gap; what is left between them follows as a block of no words."""
    most = min(i1 - i0, j1 - j0)
    head = next((k for k in range(most) if a[i0 + k] != b[j0 + k]), most)
    most -= head
    tail = next((k for k in range(most) if a[i1 - 1 - k] != b[j1 - 1 - k]), most)
    yield i0, j0, head
    yield i1 - tail, j1 - tail, tail


def align_gap(a: list[str], b: list[str]) -> list[Block]:
    """Blocks of equal words of one gap: its ends, rare words, and the ends of what lies between these."""
    (_, _, head), (i1, j1, tail) = _ends(a, b, 0, len(a), 0, len(b))
    once_a, once_b = Counter(a[head:i1]), Counter(b[head:j1])
    place = {w: j for j, w in enumerate(b[head:j1], head) if once_b[w] == 1}
    blocks: list[Block] = []
    for i in range(head, i1):
        j = place.get(a[i]) if once_a[a[i]] == 1 else None
        if j is None:
            continue
        if blocks and (i, j) == (blocks[-1][0] + blocks[-1][2], blocks[-1][1] + blocks[-1][2]):
            blocks[-1] = (*blocks[-1][:2], blocks[-1][2] + 1)
        else:
            blocks.append((i, j, 1))
    chain = heaviest_chain(blocks)
    edges = [(head, head, 0), *chain, (i1, j1, 0)]
    between = [x for (i, j, n), (k, m, _) in zip(edges, edges[1:]) for x in _ends(a, b, i + n, k, j + n, m)]
    return [x for x in [(0, 0, head), *chain, *between, (i1, j1, tail)] if x[2]]


def _stream(df: DataFrame, keys: list[str], order: list[str], schema: str, work) -> DataFrame:
    """Rows grouped by their keys and sorted within, each group given to work as it goes by; work gives rows of the schema."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in batch.to_pylist())
        out = (x for key, group in itertools.groupby(rows, lambda r: tuple(r[k] for k in keys)) for x in work(key, group))
        while chunk := list(itertools.islice(out, _ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*chunk)], names=[x.split()[0] for x in schema.split(", ")])

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _chained(blocks: DataFrame) -> DataFrame:
    """The kept blocks of each chapter."""
    return _stream(blocks, ["chapter_idx"], ["i", "j"], "chapter_idx long, i long, j long, n long", lambda key, group: ((*key, *b) for b in heaviest_chain([(r["i"], r["j"], r["n"]) for r in group])))


def _gap_blocks(gaps: DataFrame) -> DataFrame:
    """Blocks of equal words inside the gaps: rows (chapter_idx, gap, side, at, w), side 0 for the source."""

    def work(key: tuple, group: Iterable[dict]) -> Iterator[tuple]:
        sides: tuple[list, list] = ([], [])
        for r in group:
            sides[r["side"]].append((r["at"], r["w"]))
        (a, b) = sides
        if a and b:
            for i, j, n in align_gap([w for _, w in a], [w for _, w in b]):
                yield key[0], a[0][0] + i, b[0][0] + j, n

    return _stream(gaps, ["chapter_idx", "gap"], ["side", "at"], "chapter_idx long, i long, j long, n long", work)


def _split(text: Column) -> Column:
    """Per word: the word as compared, its length, what stands before and after it."""
    words, marks = F.regexp_extract_all(text, F.lit(f"({X.WORD})"), F.lit(1)), F.split(text, X.WORD, -1)
    # both lists are made once, not for each word
    zipped = let(marks, lambda m: F.arrays_zip(words.alias("x"), F.slice(m, 1, F.size(m) - 1).alias("before"), F.slice(m, 2, F.size(m) - 1).alias("after")))
    return F.transform(zipped, lambda z: F.struct(F.lower(z["x"]).alias("w"), F.length(z["x"]).alias("size"), z["before"].alias("before"), z["after"].alias("after")))


def _placed(words: DataFrame, key: str, order: str) -> DataFrame:
    """Where each word begins and ends in its text."""
    so_far = F.sum(F.length("before") + F.col("size")).over(Window.partitionBy(key).orderBy(order))
    return words.withColumn("b", so_far.cast("long")).withColumn("a", F.col("b") - F.col("size"))


def _once(words: DataFrame, at: str) -> DataFrame:
    """Runs of RUN words that a chapter has once, and where."""
    ahead = Window.partitionBy("chapter_idx").orderBy(at)
    run = F.concat_ws(" ", "w", *(F.lead("w", k).over(ahead) for k in range(1, RUN)))
    runs = words.select("chapter_idx", at, run.alias("run"), F.lead("w", RUN - 1).over(ahead).alias("last")).where(F.col("last").isNotNull())
    return runs.groupBy("chapter_idx", "run").agg(F.min(at).alias(at), F.count(F.lit(1)).alias("times")).where("times = 1").drop("times")


def _blocks(anchors: DataFrame) -> DataFrame:
    """Anchors that follow each other on both sides, as one block."""
    diagonal = anchors.withColumn("d", F.col("i") - F.col("j"))
    island = F.col("i") - F.row_number().over(Window.partitionBy("chapter_idx", "d").orderBy("i"))
    return diagonal.withColumn("island", island).groupBy("chapter_idx", "d", "island").agg(F.min("i").alias("i"), F.min("j").alias("j"), (F.count(F.lit(1)) + RUN - 1).alias("n")).drop("d", "island")


def _pairs(blocks: DataFrame) -> DataFrame:
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("k")
    return blocks.select("chapter_idx", "i", "j", k).select("chapter_idx", (F.col("i") + F.col("k")).alias("i"), (F.col("j") + F.col("k")).alias("j"))


def _gapped(words: DataFrame, pairs: DataFrame, at: str) -> DataFrame:
    """The words with their partners; gap counts the matched words before."""
    other = "j" if at == "i" else "i"
    return words.join(pairs, ["chapter_idx", at], "left").withColumn("gap", F.count(other).over(Window.partitionBy("chapter_idx").orderBy(at)))


def align_words(source: DataFrame, script: DataFrame) -> DataFrame:
    """(chapter_idx, i, j): matched words of source (chapter_idx, i, w) and script (chapter_idx, j, w), places counted from zero without holes."""
    anchors = _once(source, "i").join(_once(script, "j"), ["chapter_idx", "run"])
    first = kept(_pairs(_chained(_blocks(anchors))))
    rest = [_gapped(words.select("chapter_idx", at, "w"), first, at).where(F.col(other).isNull()).select("chapter_idx", "gap", F.lit(side).alias("side"), F.col(at).alias("at"), "w") for side, (words, at, other) in enumerate(((source, "i", "j"), (script, "j", "i")))]
    return kept(first.unionByName(_pairs(_gap_blocks(rest[0].unionByName(rest[1])))))


def source_words(sources: DataFrame) -> DataFrame:
    """(chapter_idx, i, w, a, b, before, after) of every word of sources (chapter_idx, text)."""
    words = rows_of(sources, ["chapter_idx"], _split(F.col("text")), "i", "x").select("chapter_idx", F.col("i").cast("long"), "x.*")
    return _placed(words, "chapter_idx", "i").drop("size")


def script_words(segments: DataFrame) -> DataFrame:
    """(chapter_idx, seg, j, w, a) of every word of segments (chapter_idx, seg, text), seg counted from zero without holes."""
    words = rows_of(segments, ["chapter_idx", "seg"], _split(F.col("text")), "k", "x").select("chapter_idx", "seg", "k", "x.*")
    keyed = words.withColumn("key", F.struct("chapter_idx", "seg"))
    order = Window.partitionBy("chapter_idx").orderBy("seg", "k")
    return _placed(keyed, "key", "k").select("chapter_idx", "seg", (F.row_number().over(order) - 1).cast("long").alias("j"), "w", "a")


def validate_scripts(sources: DataFrame, segments: DataFrame) -> DataFrame:
    """(chapter_idx, kind, seg_idx, offset, text, line): missing fragments and hallucinated segments of each chapter.

    sources (chapter_idx, text), segments (chapter_idx, seg_idx, text). A missing fragment is a run of source words without
    partners, with the marks right around it; it belongs where the script goes on behind the last matched word (segment,
    counted from zero, and offset in it; the number of segments at the end) and line is the whole lines that hold it. Of a
    hallucinated segment under half the words are matched; a segment without words is none. Fragments of one mark are left out.
    """
    whole = sources.where("chapter_idx is not null").groupBy(F.col("chapter_idx").cast("long").alias("chapter_idx")).agg(F.coalesce(F.min("text"), F.lit("")).alias("text"))
    order = Window.partitionBy("chapter_idx").orderBy("seg_idx", "text")
    said = segments.where("chapter_idx is not null").select(F.col("chapter_idx").cast("long").alias("chapter_idx"), "seg_idx", F.coalesce("text", F.lit("")).alias("text"))
    said = said.withColumn("seg", (F.row_number().over(order) - 1).cast("long"))
    have, spoken = source_words(whole), script_words(said)
    pairs = align_words(have, spoken)

    behind = F.max("j").over(Window.partitionBy("chapter_idx").orderBy("i"))
    gaps = _gapped(have, pairs, "i").withColumn("to", F.coalesce(behind + 1, F.lit(0).cast("long"))).where(F.col("j").isNull())
    fragments = gaps.groupBy("chapter_idx", "gap", "to").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.min_by("before", "i").alias("before"), F.max_by("after", "i").alias("after"))
    fragments = fragments.select(
        "chapter_idx", "to",
        (F.col("a") - F.length(F.regexp_extract("before", rf"({_EDGE}*)\z", 1))).alias("a"),
        (F.col("b") + F.length(F.regexp_extract("after", f"^({_EDGE}*)", 1))).alias("b"),
    )
    sizes = said.groupBy("chapter_idx").agg(F.count(F.lit(1)).alias("segs"))
    at = spoken.select("chapter_idx", F.col("j").alias("to"), "seg", F.col("a").alias("offset"))
    shown = fragments.join(whole, "chapter_idx").join(sizes, "chapter_idx").join(at, ["chapter_idx", "to"], "left")
    text = X.stripped(F.substring(F.col("text"), F.col("a") + 1, F.col("b") - F.col("a")))
    line = F.concat(
        F.substring_index(F.substring(F.col("text"), F.lit(1).cast("long"), F.col("a")), "\n", -1),
        F.substring(F.col("text"), F.col("a") + 1, F.col("b") - F.col("a")),
        F.substring_index(F.substring(F.col("text"), F.col("b") + 1, F.length("text")), "\n", 1),
    )
    missing = shown.select("chapter_idx", F.lit("missing").alias("kind"), F.coalesce("seg", "segs").alias("seg_idx"), F.coalesce("offset", F.lit(0)).alias("offset"), text.alias("text"), X.stripped(line).alias("line"))
    missing = missing.where((F.length("text") > 1) | F.col("text").rlike(r"^[\p{L}\p{N}]$"))
    # a chapter that nobody says
    unsaid = whole.join(sizes, "chapter_idx", "left_anti").where(X.stripped(F.col("text")) != "")
    zero = F.lit(0).cast("long")
    nothing = unsaid.select("chapter_idx", F.lit("missing").alias("kind"), zero.alias("seg_idx"), zero.alias("offset"), "text", F.col("text").alias("line"))

    share = spoken.join(pairs, ["chapter_idx", "j"], "left").groupBy("chapter_idx", "seg").agg(F.count("i").alias("found"), F.count(F.lit(1)).alias("words")).where("2 * found < words")
    known = said.join(whole.select("chapter_idx"), "chapter_idx", "left_semi")
    invented = known.join(share, ["chapter_idx", "seg"]).select("chapter_idx", F.lit("hallucinated").alias("kind"), F.col("seg").alias("seg_idx"), zero.alias("offset"), "text", F.col("text").alias("line"))
    return reduce(DataFrame.unionByName, (missing, nothing, invented))


#: Runs of so many needle words are sent to every task; more are joined by an exchange.
BROADCAST_RUNS = 200_000


def _anchored(words: DataFrame, key: str, place: str, lengths: Column, *kept: str) -> DataFrame:
    """(key, place, anchor, h): hashes of all runs of the given numbers of words, all from one array."""
    run = lambda n: F.transform(F.sequence(F.lit(0), F.size("w") - n), lambda i: F.struct(n.alias("anchor"), i.alias("at"), F.xxhash64(F.slice("w", i + 1, n)).alias("h")))
    fitting = F.filter(lengths, lambda n: n <= F.size("w"))
    return rows_of(words, [key, *kept], F.flatten(F.transform(fitting, run)), "at", "x").select(key, *kept, F.col("x.anchor").alias("anchor"), F.col("x.at").alias(place), F.col("x.h").alias("h"))


def longest_shared_runs(needles: DataFrame, sources: DataFrame, needle_key: str, source_key: str, longest_anchor: int = 4) -> DataFrame:
    """Pairs whose longest common run of words has at least 0.7 of the needle's words.

    Needles and sources (key, text). A needle's anchors are its runs of as many words as any accepted match must have, four
    at most; they are joined by their hash. Matches on one diagonal in consecutive places are one run, so the longest run
    follows from gaps and islands. Ties: earliest in the needle, then earliest in the source. A needle or source that is null
    or has no words is in no pair; repeated rows count once, and different texts must have different keys.
    """
    own = needles.select(needle_key, X.word_tokens(F.col("text")).alias("w")).where(F.size("w") > 0)
    theirs = sources.select(source_key, X.word_tokens(F.col("text")).alias("w")).where(F.size("w") > 0)
    needed = F.ceil(F.size("w") * F.lit(ACCEPT) - 1e-9).cast("int")
    sized = _anchored(own.withColumn("needed", needed), needle_key, "i", F.array(F.least(F.lit(longest_anchor), needed)), "needed")
    # lengths that occur, and how many runs of each: a few numbers
    found = {r["anchor"]: r["n"] for r in sized.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).collect()}
    held = _anchored(theirs, source_key, "j", F.array(*map(F.lit, sorted(found) or [1])))
    small = sum(found.values()) <= BROADCAST_RUNS
    hits = held.join(F.broadcast(sized) if small else sized, ["anchor", "h"]).withColumn("diagonal", F.col("i") - F.col("j"))
    w = Window.partitionBy(needle_key, source_key, "diagonal").orderBy("i")
    islands = hits.withColumn("island", F.col("i") - F.dense_rank().over(w))
    runs = islands.groupBy(needle_key, source_key, "diagonal", "island").agg(F.min("i").alias("i"), F.min("j").alias("j"), (F.max("i") - F.min("i") + F.first("anchor")).alias("size"), F.first("needed").alias("needed"))
    longest = F.max(F.struct("size", (-F.col("i")).alias("i"), (-F.col("j")).alias("j")))
    best = runs.where(F.col("size") >= F.col("needed")).groupBy(needle_key, source_key).agg(longest.alias("b"))
    return best.select(needle_key, source_key, F.col("b.size").cast("long").alias("size"), (-F.col("b.i")).cast("long").alias("needle_at"), (-F.col("b.j")).cast("long").alias("source_at"))
