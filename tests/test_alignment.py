"""Alignment, places of texts and packing against plain versions of their definitions."""

import difflib
import itertools
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lectern.operators import alignment, chunking, locate, timing

WORD = re.compile(r"\w+")
EDGE = ".,;:?!\"'()[]-"


def tokens(text):
    return [(m.group().lower(), m.start(), m.end()) for m in WORD.finditer(text)]


def plain_chain(blocks):
    """The heaviest rising chain by all pairs; earlier blocks win ties; overlaps are cut from the later block."""
    best = []
    for k, (_, j, n) in enumerate(blocks):
        weight, prev = max([(best[m][0], -m) for m in range(k) if blocks[m][1] < j], default=(0, 1))
        best.append((weight + n, -prev))
    chain = []
    k = -max([(b[0], -k) for k, b in enumerate(best)], default=(0, 1))[1]
    while k >= 0:
        chain.insert(0, blocks[k])
        k = best[k][1]
    out = []
    for last, (i, j, n) in zip([None, *chain], chain):
        cut = max(0, last[0] + last[2] - i, last[1] + last[2] - j) if last else 0
        out.append((i + cut, j + cut, max(0, n - cut)))
    return {(i + x, j + x) for i, j, n in out for x in range(n)}


def plain_gaps(a, b, pairs):
    """Runs of places without partners on either side, by the number of pairs before."""
    left, right = {i for i, _ in pairs}, {j for _, j in pairs}
    found = {}
    for side, (n, used) in enumerate(((len(a), left), (len(b), right))):
        before = 0
        for k in range(n):
            if k in used:
                before += 1
            else:
                found.setdefault(before, ([], []))[side].append(k)
    return found.values()


def plain_rare(a, b, pairs, run):
    out = set(pairs)
    for ia, jb in plain_gaps(a, b, pairs):
        def once(words, at):
            grams = [(tuple(words[x] for x in at[k : k + run]), at[k]) for k in range(len(at) - run + 1)]
            return {g: x for g, x in grams if sum(h == g for h, _ in grams) == 1}

        left, right = once(a, ia), once(b, jb)
        anchors = sorted((i, right[g]) for g, i in left.items() if g in right)
        blocks = []
        for i, j in anchors:
            for m, (x, y, n) in enumerate(blocks):
                if (i, j) == (x + n - run + 1, y + n - run + 1):
                    blocks[m] = (x, y, n + 1)
                    break
            else:
                blocks.append((i, j, run))
        out |= plain_chain(blocks)
    return out


def plain_ends(a, b, pairs, back):
    out = set(pairs)
    for ia, jb in plain_gaps(a, b, pairs):
        order = reversed if back else iter
        out |= set(itertools.takewhile(lambda p: a[p[0]] == b[p[1]], zip(order(ia), order(jb))))
    return out


def plain_validation(source, segments):
    """(missing, hallucinated) as `validate_scripts` states it."""
    if not segments:
        return ([(0, 0, source, source)] if source.strip() else []), []
    have, said = tokens(source), [(w, k, at) for k, t in enumerate(segments) for w, at, _ in tokens(t)]
    a, b = [t[0] for t in have], [t[0] for t in said]
    pairs = plain_rare(a, b, set(), 3)
    pairs = plain_ends(a, b, plain_ends(a, b, pairs, False), True)
    pairs = plain_rare(a, b, pairs, 1)
    pairs = dict(plain_ends(a, b, plain_ends(a, b, pairs, False), True))
    missing = []
    for lost, run in itertools.groupby(range(len(a)), lambda i: i not in pairs):
        if lost:
            run = list(run)
            at = pairs[run[0] - 1] + 1 if run[0] else 0
            x, y = have[run[0]][1], have[run[-1]][2]
            while x and source[x - 1] in EDGE:
                x -= 1
            while y < len(source) and source[y] in EDGE:
                y += 1
            if len(text := source[x:y].strip()) > 1 or text.isalnum():
                line = (source[:x].rpartition("\n")[2] + source[x:y] + source[y:].partition("\n")[0]).strip()
                missing.append((*(said[at][1:] if at < len(said) else (len(segments), 0)), text, line))
    found = [said[j][1] for j in pairs.values()]
    return missing, [k for k, t in enumerate(segments) if tokens(t) and 2 * found.count(k) < len(tokens(t))]


def validated(spark, chapters):
    sources = spark.createDataFrame([(k, s) for k, (s, _) in enumerate(chapters)], "chapter_idx long, text string").repartition(3)
    segments = spark.createDataFrame([(k, i, t) for k, (_, ts) in enumerate(chapters) for i, t in enumerate(ts)], "chapter_idx long, seg_idx long, text string").repartition(3)
    out = {k: ([], []) for k in range(len(chapters))}
    for r in alignment.validate_scripts(sources, segments).collect():
        if r.kind == "missing":
            out[r.chapter_idx][0].append((r.seg_idx, r.offset, r.text, r.line))
        else:
            out[r.chapter_idx][1].append(r.seg_idx)
    return out


SOURCE = "It was late. The road lay empty and the rain fell on it.\nNobody came."
PARTS = ["It was late.", "The road lay empty and the rain fell on it.", "Nobody came."]


def test_validation_cases(spark):
    cases = [
        (PARTS, [], []),
        (PARTS[1:], [("It was late.", 0)], []),
        (PARTS[:2], [("Nobody came.", 2)], []),
        ([PARTS[0], PARTS[2]], [(PARTS[1], 1)], []),
        ([*PARTS[:2], "Quite other words here.", PARTS[2]], [], [2]),
        ([], [(SOURCE, 0)], []),
        (["It was late. The road lay", "and the rain fell on it. Nobody came."], [("empty", 1)], []),
        (["..."], [(SOURCE, 1)], []),
    ]
    found = validated(spark, [(SOURCE, segments) for segments, _, _ in cases])
    for k, (_, missing, invented) in enumerate(cases):
        assert ([(t, s) for s, _, t, _ in found[k][0]], found[k][1]) == (missing, invented), k


def test_validation_by_brute_force(spark):
    r = random.Random(4)
    words = "a bb c1 d_e late Road road empty it été".split()
    chapters = []
    for k in range(150):
        pool = words if k % 2 else words + [f"w{x}" for x in range(30)]
        source = "".join(r.choice(pool) + r.choice([" ", ", ", ". ", "\n", " “", "” ", "- "]) for _ in range(r.randint(0, 60)))
        segments = [" ".join(r.choice(pool) for _ in range(r.randint(0, 6))) if r.random() < 0.3 else source[(a := r.randint(0, len(source))) : a + r.randint(0, 80)] for _ in range(r.randint(0, 5))]
        chapters.append((source, segments))
    found = validated(spark, chapters)
    for k, (source, segments) in enumerate(chapters):
        missing, invented = plain_validation(source, segments)
        assert (sorted(found[k][0]), sorted(found[k][1])) == (sorted(missing), invented), chapters[k]


def test_odd_chapters(spark):
    """Nulls, repeated chapters and segments, chapters on one side only, empty tables."""
    sources = spark.createDataFrame([(1, "one two"), (1, "one two"), (2, None), (None, "lost"), (3, " \n"), (4, "here it is")], "chapter_idx int, text string")
    segments = spark.createDataFrame([(1, 0, "one"), (1, 0, "one"), (1, None, None), (None, 0, "x"), (9, 0, "no source"), (2, 0, "made up here")], "chapter_idx int, seg_idx int, text string")
    found = sorted((r.chapter_idx, r.kind, r.seg_idx, r.text) for r in alignment.validate_scripts(sources, segments).collect())
    assert found == [(1, "hallucinated", 2, "one"), (1, "missing", 2, "two"), (2, "hallucinated", 0, "made up here"), (4, "missing", 0, "here it is")]
    assert alignment.validate_scripts(sources.limit(0), segments.limit(0)).collect() == []


def narration(n):
    pairs = [f"The lamp number {k} burned low over the table. “Take lamp {k} away,” someone said." for k in range(n // 16)]
    segments = [*pairs[: len(pairs) // 2], *pairs[len(pairs) // 2 + 1 :]]
    segments.insert(7, "Quite unheard sentences appear right here without cause.")
    return "\n".join(pairs), segments


@pytest.mark.parametrize("n, bound", [(5_000, 2.0), (20_000, 10.0)])
def test_alignment_bounds(n, bound):
    a = [w for k in range(n // 10) for w in f"the lamp {k} burned low over the table that night".split()]
    b = [*a[: n // 2], *"quite unheard".split(), *a[n // 2 + 10 :]]
    start = time.process_time()
    blocks = alignment.align_gap(a, b)
    assert time.process_time() - start < bound / 4
    assert sum(n for _, _, n in blocks) > 0.99 * len(a)
    assert all(a[i : i + n] == b[j : j + n] for i, j, n in blocks)
    # chains of n blocks out of order
    r = random.Random(1)
    shuffled = [(i, j, 1) for i, j in enumerate(r.sample(range(n), n))]
    start = time.process_time()
    chain = alignment.heaviest_chain(shuffled)
    assert time.process_time() - start < bound / 4 and all(x[1] < y[1] for x, y in zip(chain, chain[1:]))


def test_long_chapter(spark):
    source, segments = narration(60_000)
    found = validated(spark, [(source, segments)])
    assert len(found[0][0]) == 1 and found[0][1] == [7]


def plain_find(needle, source, at):
    a, b = [t[0] for t in tokens(needle)], [t for t in tokens(source) if t[1] >= at]
    if not a or not b:
        return None
    m = difflib.SequenceMatcher(None, a, [t[0] for t in b], autojunk=False).find_longest_match()
    return (b[m.b][1], b[m.b + m.size - 1][2]) if m.size >= 0.7 * len(a) else None


def plain_span(source, texts, cursor):
    start, end, at = None, cursor, cursor
    for needle in filter(None, map(str.strip, texts)):
        place = source.find(needle, at)
        span = (place, place + len(needle)) if place >= 0 else None
        if not span:
            place = re.sub(r"\s+", " ", source[at:]).find(re.sub(r"\s+", " ", needle))
            span = (at + place, at + place + len(needle)) if place >= 0 else plain_find(needle, source, at)
        if not span:
            start = cursor if start is None else start
            continue
        start = span[0] if start is None and span[0] >= cursor else start
        at = end = span[1]
    start = cursor if start is None else start
    return start, end if end > start else len(source)


def test_review_spans_by_brute_force(spark):
    r = random.Random(5)
    words = "late road empty rain it fell on and nobody".split()
    chapters = []
    for k in range(120):
        source = " ".join(r.choice(words) + r.choice(["", "", ",", ".", "\n", "  "]) for _ in range(r.randint(0, 50)))
        # texts cut at words, so that no cursor stands inside one
        pieces = source.split(" ")
        batches = []
        for _ in range(r.randint(0, 4)):
            texts = []
            for _ in range(r.randint(0, 3)):
                a = r.randint(0, len(pieces))
                text = " ".join(pieces[a : a + r.randint(0, 6)])
                texts.append(r.choice([text, text.upper(), text.replace(" ", "  "), text.replace(",", "!"), "nowhere at all", None, " "]))
            batches.append(texts)
        chapters.append((k, source, batches))
    df = spark.createDataFrame(chapters, "chapter_idx long, text string, batches array<array<string>>").repartition(3)
    found = {(x.chapter_idx, x.batch): (x.start_char, x.end_char) for x in locate.review_spans(df).collect()}
    expected = {}
    for k, source, batches in chapters:
        cursor = 0
        for n, texts in enumerate(batches):
            expected[k, n] = plain_span(source, [t or "" for t in texts], cursor)
            cursor = expected[k, n][0]
    assert found == expected


def test_locate_chunks_by_brute_force(spark):
    r = random.Random(6)
    words = "late road empty rain it fell".split()
    chapters = [(0, "go on. go on.", ["go on", "go on", "zzz", None, " "]), (1, None, ["x"]), (2, "some text", None)]
    for k in range(3, 120):
        source = " ".join(r.choice(words) + r.choice(["", ",", "."]) for _ in range(r.randint(1, 40)))
        pieces = source.split(" ")
        chunks = []
        for _ in range(r.randint(0, 6)):
            a = r.randint(0, len(pieces))
            chunks.append(" ".join([*pieces[a : a + r.randint(1, 8)], *r.choice([[], ["other"], ["other", "words"]])]).upper())
        chapters.append((k, source, chunks))
    df = spark.createDataFrame(chapters, "chapter_idx long, text string, chunks array<string>").repartition(3)
    found = {(x.chapter_idx, x.chunk_idx): None if x.start_char is None else (x.start_char, x.end_char) for x in locate.locate_chunks(df).collect()}
    expected = {}
    for k, source, chunks in chapters:
        cursor = 0
        for n, chunk in enumerate(chunks or []):
            expected[k, n] = plain_find(chunk or "", source or "", cursor)
            cursor = expected[k, n][1] if expected[k, n] else cursor
    assert found == expected


def plain_runs(pieces, limit):
    """The longest beginning whose lengths, and one each, stay within the limit, then the same of the rest."""
    if not pieces:
        return []
    k = max([1, *(k for k in range(1, len(pieces) + 1) if sum(len(p) + 1 for p in pieces[:k]) <= limit)])
    return [" ".join(pieces[:k]), *plain_runs(pieces[k:], limit)]


def plain_pack(text, limit):
    def pack(carried, rest):
        k = next((k for k, s in enumerate(rest) if len(s) > limit), None)
        if k is None:
            return plain_runs(carried + rest, limit + 1)
        words = rest[k].split(" ")
        *full, last = plain_runs(words, limit)
        return plain_runs(carried + rest[:k], limit + 1) + [""] * (len(words[0]) >= limit) + full + pack([last], rest[k + 1 :])

    return pack([], [s for part in re.split(r"(?<=[.!?])\s+", text) if (s := part.strip())])


def plain_paragraphs(text, most, overlap, keep_blank):
    out, held, count = [], [], 0
    for paragraph in text.split("\n"):
        if not keep_blank and not paragraph.strip():
            continue
        size = len(paragraph.split())
        if held and count + size > most:
            out.append("\n".join(held))
            tail = " ".join(held).split()[-overlap:] if overlap else []
            held, count = ([" ".join(tail)] if tail else []), len(tail)
        held.append(paragraph)
        count += size
    return out + (["\n".join(held)] if held else [])


@pytest.mark.parametrize("limit", [3, 9, 25, 40])
def test_packing_by_brute_force(spark, limit):
    r = random.Random(limit)
    texts = ["".join(r.choice(["a", "bb", "cccccc", " ", " ", ". ", "! ", "x" * r.randint(1, 30), "\n"]) for _ in range(r.randint(0, 60))) for _ in range(300)]
    texts += ["One two. " * 300, "x" * 60, "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string").repartition(3)

    def cut(chunks):
        out = {}
        for x in chunks.collect():
            out.setdefault(x.k, {})[x.chunk_idx] = x.chunk
        return out

    found = cut(chunking.sentence_chunks(df, "k", "t", limit))
    packed = {k: {n: c for n, c in enumerate(plain_pack(t or "", limit)) if c.strip(" ")} for k, t in enumerate(texts)}
    assert found == {k: c for k, c in packed.items() if c}
    for overlap, keep in ((0, True), (2, False), (0, False), (7, False)):
        chunks = chunking.paragraph_chunks(df, "k", "t", limit, "\n") if keep else chunking.overlapping_chunks(df, "k", "t", limit, overlap, "\n")
        assert cut(chunks) == {k: dict(enumerate(c)) for k, t in enumerate(texts) if (c := plain_paragraphs(t or "", limit, overlap, keep))}


def plain_cues(rows):
    prev, out = -1.0, []
    for start, end in rows:
        end = start + 0.001 if end <= start else end
        if start < prev:
            start = prev
            end = start + 0.001 if end <= start else end
        prev = end
        out.append((round(start, 6), round(end, 6)))
    return out


@pytest.mark.parametrize("block", [1, 3, 64, timing.CUE_BLOCK])
def test_cues_by_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(timing, "CUE_BLOCK", block)
    r = random.Random(block)
    chapters = {k: [(round(r.random() * 5, 3), round(r.random() * 5, 3)) for _ in range(r.randint(1, 40))] for k in range(60)}
    chapters[60] = [(0.0, 9.0)] + [(0.0, 0.0)] * 30 + [(9.01, 9.02)] * 5
    rows = [(k, n, a, b, "A", "t") for k, times in chapters.items() for n, (a, b) in enumerate(times)]
    df = spark.createDataFrame(rows, "chapter_idx long, seg_idx long, start_s double, end_s double, speaker string, text string").repartition(3)
    found = {}
    for x in timing.cues(df).orderBy("chapter_idx", "cue_idx").collect():
        found.setdefault(x.chapter_idx, []).append((round(x.start_s, 6), round(x.end_s, 6)))
    assert found == {k: plain_cues(times) for k, times in chapters.items()}


def test_a_million_cues(spark):
    """One chapter of a million cues that all push each other on."""
    t = spark.range(1_000_000).select(F.lit(1).cast("long").alias("chapter_idx"), F.col("id").alias("seg_idx"), (F.col("id") % 7 / 10).alias("start_s"), F.lit(0.5).alias("end_s"), F.lit("").alias("speaker"), F.lit("t").alias("text"))
    last = timing.cues(t).agg(F.max("cue_idx").alias("n"), F.max("end_s").alias("end")).first()
    assert last.n == 1_000_000 and abs(last.end - 1000.5) < 1
