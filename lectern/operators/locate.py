"""Places of texts in their source, found in order.

Each text is looked for behind the end of the one before: literally, else with
white space as single spaces, else as the longest run of words that the two
share, if it has 0.7 of the text's words. The order makes this a fold: its
state is the cursor, and it runs over the row of a chapter.

A match that is accepted holds the words in the middle of its text, so the
rarest few of them in the source tell where it can be: each such place is
spread as far as the words agree, once for each distinct text of a chapter. Of the runs
so found a step takes the longest behind the cursor, of which it only cuts off
the words that begin before (ties: earliest in the text, then in the source).
Chapters in which every text is there literally or but for white space are
never cut into words. A chapter is one row, and nothing is exchanged or kept on the way.

A place found with other white space is counted in the source behind the
cursor so written, and ends after as many characters as the text has; this is
a fixed value of the format, and reviewed scripts hold such places.

Defined results: a null text is empty; rows without a chapter are left out;
chapters have different indexes; blank texts are not looked for; a chapter
without texts has no rows; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators.alignment import ACCEPT

#: Words of the longest anchor.
ANCHOR = 4
#: Rows that leave a task at once.
_OUT_ROWS = 8192
_WORD = re.compile(r"\w+")
_BLANKS, _LONG = re.compile(r"\s+"), re.compile(r"\s{2,}")

Span = tuple[int, int]


class _Runs:
    """The maximal runs (size, i, j) of words that a text shares with its source, those that are long enough; by where they are in the source."""

    def __init__(self, found: list[tuple[int, int, int]], size: int, needed: int) -> None:
        self.found = sorted(found, key=lambda r: r[2])
        self.starts = [r[2] for r in self.found]
        self.spare, self.needed = size - needed, needed
        # the best of each run and all behind it: longest, then earliest in the text, then in the source
        order = lambda r: (r[0], -r[1], -r[2])
        self.best = list(accumulate(reversed(self.found), lambda a, b: max(a, b, key=order)))[::-1]

    def behind(self, first: int) -> tuple[int, int] | None:
        """(j, size) of the best run without the words before the given one."""
        k = bisect_left(self.starts, first)
        cut = [(size - first + j, -(i + first - j), -first) for size, i, j in self.found[bisect_left(self.starts, first - self.spare) : k] if size - first + j >= self.needed]
        if k < len(self.best):
            size, i, j = self.best[k]
            cut.append((size, -i, -j))
        size, _, j = max(cut, default=(0, 0, 0))
        return (-j, size) if size else None


class Source:
    """A text in which others are looked for; words, and white space as single spaces, are only made where they are needed."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.words: list[str] | None = None
        self.loose: str | None = None
        self.known: dict[str, _Runs | None] = {}
        self.anchors: dict[int, dict[tuple[str, ...], list[int]]] = {}

    def _cut(self) -> None:
        if self.words is None:
            found = list(_WORD.finditer(self.text))
            self.words = [m.group().lower() for m in found]
            self.starts, self.ends = [m.start() for m in found], [m.end() for m in found]

    def _anchored(self, size: int) -> dict[tuple[str, ...], list[int]]:
        """Where each run of so many words begins."""
        if size not in self.anchors:
            self.anchors[size] = found = {}
            for j, run in enumerate(zip(*(islice(self.words, k, None) for k in range(size)))):
                found.setdefault(run, []).append(j)
        return self.anchors[size]

    def _runs(self, text: str) -> _Runs | None:
        own = [w.lower() for w in _WORD.findall(text)]
        n = len(own)
        needed = -int(-(n * ACCEPT - 1e-9) // 1)
        if not n or needed > len(self.words):
            return None
        # the words that every run of that many holds
        low, high = n - needed, needed
        size = min(ANCHOR, high - low)
        there = self._anchored(size)
        at, places = min(((i, there.get(tuple(own[i : i + size]), ())) for i in range(low, high - size + 1)), key=lambda x: len(x[1]))
        found = []
        for place in places:
            i, j, end = at, place, at + size
            while i and j and own[i - 1] == self.words[j - 1]:
                i, j = i - 1, j - 1
            shift, most = j - i, len(self.words)
            while end < n and end + shift < most and own[end] == self.words[end + shift]:
                end += 1
            if end - i >= needed:
                found.append((end - i, i, j))
        return _Runs(found, n, needed) if found else None

    def by_words(self, text: str, cursor: int) -> Span | None:
        """The longest run of words shared with the text, behind the cursor."""
        self._cut()
        if text not in self.known:
            self.known[text] = self._runs(text)
        runs = self.known[text]
        found = runs and runs.behind(bisect_left(self.starts, cursor))
        return (self.starts[found[0]], self.ends[found[0] + found[1] - 1]) if found else None

    def literally(self, text: str, cursor: int) -> Span | None:
        """The text as it is, else with white space as single spaces."""
        at = self.text.find(text, cursor)
        if at < 0:
            if self.loose is None:
                blanks = [m.span() for m in _LONG.finditer(self.text)]
                self.loose = _BLANKS.sub(" ", self.text)
                self.blanks, self.gone = [a for a, _ in blanks], [0, *accumulate(b - a - 1 for a, b in blanks)]
                self.blank_ends = [b for _, b in blanks]
            # where the source behind the cursor begins in the source so written; white space that the cursor is in counts again
            k = bisect_right(self.blanks, cursor)
            inside = k and cursor < self.blank_ends[k - 1]
            start = self.blanks[k - 1] - self.gone[k - 1] if inside else cursor - self.gone[k]
            found = self.loose.find(_BLANKS.sub(" ", text), start)
            if found < 0:
                return None
            at = cursor + found - start
        return at, at + len(text)

    def place(self, text: str, cursor: int) -> Span | None:
        return self.literally(text, cursor) or self.by_words(text, cursor)


def chunk_spans(text: str, chunks: list[str]) -> list[Span | None]:
    """Where the words of each chunk are in the text, searched from the end of the one before."""
    source, cursor, out = Source(text), 0, []
    for chunk in chunks:
        out.append(place := source.by_words(chunk, cursor))
        cursor = place[1] if place else cursor
    return out


def batch_spans(text: str, batches: list[list[str]]) -> list[Span]:
    """The span of the text that each batch covers, searched behind the start of the one before."""
    source, begin, out = Source(text), 0, []
    for texts in batches:
        cursor, first = begin, None
        for x in filter(None, texts):
            place = source.place(x, cursor)
            if place is None:
                first = begin if first is None else first
                continue
            if first is None and place[0] >= begin:
                first = place[0]
            cursor = place[1]
        begin = begin if first is None else first
        out.append((begin, cursor if cursor > begin else len(text)))
    return out


def _cleaned(chapters: DataFrame) -> DataFrame:
    texts = F.transform(F.coalesce("batches", F.array()), lambda b: F.transform(F.coalesce(b, F.array()), lambda t: X.stripped(F.coalesce(t, F.lit("")))))
    return chapters.where("chapter_idx is not null").select(F.col("chapter_idx").cast("long").alias("chapter_idx"), F.coalesce("text", F.lit("")).alias("text"), texts.alias("batches"))


def _looked_up(clean: DataFrame, number: str, look: Callable[[str, list[list[str]]], list[Span | None]]) -> DataFrame:
    """(chapter_idx, number, start_char, end_char) of all that look(text, batches) gives for a chapter, in its order."""

    def spans(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for key, text, asked in zip(*batch.columns):
                for k, span in enumerate(look(text.as_py(), asked.as_py())):
                    yield (key.as_py(), k, *(span or (None, None)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = spans(batches)
        while held := list(islice(found, _OUT_ROWS)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*held)], names=["chapter_idx", number, "start_char", "end_char"])

    return clean.mapInArrow(run, f"chapter_idx long, {number} long, start_char long, end_char long")


def review_spans(chapters: DataFrame) -> DataFrame:
    """(chapter_idx, batch, start_char, end_char) of chapters (chapter_idx, text, batches array<array<string>>): the span of the source that each batch of texts covers.

    A batch is searched behind the start of the one before. Its span begins where its first text was found (at the cursor if that was not found)
    and ends behind the last that was found, at the end of the source if none was.
    """
    return _looked_up(_cleaned(chapters), "batch", batch_spans)


def locate_chunks(chapters: DataFrame) -> DataFrame:
    """(chapter_idx, chunk_idx, start_char, end_char) of chapters (chapter_idx, text, chunks array<string>): where each chunk's words are, searched from the end of the one before; nulls where they are not."""
    clean = _cleaned(chapters.select("chapter_idx", "text", F.array(F.coalesce("chunks", F.array().cast("array<string>"))).alias("batches")))
    return _looked_up(clean, "chunk_idx", lambda text, asked: chunk_spans(text, asked[0]))
