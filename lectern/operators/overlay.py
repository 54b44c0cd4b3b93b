"""Read-along overlays: spans of a chapter's document that its chunks are anchored to."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate, count, islice, zip_longest
from xml.etree import ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions.constants import CONTENT_TAGS, SKIP_TAGS
from lectern.operators.locate import chunk_spans

#: The class that readers give to the active fragment, and its style.
ACTIVE_CLASS = "-epub-media-overlay-active"
#: Rows that leave a task at once.
_OUT_ROWS = 8192
ACTIVE_STYLE = f".{ACTIVE_CLASS} {{ background: rgba(255, 214, 0, 0.35); }}"


def local(tag: object) -> str:
    return tag.rpartition("}")[2] if isinstance(tag, str) else ""


@dataclass
class Run:
    """A stretch of a paragraph's text as the document keeps it: the text of a node, or what follows it inside its parent."""

    node: ET.Element
    parent: ET.Element | None

    @property
    def raw(self) -> str:
        return (self.node.text if self.parent is None else self.node.tail) or ""

    def wrap(self, a: int, b: int, span: ET.Element) -> None:
        """Put raw[a:b] into the span."""
        raw = self.raw
        span.text, span.tail = raw[a:b], raw[b:]
        if self.parent is None:
            self.node.text = raw[:a]
            self.node.insert(0, span)
        else:
            self.node.tail = raw[:a]
            self.parent.insert(list(self.parent).index(self.node) + 1, span)


class Paragraph:
    """The text of a content element without that of nested ones: words of the document's runs, joined by one space where there was any.

    Words are kept with where they begin in the joined text, so a place there is found by one search. A run that spans cut is kept
    as its pieces, so a span is put in without walking the paragraph again.
    """

    def __init__(self, element: ET.Element) -> None:
        self.element = element
        #: Per run, as it was: where its pieces begin in it, and what they are now.
        self.pieces: list[tuple[list[int], list[Run]]] = []
        #: Per word: where it begins in the joined text, its run, where it begins there.
        self.starts: list[int] = []
        self.at: list[tuple[int, int]] = []
        parts: list[str] = []
        size, gap = 0, False
        runs: list[Run] = []
        self._collect(element, runs)
        for k, run in enumerate(runs):
            self.pieces.append(([0], [run]))
            for m in _BLANK_OR_WORD.finditer(run.raw):
                if m.lastgroup == "blank":
                    gap = size > 0
                    continue
                parts += [" "] * gap + [m.group()]
                size += gap
                self.starts.append(size)
                self.at.append((k, m.start()))
                size += len(m.group())
                gap = False
        self.text = "".join(parts)

    def _collect(self, element: ET.Element, runs: list[Run]) -> None:
        runs.append(Run(element, None))
        for child in element:
            if not own_text(child):
                self._collect(child, runs)
            runs.append(Run(child, element))

    def _place(self, at: int) -> tuple[int, int, int] | None:
        """Run, its piece and the offset in the run of a character of the joined text, none for a space."""
        word = bisect_right(self.starts, at) - 1
        if word < 0 or self.text[at] == " ":
            return None
        run, start = self.at[word]
        offset = start + at - self.starts[word]
        return run, bisect_right(self.pieces[run][0], offset) - 1, offset

    def wrap(self, start: int, end: int, fragment: str, expected: str) -> bool:
        """Put a range of the joined text in a span with an id; False if it crosses markup, is out of range, begins or ends with a space, or reads otherwise."""
        if not 0 <= start < end <= len(self.text) or self.text[start:end] != expected:
            return False
        first, last = self._place(start), self._place(end - 1)
        if first is None or last is None or first[:2] != last[:2]:
            return False
        tag = self.element.tag
        span = ET.Element(tag[: tag.rfind("}") + 1] + "span", id=fragment)
        run, k, a = first
        starts, pieces = self.pieces[run]
        piece, b = pieces[k], last[2] + 1
        piece.wrap(a - starts[k], b - starts[k], span)
        starts[k + 1 : k + 1] = [a, b]
        pieces[k + 1 : k + 1] = [Run(span, None), Run(span, piece.node if piece.parent is None else piece.parent)]
        return True


_BLANK_OR_WORD = re.compile(r"(?P<blank>\s+)|(?P<word>\S+)")


def own_text(element: ET.Element) -> bool:
    """Whether an element's text is not part of the paragraph around it: it is one itself, or is left out."""
    return local(element.tag) in CONTENT_TAGS or local(element.tag) in SKIP_TAGS


def content(root: ET.Element) -> Iterator[Paragraph]:
    """All content elements in document order, none inside dropped ones."""
    todo = [root]
    while todo:
        element = todo.pop()
        if local(element.tag) in SKIP_TAGS:
            continue
        if local(element.tag) in CONTENT_TAGS:
            yield Paragraph(element)
        todo += reversed(element)


def paragraphs(root: ET.Element) -> list[Paragraph]:
    """Content elements with text of their own."""
    return [found for found in content(root) if found.text]


def text_of(found: list[Paragraph]) -> str:
    """The text in which chunks are looked for."""
    return "\n\n".join(p.text for p in found)


def shares(ends: list[int], starts: list[int], a: int, b: int) -> list[tuple[int, float, float]]:
    """Intervals, in order and apart, that [a, b) overlaps, each with its share of what is covered."""
    first, last = bisect_right(ends, a), bisect_left(starts, b)
    edges = [0, *accumulate(min(b, ends[k]) - max(a, starts[k]) for k in range(first, last))]
    # a place without any text covers nothing
    return [] if not edges[-1] else [(k, low / edges[-1], high / edges[-1]) for k, low, high in zip(range(first, last), edges, edges[1:])]


def place_chunks(root: ET.Element, spans: list[tuple[int, int] | None], prefix: str = "lv") -> list[list[tuple[str, float, float]]]:
    """(fragment id, from share, to share) of each span of the document's text: a span of its own inside one paragraph, else the paragraphs it covers. Changes the document."""
    found = paragraphs(root)
    source = text_of(found)
    starts = [0, *accumulate(len(p.text) + 2 for p in found)][: len(found)]
    ends = [a + len(p.text) for a, p in zip(starts, found)]
    taken = {e.get("id") for e in root.iter() if e.get("id")}
    names = (name for k in count() if (name := f"{prefix}{k}") not in taken)
    spare: list[str] = []

    def named(element: ET.Element) -> str:
        if not element.get("id"):
            element.set("id", spare.pop() if spare else next(names))
        return element.get("id")

    out: list[list[tuple[str, float, float]]] = []
    for span in spans:
        over = shares(ends, starts, *span) if span else []
        if len(over) == 1:
            k = over[0][0]
            name = spare.pop() if spare else next(names)
            if found[k].wrap(span[0] - starts[k], span[1] - starts[k], name, source[slice(*span)]):
                out.append([(name, 0.0, 1.0)])
                continue
            spare.append(name)
        out.append([(named(found[k].element), low, high) for k, low, high in over])
    return out


def with_highlight(root: ET.Element) -> bool:
    """Add the style of the active fragment to the head; False without one."""
    head = next((e for e in root.iter() if local(e.tag) == "head"), None)
    if head is None:
        return False
    style = ET.SubElement(head, head.tag[: head.tag.rfind("}") + 1] + "style", type="text/css")
    style.text = ACTIVE_STYLE
    return True


def _placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a few documents at a time: each is parsed once, its chunks are looked for in its text, and put where they were found."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.string()]

    def rows_of(key: int, xhtml: str | None, chunks: list[str] | None) -> Iterator[tuple]:
        try:
            root = ET.fromstring(xhtml or "")
        except ET.ParseError as problem:
            yield (key, None, None, None, None, None, str(problem))
            return
        spans = chunk_spans(text_of(paragraphs(root)), chunks or [])
        yield from ((key, i, j, *p, None) for i, found in enumerate(place_chunks(root, spans)) for j, p in enumerate(found))

    found = (row for batch in batches for columns in zip(*batch.columns) for row in rows_of(*(c.as_py() for c in columns)))
    while held := list(islice(found, _OUT_ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held), kinds)], names=["chapter_idx", "chunk_idx", "place", "fragment", "from_share", "to_share", "problem"])


def placements(chapters: DataFrame) -> DataFrame:
    """(chapter_idx, chunk_idx, place, fragment, from_share, to_share, problem) of chapters (chapter_idx, xhtml, chunks array<string>).

    A chapter whose document is null or not well formed has one row with the problem and nothing else; null chunks are not found,
    and chunks that are not found have no rows. Chapters have different indexes; rows without one are only told if their document is broken.
    """
    chunks = F.transform(F.when(F.col("chapter_idx").isNotNull(), F.col("chunks")), lambda t: X.stripped(F.coalesce(t, F.lit(""))))
    ready = chapters.select(F.col("chapter_idx").cast("long").alias("chapter_idx"), "xhtml", chunks.alias("chunks"))
    return ready.mapInArrow(_placed, "chapter_idx long, chunk_idx long, place long, fragment string, from_share double, to_share double, problem string")


def document_elements(documents: DataFrame) -> DataFrame:
    """(chapter_idx, tag_idx, text, problem): the content elements of documents (chapter_idx, xhtml) as an XML reader sees them; a document that is null or not well formed is one row with the problem."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, xhtml in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows += [(key, k, p.text, None) for k, p in enumerate(content(ET.fromstring(xhtml or "")))]
                except ET.ParseError as problem:
                    rows.append((key, None, None, str(problem)))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["chapter_idx", "tag_idx", "text", "problem"])

    return documents.select(F.col("chapter_idx").cast("long"), "xhtml").mapInArrow(run, "chapter_idx long, tag_idx long, text string, problem string")


def verified_chapters(extracted: DataFrame, documents: DataFrame) -> DataFrame:
    """(chapter_idx, n_paragraphs, n_wrong, problem, verified): whether the paragraphs that were extracted (chapter_idx, tag_idx, text) are the elements of the documents (chapter_idx, xhtml), one by one.

    The two walks are made by different readers and joined by element; a chapter with any paragraph that is not the element of its
    number, or whose document cannot be read, is refused: chunks anchored there would light up other text. Elements without an
    extracted paragraph do not matter. Extracted chapters without a document are refused, documents without paragraphs are not.
    """
    seen = document_elements(documents)
    problems = seen.where("problem is not null").groupBy("chapter_idx").agg(F.min("problem").alias("problem"))
    there = seen.where("problem is null").select("chapter_idx", "tag_idx", F.col("text").alias("seen"))
    both = extracted.select(F.col("chapter_idx").cast("long").alias("chapter_idx"), F.col("tag_idx").cast("long").alias("tag_idx"), "text").withColumn("asked", F.lit(True)).join(there, ["chapter_idx", "tag_idx"], "full_outer")
    same = F.when(F.col("asked"), F.col("text").eqNullSafe(F.col("seen")))
    found = both.groupBy("chapter_idx").agg(F.count("asked").alias("n_paragraphs"), F.count_if(~same).alias("n_wrong"), F.coalesce(F.bool_and(same), F.lit(True)).alias("same"))
    out = found.join(problems, "chapter_idx", "full_outer")
    return out.select("chapter_idx", F.coalesce("n_paragraphs", F.lit(0)).cast("long").alias("n_paragraphs"), F.coalesce("n_wrong", F.lit(0)).cast("long").alias("n_wrong"), "problem", (F.coalesce("same", F.lit(True)) & F.col("problem").isNull()).alias("verified"))


def verified_rows(chapters: DataFrame) -> DataFrame:
    """Every row of chapters (xhtml, tags array<long>, texts array<string>, others) without these three, with n_paragraphs, n_wrong, problem and verified as verified_chapters tells them.

    A chapter has its document and its paragraphs in one row, so nothing is joined: rows without any element stay, as do rows that repeat
    an index or have none. Null arrays are empty.
    """
    others = [c for c in chapters.columns if c not in ("xhtml", "tags", "texts")]

    def told(xhtml: str | None, tags: list[int | None] | None, texts: list[str | None] | None) -> tuple[int, int, str | None, bool]:
        seen, problem = [], None
        try:
            seen = [p.text for p in content(ET.fromstring(xhtml or ""))]
        except ET.ParseError as found:
            problem = str(found)
        asked = list(zip_longest(tags or [], texts or []))
        wrong = sum(t is None or not 0 <= t < len(seen) or seen[t] != x for t, x in asked)
        return len(asked), wrong, problem, not wrong and problem is None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_())
        for batch in batches:
            rows = [told(*r) for r in zip(*(batch.column(c).to_pylist() for c in ("xhtml", "tags", "texts")))]
            made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*map(batch.column, others), *made], names=[*others, "n_paragraphs", "n_wrong", "problem", "verified"])

    schema = chapters.select(*others).schema.add("n_paragraphs", "long").add("n_wrong", "long").add("problem", "string").add("verified", "boolean")
    return chapters.mapInArrow(run, schema)
