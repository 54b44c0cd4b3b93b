"""Paragraphs and titles of HTML documents with the standard library's parser.

Tags that are never closed end where HTML says they do: a block tag ends an
open paragraph, a list item or table cell ends the one before it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from lectern.functions.constants import CONTENT_TAGS, SKIP_TAGS

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: What an opening tag closes, and inside which tags it stops looking.
_ENDS = {"li": ({"li"}, {"ul", "ol"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr", "td", "th"}, {"table"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"})}


class _Node:
    __slots__ = ("tag", "parts", "content_inside", "index")

    def __init__(self, tag: str, index: int) -> None:
        self.tag, self.index, self.content_inside = tag, index, False
        self.parts: list[str] = []


class ParagraphWalk(HTMLParser):
    """Collects (tag index, tag, loose text) of every content tag, in document order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[_Node] = []
        self.found: list[_Node] = []
        self.skipping: list[str] = []
        self.title: str | None = None
        self.headings: dict[str, str] = {}

    def _close(self, node: _Node) -> None:
        if node.tag in ("h1", "h2", "h3") and (text := " ".join("".join(node.parts).split())):
            self.headings.setdefault(node.tag, text)

    def _pop_to(self, at: int) -> None:
        while len(self.open) > at:
            self._close(self.open.pop())

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "title":
            self.title = self.title or ""
            self.skipping.append(tag)
            return
        if self.skipping or tag in SKIP_TAGS and tag in _VOID:
            if tag not in _VOID and tag in SKIP_TAGS:
                self.skipping.append(tag)
            return
        if tag in _BLOCK:
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i].tag == "p":
                    self._pop_to(i)
                    break
                if self.open[i].tag in ("div", "li", "td", "th", "table"):
                    break
        if tag in _ENDS:
            ends, stops = _ENDS[tag]
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i].tag in ends:
                    self._pop_to(i)
                    break
                if self.open[i].tag in stops:
                    break
        if tag in SKIP_TAGS:
            self.skipping.append(tag)
            return
        if tag in _VOID:
            return
        node = _Node(tag, -1)
        if tag in CONTENT_TAGS:
            node.index = len(self.found)
            self.found.append(node)
            for outer in self.open:
                outer.content_inside = True
        self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        if self.skipping:
            if tag in self.skipping:
                while self.skipping.pop() != tag:
                    pass
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i].tag == tag:
                self._pop_to(i)
                break

    def handle_data(self, data: str) -> None:
        if self.skipping:
            if self.skipping[-1] == "title":
                self.title = (self.title or "") + data
            return
        # text belongs to the innermost content tag around it
        for node in reversed(self.open):
            if node.tag in CONTENT_TAGS:
                node.parts.append(data)
                break


def walk(html: str) -> ParagraphWalk:
    parser = ParagraphWalk()
    parser.feed(html)
    parser.close()
    parser._pop_to(0)
    return parser


def paragraphs_of(html: str) -> list[tuple[int, str, str]]:
    """(tag_idx, tag, text) of every paragraph with text; a container gives only the text that is not in a nested content tag."""
    return [(n.index, n.tag, text) for n in walk(html).found if (text := " ".join("".join(n.parts).split()))]


def title_of(html: str) -> str | None:
    """The title, else the first h1, h2 or h3 with text."""
    parser = walk(html)
    if parser.title and parser.title.strip():
        return parser.title.strip()
    return next((parser.headings[h] for h in ("h1", "h2", "h3") if h in parser.headings), None)


def extract_paragraphs(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, para_idx, tag_idx, tag, text)."""
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, i, *p) for k, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, p in enumerate(paragraphs_of(h or ""))]
            if rows:
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], batch.schema.field(0).type), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3]), pa.array(columns[4])],
                    names=[key, "para_idx", "tag_idx", "tag", "text"],
                )

    return pages.select(key, html).mapInArrow(run, f"{key} {kind}, para_idx long, tag_idx long, tag string, text string")


def with_paragraphs(pages: DataFrame, html: str) -> DataFrame:
    """Every row of pages with the paragraphs of its html: tags array<long> and texts array<string>, as extract_paragraphs numbers them; null for a null html."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if h is None else paragraphs_of(h) for h in batch.column(html).to_pylist()]
            tags, texts = ([None if ps is None else [p[k] for p in ps] for ps in found] for k in (0, 2))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tags, pa.list_(pa.int64())), pa.array(texts, pa.list_(pa.string()))], names=[*batch.schema.names, "tags", "texts"])

    return pages.mapInArrow(run, StructType([*pages.schema.fields]).add("tags", ArrayType(LongType())).add("texts", ArrayType(StringType())))


def title_column(html: Column) -> Column:
    """The title by patterns alone, for well-formed heads."""
    inner = lambda tag: F.nullif(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract(html, rf"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1), "<[^>]+>", ""), r"\s+", " ")), F.lit(""))
    return F.coalesce(inner("title"), inner("h1"), inner("h2"), inner("h3"))


def chapter_texts(paragraphs: DataFrame, key: str, separator: str = "\n\n") -> DataFrame:
    """(key, text): paragraphs joined in order."""
    p = paragraphs.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("para_idx", "text"))).alias("p"))
    return p.select(key, F.array_join("p.text", separator).alias("text"))
