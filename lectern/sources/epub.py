"""EPUB and WAV sources and sinks. Files are read by Spark's binary source, so any store that Spark reaches will do."""

from __future__ import annotations

import hashlib
import io
import re
import wave
import zipfile
import zlib
from array import array
from collections.abc import Iterable, Iterator
from posixpath import dirname, join, normpath
from urllib.parse import quote, unquote
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.constants import MIN_CHAPTER_WORDS
from lectern.operators.html import paragraphs_of, title_of

#: Marks that no XML document may hold.
_NO_XML = re.compile("[^\\t\\n\\r\\x20-\ud7ff\ue000-\ufffd\U00010000-\U0010ffff]")
_DC = "{http://purl.org/dc/elements/1.1/}"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def package_path(book: zipfile.ZipFile) -> str:
    container = ElementTree.fromstring(book.read("META-INF/container.xml"))
    return next(e.get("full-path") for e in container.iter() if _local(e.tag) == "rootfile")


def read_part(book: zipfile.ZipFile, path: str) -> bytes | None:
    """A part by its path as written, unquoted or quoted."""
    names = set(book.namelist())
    return next((book.read(p) for p in (path, unquote(path), quote(path)) if p in names), None)


def book_of(data: bytes, fallback: str, min_words: int = MIN_CHAPTER_WORDS) -> dict:
    """Title, creator, language and chapters (title, href, text) of a book; short documents are no chapters, chapters are numbered densely."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        path = package_path(book)
        package = ElementTree.fromstring(book.read(path))
        first = lambda name, default: next((e.text for e in package.iter(_DC + name) if e.text), default)
        items = {e.get("id"): e for e in package.iter() if _local(e.tag) == "item"}
        spine = [items[e.get("idref")] for e in package.iter() if _local(e.tag) == "itemref" and e.get("idref") in items]
        chapters = []
        for item in spine:
            href = normpath(join(dirname(path), item.get("href", "")))
            html = (read_part(book, href) or b"").decode("utf-8", "replace")
            text = "\n\n".join(t for _, _, t in paragraphs_of(html))
            if len(text.split()) >= min_words:
                n = len(chapters) + 1
                chapters.append({"chapter_idx": n, "title": title_of(html) or f"Chapter {n}", "href": href, "text": text})
        return {"title": first("title", fallback), "author": first("creator", "Unknown"), "language": first("language", "en"), "chapters": chapters}


#: What a broken file raises while it is opened and read.
_BROKEN = (zipfile.BadZipFile, ElementTree.ParseError, KeyError, StopIteration, ValueError, RuntimeError, NotImplementedError, zlib.error)


def read_books(spark: SparkSession, path: str, min_words: int = MIN_CHAPTER_WORDS) -> DataFrame:
    """(path, sha256, title, author, language, chapter_idx, chapter_title, href, text, problem) of every EPUB file under a path.

    The driver lists the folder; files that a table names are read by `media.read_files` and given to `books_of`.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.epub").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return books_of(files, min_words)


def books_of(files: DataFrame, min_words: int = MIN_CHAPTER_WORDS) -> DataFrame:
    """The rows of `read_books` of files (path, content) from anywhere.

    A file that cannot be read is one row with the problem, and with nothing else; a book without chapters has no rows.
    """

    def rows_of(where: str, data: bytes) -> Iterator[tuple]:
        digest = hashlib.sha256(data).hexdigest()
        try:
            book = book_of(data, unquote(where.rpartition("/")[2].removesuffix(".epub")), min_words)
        except _BROKEN as error:
            yield (where, digest, *[None] * 7, f"{type(error).__name__}: {error}")
            return
        for c in book["chapters"]:
            yield where, digest, book["title"], book["author"], book["language"], c["chapter_idx"], c["title"], c["href"], c["text"], None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "sha256", "title", "author", "language", "chapter_idx", "chapter_title", "href", "text", "problem"]
        kinds = [pa.int64() if n == "chapter_idx" else pa.string() for n in names]
        for batch in batches:
            for where, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                rows = list(rows_of(where, data or b""))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return files.select("path", "content").mapInArrow(run, "path string, sha256 string, title string, author string, language string, chapter_idx long, chapter_title string, href string, text string, problem string")


def with_parts(book: bytes, replacements: dict[str, bytes], additions: dict[str, bytes]) -> bytes:
    """A copy of a book with parts replaced and added; the type marker comes first and uncompressed."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(book)) as source, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as target:
        if "mimetype" in source.namelist():
            target.writestr("mimetype", source.read("mimetype"), zipfile.ZIP_STORED)
        for name in source.namelist():
            if name != "mimetype" and name not in additions:
                target.writestr(name, replacements.get(name, source.read(name)))
        for name, data in additions.items():
            target.writestr(name, data)
    return out.getvalue()


def _page(title: str, text: str) -> str:
    lines = "".join(f"<p>{escape(line)}</p>" for line in text.split("\n") if line.strip())
    return f"<html xmlns='http://www.w3.org/1999/xhtml'><head><title>{escape(title)}</title></head><body>{lines}</body></html>"


def book_bytes(title: str, author: str, language: str, chapters: list[tuple[str, str]]) -> bytes:
    """A package of chapters (title, text), a paragraph per line; marks that XML does not know are left out."""
    known = lambda text: _NO_XML.sub(" ", text or "")
    parts = [(f"c{k}.xhtml", known(_page(name or "", text or ""))) for k, (name, text) in enumerate(chapters)]
    items = "".join(f"<item id='c{k}' href='{name}' media-type='application/xhtml+xml'/>" for k, (name, _) in enumerate(parts))
    spine = "".join(f"<itemref idref='c{k}'/>" for k in range(len(parts)))
    said = "".join(f"<dc:{tag}>{escape(known(value))}</dc:{tag}>" for tag, value in (("title", title), ("creator", author), ("language", language)) if value)
    package = f"<package xmlns='http://www.idpf.org/2007/opf' version='3.0'><metadata xmlns:dc='{_DC[1:-1]}'>{said}</metadata><manifest>{items}</manifest><spine>{spine}</spine></package>"
    container = "<container xmlns='urn:oasis:names:tc:opendocument:xmlns:container' version='1.0'><rootfiles><rootfile full-path='OPS/package.opf' media-type='application/oebps-package+xml'/></rootfiles></container>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
        for name, content in (("META-INF/container.xml", container), ("OPS/package.opf", package), *((f"OPS/{name}", content) for name, content in parts)):
            book.writestr(name, content)
    return out.getvalue()


def packaged(books: DataFrame) -> DataFrame:
    """(name, data) of books (name, title, author, language, chapters array<struct<title, text>>), as the media source writes them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("title", "author", "language", "chapters"))
            data = [book_bytes(t, a, n, [(c["title"], c["text"]) for c in chapters or []]) for t, a, n, chapters in zip(*columns)]
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(data, pa.binary())], names=["name", "data"])

    return books.select("name", "title", "author", "language", "chapters").mapInArrow(run, "name string, data binary")


def wav_bytes(samples: list[float], rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(array("h", (max(-32768, min(32767, round(x * 32768))) for x in samples)).tobytes())
    return out.getvalue()


def wav_samples(data: bytes) -> tuple[list[float], int]:
    """Samples of 16-bit sound, channels averaged, and the rate."""
    with wave.open(io.BytesIO(data)) as w:
        n, rate = w.getnchannels(), w.getframerate()
        raw = array("h", w.readframes(w.getnframes()))
    return [sum(raw[i : i + n]) / n / 32768 for i in range(0, len(raw), n)], rate


def duration_ms(frames: Column, rate: Column) -> Column:
    return F.floor(frames / rate * 1000)


def pick_cover(manifest: DataFrame) -> DataFrame:
    """The cover of each book's manifest (book_id, ordinal, item_id, href, media_type, is_meta_cover): a known id, the declared cover, an image named so, the first image."""
    image = F.col("media_type").startswith("image/")
    rank = F.when(F.col("item_id").isin("cover", "cover-image", "coverimage"), 1).when(F.col("is_meta_cover"), 2).when(image & F.lower("href").contains("cover"), 3).when(image, 4)
    ranked = manifest.withColumn("rank", rank).where("rank is not null")
    first = F.row_number().over(Window.partitionBy("book_id").orderBy("rank", "ordinal"))
    return ranked.withColumn("n", first).where("n = 1").drop("n")
