"""Order-preserving packers of text: one fold per text inside the JVM, all rows in parallel.

The fold passes over a text's pieces with the size of the open chunk as its
state and gives each piece the number of its chunk; pieces of one chunk stand
together, so chunks are slices. A text costs its length once.

Defined results: a null text is empty; an empty text has no sentences, and one
empty paragraph where blank ones are kept; a repeated row is cut again; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions.constants import CAST_CHUNK_WORDS, CAST_OVERLAP_WORDS, MAX_CHUNK_CHARS, SCRIPT_CHUNK_WORDS
from lectern.functions.folds import fold_list, let, rows_of

_NONE = "array<string>"


def sentences(text: Column) -> Column:
    """Sentences: cut behind a full stop, question or exclamation mark and white space, without white space around."""
    parts = F.split(F.coalesce(text, F.lit("")), rf"(?<=[.!?]){X._BLANK}+", -1)
    return F.filter(F.transform(parts, X.stripped), lambda s: s != "")


def _slices(pieces: Column, chunk_of: Column) -> Column:
    """Per chunk its pieces; chunk_of has the chunk of each piece, in order."""
    at = F.filter(F.sequence(F.lit(0), F.size(pieces) - 1), lambda k: (k == 0) | (F.get(chunk_of, k) != F.get(chunk_of, k - 1)))
    one = lambda a, end: F.struct(F.get(chunk_of, a).alias("chunk"), F.slice(pieces, a + 1, end - a).alias("pieces"))
    found = let(at, lambda starts: F.zip_with(starts, F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(pieces))), one))
    return F.when(F.size(pieces) > 0, found)


def _packed_sentences(text: Column, limit: int) -> Column:
    """(chunk, pieces): words take the place of a sentence longer than a chunk."""
    words = lambda s: F.transform(F.split(s, " ", -1), lambda w, i: F.struct(w.alias("x"), F.when(i == 0, 1).otherwise(2).alias("kind")))
    return F.flatten(F.transform(sentences(text), lambda s: F.when(F.length(s) <= limit, F.array(F.struct(s.alias("x"), F.lit(0).alias("kind")))).otherwise(words(s))))


def sentence_rows(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, chunk_idx, chunk): the sentences of each text."""
    rows = rows_of(df, [key], sentences(F.col(text)), "chunk_idx", "chunk")
    return rows.select(key, F.col("chunk_idx").cast("long"), "chunk")


def sentence_chunks(df: DataFrame, key: str, text: str, max_chars: int = MAX_CHUNK_CHARS) -> DataFrame:
    """(key, chunk_idx, chunk): sentences packed while they fit; the last of a chunk need not pay for its space.

    A sentence longer than a chunk is packed by words, and its last words open the next chunk. Before a first word that is too
    long itself a number is left out. Blank chunks have no rows.
    """

    def step(s: Column, p: Column) -> tuple[Column, Column]:
        size = F.length(p["x"])
        ends = F.when(p["kind"] == 0, s["n"] + size > max_chars).when(p["kind"] == 1, F.lit(True)).otherwise(s["n"] + size + 1 > max_chars)
        chunk = s["chunk"] + (ends & s["held"]).cast("int") + ((p["kind"] == 1) & (size >= max_chars)).cast("int")
        return F.struct((size + 1 + F.when(ends, 0).otherwise(s["n"])).alias("n"), chunk.alias("chunk"), F.lit(True).alias("held")), chunk

    pieces = df.select(key, _packed_sentences(F.col(text), max_chars).alias("_p"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("chunk"), F.lit(False).alias("held"))
    numbered = pieces.select(key, F.col("_p.x").alias("_x"), fold_list(F.col("_p"), start, step, "int")["made"].alias("_of"))
    rows = rows_of(numbered, [key], _slices(F.col("_x"), F.col("_of")), "_k", "_c")
    return rows.select(key, F.col("_c.chunk").cast("long").alias("chunk_idx"), F.array_join("_c.pieces", " ").alias("chunk")).where("trim(chunk) <> ''")


def _paragraph_slices(df: DataFrame, key: str, text: str, max_words: int, separator: str, overlap: int, keep_blank: bool) -> DataFrame:
    """(key, _chunks): the paragraphs of each chunk; a chunk also pays for the words that it takes over."""
    parts = F.split(F.coalesce(F.col(text), F.lit("")), f"\\Q{separator}\\E", -1)
    parts = parts if keep_blank else F.filter(parts, lambda p: X.stripped(p) != "")
    sized = F.transform(parts, lambda p: F.struct(p.alias("x"), F.size(X.words(p)).alias("n")))

    def step(s: Column, p: Column) -> tuple[Column, Column]:
        full = s["held"] & (s["n"] + p["n"] > max_words)
        chunk = s["chunk"] + full.cast("int")
        return F.struct((p["n"] + F.when(full, F.least(s["n"], F.lit(overlap))).otherwise(s["n"])).alias("n"), chunk.alias("chunk"), F.lit(True).alias("held")), chunk

    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("chunk"), F.lit(False).alias("held"))
    pieces = df.select(key, sized.alias("_p"))
    numbered = pieces.select(key, F.col("_p.x").alias("_x"), fold_list(F.col("_p"), start, step, "int")["made"].alias("_of"))
    return numbered.select(key, F.transform(_slices(F.col("_x"), F.col("_of")), lambda c: c["pieces"]).alias("_chunks"))


def paragraph_chunks(df: DataFrame, key: str, text: str, max_words: int = SCRIPT_CHUNK_WORDS, separator: str = "\n\n") -> DataFrame:
    """(key, chunk_idx, chunk): paragraphs packed up to a number of words, none split."""
    rows = rows_of(_paragraph_slices(df, key, text, max_words, separator, 0, True), [key], F.col("_chunks"), "chunk_idx", "_c")
    return rows.select(key, F.col("chunk_idx").cast("long"), F.array_join("_c", separator).alias("chunk"))


def overlapping_chunks(df: DataFrame, key: str, text: str, max_words: int = CAST_CHUNK_WORDS, overlap: int = CAST_OVERLAP_WORDS, separator: str = "\n\n") -> DataFrame:
    """(key, chunk_idx, chunk): paragraphs that are not blank, packed alike; a chunk begins with the last words of the one before."""
    if not overlap:
        rows = rows_of(_paragraph_slices(df, key, text, max_words, separator, 0, False), [key], F.col("_chunks"), "chunk_idx", "_c")
        return rows.select(key, F.col("chunk_idx").cast("long"), F.array_join("_c", separator).alias("chunk"))

    def step(tail: Column, c: Column) -> tuple[Column, Column]:
        words = F.concat(tail, F.flatten(F.transform(c, X.words)))
        left = F.slice(words, F.greatest(F.lit(1), F.size(words) - (overlap - 1)), F.lit(overlap))
        opening = F.when(F.size(tail) > 0, F.array(F.array_join(tail, " "))).otherwise(F.array().cast(_NONE))
        return left, F.array_join(F.concat(opening, c), separator)

    chunks = _paragraph_slices(df, key, text, max_words, separator, overlap, False)
    joined = fold_list(F.coalesce("_chunks", F.array().cast(f"array<{_NONE}>")), F.array().cast(_NONE), step, "string")["made"]
    rows = rows_of(chunks, [key], joined, "chunk_idx", "chunk")
    return rows.select(key, F.col("chunk_idx").cast("long"), "chunk")
