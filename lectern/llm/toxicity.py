"""Toxicity by noisy-channel deobfuscation and learned word evidence.

1. A character trigram model is counted over every text of the corpus
   (64 symbol classes, so at most 64**3 counts whatever the corpus size).
2. Tokens that leetspeak, spacing or repetition may have changed become a
   lattice: a symbol may stand for a letter or for itself, a letter of
   another script for the Latin one that it looks like, a run of a letter
   for one or two of it, a gap between single letters for a word end or for
   nothing, a mark at the end of a token for a letter or for punctuation.
   Viterbi decoding under the character model and the channel's costs
   restores the text; its words are scored. A state is the last two
   symbols and none is ever dropped, so the reading found is the best of
   the whole lattice, whatever the length of the token.
3. Evidence of words and of word beginnings is learned from labelled rows:
   a toxic document counts for the strongest evidence it holds, so words
   that merely keep such company get no credit, and occurrences with the
   same neighbours (copies) count once. A document is as toxic as its
   strongest word, however long it is.

A token without any letter is taken as a number or a mark and not decoded,
unless it is part of a run of single characters.

Labels are read only for training rows; a document's id, language and
source are never inputs of its score.

Defined results: a null or empty text scores PRIOR; repeated rows score
alike; labels of one document that disagree count as toxic; a null label
is no label; a document with a null id is not held out; without any toxic
training row every score is PRIOR; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import annotate, free_name, materialise, slices, texts

#: Labelled rows that the classifier is fitted on at most, the first by a hash of their id.
TRAIN_ROWS = 12_000
THRESHOLD = 0.7
#: Score of a document without any evidence.
PRIOR = 0.02
#: Strength and mean of the prior on a feature's toxicity.
PRIOR_WEIGHT, PRIOR_MEAN = 0.8, 0.1
#: Lengths of word beginnings that are features, besides the whole word.
STEMS = range(4, 9)
#: Features weaker than this are not evidence.
WEAK = 0.3
CACHE_ENTRIES = 400_000

#: Letters with classes of their own: class 0 is everything that is no letter, class 1 every other letter.
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿœšž"
SYMBOLS = 64
CLASS = {c: i + 2 for i, c in enumerate(LETTERS)}
#: What a symbol may stand for (fixed values).
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¥": "y", "*": "aeiou", "#": "h",
}
#: Channel costs in nats: a letter written as a symbol, a symbol meant as itself, a mark dropped between letters, a doubled or single reading of a run.
SWAP, ITSELF, DROP, RUN_TWO, RUN_ONE = 1.0, 6.0, 1.5, 0.7, 2.0
#: Costs of a gap between single letters that joins them, and of one that ends a word.
JOIN, SPLIT = 0.2, 3.0
#: Costs of a mark at either end of a token as punctuation, for marks that often are and for the others.
EDGE, EDGE_RARE = 0.5, 2.0
_OFTEN_AT_ENDS = "!(*#|"
#: Letters of other scripts and the Latin ones that they look like (fixed values).
LOOKS_LIKE = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u",
}

_RUN = re.compile(r"(.)\1\1")
_SPACED = re.compile(r"(?<!\S)(?:[^\s][ ]){2,}[^\s](?!\S)")
#: Marks around a token that are punctuation and nothing else.
_EDGES = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in STANDS_FOR) + "«»“”‘’…–—¿¡"


def letter_class(c: str) -> int:
    return CLASS.get(c, 1 if c.isalpha() else 0)


def _class_table() -> np.ndarray:
    return np.array([letter_class(chr(c)) for c in range(0x3000)] + [1], np.int64)


def character_counts(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Trigram counts over all texts, by symbol classes; what reaches the driver is at most SYMBOLS**3 rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _class_table()
        counts = np.zeros(SYMBOLS**3, np.int64)
        for batch in slices(batches):
            joined = "\n" + "\n".join(texts(batch)).lower() + "\n"
            codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
            classes = table[np.minimum(codes, len(table) - 1)]
            a, b, c = classes[:-2].copy(), classes[1:-1], classes[2:]
            a[b == 0] = 0
            used = (b != 0) | (c != 0)
            counts += np.bincount(((a * SYMBOLS + b) * SYMBOLS + c)[used], minlength=SYMBOLS**3)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["gram", "n"])

    rows = docs.select(docs[text_col].alias("text")).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(SYMBOLS**3)
    for r in rows:
        counts[r["gram"]] = r["n"]
    return counts


def character_costs(counts: np.ndarray, weight: float = 4.0) -> np.ndarray:
    """Negative log probabilities of a symbol after two others, smoothed by shorter contexts."""
    three = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    two, one = three.sum(0), three.sum((0, 1))
    p1 = (one + 0.5) / (one + 0.5).sum()
    p2 = (two + weight * p1) / (two.sum(1, keepdims=True) + weight)
    p3 = (three + weight * p2[None]) / (three.sum(2, keepdims=True) + weight)
    return -np.log(p3).astype(np.float32)


def lattice(token: str, spaced: bool = False) -> list[list[tuple[str, float]]]:
    """Readings of each position of a token, with their channel costs; a space is a word end."""
    out: list[list[tuple[str, float]]] = []
    at = 0
    while at < len(token):
        c = token[at]
        run = at + 1
        while run < len(token) and token[run] == c:
            run += 1
        if c == " " and spaced:
            out.append([("", JOIN), (" ", SPLIT)])
            run = at + 1
        elif c in LOOKS_LIKE:
            out.append([(c, 0.0), (LOOKS_LIKE[c], SWAP)])
            run = at + 1
        elif c.isalpha() and run - at >= 3:
            out.append([(c, 0.0), (c + c, RUN_TWO)])
        elif c.isalpha() and run - at == 2:
            out.append([(c + c, 0.0), (c, RUN_ONE)])
        elif c.isalpha():
            out.append([(c, 0.0)])
        elif c in STANDS_FOR:
            edge = not c.isdigit() and not spaced and (at == 0 or run == len(token))
            choices = [(r, SWAP) for r in STANDS_FOR[c]] + [(" ", ITSELF if not edge else EDGE if c in _OFTEN_AT_ENDS else EDGE_RARE)]
            if run - at > 1:
                choices += [(r + r, SWAP + RUN_TWO) for r in STANDS_FOR[c]]
            if not c.isdigit() and not edge:
                choices.append(("", DROP))
            out.append(choices)
        elif c.isdigit():
            out.append([(" ", 0.0)])
            run = at + 1
        else:
            out.append([("", DROP), (" ", 0.5)])
        at = run
    return out


def decode(steps: list[list[tuple[str, float]]], costs: np.ndarray) -> tuple[float, str]:
    """Cost and text of the best reading of a lattice under the character model; of equal ones the first choices win."""
    # of every pair of last symbols the cheapest way there, as (cost, choice, the state before); no state is dropped
    states: dict[tuple[int, int], tuple] = {(0, 0): (0.0, "", None)}
    for choices in steps:
        ahead: dict[tuple[int, int], tuple] = {}
        spelled = [(written, channel, [letter_class(c) for c in written]) for written, channel in choices]
        for (a, b), before in states.items():
            for written, channel, classes in spelled:
                total, x, y = before[0] + channel, a, b
                for z in classes:
                    if z or y:
                        total += costs.item(x, y, z)
                    x, y = (y, z) if z else (0, 0)
                if (x, y) not in ahead or total < ahead[x, y][0]:
                    ahead[x, y] = (total, written, before)
        states = ahead
    best, node = min(((node[0] + (costs.item(a, b, 0) if b else 0.0), node) for (a, b), node in states.items()), key=lambda s: s[0])
    parts: list[str] = []
    while node is not None:
        parts.append(node[1])
        node = node[2]
    return best, "".join(reversed(parts))


class Restorer:
    """Words that the tokens of a text stand for."""

    def __init__(self, costs: np.ndarray) -> None:
        self.costs = costs

    def words(self, token: str) -> list[str]:
        """Words of one lower-case token: its runs of letters as written, and those of its best reading."""
        core = token.strip(_EDGES)
        if core.isalpha():
            alike = not core.isascii() and not LOOKS_LIKE.keys().isdisjoint(core) and any(c in CLASS for c in core)
            return [core, *self._decoded(core)] if alike or _RUN.search(core) else [core]
        plain = _LETTERS.findall(core)
        if not plain:
            return plain
        if len(plain) > 2 and max(map(len, plain)) == 1 and len(core) >= 2 * len(plain) - 1:
            return [*plain, *self._decoded(" ".join(_SINGLE.findall(core)), True)]
        return [*plain, *self._decoded(core)]

    def _decoded(self, token: str, spaced: bool = False) -> list[str]:
        return decode(lattice(token, spaced), self.costs)[1].split()

    def spaced(self, text: str) -> list[str]:
        """Words of runs of single characters in a lower-case text, each run read as a whole."""
        return [w for m in _SPACED.finditer(text) for w in self._decoded(m.group(), True)]


_LETTERS, _SINGLE = re.compile(r"[^\W\d_]+"), re.compile(r"[^\W_]")


def features(word: str) -> list[str]:
    return [word[:k] for k in STEMS if k <= len(word)] + [word + "$"]


def _token_words(restorer: Restorer, cache: dict[str, list[str]], token: str) -> list[str]:
    words = cache.get(token)
    if words is None:
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        words = cache[token] = restorer.words(token)
    return words


def _evidence(text: str, restorer: Restorer, cache: dict[str, list[str]]) -> set[tuple[str, int]]:
    """(feature, hash of the occurrence's neighbours) of a text; a text gives a feature at most once."""
    low = text.lower()
    tokens = low.split()
    out: dict[str, int] = {}
    for i, token in enumerate(tokens):
        if token in tokens[i - 1 : i]:
            continue
        around = f"{tokens[i - 1] if i else ''} {token} {tokens[i + 1] if i + 1 < len(tokens) else ''}"
        mark = zlib.crc32(around.encode())
        for word in _token_words(restorer, cache, token):
            for f in features(word):
                out[f] = min(mark, out.get(f, mark))
    for word in restorer.spaced(low):
        out |= {f: zlib.crc32(low.encode()) for f in features(word)}
    return set(out.items())


def held_out(id_col: Column) -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _strength(credit: Column | float, clean: Column | float):
    return (credit + PRIOR_WEIGHT * PRIOR_MEAN) / (credit + clean + PRIOR_WEIGHT)


def learn(docs: DataFrame, labels: DataFrame, costs: np.ndarray, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict[str, float]:
    """Evidence strengths of features, fitted on at most `rows` labelled rows outside the held-out part.

    The sample bounds everything that is broadcast or collected here.
    """
    known = labels.select(labels[id_col].alias("doc_id"), labels[label_col].cast("int").alias("y")).where("doc_id is not null and y is not null")
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = materialise(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).join(F.broadcast(known), "doc_id").select("text", "y"))

    def toxic(strength: dict[str, float] | None):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            restorer, cache = Restorer(costs), {}
            for batch in slices(batches):
                held: set[tuple[str, int]] = set()
                for text in texts(batch):
                    own = _evidence(text, restorer, cache)
                    if strength is not None:
                        best = max((strength.get(f, 0.0) for f, _ in own), default=0.0)
                        own = {x for x in own if strength.get(x[0], 0.0) >= max(WEAK, 0.97 * best)}
                    held |= own
                if held:
                    names, marks = zip(*held)
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(marks, pa.int64())], names=["feature", "mark"])

        return run

    def credits(strength: dict[str, float] | None) -> DataFrame:
        return sample.where("y = 1").select("text").mapInArrow(toxic(strength), "feature string, mark long").groupBy("feature").agg(F.countDistinct("mark").alias("credit")).where("credit > 1")

    first = {r["feature"]: r["credit"] for r in credits(None).collect()}

    def clean(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, cache = Restorer(costs), {}
        counts: dict[str, int] = {}
        for batch in slices(batches):
            for text in texts(batch):
                words = {w for t in set(text.lower().split()) for w in _token_words(restorer, cache, t)}
                for f in {f for w in words for f in features(w)} & first.keys():
                    counts[f] = counts.get(f, 0) + 1
        if counts:
            yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array(list(counts.values()), pa.int64())], names=["feature", "n"])

    if not first:
        return {}
    rows_clean = sample.where("y = 0").select("text").mapInArrow(clean, "feature string, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect()
    clean_docs = {r["feature"]: r["n"] for r in rows_clean}
    strength = {f: s for f, n in first.items() if (s := _strength(n, clean_docs.get(f, 0))) >= WEAK}
    credit = {r["feature"]: r["credit"] for r in credits(strength).collect()}
    return {f: s for f, n in credit.items() if (s := _strength(n, clean_docs.get(f, 0))) >= WEAK}


class Scorer:
    def __init__(self, strength: dict[str, float], costs: np.ndarray) -> None:
        self.strength, self.restorer = strength, Restorer(costs)
        self.known: set[str] = set()
        self.hot: dict[str, float] = {}

    def word(self, word: str) -> float:
        get = self.strength.get
        return max(get(f, 0.0) for f in features(word))

    def score(self, text: str) -> float:
        low = text.lower()
        tokens = set(low.split())
        fresh = tokens - self.known
        if fresh:
            if len(self.known) > CACHE_ENTRIES:
                self.known.clear()
                self.hot.clear()
                fresh = tokens
            for token in fresh:
                p = max(map(self.word, self.restorer.words(token)), default=0.0)
                if p:
                    self.hot[token] = p
            self.known |= fresh
        found = [self.hot[t] for t in tokens & self.hot.keys()]
        found += map(self.word, self.restorer.spaced(low))
        return 1.0 - (1.0 - PRIOR) * (1.0 - max(found, default=0.0))


def score(docs: DataFrame, strength: dict[str, float], costs: np.ndarray, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every whole text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(strength, costs)
        for batch in slices(batches):
            found = [scorer.score(t) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], names=["doc_id", "score"])

    scored = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def toxicity(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Count the character model over all documents, learn from labelled rows, score every document."""
    costs = character_costs(character_counts(docs))
    return score(docs, learn(docs, labels, costs, train_rows), costs)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The rows of docs that score below the threshold, with their columns."""
    costs = character_costs(character_counts(docs))
    strength = learn(docs, labels, costs, train_rows)

    name = free_name(docs, "_toxicity")

    def make():
        scorer = Scorer(strength, costs)
        return lambda whole: [pa.array([scorer.score(t) for t in whole], pa.float64())]

    return annotate(docs, make, [T.StructField(name, T.DoubleType())]).where(F.col(name) < threshold).drop(name)
