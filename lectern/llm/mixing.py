"""Mixing of sources to target weights by soft domain membership.

1. A multinomial classifier is learned from a labelled table (bounded
   sample of labelled rows) and gives every document posterior
   probabilities over the domains; no label is needed for the rest.
2. Every document gets a nonnegative rate, the expected number of times it
   is used. The rates solve a least-squares problem: expected tokens per
   domain, summed over rate * tokens * posterior, shall equal the targets.

The search is projected gradient over the rates. Its variables are
rate * sqrt(tokens), so that the length of a document cancels from its step
and documents of equal posteriors get equal rates, however long they are;
the misses are weighted by the inverse of the domain-by-domain Gram matrix
at the start, under which a step of length one never overshoots. Every
iterate is projected: a rate below its bound is set to the bound. Steps are
taken from a point that runs a little ahead of the iterates (momentum), and
from the iterate itself again where that did not lower the miss. One step is
one distributed sum of twice as many numbers as there are domains. A worker
rebuilds a document's rate by running through the steps so far, which are a
few numbers each; nothing of the size of the corpus is kept or sent.

Targets are weights per domain; the total is the number of tokens at rate
one. What the rates cannot meet (a domain in which hardly any document has a
posterior) stays as a miss, which is returned with the rows.

Defined results: a null or empty text has no tokens; it gets the rate of its
posterior like any other, which changes no total; repeated rows are rated
alike; labels of one document that disagree take the largest domain; without
labelled rows all posteriors are equal; a null id stays null; extra columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import annotate, free_name, materialise, slices, texts

#: Labelled rows that the classifier is fitted on at most, the first by a hash of their id.
TRAIN_ROWS = 12_000
#: Steps of the rate search at most, and the relative miss at which it ends.
STEPS, TOLERANCE = 200, 1e-4
#: The search also ends where so many steps lower the weighted miss by less than this share.
STALL, STALL_STEPS = 1e-3, 10
#: Where no domain may shrink, the total is this much more than the least possible one, so that even the domain with the least room has some.
GROWTH = 1.02
#: Least posterior of any domain: the classifier is never sure.
FLOOR = 1e-3
#: Features count if so many labelled rows have them and their evidence for the domains differs by so much; a document's evidence is cut to a span.
LEAST_ROWS, LEAST_SPREAD, SPAN = 6, 1.5, 9.0
CACHE_ENTRIES = 300_000


_MARKS = ".,;:!?\"'()[]"


def token_features(token: str) -> tuple[str, ...]:
    """A word's beginning or the whole of a short one, and its shape."""
    core = token.strip(_MARKS).lower()
    word = f"w:{core}" if len(core) < 5 else f"p:{core[:5]}"
    if token.isalpha() and not token.isupper():
        return (word,)
    shape = "U" * (token.isupper() and len(token) > 1) + "D" * any(map(str.isdigit, token)) + "S" * any(c in "#*$%&|<>" for c in token) + "!" * token.endswith("!!")
    return (word, f"s:{shape}") if shape else (word,)


def text_features(text: str) -> set[str]:
    return {f for token in set(text.split()) for f in token_features(token)}


class DomainModel:
    """Class evidence of the features that tell domains apart, by the share of labelled rows that have them."""

    def __init__(self, counts: dict[str, list[float]], rows: list[float]) -> None:
        n = np.array(rows, float)
        self.prior = np.log((n + 1.0) / (n + 1.0).sum())
        self.weights: dict[str, np.ndarray] = {}
        overall = n.sum()
        for f, c in counts.items():
            c = np.array(c, float)
            # shares shrink towards the feature's overall share
            share = (c + 2.0 * c.sum() / overall) / (n + 2.0)
            w = np.log(share)
            w -= w.mean()
            if c.sum() >= LEAST_ROWS and w.max() - w.min() >= LEAST_SPREAD:
                self.weights[f] = w

    def posterior(self, evidence: np.ndarray) -> np.ndarray:
        """Posteriors of rows of summed evidence."""
        evidence = evidence - evidence.mean(1, keepdims=True)
        widest = evidence.max(1, keepdims=True) - evidence.min(1, keepdims=True)
        evidence = evidence * np.minimum(1.0, SPAN / np.maximum(widest, SPAN))
        logits = self.prior + evidence
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        return FLOOR + (1 - FLOOR * p.shape[1]) * p


def learn_domains(docs: DataFrame, labels: DataFrame, domain: Column, n_domains: int, rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DomainModel:
    """Fit on at most `rows` labelled rows; domain is an integer column over labels, 0 to n_domains - 1, null where unlabelled."""
    known = labels.select(labels[id_col].alias("doc_id"), domain.cast("int").alias("domain")).where("doc_id is not null and domain is not null")
    known = known.groupBy("doc_id").agg(F.max("domain").alias("domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).join(F.broadcast(known), "doc_id").select("text", "domain")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[Counter] = [Counter() for _ in range(n_domains)]
        for batch in slices(batches):
            for text, k in zip(texts(batch), batch.column("domain").to_pylist()):
                counts[k].update(text_features(text))
                counts[k][""] += 1
        keep = [(f, k, n) for k, own in enumerate(counts) for f, n in own.items()]
        if keep:
            names, kinds, values = zip(*keep)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(kinds, pa.int32()), pa.array(values, pa.int64())], names=["feature", "domain", "n"])

    summed = sample.mapInArrow(run, "feature string, domain int, n long").groupBy("feature").agg(*(F.sum(F.when(F.col("domain") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(n_domains)), F.sum("n").alias("n"))
    # the sample bounds what is collected
    counts = {r["feature"]: [r[f"n{k}"] for k in range(n_domains)] for r in summed.where((F.col("n") >= LEAST_ROWS) | (F.col("feature") == "")).collect()}
    return DomainModel(counts, counts.pop("", [0] * n_domains))


#: Makes, once per task, a function from texts to their numbers of tokens; none counts words between white space.
TokenCounter = Callable[[], Callable[[list[str]], list[int]]]


def vocabulary_counter(vocabulary: str, pattern: str) -> TokenCounter:
    """Tokens under a byte-level vocabulary file. It costs about as much as `token_counts`, on top of the classifier."""
    from lectern.llm.token_counts import RankMerger

    return lambda: RankMerger(vocabulary, pattern).count


def membership_function(model: DomainModel, counter: TokenCounter | None = None):
    """A function from texts to their numbers of tokens and their posteriors."""
    count = counter() if counter else None
    number = {f: i for i, f in enumerate(model.weights)}
    table = np.array(list(model.weights.values())).reshape(-1, len(model.prior))
    short, begins = ({f[2:]: i for f, i in number.items() if f[:2] == kind} for kind in ("w:", "p:"))
    known: set[str] = set()
    telling: dict[str, tuple[int, ...]] = {}

    def numbers(token: str) -> tuple[int, ...]:
        """Numbers of a token's features; a plain word has one, which needs no general look."""
        core = token[:-1] if token[-1] in ".,;:" else token
        if core.isalpha() and not core.isupper():
            low = core.lower()
            i = short.get(low) if len(low) < 5 else begins.get(low[:5])
            return () if i is None else (i,)
        return tuple(number[f] for f in token_features(token) if f in number)

    def of(whole: list[str]) -> list[pa.Array]:
        split = [t.split() for t in whole]
        if len(known) > CACHE_ENTRIES:
            known.clear()
            telling.clear()
        for token in set().union(*split) - known:
            if found := numbers(token):
                telling[token] = found
            known.add(token)
        evidence = np.zeros((len(whole), table.shape[1]))
        for i, tokens in enumerate(split):
            if found := sorted({k for t in set(tokens) & telling.keys() for k in telling[t]}):
                evidence[i] = table[found].sum(0)
        return [pa.array(count(whole) if count else list(map(len, split)), pa.int64()), pa.array(list(model.posterior(evidence)), pa.list_(pa.float64()))]

    return of


_MEMBERSHIP = [T.StructField("n_tokens", T.LongType()), T.StructField("posterior", T.ArrayType(T.DoubleType()))]


def memberships(docs: DataFrame, model: DomainModel, id_col: str = "doc_id", text_col: str = "text", counter: TokenCounter | None = None) -> DataFrame:
    """doc_id, n_tokens, posterior array<double> of every whole text; tokens are what the counter counts, words by default."""
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return annotate(source, lambda: membership_function(model, counter), _MEMBERSHIP).drop("text")


Step = tuple[np.ndarray, float]


def rates(posterior: np.ndarray, steps: list[Step], least: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Rates of rows of posteriors after the steps, and the point ahead of them: each step's gradient is taken off, and the rate projected to its bound."""
    rate = ahead = np.ones(len(posterior))
    for gradient, momentum in steps:
        moved = np.maximum(least, ahead - posterior @ gradient)
        ahead = moved + momentum * (moved - rate)
        rate = moved
    return rate, ahead


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


class Fit:
    """The steps of a rate search, its bound, and the share of all target tokens by which domain totals missed at each step."""

    def __init__(self, least: float) -> None:
        self.steps: list[Step] = []
        self.least = least
        self.misses: list[float] = []

    def rates(self, posterior: np.ndarray) -> np.ndarray:
        return rates(posterior, self.steps, self.least)[0]

    @property
    def miss(self) -> float:
        return self.misses[-1] if self.misses else 0.0


def _summed(rows: DataFrame, width: int, sums: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of what a function makes of a batch's tokens and posteriors; a task sends one row of `width` numbers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for batch in batches:
            if batch.num_rows:
                total += sums(batch.column("n_tokens").to_numpy().astype(float), _matrix(batch, "posterior"))
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in total], names=[f"s{i}" for i in range(width)])

    parts = rows.select("n_tokens", "posterior").mapInArrow(run, ", ".join(f"s{i} double" for i in range(width)))
    row = parts.agg(*(F.sum(f"s{i}").alias(f"s{i}") for i in range(width))).first()
    return np.array([x or 0.0 for x in row])


def solve_rates(rows: DataFrame, weights: list[float], least: float = 0.0, grow: bool = False, steps: int = STEPS, tolerance: float = TOLERANCE) -> Fit:
    """Projected-gradient rates of rows (n_tokens, posterior) whose expected domain tokens are nearest to the targets, from rates of one.

    With grow the total is GROWTH times the least at which no domain has to shrink.
    """
    k, fit = len(weights), Fit(least)
    held = _summed(rows, k + k * k, lambda n, p: np.concatenate((n @ p, ((p * n[:, None]).T @ p).reshape(-1))))
    held, gram = held[:k], held[k:].reshape(k, k)
    total = float(held.sum())
    if not total:
        return fit
    share = np.array(weights, float) / sum(weights)
    if grow:
        total = GROWTH * max(h / s for h, s in zip(held, share) if s)
    target = total * share
    # the weights of the misses; the ridge only matters for domains without documents
    inverse = np.linalg.inv(gram + 1e-9 * np.trace(gram) * np.eye(k))
    def totals(n: np.ndarray, p: np.ndarray) -> np.ndarray:
        rate, ahead = rates(p, fit.steps, least)
        return np.concatenate(((n * rate) @ p, (n * ahead) @ p))

    now = ahead = held
    values, pace = [], 1.0
    while True:
        miss = now - target
        values.append(float(miss @ inverse @ miss))
        fit.misses.append(float(np.abs(miss).sum() / total))
        stalled = len(values) > STALL_STEPS and values[-1] > (1 - STALL) * values[-1 - STALL_STEPS]
        if fit.miss <= tolerance or stalled or len(fit.steps) == steps:
            return fit
        if len(values) > 1 and values[-1] > values[-2]:
            # start anew from the iterate
            fit.steps[-1], ahead, pace = (fit.steps[-1][0], 0.0), now, 1.0
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        fit.steps.append((inverse @ (ahead - target), (pace - 1) / faster))
        pace = faster
        now, ahead = np.split(_summed(rows, 2 * k, totals), 2)


def mix(docs: DataFrame, labels: DataFrame, domain: Column, weights: list[float], train_rows: int = TRAIN_ROWS, counter: TokenCounter | None = None) -> DataFrame:
    """doc_id, n_tokens, posterior, rate of every document, and miss, the share of tokens by which the whole mixture misses its targets."""
    model = learn_domains(docs, labels, domain, len(weights), train_rows)
    rows = materialise(memberships(docs, model, counter=counter))
    fit = solve_rates(rows, weights)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fit.rates(_matrix(batch, "posterior")))], names=[*batch.schema.names, "rate"])

    rated = rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("rate", T.DoubleType())]))
    return rated.withColumn("miss", F.lit(fit.miss))


def mixed_rows(docs: DataFrame, labels: DataFrame, domain: Column, weights: list[float], train_rows: int = TRAIN_ROWS, counter: TokenCounter | None = None) -> DataFrame:
    """The rows of docs, each as often as its rate says: all whole uses, and one more by a hash of id and text with the rest as probability.

    Rates are at least one, so no document is lost: domains below their weight are repeated.
    """
    model = learn_domains(docs, labels, domain, len(weights), train_rows)
    fit = solve_rates(materialise(memberships(docs, model, counter=counter)), weights, least=1.0, grow=True)
    name, use = free_name(docs, "_rate"), free_name(docs, "_use")

    def make():
        member = membership_function(model)
        return lambda whole: [pa.array(fit.rates(member(whole)[1].flatten().to_numpy(zero_copy_only=False).reshape(len(whole), -1)), pa.float64())]

    rated = annotate(docs, make, [T.StructField(name, T.DoubleType())])
    chance = F.xxhash64(F.lit("uses"), F.col("doc_id"), F.col("text")).bitwiseAND(F.lit((1 << 30) - 1)) / F.lit(float(1 << 30))
    uses = F.floor(F.col(name) + chance).cast("int")
    return rated.select(*docs.columns, F.explode(F.sequence(F.lit(1), uses)).alias(use)).drop(use)


def label_domain() -> Column:
    """Domains of the labels table: 0 sound, 1 poor quality, 2 toxic."""
    return F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 0)


#: Target weights of the registered query: sound, poor, toxic.
TARGETS = [0.90, 0.08, 0.02]
