"""Quality rules as weak supervision: rules vote or abstain, and their accuracies are estimated.

Every rule votes good, bad or abstains on a document, from counts over its
whole text; the bands of the rules overlap, so votes on one document often
disagree. Documents fail in different ways, so the latent state of a
document is "good" or one of a few kinds of bad, each kind first guessed
from the rules that look for it. Documents with equal votes are summed (with
R rules there are at most 3**R patterns), and expectation-maximisation over
the patterns estimates the share of every state and how often each rule
votes bad in each; the posterior probability of the good state replaces an
all-must-pass filter. Everything is built from DataFrame and SQL functions:
counts are array expressions inside a row, the estimation is one fold over
the array of patterns, and posteriors come back by a join on the pattern.

Defined results: a null or empty text has no words, fails the base rules
and is not kept; where every rule abstains the posterior is the estimated
share of good documents; repeated rows get equal results, and a posterior of
just one half is kept; a null id stays null; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import materialise

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
KEEP_AT = 0.5
ROUNDS = 25
SPACE = r"\x20\x09-\x0D"
SYMBOLS = "#*$%&|<>"
#: Characters that are no marks: letters, digits, white space and the common signs of a sentence.
PLAIN = r"[\p{L}\p{M}\p{N}\s.,;:'\"()?\u2019-]+"

GOOD, BAD, ABSTAIN = 1, 0, 2
#: Rules: (name, condition of a bad vote, condition of a good vote) over the counted columns; between the two a rule abstains.
RULES: tuple[tuple[str, str, str], ...] = (
    ("length", "n_words < 100", "n_words >= 200"),
    ("symbols", "10 * n_symbols > n_words", "100 * n_symbols <= n_words"),
    ("marks", "5 * n_marks > n_words", "50 * n_marks <= n_words"),
    ("repeats", "5 * n_repeat_words > n_words", "20 * n_repeat_words <= n_words"),
    ("lines", "10 * n_dup_lines > n_lines", "n_dup_lines = 0 and n_lines > 1"),
    ("capitals", "10 * n_capitals > 3 * word_chars", "10 * n_capitals <= word_chars"),
    ("variety", "4 * n_distinct < n_words", "2 * n_distinct >= n_words"),
    ("sentences", "50 * n_ends < n_words or 3 * n_ends > n_words", "30 * n_ends >= n_words and 6 * n_ends <= n_words"),
)
#: Kinds of bad documents, by the rules that look for them; they only start the estimation.
KINDS: tuple[tuple[str, ...], ...] = (
    ("symbols", "marks"),
    ("capitals", "marks", "sentences"),
    ("repeats", "lines", "variety"),
    ("length", "sentences"),
)
#: First guess of the share of good documents, and of how often a rule votes bad on a good document, on one of a kind it looks for, and on another bad one.
FIRST_GOOD, FALSE_ALARM, HIT, OTHER = 0.8, 0.05, 0.8, 0.1
#: Strength of the first guess in every estimate, in documents.
PRIOR_DOCS = 5.0


def repeated_words(words: Column) -> Column:
    """Words of an array that lie in a run of three words found twice or more in it."""

    def of(w: Column) -> Column:
        runs = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), lambda x, i: F.struct(F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))
        return F.element_at(F.transform(F.array(F.sort_array(runs)), starts), 1)

    def starts(runs: Column) -> Column:
        again = F.filter(
            runs,
            lambda r, j: (r["h"] == F.get(runs, j - 1)["h"]) | (r["h"] == F.get(runs, j + 1)["h"]),
        )
        return F.element_at(F.transform(F.array(F.sort_array(F.transform(again, lambda r: r["i"]))), covered), 1)

    def covered(at: Column) -> Column:
        steps = F.transform(at, lambda p, j: F.least(F.coalesce(F.get(at, j + 1) - p, F.lit(3)), F.lit(3)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

    return F.element_at(F.transform(F.array(words), of), 1)


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counted columns of every whole text."""
    source = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    text = F.col("text")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{SPACE}]"))

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct"))

    def of_lines(x: Column) -> Column:
        return F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))

    def left(pattern: str) -> Column:
        return F.length(F.regexp_replace(text, pattern, "")).cast("long")

    # a lambda over a one-element array computes the words and the lines once for all that is made of them
    words = F.array_remove(F.split(text, f"[{SPACE}]+", -1), "")
    return source.select(
        "doc_id",
        F.element_at(F.transform(F.array(words), of_words), 1).alias("w"),
        F.element_at(F.transform(F.array(lines), of_lines), 1).alias("l"),
        left(f"[^{SYMBOLS}]+").alias("n_symbols"),
        left(r"[^\p{Lu}]+").alias("n_capitals"),
        left(PLAIN).alias("n_marks"),
        left("[^.!?]+").alias("n_ends"),
    ).select("doc_id", "w.*", "l.*", "n_symbols", "n_capitals", "n_marks", "n_ends")


#: Counts that no column of the result repeats.
_ONLY_FOR_VOTES = ("n_capitals", "n_marks", "n_ends", "n_lines", "n_distinct")


def votes(rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """The votes of all rules as an array."""
    return F.array(*(F.when(F.expr(bad), BAD).when(F.expr(good), GOOD).otherwise(ABSTAIN) for _, bad, good in rules))


def posteriors(counted: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, kinds: tuple[tuple[str, ...], ...] = KINDS, rounds: int = ROUNDS) -> DataFrame:
    """(votes, n, posterior) of every pattern of votes: at most 3**len(rules) rows.

    Given a document's state, every rule that votes does so by itself; whether it abstains says nothing.
    """
    names = [name for name, _, _ in rules]
    first = [[FALSE_ALARM] * len(rules)] + [[HIT if n in kind else OTHER for n in names] for kind in kinds]
    shares = [FIRST_GOOD] + [(1 - FIRST_GOOD) / len(kinds)] * len(kinds)
    patterns = counted.groupBy(votes(rules).alias("votes")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    one = patterns.agg(F.collect_list(F.struct("votes", "n")).alias("patterns"))

    def array(values: list[float]) -> str:
        return f"array({', '.join(f'{x!r}D' for x in values)})"

    # the estimates are (log share, log chance of a bad vote per rule, log chance of a good one) of every state
    start = f"array({', '.join(f'struct({x!r}D AS share, {array(row)} AS bad)' for x, row in zip(shares, first))})"
    logs = "transform({0}, x -> struct(ln(x.share) AS share, transform(x.bad, b -> ln(b)) AS bad, transform(x.bad, b -> ln(1D - b)) AS good))"
    scores = f"transform(s, x -> x.share + aggregate(sequence(0, {len(rules) - 1}), 0D, (t, j) -> t + CASE p.votes[j] WHEN {BAD} THEN x.bad[j] WHEN {GOOD} THEN x.good[j] ELSE 0D END))"
    # the share of every state among the documents of a pattern; the largest score is taken off before exp
    weights = f"transform(array({scores}), l -> transform(l, y -> exp(y - array_max(l))))[0]"
    belongs = f"transform(array({weights}), w -> transform(w, y -> y / aggregate(w, 0D, (t, z) -> t + z)))[0]"
    held = "aggregate(g, 0D, (t, q) -> t + q.n * q.state[c])"
    voted = f"aggregate(g, 0D, (t, q) -> t + IF(q.votes[j] = {ABSTAIN}, 0D, q.n * q.state[c]))"
    bad = f"aggregate(g, 0D, (t, q) -> t + IF(q.votes[j] = {BAD}, q.n * q.state[c], 0D))"
    share = f"({held} + {PRIOR_DOCS}D * f.share) / (aggregate(g, 0D, (t, q) -> t + q.n) + {PRIOR_DOCS}D)"
    chance = f"transform(f.bad, (b, j) -> ({bad} + {PRIOR_DOCS}D * b) / ({voted} + {PRIOR_DOCS}D))"
    estimate = logs.format(f"transform(first, (f, c) -> struct({share} AS share, {chance} AS bad))")
    step = f"transform(array(transform(patterns, p -> struct(p.votes AS votes, p.n AS n, {belongs} AS state))), g -> {estimate})[0]"
    fitted = one.select("patterns", F.expr(start).alias("first"))
    fitted = fitted.select("patterns", F.expr(f"aggregate(sequence(1, {rounds}), {logs.format('first')}, (s, _i) -> {step})").alias("s"))
    return fitted.select(F.explode(F.expr(f"transform(patterns, p -> struct(p.votes AS votes, p.n AS n, ({belongs})[0] AS posterior))")).alias("x")).select("x.*")


def quality(docs: DataFrame, rules: tuple[tuple[str, str, str], ...] = RULES, kinds: tuple[tuple[str, ...], ...] = KINDS, keep_at: float = KEEP_AT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts, base_failed, posterior and kept of every document."""
    counted = materialise(counts(docs, id_col, text_col))
    # at most 3**len(rules) rows of a few bytes
    found = F.broadcast(posteriors(counted, rules, kinds).select("votes", "posterior"))
    base_failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (
        counted.withColumn("votes", votes(rules))
        .join(found, "votes", "left")
        .select(
            *(c for c in counted.columns if c not in _ONLY_FOR_VOTES),
            base_failed.alias("base_failed"),
            "posterior",
            (~base_failed & (F.col("posterior") >= keep_at)).alias("kept"),
        )
    )
