"""The divergence audit against plain counting over whole texts."""

import collections
import random
import re

import numpy as np
import pytest

from lectern.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, bucket int, terms int"


def terms_of(text):
    return TERM.findall((text or "").translate(UPPER))


def plain(rows, min_docs=30, top=50):
    """(lang, source, part, item, value, rank) of rows (text, lang, source)."""
    rows = [(t or "", a or "", s or "") for t, a, s in rows]
    docs, counts = collections.Counter(), collections.Counter()
    for text, lang, source in rows:
        words = terms_of(text)
        docs.update((lang, w) for w in set(words))
        counts.update((lang, source, w) for w in words)
    out = []
    for lang in {a for _, a, _ in rows}:
        kept = sorted(w for (a, w), n in docs.items() if a == lang and n >= min_docs)
        sources = sorted({s for _, a, s in rows if a == lang}, key=str.encode)
        n = {s: [counts[lang, s, w] for w in kept] for s in sources}
        whole = [sum(c) for c in zip(*n.values())]
        shares = lambda c: [1 + 10**9 * (x + 5) // (sum(c) + 5 * len(kept)) for x in c]
        p, q = {s: shares(c) for s, c in n.items()}, shares(whole)
        for s in sources:
            far = sorted((-sum(abs(x - y) for x, y in zip(p[s], p[t])), t.encode(), t) for t in sources if t != s)
            out += [(lang, s, "pair", t, -v, k) for k, (v, _, t) in enumerate(far, 1)]
            own = sorted((y - x, w.encode(), w) for x, y, c, w in zip(p[s], q, n[s], kept) if c and x > y)[:top]
            out += [(lang, s, "term", w, -v, k) for k, (v, _, w) in enumerate(own, 1)]
    return sorted(out)


def found(df, **how):
    return sorted(tuple(r) for r in divergence.divergence(df, **how).select("lang", "source", "part", "item", "value", "rank").collect())


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert found(docs) == plain([(r.text, r.lang, r.source) for r in docs.collect()])


def odd_rows():
    r = random.Random(4)
    words = ["Alpha", "beta", "ÉTÉ", "é", "naïve", "字", "x1y", "😀", "a-b", "Ω"] + [f"w{chr(97 + k)}" for k in range(20)]
    rows = [(" ".join(r.choice(words) for _ in range(r.randint(0, 30))), r.choice(["en", "fr", "", None]), r.choice(["web", "books", "Web", None, "é"])) for _ in range(300)]
    rows += [(None, "xx", "a"), ("", "xx", "b"), ("lonely", "yy", "a"), ("Alpha " * 200_000, "en", "web")] + [("same same text", "en", "copies")] * 40
    return rows


@pytest.mark.parametrize("pairs", [divergence._PAIRS, 3])
def test_odd_rows(spark, monkeypatch, pairs):
    """Nulls, empty and very long texts, repeated rows, ties, clashing columns; a language whose sources are dealt out."""
    monkeypatch.setattr(divergence, "_PAIRS", pairs)
    rows = odd_rows()
    docs = spark.createDataFrame([(k % 50, *row, "t", 1, 1, 1) for k, row in enumerate(rows)], SCHEMA).repartition(5)
    assert found(docs) == plain(rows)
    assert found(docs, min_docs=5, top=3) == plain(rows, 5, 3)
    assert found(docs.where("doc_id > 99")) == []


def test_terms_in_bytes():
    texts = [t for t, _, _ in odd_rows() if t]
    number, terms, n, seen = divergence.counted([t.encode() for t in texts], np.zeros(len(texts), np.int64))
    expected = collections.Counter(w for t in texts for w in terms_of(t))
    assert dict(zip((t.decode() for t in terms), n.tolist())) == expected and not number.any()
    assert sum(seen) == sum(len(set(terms_of(t))) for t in texts)


def test_equal_hashes_are_told_apart():
    buffer = b"ab cd ab ef cd abc"
    starts, ends = divergence.boundaries(buffer)
    term, terms = divergence.grouped(buffer, starts, ends, hashed=lambda x: 7)
    assert [terms[k] for k in term.tolist()] == buffer.split()


def test_counts_beyond_64_bits():
    big = np.array([10**12, 4], np.int64)
    below = np.array([10**13, 10**13], np.int64)
    assert divergence.shares_of(big, below).tolist() == [1 + 10**9 * (c + 5) // 10**13 for c in big.tolist()]
