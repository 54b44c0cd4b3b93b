"""The Merkle manifest against a plain recursion over whole lists."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from lectern.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos long, digest string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(r, more=0):
    values = (r.doc_id, r.source, r.lang, None if r.n_chars is None else r.n_chars + more, r.text)
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + 2]) for k in range(0, len(out[-1]), 2)])
    return out


def plain_path(levels, k):
    """(side, digest) of the sibling per level; None where there is none."""
    path = []
    for row in levels[:-1]:
        other = k ^ 1
        path.append(("L" if other < k else "R", row[other]) if other < len(row) else None)
        k //= 2
    return path


def plain_manifest(rows):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r.lang, []).append(r)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for name in langs:
        held = sorted(by_lang[name], key=lambda r: (r.doc_id is not None, r.doc_id or 0, plain_leaf(r)))
        trees[name] = held, plain_levels([plain_leaf(r) for r in held])
    top = plain_levels([trees[name][1][-1][0] for name in langs])
    out = []
    for spot, name in enumerate(langs):
        held, levels = trees[name]
        for k, r in enumerate(held):
            path = plain_path(levels, k) + plain_path(top, spot)
            hit = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 0
            node = plain_leaf(r, int(hit))
            for step in path:
                node = h(node) if step is None else h(step[1], node) if step[0] == "L" else h(node, step[1])
            out.append((r.doc_id, plain_leaf(r), levels[-1][0], top[-1][0], h(*(s[1] for s in path if s)), node, node == top[-1][0]))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = merkle.merkle_manifest(docs)
    assert found(out) == plain_manifest(docs.collect())
    assert {r.verified for r in out.collect()} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 3, 256, 257, 600])
def test_sizes_around_a_block(spark, n):
    """Trees of one node, of a block, and of more than one band; a language with a single leaf beside them."""
    rows = [(k, f"text {k}", "en", None, k) for k in range(n)] + [(10**6, "alone", "zz", "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert found(merkle.merkle_manifest(docs)) == plain_manifest(docs.collect())


def test_odd_rows(spark):
    """Nulls, empty texts, repeated rows and ids, a null language, a very long text, extra columns with clashing names."""
    extra = ("t", 1, "d")
    rows = [(None, "no id", "en", "s", 1), (3, None, "en", None, None), (3, "", "en", "", 0), (3, "", "en", "", 0), (14, "é" * 300_000, None, "s", 300_000), (21, "x", "", "s", 1), (4, "a", "fr", "s", 1), (4, "b", "fr", "s", 1)]
    docs = spark.createDataFrame([(*r, *extra) for r in rows], SCHEMA).repartition(3)
    assert found(merkle.merkle_manifest(docs)) == plain_manifest(docs.collect())
    assert merkle.merkle_manifest(docs.where("doc_id > 99")).collect() == []


def test_proofs_stand_alone(spark):
    """A leaf and its proof give the root without the store; a leaf with another text does not."""
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(5).cast("long").alias("n_chars"))
    for r in merkle.merkle_manifest(docs).collect():
        assert merkle.folded(r.leaf, r.proof_shape, r.proof) == r.root
        assert merkle.folded(h("other"), r.proof_shape, r.proof) != r.root
