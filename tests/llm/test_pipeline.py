"""The corpus pipeline stage by stage, each held against its own input."""

import hashlib
import sys
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import public_tokenizers
import pytest

import corpus_pipeline
from lectern.llm import secret_scan, toxicity
from lectern.llm.common import checkpoint_dir, materialise

sys.path.insert(0, str(Path(__file__).parent))
from test_similar import plain_groups  # noqa: E402


@pytest.fixture(scope="module")
def steps(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, sf))
        out.append(docs)
    return out


def test_stages(spark, sf, steps):
    import sentencepiece

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "secrets", "mixing", "encoding"]
    for before, after in zip(steps, steps[1:-1]):
        assert after.columns == before.columns and after.dtypes == before.dtypes
    rows = [[tuple(r) for r in s.select("doc_id", "text").collect()] for s in steps[:-1]]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    flagged = {r.doc_id for r in toxicity.toxicity(steps[0], labels).where("predicted = 1").collect()}
    assert flagged and sorted(rows[1]) == sorted(r for r in rows[0] if r[0] not in flagged)
    # near-duplicates by brute force over all pairs: 5-word shingles, similarity of 0.8 or more
    firsts = set(plain_groups(rows[1])[0].values())
    assert sorted(rows[2]) == sorted(r for r in rows[1] if r[0] in firsts) and len(rows[2]) < len(rows[1])
    assert sorted(rows[3]) == sorted((i, secret_scan.redacted(t, secret_scan.scan(t)[1])) for i, t in rows[2])
    assert set(rows[4]) == set(rows[3]) and len(rows[4]) >= len(rows[3])
    assert all(r.n_chars == len(r.text) for r in steps[3].collect())
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    expected = sorted((i, hashlib.sha256(" ".join(map(str, lib.encode(t, add_eos=True))).encode()).hexdigest()) for i, t in rows[4])
    assert sorted((r.doc_id, r.ids_sha256) for r in steps[5].collect()) == expected


def test_no_table_is_left_but_the_last(spark, sf):
    """Only the last stage's input is left of the run, and what another query wrote meanwhile is still there."""
    import os

    other = materialise(spark.range(5).toDF("id"))
    folder = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    stages, beside = list(corpus_pipeline.STAGES), []

    def meanwhile(spark, docs, sf_dir, stage=stages[1][1]):
        with ThreadPoolExecutor() as pool:
            beside.append(pool.submit(lambda: materialise(spark.range(7).toDF("id"))).result())
        return stage(spark, docs, sf_dir)

    corpus_pipeline.STAGES[1] = ("simhash", meanwhile)
    try:
        out = corpus_pipeline.run(spark, sf)
    finally:
        corpus_pipeline.STAGES[:] = stages
    assert len(set(os.listdir(folder)) - before) == 2 and out.count() > 100
    assert other.count() == 5 and beside[0].count() == 7


def test_odd_documents(spark, sf):
    import os
    import tempfile

    with tempfile.TemporaryDirectory() as d:
        rows = [(1, "some words here", "en", "s", 15, "x"), (2, None, None, None, None, None), (3, "", "xx", "s", 0, "y"), (4, "some words here", "fr", "s", 15, "x"), (1, "some words here", "en", "s", 15, "x")]
        schema = "doc_id long, text string, lang string, source string, n_chars long, _fp string"
        docs = spark.createDataFrame([(*r, "a", "b", "c", "d", "e", "f") for r in rows], schema + ", _node string, _toxicity string, _n_tokens string, _posterior string, _masked string, _use string")
        docs.write.parquet(f"{d}/documents.parquet")
        os.symlink(f"{sf}/labels.parquet", f"{d}/labels.parquet")
        assert {r.doc_id for r in corpus_pipeline.run(spark, d).collect()} == {1, 2}
