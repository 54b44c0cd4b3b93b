"""Near-duplicates by similarity, against brute force over all pairs."""

import random

import numpy as np
import pytest

import corpus_pipeline
from lectern.llm import similar


def plain_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def plain_groups(rows):
    sets, root = {i: plain_set(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    links = set()
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both, every = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if 5 * both >= 4 * every:
                links.add((i, j))
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}, links


def made_texts():
    """Dense groups, pairs on both sides of 0.8, short and empty texts."""
    r = random.Random(8)
    words = [f"w{k}" for k in range(3000)]
    rows = []
    for group in range(40):
        base = [r.choice(words) for _ in range(r.randint(30, 300))]
        for _ in range(8):
            own = list(base)
            for _ in range(r.randint(0, len(own) // 60 + 1)):
                own[r.randrange(len(own))] = r.choice(words)
            rows.append(" ".join(own))
    rows += [" ".join(r.choice(words) for _ in range(n)) for n in range(1, 9) for _ in range(30)]
    rows += ["", None, "  ", "same few words", "Same few WORDS"]
    r.shuffle(rows)
    return list(enumerate(rows))


def test_stage_equals_brute_force(spark):
    rows = made_texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    expected, _ = plain_groups(rows)
    kept = sorted(r.doc_id for r in corpus_pipeline.simhash_stage(spark, docs, "").collect())
    assert kept == sorted(set(expected.values()))


def test_recall_of_candidates():
    """Share of the links of brute force that share a cell and pass the bounds: all but one in a thousand."""
    rows = made_texts()
    _, links = plain_groups(rows)
    found = similar.minima([similar.shingle_set((t or "").encode()) for _, t in rows])
    prints, codes = similar._opened(similar.sketches(found))
    assert (prints == similar.fingerprints(found)).all()
    for points in (100, 10**7, 10**10):
        cells = similar.grid(prints, similar.grid_masks(points))
        a, b = np.array(sorted(links)).T
        met = (cells[a] == cells[b]).any(axis=1) & similar.candidates((prints[a], codes[a]), (prints[b], codes[b]))
        assert len(met) > 500 and np.mean(met) >= 0.999


def test_fingerprints_are_simhashes_of_samples():
    found = similar.minima([similar.shingle_set(b" ".join(b"w%d" % (k * j) for k in range(60))) for j in range(1, 6)])
    x = found ^ (found >> np.uint64(32))
    x = (x * similar._MIX) ^ ((x * similar._MIX) >> np.uint64(29))
    x = x * similar._MIX
    for row, prints in zip(x, similar.fingerprints(found)):
        for k, got in enumerate(prints.tolist()):
            sample = row[k * similar.SAMPLE : (k + 1) * similar.SAMPLE].tolist()
            assert got == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in sample) > similar.SAMPLE)


@pytest.mark.parametrize("shape", ["dense", "open"])
@pytest.mark.parametrize("block", [10**6, 12])
def test_families_of_near_and_not_so_near_copies(spark, monkeypatch, shape, block):
    """A family of copies, all near or mostly too far from one another, whole and cut into blocks; every link counts."""
    monkeypatch.setattr(similar, "CELL_BLOCK", block)
    monkeypatch.setattr(similar, "FAMILY_BLOCK", block)
    r = random.Random(3)
    words = [f"w{k}" for k in range(500)]
    base = [r.choice(words) for _ in range(200)]
    rows = []
    for _ in range(120):
        own = list(base)
        for at in r.sample(range(200), r.randint(0, 2 if shape == "dense" else 8)):
            own[at] = r.choice(words)
        rows.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)
    expected, _ = plain_groups(list(enumerate(rows)))
    assert {x.doc_id: x.component_id for x in similar.near_duplicates(docs).collect()} == expected


def test_null_and_repeated_ids(spark):
    """Ids name nothing: groups follow the texts, and no text is lost with an id that it shares."""
    one = " ".join(f"a{k}" for k in range(100))
    near = one + " end"
    rows = [(1, one), (None, near), (None, "an unrelated text of some words here"), (None, one), (2, "first text under two " + one[:20]), (2, "second, quite different, text under the id two"), (2, "second, quite different, text under the id two"), (None, None), (7, ""), (None, "alone without an id at all")]
    docs = spark.createDataFrame([(i, t, "a", "b", 1) for i, t in rows], "doc_id long, text string, _key string, _NODE string, key int").repartition(3)
    found = sorted((repr(x.doc_id), repr(x.component_id)) for x in similar.near_duplicates(docs).collect())
    assert found == sorted([("1", "1"), ("None", "1"), ("None", "None"), ("None", "1"), ("2", "2"), ("2", "2"), ("2", "2"), ("None", "7"), ("7", "7"), ("None", "None")])
    kept = similar.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((repr(x.doc_id), x.text) for x in kept.collect()) == sorted([("1", one), ("None", rows[2][1]), ("2", rows[4][1]), ("2", rows[5][1]), ("7", ""), ("None", rows[9][1])])
