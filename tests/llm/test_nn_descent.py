"""NN-descent against all pairs: planted copies, chains, dense groups, loose groups, odd vectors."""

import numpy as np
import pytest

from lectern.llm import nn_descent

SCHEMA = "vec_id long, embedding array<float>, label int, ball long, unit string"


def plain(rows, cosine=0.9):
    """vec_id, n_links, component_id, kept of rows (vec_id, vector), by all pairs."""
    good = {k: np.array(v, float) / np.linalg.norm(v) for k, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and np.any(v)}
    links = [0] * len(rows)
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    by_size = {}
    for k, v in good.items():
        by_size.setdefault(len(v), []).append(k)
    for keys in by_size.values():
        x = np.array([good[k] for k in keys])
        for i, j in zip(*np.nonzero(np.triu(x @ x.T >= cosine, 1))):
            a, b = keys[i], keys[j]
            links[a] += 1
            links[b] += 1
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(((i, links[k], c, i == c) for k, (i, _) in enumerate(rows) for c in [least.get(find(k))]), key=str)


def found(spark, rows, note=None):
    extra = [(i, v, 1, 2, "u") for i, v in rows]
    out = nn_descent.near_vectors(spark.createDataFrame(extra, SCHEMA).repartition(4), note=note)
    return sorted((tuple(r) for r in out.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def planted(seed=3):
    """Noise, exact copies, a dense group, a loose one whose members partly link, pairs at 0.95, a chain."""
    r = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    near = lambda v, angle, n: np.cos(angle) * v + np.sin(angle) * unit((w := r.standard_normal((n, 48))) - (w @ v)[:, None] * v)
    noise = unit(r.standard_normal((700, 48)))
    dense = near(noise[0], 0.05, 400)
    loose = near(noise[1], 0.33, 120)
    middle = np.concatenate([near(noise[2], a, 40) for a in (0.05, 0.16, 0.3)])
    pairs = np.concatenate([near(v, 0.3, 1) for v in noise[3:60]])
    chain = [noise[60]]
    for _ in range(12):
        chain.append(near(chain[-1], 0.4, 1)[0])
    return np.concatenate([noise, np.repeat(noise[61:62], 250, axis=0), dense, loose, middle, pairs, np.array(chain[1:])])


def test_planted_links(spark):
    x = planted()
    order = np.random.default_rng(1).permutation(len(x))
    rows = [(int(i), x[i].astype(np.float32).tolist()) for i in order]
    recalls = []
    assert found(spark, rows, recalls.append) == plain(rows)
    assert min(recalls) >= nn_descent.RECALL


def test_table(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet")
    out = sorted((tuple(r) for r in nn_descent.near_vectors(vectors).select("vec_id", "n_links", "component_id", "kept").collect()), key=str)
    assert out == plain([(r.vec_id, r.embedding) for r in vectors.collect()])


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [3e38, 1e37]), (None, [0.0, 1.0]), (None, None), (9, [1.0, 0.0, 0.0]), (9, [-1.0, 0.0]), (0, [1e-38, 0.0]), (10, [-0.0, -5.0])]
    assert found(spark, rows) == plain(rows)
    assert found(spark, rows[:0]) == []


def test_radii_decide_whole_balls():
    """Vectors of merged balls stay within the radius, which is small enough for any two to link."""
    x = planted()[-800:]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    into, centre, radius = nn_descent.merged(x, np.zeros(len(x)), 0.11)
    assert len(set(into.tolist())) < 500 and radius.max() <= 0.11
    assert all(np.arccos(min(1.0, x[k] @ centre[into[k]])) <= radius[into[k]] + 1e-9 for k in range(len(x)) if radius[into[k]])


@pytest.mark.parametrize("size", [2, 64, 300])
def test_blocks_cut_rows_in_order(size):
    import pyarrow as pa

    batches = [pa.RecordBatch.from_arrays([pa.array(k), pa.array(v)], names=["k", "v"]) for k, v in (([1] * 5 + [2], [*range(6)]), ([2] * 400, [*range(6, 406)]), ([], []), ([3], [406]))]
    cut = [t.to_pydict() for t in nn_descent._blocks(batches, size, ["k"])]
    assert [x for t in cut for x in t["v"]] == [*range(407)]
    assert all(len(t["v"]) <= size and len(set(t["k"])) == 1 for t in cut)
