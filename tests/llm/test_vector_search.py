import numpy as np
import pytest

from sketchmill.llm import vector_search


def brute(vectors, k=10):
    ok = [(i, np.array(v, np.float64)) for i, v in vectors if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    out = []
    for q, a in {i: (i, v) for i, v in reversed(ok)}.values():
        if q % 100 == 0:
            near = sorted((float(np.sqrt(np.add.accumulate((a - b) ** 2)[-1])), i) for i, b in ok if i != q and len(b) == len(a))[:k]
            out += [(q, r + 1, i, d) for r, (d, i) in enumerate(near)]
    return sorted(out)


def cases(n, dim, seed):
    rng = np.random.default_rng(seed)
    v = [(k, np.round(rng.normal(size=dim), 2).astype(np.float32).tolist()) for k in range(n)]
    return v + [(10_000, v[3][1]), (10_001, v[3][1]), (10_100, [0.0] * dim), (10_200, None), (10_300, [1.0, None]), (10_400, [float("nan")] * dim), (10_500, []), (10_600, [1.0, 2.0]), (10_601, [2.0, 1.0]), (None, v[0][1]), v[100]]


@pytest.mark.parametrize("shard, block", [(8192, 64_000_000), (90, 1500)])
def test_brute_force(spark, tables, monkeypatch, shard, block):
    monkeypatch.setattr(vector_search, "SHARD_ROWS", shard)
    monkeypatch.setattr(vector_search, "QUERY_BYTES", block)
    v = cases(420, 8, 1)
    got = sorted(tuple(r) for r in vector_search.op8_vantage_point_search(spark, tables(embeddings=v)).collect())
    want = brute(v)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=0, atol=1e-15)


def test_factor_trades_recall():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, 6))
    tree = vector_search.VantageTree(x, np.arange(3000))
    want = np.argsort(vector_search.distances(x[:50], x) + np.diag(np.full(3000, np.inf))[:50], 1, kind="stable")[:, :10]
    recall = {}
    for factor in (1.0, 3.0, 50.0):
        d, i = np.full((50, 10), np.inf), np.full((50, 10), 2**62)
        tree.search(x[:50], np.arange(50), d, i, factor)
        recall[factor] = np.mean([len(set(a) & set(b)) / 10 for a, b in zip(i, want)])
    assert recall[1.0] == 1.0 and recall[3.0] >= recall[50.0] and recall[50.0] < 1.0


def test_few_and_none(spark, tables):
    assert vector_search.op8_vantage_point_search(spark, tables()).count() == 0
    rows = vector_search.op8_vantage_point_search(spark, tables(embeddings=[(0, [1.0, 0.0]), (7, [0.0, 1.0])])).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in rows] == [(0, 1, 7)]
