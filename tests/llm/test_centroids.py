"""Clustering against Lloyd's rounds in plain Python integers."""

import hashlib
import math
import random
from collections import Counter

import numpy as np

from sketchmill.llm import centroids


def brute(rows, k=40, rounds=5):
    kept = [(i, [max(-centroids.REACH, min(centroids.REACH, math.floor(256 * x))) for x in np.array(v, np.float32).astype(float)]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", np.array(r[1], "<i4").tobytes()))
    c = [v for _, v in start[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    find = lambda v: min((far(v, m), j) for j, m in enumerate(c))
    for _ in range(rounds):
        own = [find(v)[1] for _, v in kept]
        for j in range(len(c)):
            mine = [v for (_, v), o in zip(kept, own) if o == j]
            if mine:
                c[j] = [sum(col) // len(mine) for col in zip(*mine)]
    found = [(i, *find(v)) for i, v in kept]
    inertia = Counter()
    for _, d, j in found:
        inertia[j] += d
    return Counter((i, j, d, inertia[j], sum(inertia.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, d, j in found)


def got(spark, folder):
    df = centroids.op13_centroid_clustering(spark, folder)
    assert df.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return Counter(map(tuple, df.collect()))


def test_hot_vectors_ties_and_odd_rows(spark, tables):
    draw = random.Random(3)
    few = [[draw.choice([-0.5, 0.0, 0.25, 0.5]) for _ in range(64)] for _ in range(30)]
    rows = [(k, few[0] if k % 3 == 0 else draw.choice(few) if k % 3 == 1 else [draw.gauss(0, 0.3) for _ in range(64)]) for k in range(400)]
    rows += [(7, few[1]), (7, few[2]), (None, few[3]), (None, None), (900, None), (901, []), (902, few[0][:63]), (903, few[0] + [0.0])]
    rows += [(904, [None] + few[0][1:]), (905, [math.nan] + few[0][1:]), (906, [math.inf] + few[0][1:]), (907, [0.0] * 64), (908, [-0.0] * 64)]
    assert got(spark, tables(embeddings=rows)) == brute(rows)


def test_huge_components_are_held(spark, tables):
    rows = [(k, [(-1) ** k * 10.0 ** (k % 12)] * 32 + [float(k)] * 32) for k in range(60)]
    assert got(spark, tables(embeddings=rows)) == brute(rows)


def test_fewer_vectors_than_centroids(spark, tables):
    rows = [(k, [k / 64.0] * 64) for k in range(3)] + [(None, [9.0] * 64)]
    assert got(spark, tables(embeddings=rows)) == brute(rows)
    assert not got(spark, tables(embeddings=[]))
    assert not got(spark, tables(embeddings=[(1, None)]))


def test_both_kernels_agree():
    draw = np.random.default_rng(1)
    x, c = draw.integers(-900, 900, (500, 64)), draw.integers(-900, 900, (40, 64))
    a = centroids.nearest(x, c)
    big = 1 << 12  # past EXACT after scaling
    b = centroids.nearest(x * big, c * big)
    assert (a[0] == b[0]).all() and (a[1] * big * big == b[1]).all()


def test_distinct_vectors_count_rows(spark):
    rows = spark.createDataFrame([(k, bytearray(b"a" if k % 2 else b"b")) for k in range(1000)], "vec_id long, q binary")
    made = {bytes(r["q"]): r for r in centroids.distinct_vectors(rows).collect()}
    assert {k: r["weight"] for k, r in made.items()} == {b"a": 500, b"b": 500}
    assert all(len(r["salts"]) == len(set(r["salts"])) <= centroids.SALTS for r in made.values())
