import random
import re

import numpy as np
import pytest

from sketchmill.llm import near_dedup
from sketchmill.llm.components import connected_components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(docs):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i in range(len(docs)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for k, (d, _) in enumerate(docs):
        if d is not None:
            least[find(k)] = min(least.get(find(k), d), d)
    return sorted(((d, len(sets[k]), c := least.get(find(k)) if sets[k] else d, d == c) for k, (d, _) in enumerate(docs)), key=str)


def edited(rng, words, n):
    w = list(words)
    for _ in range(n):
        k = rng.randrange(len(w))
        w[k : k + 1] = rng.choice([[], ["new%d" % rng.randrange(10**6)], [w[k], w[k]]])
    return " ".join(w)


def corpus(seed, copies):
    rng = random.Random(seed)
    texts = []
    for g in range(6):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([6, 30, 120, 400]))]
        texts += [" ".join(base)] * 3 + [" ".join(base).upper()]
        chain = base
        for _ in range(copies):
            texts.append(edited(rng, base, rng.randrange(0, 1 + len(base) // 40)))
            chain = edited(rng, chain, 1 + len(base) // 90).split()
            texts.append(" ".join(chain))
    texts += [None, "", "  \n", "a", "A", "a b", "a b c d e", "a b c d e f", "x y z", "long " * 20_000]
    rng.shuffle(texts)
    return [(k * 3, t) for k, t in enumerate(texts)]


def test_brute_force(spark, tables):
    docs = corpus(5, 12) + [(None, "only with no id"), (0, "the same id again and again here"), (None, "long " * 20_000)]
    got = sorted((tuple(r) for r in near_dedup.op10_minhash_near_dedup(spark, tables(documents=docs)).collect()), key=str)
    want = [(d, n, c, d == c) for d, n, c, _ in brute(docs)]
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(g[3] == (g[0] == g[2]) for g in got)


def test_small_parts(spark, tables, monkeypatch):
    """Stars and lists dealt into parts of one row or few give the same."""
    for part in (1, 7):
        monkeypatch.setattr(near_dedup, "PART", part)
        docs = corpus(6, 15)
        got = sorted((tuple(r) for r in near_dedup.op10_minhash_near_dedup(spark, tables(documents=docs)).collect()), key=str)
        assert got == brute(docs)


def test_planted_pairs_in_boilerplate(spark, tables):
    """800 texts of one boilerplate, every pair just under the threshold, but for 20 planted pairs just over it: every planted pair is
    found and nothing else."""
    fixed = [f"b{k}" for k in range(1104)]
    own = lambda k, n: [f"own{k}x{j}" for j in range(n)]
    texts = [fixed + own(k, 100) for k in range(780)]
    for k in range(20):  # a twin shares some of its partner's own words
        texts.append(fixed + own(k, 6) + own(10_000 + k, 94))
    docs = list(enumerate(" ".join(w) for w in texts))
    sets = [shingles(t) for _, t in docs[:2] + docs[780:781]]
    jaccard = lambda a, b: len(a & b) / len(a | b)
    assert 0.84 < jaccard(sets[0], sets[1]) < 0.85 <= jaccard(sets[0], sets[2]) < 0.856
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.op10_minhash_near_dedup(spark, tables(documents=docs)).collect()}
    assert got == {k: k - 780 if k >= 780 else k for k in range(800)}


def slotted(seed, n):
    """Texts of a common template with one of two words in each of 40 slots, and of most another one that differs in 5 or 6 slots:
    every shingle is common, so only large buckets join such a pair."""
    rng = random.Random(seed)
    fixed = [f"t{k}" for k in range(400)]
    out = []
    for _ in range(n):
        a = [rng.randrange(2) for _ in range(40)]
        b = list(a)
        for k in rng.sample(range(40), rng.choice([5, 6])):
            b[k] ^= 1
        for bits in (a, b):
            words = list(fixed)
            for k, x in enumerate(bits):
                words[10 * k + 5] = f"s{k}v{x}"
            out.append(" ".join(words))
    rng.shuffle(out)
    return list(enumerate(out))


def test_hidden_links(spark, tables, monkeypatch):
    """No link inside a bucket of common shingles is left to chance, and parts of a list meet."""
    monkeypatch.setattr(near_dedup, "PART", 20)
    docs = slotted(7, 250)
    got = sorted((tuple(r) for r in near_dedup.op10_minhash_near_dedup(spark, tables(documents=docs)).collect()), key=str)
    assert got == brute(docs)


def test_open_pairs_hold_all_links(spark):
    """Of random sets in random components, every link between two components is among the pairs of the prefix join."""
    rng = np.random.default_rng(3)
    sets = []
    for g in range(40):
        base = rng.integers(0, 10**6, int(rng.integers(1, 200)))
        for _ in range(6):
            keep = base[rng.random(len(base)) < rng.choice([0.8, 0.93, 1.0])]
            sets.append(sorted({*keep.tolist(), *rng.integers(0, 10**6, int(rng.integers(0, 1 + len(base) // 12))).tolist()}) or [g])
    rows = [(k, len(s), int(rng.integers(0, 120)), s) for k, s in enumerate(sets)]
    frame = spark.createDataFrame(rows, "node long, n long, root long, grams array<long>")
    got = {(r["a"], r["b"]) for r in near_dedup.open_pairs(near_dedup.prefixes(frame)).collect()}
    linked = lambda a, b: 100 * len(a & b) >= 85 * len(a | b)
    want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if rows[i][2] != rows[j][2] and linked(set(sets[i]), set(sets[j]))}
    assert want and want <= got and all(rows[i][2] != rows[j][2] for i, j in got)
    assert len(got) < 20 * len(want)


def test_empty(spark, tables):
    assert near_dedup.op10_minhash_near_dedup(spark, tables()).count() == 0
    rows = near_dedup.op10_minhash_near_dedup(spark, tables(documents=[(1, None), (2, "")])).collect()
    assert sorted(map(tuple, rows)) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_bucket_rate():
    """Pairs at the threshold meet in some bucket; far pairs in few."""
    rng = np.random.default_rng(1)
    met = {0.85: 0, 0.3: 0}
    for j, n in ((0.85, 400), (0.3, 400)):
        for _ in range(60):
            both = rng.integers(0, 2**63, int(n * 2 * j / (1 + j)), dtype=np.uint64)
            sets = [np.unique(np.concatenate([both, rng.integers(0, 2**63, n - len(both), dtype=np.uint64) * 2 + 1])) for _ in range(2)]
            sets = [near_dedup.mix(s) for s in sets]
            keys = near_dedup.bucket_keys([np.sort(s) for s in sets])
            met[j] += bool((keys[0] == keys[1]).any())
    assert met[0.85] == 60 and met[0.3] < 20


@pytest.mark.parametrize("edges, want", [([], {}), ([(5, 1), (1, 5), (3, 3)], {1: 1, 5: 1}), ([(k, k + 1) for k in range(40)], dict.fromkeys(range(41), 0))])
def test_components(spark, edges, want):
    rows = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in rows} == want
