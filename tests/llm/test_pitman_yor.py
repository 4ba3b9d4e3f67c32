import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from sketchmill.llm import pitman_yor

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER)) + [None]


def corpus(n=160, seed=1):
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(40)]
    out = []
    for k in range(n):
        at, text = int(rng.integers(40)), []
        for _ in range(int(rng.integers(1, 60))):
            text.append(words[at])
            at = (at * 7 + int(rng.integers(3))) % 40
        out.append((k, " ".join(text).title()))
    return out


def test_counts_and_base(spark, tables):
    docs = corpus() + [(1000, None), (1001, ""), (1002, "unseen Words only"), (None, "w1 w2"), (7, "repeated row"), (7, "repeated row"), (1003, "w1 " * 30_000)]
    got = pitman_yor.op6_pitman_yor_lm(spark, tables(documents=docs)).toPandas()
    assert len(got) == len(docs)
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    c = Counter(w for d, t in docs if not held(d) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((-1 if d is None else d, held(d), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 6)) for d, t in docs)
    rows = sorted((-1 if pd.isna(r.doc_id) else int(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got.itertuples())
    assert [r[:5] for r in rows] == [w[:5] for w in want]
    assert np.allclose([r[5] for r in rows], [w[5] for w in want], atol=1e-5)
    h = got[got.held_out & (got.doc_id < 200)]
    assert h.score.sum() > 1.1 * h.base_score.sum()  # log probabilities: the model is well ahead of the base


def test_scores_do_not_depend_on_each_other(spark):
    """A model is what its training rows make it: other rows to score change nothing, and every score is a log probability."""
    docs = [(k, t, True) for k, t in corpus(60, 2)]
    few = docs + [(10_000, "w3 w3 zzz", False)]
    more = few + [(20_000 + k, f"w{k} never seen {k}", False) for k in range(30)]
    a, b = ({r["doc_id"]: r["score"] for r in pitman_yor.score(spark.createDataFrame(x, "doc_id long, text string, learn boolean")).collect()} for x in (few, more))
    assert all(b[k] == pytest.approx(a[k]) for k in a) and all(v <= 0 and np.isfinite(v) for v in b.values())


def test_start_distribution_sums_to_one(spark):
    """P(w | start) over all known tokens, the end and one unknown token. A text "w" scores P(w | start) P(end | w), and "w w" has
    P(w | start) P(w | w) P(end | w); training texts of one word each make every P(end | w) of known words follow from two scores."""
    docs = [(k, w, True) for k, w in enumerate("a a b c".split())] + [(9, "", True)]
    probes = [(100 + k, w, False) for k, w in enumerate(["a", "b", "c", "zz"])] + [(200, "", False)] + [(300 + k, f"{x} {y}", False) for k, (x, y) in enumerate((x, y) for x in "abc" for y in ["a", "b", "c", "zz"])]
    got = {r["doc_id"]: 10 ** r["score"] for r in pitman_yor.score(spark.createDataFrame(docs + probes, "doc_id long, text string, learn boolean"), 1).collect()}
    # an unknown context backs off to the parent, so P(end | zz) = P0(end), and "zz zz" = P(zz | start) P0(zz) P0(end)
    assert 0 < got[200] < 1
    for k, x in enumerate("abc"):
        assert got[300 + 4 * k] < got[100 + k]  # one more token is one more factor under 1
    assert sum(got[100 + k] for k in range(4)) + got[200] < 1


def test_view_is_normalised():
    """One block with its answers computed in place: sums over the whole vocabulary and the unknown token are 1 in every context."""
    rng = np.random.default_rng(3)
    n = 12
    seq = rng.integers(0, n, 4000)
    u, w = seq[:-1], seq[1:]
    count = np.zeros((n, n), np.int64)
    np.add.at(count, (u, w), 1)
    keys = pitman_yor.mix(np.arange(n * n, dtype=np.uint64)).reshape(n, n)
    d, d0 = 0.6, 0.4
    start = (count > 0).astype(int)
    parent = np.full(n, 1 / (n + 1))
    t = np.stack([pitman_yor.seat(keys[k], count[k], (1.0 + d * start.sum(1)[k]) * parent, d, 1) for k in range(n)])
    assert (t <= count).all() and (t[count > 0] >= 1).all()
    customers = t.sum(0)
    s = pitman_yor.seat(keys[0], customers, np.full(n, (1 + d0 * n) / (n + 1)), d0, 1)
    share = (1 + d0 * s.sum()) / (n + 1)
    p0 = (customers - d0 * s + share) / (1 + customers.sum())
    assert p0.sum() + share / (1 + customers.sum()) == pytest.approx(1)
    for k in range(n):
        back = (1 + d * t[k].sum()) / (1 + count[k].sum())
        p = (count[k] - d * t[k]) / (1 + count[k].sum()) + back * p0
        assert p.sum() + back * share / (1 + customers.sum()) == pytest.approx(1)


def test_seating_mean():
    """Tables follow the seating rule: the mean over many dishes is that of customer-by-customer simulation."""
    rng = np.random.default_rng(4)
    for c, a, d in ((5, 2.0, 0.5), (60, 3.0, 0.7), (900, 5.0, 0.3)):
        keys = pitman_yor.mix(np.arange(20_000, dtype=np.uint64) + np.uint64(c))
        got = pitman_yor.seat(keys, np.full(len(keys), c), np.full(len(keys), a), d, 1)
        sim = np.ones(4000)
        for k in range(1, c):
            sim += rng.random(4000) < a / (a + k - d * sim)
        assert abs(got.mean() - sim.mean()) < 0.03 * sim.mean() + 0.05


def test_seating_of_frequent_pairs():
    """Mean and spread of the tables are those of customer-by-customer seating, also of many customers and large weights."""
    rng = np.random.default_rng(6)
    for c, a, d in ((17, 20.0, 0.9), (128, 20.0, 0.9), (500, 20.0, 0.9), (500, 0.05, 0.5), (2000, 400.0, 0.8)):
        keys = pitman_yor.mix(np.arange(20_000, dtype=np.uint64) + np.uint64(c << 20))
        got = pitman_yor.seat(keys, np.full(len(keys), c), np.full(len(keys), a), d, 1)
        sim = np.ones(20_000)
        for k in range(1, c):
            sim += rng.random(len(sim)) < a / (a + k - d * sim)
        assert abs(got.mean() - sim.mean()) < 5 * sim.std() * (2 / len(sim)) ** 0.5
        assert abs(got.std() / sim.std() - 1) < 0.06


def test_seating_does_not_depend_on_neighbours():
    rng = np.random.default_rng(7)
    customers = np.minimum(rng.zipf(1.3, 3000), 50_000)
    keys, weights = pitman_yor.mix(np.arange(3000, dtype=np.uint64)), rng.gamma(0.5, 8, 3000) + 1e-9
    whole = pitman_yor.seat(keys, customers, weights, 0.7, 3)
    some = np.flatnonzero(rng.random(3000) < 0.3)[::-1]
    assert (whole[some] == pitman_yor.seat(keys[some], customers[some], weights[some], 0.7, 3)).all()
    assert (whole >= 1).all() and (whole <= customers).all()


def test_blocks_do_not_matter(spark, monkeypatch):
    docs = [(k, t, k % 5 != 0) for k, t in corpus(80, 5)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, learn boolean")
    one = {r["doc_id"]: r["score"] for r in pitman_yor.score(frame.coalesce(1)).collect()}
    many = {r["doc_id"]: r["score"] for r in pitman_yor.score(frame.repartition(7)).collect()}
    assert one == pytest.approx(many)


def test_pack():
    x, y = np.array([0, 1, -5, 2**31 - 1], np.int32), np.array([7, 8, 9, 10], np.int32)
    assert pitman_yor.unpack(pitman_yor.pack(x, y), 2).tolist() == [x.tolist(), y.tolist()]
    assert pitman_yor.unpack(pitman_yor.pack(x[:0])).tolist() == [[]]


def test_empty(spark, tables):
    assert pitman_yor.op6_pitman_yor_lm(spark, tables()).count() == 0
    docs = [(k, "a b") for k in range(60) if zlib.crc32(str(k).encode()) % 7 == 2]
    rows = pitman_yor.op6_pitman_yor_lm(spark, tables(documents=docs)).collect()
    assert all((r["score"], r["base_score"], r["train_tokens"], r["n_known"]) == (0.0, 0.0, 0, 0) for r in rows)


def plain_scores(docs, sweeps):
    """The model in plain dictionaries: counts, seatings level by level and chain by chain, predictive probabilities. Only the draw of one
    dish's tables (`seat`, held against simulation above) and the hashes it goes by are the operator's."""
    from sketchmill.llm.common import LOWER as BYTES
    from sketchmill.llm.common import mix, word_hashes

    def key_of(token):
        if token == "<end>":
            return int(pitman_yor.END)
        if token == "<begin>":
            return int(pitman_yor.BEGIN)
        raw = np.frombuffer(token.encode(), np.uint8)
        assert (BYTES[raw] == raw).all()
        return int(word_hashes(raw, np.array([0]), np.array([len(raw)]))[0])

    draw = lambda keys, n, a, d, sweep: pitman_yor.seat(np.array(keys, np.uint64), np.array(n), np.array(a, float), d, sweep).tolist()
    texts = [(d, [w or "<end>" for w in tokens(t)], learn) for d, t, learn in docs]
    count, pair = Counter(), Counter()
    for _, words, learn in texts:
        if learn:
            count.update(words)
            pair.update(zip(["<begin>", *words], words))
    V, N, within = len(count), sum(count.values()), Counter()
    for (u, _), n in pair.items():
        within[u] += n
    d = pitman_yor.discount_of(sum(n == 1 for n in pair.values()), sum(n == 2 for n in pair.values()))
    names, words = sorted(pair), sorted(count)
    with np.errstate(over="ignore"):
        pair_keys = [int(mix(np.array([np.uint64(key_of(u)) * np.uint64(0xA0761D6478BD642F) + np.uint64(key_of(w)) * np.uint64(0xE7037ED1A0B428DB)]))[0]) for u, w in names]
    word_keys = [key_of(w) for w in words]

    def level_of(tables, d0, sweep):
        opened, customers = Counter(), Counter()
        for (u, w), t in tables.items():
            opened[u] += t
            customers[w] += t
        own = dict.fromkeys(words, 1) if sweep is None else dict(zip(words, draw(word_keys, [customers[w] for w in words], [(1 + d0 * V) / (V + 1)] * V, d0, sweep)))
        return tables, opened, customers, own

    def parent(state, d0, w):
        _, _, customers, own = state
        share = (1 + d0 * sum(own.values())) / (V + 1)
        return (max(customers[w] - d0 * own.get(w, 0), 0) + share) / (1 + sum(customers.values()))

    first = level_of(dict.fromkeys(names, 1), None, None)
    d0 = pitman_yor.discount_of(sum(n == 1 for n in first[2].values()), sum(n == 2 for n in first[2].values()))
    states = []
    for chain in range(pitman_yor.CHAINS):
        at = first
        for level in range(1, sweeps + 1):
            weights = [(1 + d * max(at[1][u] - 1, 0)) * parent(at, d0, w) for u, w in names]
            sweep = level * pitman_yor.CHAINS + chain
            at = level_of(dict(zip(names, draw(pair_keys, [pair[x] for x in names], weights, d, sweep))), d0, sweep)
            states.append(at)

    def probability(u, w):
        total = 0.0
        for state in states:
            below = parent(state, d0, w)
            seated = max(pair[u, w] - d * state[0].get((u, w), 0), 0)
            total += (seated + (1 + d * state[1][u]) * below) / (1 + within[u]) if within[u] else below
        return total / len(states)

    return {k: sum(np.log10(probability(u, w)) for u, w in zip(["<begin>", *ws], ws)) for k, ws, _ in texts}, N


@pytest.mark.parametrize("sweeps", [1, 2])
def test_scores_by_brute_force(spark, monkeypatch, sweeps):
    docs = [(k, t.lower(), k % 5 != 0) for k, t in corpus(60, 9)] + [(900, "", True), (901, None, False), (902, "new words w1 here", False), (903, "w1 w8 " * 300, True), (904, "w3", True)]
    want, n = plain_scores(docs, sweeps)
    rows = pitman_yor.score(spark.createDataFrame(docs, "doc_id long, text string, learn boolean").repartition(3), sweeps).collect()
    assert len(rows) == len(docs) and all(r["train_tokens"] == n for r in rows)
    assert all(r["score"] == pytest.approx(want[r["doc_id"]], rel=1e-9) for r in rows)


def test_a_pass_looks_at_its_share_alone(spark, monkeypatch):
    draw = np.random.default_rng(4)
    docs = [(k, " ".join(f"w{x}" for x in draw.zipf(1.6, 60) % 50), k % 7 != 2) for k in range(30)]
    row = pitman_yor.make_blocks(spark.createDataFrame(docs, "doc_id long, text string, learn boolean").coalesce(1)).first().asDict()
    for buckets, passes in ((10, 4), (3, 4), (1, 1)):
        keys = pitman_yor.Tokens(row, {}).keys
        shares = [pitman_yor.asked(row, buckets, (k, passes)) for k in range(passes)]
        assert np.concatenate(shares).tolist() == keys.tolist()  # each pair in one pass, in order
        bounds = set(pitman_yor.parts_of(keys, buckets).tolist())
        assert set(np.cumsum([len(x) for x in shares]).tolist()) <= bounds  # shares are whole buckets

    seated, pairs, seat = [], [], pitman_yor.seat
    monkeypatch.setattr(pitman_yor, "seat", lambda keys, *rest: seated.append(len(keys)) or seat(keys, *rest))
    view = pitman_yor.Owned.__new__(pitman_yor.Owned)
    n = 400
    view.constants, view.vocabulary = {"discount": 0.5}, np.arange(20, dtype=np.uint64)
    view.u, view.w, view.pair_count, view.keys = draw.integers(0, 20, n), draw.integers(0, 20, n), draw.integers(1, 9, n), pitman_yor.mix(np.arange(n, dtype=np.uint64))
    view.state = lambda level, chain: np.ones((3, 20), np.int64)
    view.parent = lambda level, chain, state: np.full(20, 0.05)
    parts = [view.drawn(4, 10, (k, 4)) for k in range(4)]
    assert sum(seated) == 4 * n  # once a level and chain, not once a pass
    whole = view.drawn(4, 10)
    assert [np.concatenate(x).tolist() for x in zip(*[(k, *a) for k, a in parts])] == [whole[0].tolist(), *[a.tolist() for a in whole[1]]]
