import itertools
import os
import zlib

import numpy as np
import pandas as pd
import pytest

from sketchmill.llm import quality_crf


def texts(n, seed=1):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 8)))
    good = lambda: "\n".join(" ".join(word() for _ in range(9)).capitalize() + "." for _ in range(rng.integers(1, 8)))
    bad = lambda: "\n".join(" ".join(word().upper() + "!!" for _ in range(9)) for _ in range(rng.integers(1, 8)))
    return [(k, good() if k % 3 else bad(), int(k % 3 > 0)) for k in range(n)]


def test_held_out_and_edges(spark, tables):
    rows = texts(300)
    docs = [(d, t) for d, t, _ in rows] + [(900, None), (901, ""), (902, "\n\n"), (None, "No id here."), (5, rows[5][1]), (903, "Long line. " * 40_000)]
    labels = [(d, y) for d, _, y in rows] + [(0, None), (None, 1), (12345, 0), (3, 0), (3, 1)]
    d = tables(documents=docs, labels=labels)
    got = quality_crf.op4_quality_crf(spark, d).toPandas()
    assert len(got) == len(docs) and got.score.between(0, 1).all()
    assert (got.predicted == (got.score >= 0.3)).all()
    by = {r.doc_id: r for r in got.dropna().itertuples()}
    for doc, _, y in rows:
        held = zlib.crc32(str(doc).encode()) % 5 == 0
        assert by[doc].held_out == held
        if held:
            assert by[doc].predicted == y
    prior = by[900].score
    assert by[901].score == by[902].score == prior and 0.4 < prior < 0.9


def test_labels_of_held_out_rows_are_not_used(spark, tables, tmp_path):
    rows = texts(120)
    docs = [(d, t) for d, t, _ in rows]
    a = quality_crf.op4_quality_crf(spark, tables(documents=docs, labels=[(d, y) for d, _, y in rows])).toPandas()
    flip = [(d, 1 - y if zlib.crc32(str(d).encode()) % 5 == 0 else y) for d, _, y in rows]
    b = quality_crf.op4_quality_crf(spark, tables(documents=docs, labels=flip)).toPandas()
    assert a.sort_values("doc_id").score.tolist() == b.sort_values("doc_id").score.tolist()


def test_nothing_to_learn(spark, tables):
    assert quality_crf.op4_quality_crf(spark, tables()).count() == 0
    got = quality_crf.op4_quality_crf(spark, tables(documents=[(1, "A b."), (2, None)])).toPandas()
    assert got.score.between(0, 1).all() and len(got) == 2


def test_marginals_by_enumeration():
    rng = np.random.default_rng(2)
    logit, first, trans = rng.normal(size=9), np.array([0, 4, 4, 5, 9]), rng.normal(size=(2, 2))
    good, _, expected = quality_crf.chain_marginals(logit, first, trans)
    want, pairs = np.zeros(9), np.zeros((2, 2))
    for a, b in itertools.pairwise(first):
        total = 0.0
        m, e = np.zeros(b - a), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=b - a):
            w = np.exp(sum(logit[a + k] for k, v in enumerate(y) if v) + sum(trans[p, q] for p, q in itertools.pairwise(y)))
            total += w
            m += w * np.array(y)
            for p, q in itertools.pairwise(y):
                e[p, q] += w
        if b > a:
            want[a:b] = m / total
            pairs += e / total
    assert np.allclose(good, want) and np.allclose(expected, pairs)


def test_features():
    data = np.frombuffer("Ab.\nab\n\nAb.".encode(), np.uint8)
    x, length, first = quality_crf.line_features(data, np.array([0, 6, 6, 11]))
    assert first.tolist() == [0, 2, 2, 3] and length.tolist() == [3, 2, 3] and np.isfinite(x).all()
    assert x.shape == (3, quality_crf.FEATURES)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_accuracy(spark):
    d = "/root/testdata/sf0.01"
    got = quality_crf.op4_quality_crf(spark, d).toPandas().merge(pd.read_parquet(f"{d}/labels.parquet"), on="doc_id")
    held = got[got.held_out]
    assert (held.predicted == held.quality).mean() > 0.95


def test_long_chains_in_runs(monkeypatch):
    """Chains cut into runs have the marginals of whole ones."""
    rng = np.random.default_rng(5)
    for trial in range(6):
        first = np.append(0, np.cumsum(rng.choice([0, 1, 2, 7, 40, 333], 12)))
        logit = rng.normal(0, 3, first[-1])
        trans = rng.normal(0, 1, (2, 2)) if trial else np.zeros((2, 2))
        whole = quality_crf.chain_marginals(logit, first, trans)[0]
        monkeypatch.setattr(quality_crf, "RUN", int(rng.choice([1, 2, 7, 50])))
        assert np.allclose(quality_crf.good_shares(logit, first, trans), whole, atol=1e-9)


def test_sample_is_bounded(spark):
    """Repeated ids give one row each, and whole documents are taken up to the lines' bound."""
    docs = spark.createDataFrame([(k % 30, "\n".join(["x y."] * (1 + k % 5)) + str(k // 300)) for k in range(600)] + [(99, "a\n" * 5000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(30)] * 2 + [(99, 1)], "doc_id long, quality int")
    assert quality_crf.training_rows(docs, labels).count() == 31
    rows = quality_crf.training_rows(docs, labels, train_lines=40).collect()
    assert 5 < len(rows) < 30 and sum(r["text"].count("\n") + 1 for r in rows) <= 40
    assert quality_crf.training_rows(docs, labels, train_docs=4).count() == 4
