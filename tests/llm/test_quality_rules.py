"""Counts against plain Python, binomial bounds against exact fractions, the guarantee against many draws."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from math import comb

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sketchmill.llm import quality_rules as rules
from sketchmill.llm.common import string_buffers

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    tri = Counter(zip(w, w[1:], w[2:]))
    hit = {i + k for i, t in enumerate(zip(w, w[1:], w[2:])) if tri[t] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines), len(lines) - len(set(lines)), len(hit)


def counted(texts):
    import pyarrow as pa

    data, offsets = string_buffers(pa.array(texts, pa.string()))
    got = rules.count_slice(data, offsets)
    return [tuple(int(got[c][k]) for c in rules.COUNTS) for k in range(len(texts))]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab é#|\n\t\x0b\x1c  "), max_size=60) | st.none(), min_size=1, max_size=5))
def test_counts(texts):
    assert counted(texts) == [counts(t) for t in texts]


def test_counts_of_long_texts():
    texts = ["word " * 300_000, "x" * 1_000_000, "\n" * 500_000, "a\nb\n" * 100_000, " ".join(map(str, range(200_000)))]
    assert counted(texts) == [counts(t) for t in texts]


def exact(k, n, p):
    return sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


@pytest.mark.parametrize("k,n", [(0, 1), (0, 90), (3, 200), (20, 700), (0, 2000), (60, 2000)])
def test_binomial_tail(k, n):
    assert rules.binomial_tail(k, n, 0.05) == pytest.approx(float(exact(k, n, Fraction(1, 20))), rel=1e-9)


def test_binomial_tail_of_large_numbers():
    assert rules.binomial_tail(50_000_000, 1_000_000_000, 0.05) == 1.0
    assert rules.binomial_tail(49_000_000, 1_000_000_000, 0.05) < 1e-100
    assert 0.05 < rules.binomial_tail(49_990_000, 1_000_000_000, 0.05) < 0.1


def test_false_rejections_stay_under_the_risk():
    """Good texts reach a level at random, so that later levels break the bound; in 95 of 100 draws the level taken must not."""
    n, draw, broken = len(rules.LEVELS), np.random.default_rng(7), 0
    rate = np.r_[np.full(n, 0.008), 1 - 0.008 * n]  # level k rejects 0.8 % (k + 1): over 5 % from level 6 on
    for _ in range(400):
        best, _ = rules.choose(draw.multinomial(800, rate).tolist(), [100] * n + [0], rules.ERROR / 4, weight=0)
        broken += best is not None and rate[: best + 1].sum() > rules.RISK
    assert broken <= 400 * rules.ERROR


def brute(docs, labels):
    seen = defaultdict(set)
    for doc_id, quality in labels:
        seen[doc_id].add(quality)
    held = defaultdict(lambda: ([0] * (len(rules.LEVELS) + 1), [0] * (len(rules.LEVELS) + 1)))
    rows = []
    for doc_id, text, lang in docs:
        w, chars, sym, lines, dup, rep = counts(text)
        failed = w < 50 or 100 * rep > 50 * w
        level = len(rules.LEVELS)
        for k, (a, b, c, d, e) in reversed(list(enumerate(rules.LEVELS))):
            if 1000 * sym > a * w or 1000 * dup > b * lines or 1000 * rep > c * w or 1000 * chars > d * w or 1000 * chars < e * w:
                level = k
        rows.append((doc_id, lang, (w, chars, sym, dup, rep), failed, level))
        if not failed and doc_id is not None and seen[doc_id] in ({0}, {1}):
            held[lang][seen[doc_id] == {0}][level] += 1
    taken = {}
    for lang, (good, bad) in held.items():
        best, gain = None, 0
        for k in range(len(rules.LEVELS)):
            lost, caught = sum(good[: k + 1]), sum(bad[: k + 1])
            if lost >= sum(good) / 20 or exact(lost, sum(good), Fraction(1, 20)) > Fraction(1, 20) / len(held):
                break
            if caught * sum(good) - rules.WEIGHT * lost * sum(bad) > gain:
                best, gain = k, caught * sum(good) - rules.WEIGHT * lost * sum(bad)
        taken[lang] = best
    return Counter((i, *c, failed, not failed and not (taken.get(lang) is not None and level <= taken[lang])) for i, lang, c, failed, level in rows), taken


def corpus():
    draw = random.Random(11)
    docs, labels = [], []
    for k in range(900):
        lang = "hot" if k % 3 == 0 else draw.choice(["en", None, "few"]) if k % 30 else "few"
        words = ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 9))) for _ in range(draw.randint(40, 90))]
        good = draw.random() < 0.8
        if not good:
            words = [w + draw.choice(["#", "", "$", "|"]) for w in words]
        text = " ".join(words) + ("\nsame line" * draw.randint(0, 4))
        docs.append((k, draw.choice([text] * 30 + [None, "", "short"]), lang))
        labels.append((k, int(good)))
    labels += [(3, 0), (3, 1), (6, None), (9, 2), (None, 1), (12, labels[12][1])]
    docs += docs[:5] + [(None, docs[0][1], "en")]
    return docs, labels


def test_the_whole_operator(spark, tables):
    docs, labels = corpus()
    df = rules.op12_risk_controlled_rules(spark, tables(documents=docs, labels=labels))
    assert df.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    want, taken = brute(docs, labels)
    assert Counter(map(tuple, df.collect())) == want
    assert taken["hot"] is not None


def test_no_labels_and_empty_tables(spark, tables):
    docs = corpus()[0][:40]
    rows = rules.op12_risk_controlled_rules(spark, tables(documents=docs)).collect()
    assert all(r["kept"] == (not r["base_failed"]) for r in rows) and len(rows) == 40
    assert not rules.op12_risk_controlled_rules(spark, tables()).collect()


def test_strata_met_by_a_shuffle(spark, tables, monkeypatch):
    docs, labels = corpus()
    monkeypatch.setattr(rules, "BROADCAST_STRATA", 0)
    assert Counter(map(tuple, rules.op12_risk_controlled_rules(spark, tables(documents=docs, labels=labels)).collect())) == brute(docs, labels)[0]
