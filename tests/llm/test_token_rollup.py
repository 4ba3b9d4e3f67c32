from collections import Counter

import pytest

from sketchmill.llm import token_rollup
from sketchmill.llm.packing import default_tokenizer_path, encode


def tokens(name, text):
    return len((text or "").split()) if name == token_rollup.WORDS else len(encode(default_tokenizer_path(), text or ""))


@pytest.mark.parametrize("ids", [0, 1000])
def test_query(spark, tables, monkeypatch, ids):
    """With the second form counted for all texts, and for the marked ones alone."""
    monkeypatch.setattr(token_rollup, "BROADCAST_IDS", ids)
    docs = [(k, f"word{k}  two\n\nthree" * (k % 4), ["en", None][k % 2], ["a", "b", None][k % 3]) for k in range(20)] + [(50, None, "en", "a"), (3, "again", "fr", "a"), (None, "x y", "en", "a"), (60, "z " * 50_000, "en", "hot")]
    labels = [(0, 0, 0), (1, 0, 1), (2, 1, 1), (50, 0, 1), (3, 0, 0), (3, 1, 0), (999, 0, 1), (None, 0, 1), (5, None, None)]
    got = token_rollup.op1_token_rollup(spark, tables(documents=docs, labels=labels)).collect()
    toxic = {d for d, _, t in labels if t}
    low = {d for d, q, _ in labels if q == 0}
    want = Counter(), Counter()
    import re

    for d, t, lang, source in docs:
        if d is not None and d in toxic:
            continue
        text = re.sub(r"[ \t\n\x0b\f\r]+", " ", t or "") if d is not None and d in low else t
        for name in (token_rollup.BPE, token_rollup.WORDS):
            want[0][(source, lang, name)] += 1
            want[1][(source, lang, name)] += tokens(name, text)
    assert {(r["source"], r["lang"], r["tokenizer"]): (r["n_docs"], r["n_tokens"]) for r in got} == {k: (want[0][k], want[1][k]) for k in want[0]}


def test_commits(spark, tmp_path):
    rows = lambda *x: spark.createDataFrame(list(x), "source string, lang string, tokenizer string, n_tokens long")
    r = token_rollup.Rollup(spark, f"file://{tmp_path}/rollup")
    assert r.totals().count() == 0 and r.batches() == []
    a = rows(("s", "en", "t", 5), ("s", "en", "t", 7), ("u", None, "t", 1))
    assert r.commit("b1", token_rollup.inserted(a)) and not r.commit("b1", token_rollup.inserted(a))
    assert r.commit("b2", token_rollup.revised(rows(("s", "en", "t", 5)), rows(("s", "en", "t", 9))))
    assert r.commit("b3", token_rollup.deleted(rows(("u", None, "t", 1))))
    assert [tuple(x) for x in r.totals().collect()] == [("s", "en", "t", 2, 16)]
    # a commit that died before its marker is written again
    (tmp_path / "rollup" / "batch=b3" / "_SUCCESS").unlink()
    assert sorted(x["n_docs"] for x in r.totals().collect()) == [1, 2]
    assert r.commit("b3", token_rollup.deleted(rows(("u", None, "t", 1))))
    folded = r.compact(f"file://{tmp_path}/folded")
    assert [tuple(x) for x in folded.totals().collect()] == [("s", "en", "t", 2, 16)]
    assert not folded.commit("b1", token_rollup.inserted(a)) and folded.commit("b4", token_rollup.inserted(a))


def test_two_writers(spark, tmp_path, monkeypatch):
    """Of two writers that both saw an id as free, the first to be whole counts, and nothing of the other is left."""
    r = token_rollup.Rollup(spark, f"file://{tmp_path}/rollup")
    change = lambda n: token_rollup.inserted(spark.createDataFrame([("s", "en", "t", n)], "source string, lang string, tokenizer string, n_tokens long"))
    assert r.commit("b", change(5))
    asked = iter([False])
    known = token_rollup.Rollup.is_committed
    monkeypatch.setattr(token_rollup.Rollup, "is_committed", lambda self, b: next(asked, None) is None and known(self, b))
    assert not r.commit("b", change(9))
    assert [tuple(x) for x in r.totals().collect()] == [("s", "en", "t", 1, 5)]
    assert [p.name for p in (tmp_path / "rollup").iterdir() if not p.name.startswith(".")] == ["batch=b"]


def test_empty(spark, tables):
    assert token_rollup.op1_token_rollup(spark, tables()).count() == 0
