import math
import zlib

import numpy as np
import pandas as pd

from sketchmill.llm import language_id

WORDS = {"en": "the and of this that with tion ing".split(), "de": "der die und für über nicht ung keit".split(), "fr": "le de et étre où façon eux".split()}


def docs(n, seed=1):
    rng = np.random.default_rng(seed)
    return [(k, " ".join(rng.choice(WORDS[lang], 25)), lang) for k in range(n) for lang in [list(WORDS)[k % 3]]]


def test_held_out_and_edges(spark, tables):
    rows = docs(240)
    odd = [(900, None, "en"), (901, "", "de"), (902, "123 !! ...", "fr"), (903, rows[1][1], None), (None, rows[0][1], "en"), (904, "日本", None), (905, "der und " * 50_000, "xx"), (5, rows[5][1], rows[5][2]), (906, "²³", None)]
    got = language_id.op7_language_id(spark, tables(documents=rows + odd)).toPandas()
    assert len(got) == len(rows) + len(odd) and got.score.between(0, 1).all()
    by = {r.doc_id: r for r in got.dropna().itertuples()}
    for doc, _, lang in rows:
        assert by[doc].held_out == (zlib.crc32(str(doc).encode()) % 4 == 2)
        assert by[doc].lang_pred == lang
    assert [by[k].lang_pred for k in (900, 901, 902, 906)] == ["und"] * 4 and by[900].score == 0
    assert by[903].lang_pred == rows[1][2] and by[904].lang_pred != "und"


def test_code_lengths_against_plain_ppm():
    """The tabled code lengths equal a byte-by-byte walk down the orders."""
    train = [("a", "abracadabra abra"), ("b", "barbar bar abba")]
    codes, langs = [], []
    for k, (_, t) in enumerate(train):
        raw = np.frombuffer(t.encode(), np.uint8)
        codes.append(language_id.gram_codes(raw, np.array([0, len(raw)])))
        langs.append(np.full(len(raw), k))
    trees = language_id.FrozenTrees(["a", "b"], np.concatenate(langs), np.concatenate(codes), np.ones(sum(map(len, codes))))
    seen = sorted({c for _, t in train for c in t})

    def distribution(k, context):
        """P(next) over seen symbols and one class for all other bytes."""
        p = {c: 1 / 256 for c in seen} | {None: (256 - len(seen)) / 256}
        for order in range(min(len(context), 3) + 1):
            tail = context[len(context) - order :]
            text, n = train[k][1], {}
            for i in range(order, len(text)):
                if text[i - order : i] == tail:
                    n[text[i]] = n.get(text[i], 0) + 1
            if n:
                at, room = sum(n.values()) + len(n), sum(v for c, v in p.items() if c not in n)
                p = {c: n[c] / at if c in n else len(n) / at * v / room for c, v in p.items()}
        assert math.isclose(sum(p.values()), 1)
        return p

    tests = ["abra", "xabraz", "barbara", "a", "", "rrr abra"]
    blob = "".join(tests).encode()
    offsets = np.append(0, np.cumsum([len(t) for t in tests]))
    got = trees.code_lengths(np.frombuffer(blob, np.uint8), offsets)
    for i, t in enumerate(tests):
        for k in range(2):
            bits = 0.0
            for j, c in enumerate(t):
                # a context holds seen symbols only: what stands before another byte is forgotten
                context = t[max(0, j - 3) : j]
                while any(x not in seen for x in context):
                    context = context[1:]
                union = [x for n in range(len(context), -1, -1) for x in [context[len(context) - n :]] if n == 0 or any(x in u[1][:-1] for u in train)]
                p = distribution(k, union[0])
                bits -= math.log2(p[c]) if c in p else math.log2(p[None] / (256 - len(seen)))
            assert math.isclose(got[i, k], bits, rel_tol=1e-4, abs_tol=1e-4), (t, k)


def test_nothing_to_learn(spark, tables):
    assert language_id.op7_language_id(spark, tables()).count() == 0
    got = language_id.op7_language_id(spark, tables(documents=[(1, "abc", None)])).toPandas()
    assert got.lang_pred.tolist() == ["und"] and got.score.tolist() == [0.0]


def test_extra_columns_stay(spark):
    rows = spark.createDataFrame([(1, "the and", "keep")], "doc_id long, text string, other string")
    got = language_id.identify(rows, [])
    assert got.columns == ["doc_id", "text", "other", "lang_pred", "score"]
    assert isinstance(pd.DataFrame(got.collect()), pd.DataFrame)


def test_groups_of_languages(spark, monkeypatch):
    """Languages worked off one, two or all at a time give the same; so do equal languages: the smaller name."""
    rows = docs(120) + [(1000 + k, t, "zz") for k, t, lang in docs(120) if lang == "de"] + [(2000, "9", None), (2001, "q", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {}
    for n in (1, 2, 16):
        monkeypatch.setattr(language_id, "LANGS_AT_ONCE", n)
        trees = language_id.train(frame)
        assert len(trees) == -(-4 // n)
        got[n] = {r["doc_id"]: (r["lang_pred"], round(r["score"], 4)) for r in language_id.identify(frame, trees).collect()}
    assert got[1] == got[2] == got[16] and got[16][2000] == ("und", 0.0)
    german = [k for k, _, lang in rows if lang in ("de", "zz")]
    assert all(got[16][k] == ("de", 0.5) for k in german)


def test_code_length_of_unknown_scripts(spark):
    """The posterior is sure of a text in no learned language; its code length is not below plain bytes."""
    trees = language_id.train(spark.createDataFrame(docs(240), "doc_id long, text string, lang string"))
    rows = [(k, t, "x") for k, (_, t, _) in enumerate(docs(30, seed=7))] + [(100, "これは日本語の文章です。" * 5, "x"), (101, "Это русский текст без перевода", "x"), (102, "", "x"), (103, None, "x")]
    got = {r["doc_id"]: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, bits string"), trees, "bits").collect()}
    assert all(got[k]["bits"] < 4 for k in range(30)) and got[100]["bits"] > 8 and got[101]["bits"] > 8
    assert got[102]["bits"] is None and got[103]["bits"] is None
    assert language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, bits string"), [], "bits").select("bits").dropna().count() == 0
