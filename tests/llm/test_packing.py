import zlib
from collections import Counter

import numpy as np
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from sketchmill.llm import packing


def reference_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.default_tokenizer_path())
    return [t.encode(x, add_special_tokens=False).ids + [2] for x in texts]


def test_pieces_and_slots(spark, tables):
    texts = ["", None, "hello world", "hello world", "<|endoftext|> don't\n\n  x", "é😀 ß " * 700, "word " * 4000, "\t   tail"]
    docs = [(k, t) for k, t in enumerate(texts)] + [(2, "hello world"), (None, "no id")]
    got = packing.op9_best_fit_packing(spark, tables(documents=docs)).toPandas()
    want = Counter()
    for (doc, text), ids in zip(docs, reference_ids([t or "" for _, t in docs])):
        first = len(ids) % 1024 or min(1024, len(ids))
        cuts = [0, *range(first, len(ids), 1024), len(ids)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            want[(doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    key = lambda r: (None if np.isnan(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32)
    assert Counter(map(key, got.itertuples())) == want
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == np.append(0, s.length.cumsum())[:-1].tolist() and s.length.sum() <= 1024


def test_long_text_in_runs(monkeypatch):
    text = "The quick brown fox's tail, isn't it?  A\n\nB " * 300
    whole = packing.encode(packing.default_tokenizer_path(), text).tolist()
    monkeypatch.setattr(packing, "RUN_CHARS", 97)
    assert packing.encode(packing.default_tokenizer_path(), text).tolist() == whole


PARTS = st.one_of(st.text(max_size=12), st.sampled_from(["<|endoftext|>", "<|endoftext", "|>", " ", "  ", "\n", "\r\n", "don't", "'LL", "\u00a0", "\u2028", "é", "e\u0301", "😀", "１２", "٣", "aaaa" * 50, "\x00", "\u200d", "ﬁ"]))


@settings(max_examples=400, deadline=None)
@given(st.lists(PARTS, max_size=12).map("".join))
def test_ids_of_any_text(text):
    assert packing.encode(packing.default_tokenizer_path(), text).tolist() + [2] == reference_ids([text])[0]


RUNS = st.sampled_from([" ", "\n", "\t", "\r\n", "\u00a0", "\u3000", " \n", "\x85", "\x1c", "\u200b", "a", "1", "-", "é"]).flatmap(lambda c: st.integers(0, 12).map(lambda n: c * n))


@settings(max_examples=400, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(PARTS, RUNS), max_size=10).map("".join))
def test_runs_of_white_space(monkeypatch, text):
    monkeypatch.setattr(packing, "LONG_BLANKS", 4)
    assert packing.encode(packing.default_tokenizer_path(), text).tolist() + [2] == reference_ids([text])[0]


def test_runs_of_a_million(spark, tables):
    """Runs of one class, alone, before and after words and added tokens, through Spark."""
    n = 1_000_000
    texts = [c * n for c in (" ", "\n", "\t", "\u00a0", "a", "1", "-")] + [" \n" * n, "x" + " " * n + "y", " " * n + "<|endoftext|>" + "\n" * n + "z", "\u3000 \t\n" * (n // 4) + ".", "w" * n + " " * n]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = packing.token_pieces(docs, capacity=1 << 30, keep_ids=True).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert np.frombuffer(r["ids"], "<u4").tolist() == reference_ids([texts[r["doc_id"]]])[0]


def test_ids_of_documents(spark):
    """All texts of the sf0.01 table, as the tokenizers library reads them."""
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    path = packing.default_tokenizer_path()
    assert all(packing.encode(path, t).tolist() + [2] == ids for t, ids in zip(texts, reference_ids(texts)))


def test_files_that_mean_something_else(tmp_path):
    """A file that the faster library would read otherwise goes through the tokenizers library."""
    import json

    from tokenizers import Tokenizer

    with open(packing.default_tokenizer_path(), encoding="utf-8") as f:
        spec = json.load(f)
    assert packing._plain_bpe(spec)
    changes = [
        lambda s: s["pre_tokenizer"].update(add_prefix_space=True),
        lambda s: s["added_tokens"][0].update(rstrip=True),
        lambda s: s["model"]["merges"].reverse(),
        lambda s: s.update(normalizer={"type": "Lowercase"}),
    ]
    for k, change in enumerate(changes):
        other = json.loads(json.dumps(spec))
        change(other)
        assert not packing._plain_bpe(other)
        path = str(tmp_path / f"{k}.json")
        with open(path, "w", encoding="utf-8") as f:
            json.dump(other, f)
        text = "Hello There <|endoftext|>  and more"
        assert packing.encode(path, text).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), min_size=1))
def test_plan_is_best_fit(histogram):
    """The same number of sequences as best-fit decreasing over single items, and every slot is filled once."""
    room, plan = [], packing.plan_best_fit(histogram, 40)
    for length in sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True):
        fits = [k for k, r in enumerate(room) if r >= length]
        if fits:
            room[min(fits, key=lambda k: room[k])] -= length
        else:
            room.append(40 - length)
    used: dict[int, list] = {}
    for length, count in histogram.items():
        rows = plan[plan[:, 0] == length]
        for rank in range(count):
            _, first, per, seq, at = rows[np.searchsorted(rows[:, 1], rank, "right") - 1]
            used.setdefault(int(seq + (rank - first) // per), []).append((int(at + (rank - first) % per * length), length))
    assert len(used) == len(room)
    for slots in used.values():
        ends = np.cumsum([n for _, n in sorted(slots)])
        assert [o for o, _ in sorted(slots)] == [0, *ends[:-1].tolist()] and ends[-1] <= 40


def test_assemble(spark):
    docs = spark.createDataFrame([(k, "a b c " * (k % 7 * 40)) for k in range(30)], "doc_id long, text string")
    packed = packing.pack(docs, keep_ids=True)
    rows = packing.assemble(packed).collect()
    assert sum(len(r["ids"]) for r in rows) == 4 * sum(len(i) for i in reference_ids(["a b c " * (k % 7 * 40) for k in range(30)]))


def test_empty(spark, tables):
    assert packing.op9_best_fit_packing(spark, tables()).count() == 0
