import hashlib
import random
import re

from sketchmill.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(text, items, window=13):
    w, hit, named = words(text), set(), set()
    for item, body in items:
        b = words(body)
        n = min(window, len(b))
        if item is None or not n:
            continue
        windows = {tuple(b[k : k + n]) for k in range(len(b) - n + 1)}
        for k in range(len(w) - n + 1):
            if tuple(w[k : k + n]) in windows:
                hit.update(range(k, k + n))
                named.add(str(item))
    return len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "c", "É", "d9", "ß", "the", "x"]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, line(rng.choice([5, 13, 14, 40]))) for k in range(12)] + [(77, None), (78, "  .,"), (None, line(20)), (3, line(15)), (90, "one")]
    docs = [(k, line(rng.randrange(0, 60)) + " " + (rng.choice(items)[1] or "").upper().replace(" ", ", ") + ". " + line(rng.randrange(0, 300))) for k in range(60)]
    docs += [(100, None), (101, ""), (102, "..."), (103, items[3][1]), (103, items[3][1]), (None, items[0][1]), (104, "x " * 30_000 + items[3][1])]
    return docs, items


def test_brute_force(spark, tables):
    docs, items = corpus(1)
    got = sorted((tuple(r) for r in decontaminate.op5_decontaminate(spark, tables(documents=docs, benchmark=items)).collect()), key=str)
    assert got == sorted(((d, *brute(t, items)) for d, t in docs), key=str)


def test_blocks_give_the_same(spark):
    docs, items = corpus(2)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    rows = lambda **k: sorted((tuple(r) for r in decontaminate.judge(decontaminate.find_hits(d, b, **k)).select("doc_id", "n_words", "n_hit", "items").collect()), key=str)
    assert rows() == rows(block_words=30)


def test_any_window(spark):
    """Also windows wider than a key's usual 16 words, and of one word."""
    docs, items = corpus(4)
    long = " ".join(f"w{k % 37}" for k in range(60))
    docs = docs + [(200, long), (201, " ".join(long.split()[:16] + ["other"] + long.split()[17:36])), (202, "one and one")]
    items = items + [(60, long)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    for window in (1, 2, 17, 20, 40):
        got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"]) for r in decontaminate.judge(decontaminate.find_hits(d, b, window)).collect()), key=str)
        assert got == sorted(((i, *brute(t, items, window)[:3]) for i, t in docs), key=str), window


def test_longest_matches(spark):
    docs, items = corpus(3)
    got = {(r["item_id"], r["item_word"]): (r["longest"], r["doc_id"], r["doc_word"]) for r in decontaminate.longest_matches(spark.createDataFrame([d for d in docs if d[0] is not None], "doc_id long, text string"), spark.createDataFrame([i for i in items if i[0] != 3], "item_id long, text string")).collect()}
    texts = {d: words(t) for d, t in docs if d is not None}

    def common(a, b):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        return n

    for item, body in items:
        if item in (None, 3) or not words(body):
            continue
        w = words(body)
        for k in range(0, len(w), 5):
            best = max((common(w[k:], t[p:]) for t in texts.values() if len(t) < 5000 for p in range(len(t))), default=0)
            if best >= 13:
                n, doc, place = got[(str(item), k)]
                assert n >= best and w[k : k + n] == texts[doc][place : place + n]
                if doc != 104:
                    assert n == best


def test_removal_and_empty(spark, tables):
    d = tables()
    assert decontaminate.op5_decontaminate(spark, d).count() == 0
    text = " ".join(f"w{k}" for k in range(20))
    docs = spark.createDataFrame([(1, text, "a"), (2, "clean words here", "b")], "doc_id long, text string, extra string")
    bench = spark.createDataFrame([(1, text)], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.remove_contaminated(docs, bench).collect()] == [(2, "clean words here", "b")]
    assert decontaminate.remove_contaminated(docs, bench.limit(0)).count() == 2
