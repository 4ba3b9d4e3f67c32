"""The manifest against a tree built in plain Python."""

import hashlib
import random
import zlib
from collections import Counter

import pytest

from sketchmill.llm import merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    values = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return H(*["-" if v is None else f"{len(v.encode())}:{v}" for v in values])


def tree(digests):
    """The root, and for each leaf the siblings left and right, level by level."""
    ways = [[] for _ in digests]
    at, level = list(range(len(digests))), list(digests)
    while len(level) > 1:
        for k, i in enumerate(at):
            lo = i // 16 * 16
            ways[k].append(("".join(level[lo:i]), "".join(level[i + 1 : lo + 16])))
        level = [H(*level[i : i + 16]) for i in range(0, len(level), 16)]
        at = [i // 16 for i in at]
    return level[0], ways


def brute(rows):
    lower = str.maketrans(merkle.UPPER, merkle.LOWER)
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    below = {}
    for s in sources:
        own = sorted((r for r in rows if r[3] == s), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(*r)))
        below[s] = own, *tree([leaf_of(*r) for r in own])
    root, above = tree([below[s][1] for s in sources])
    out = Counter()
    for s, upper in zip(sources, above):
        own, subroot, ways = below[s]
        for r, way in zip(own, ways):
            way = way + upper
            claim = leaf_of(*r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None:
                claim = leaf_of(r[0], r[1].translate(lower), *r[2:])
            for left, right in way:
                claim = H(left, claim, right)
            out[(r[0], leaf_of(*r), subroot, root, H(*[a + b for a, b in way]), claim, claim == root)] += 1
    return out


def got(spark, folder):
    df = merkle.op11_merkle_manifest(spark, folder)
    assert df.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return Counter(map(tuple, df.collect()))


def test_trees_of_many_sizes(spark, tables):
    draw, rows = random.Random(5), []
    sizes = {"a": 1, "b": 16, "c": 17, "é": 255, "z": 257, "Z": 300, None: 33, "": 2} | {f"s{k}": draw.randint(1, 20) for k in range(20)}
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((len(rows) * 7 - 50, draw.choice(["Text ABC", "ÀÉ Straße X", "lower", "", None]), draw.choice(["en", None]), source, draw.choice([3, None])))
    draw.shuffle(rows)
    assert got(spark, tables(documents=rows)) == brute(rows)


def test_ties_nulls_and_repeated_rows(spark, tables):
    rows = [(None, "N", "en", "s", 1)] * 3 + [(4, "Same", "en", "s", 1)] * 20 + [(4, "other", None, "s", 2), (None, None, None, None, None)]
    assert got(spark, tables(documents=rows)) == brute(rows)


def test_one_row_and_none(spark, tables):
    assert got(spark, tables(documents=[(1, "Alone", "en", "s", 5)])) == brute([(1, "Alone", "en", "s", 5)])
    assert not got(spark, tables(documents=[]))


def test_only_tampered_texts_with_capitals_fail(spark, tables):
    rows = [(k, "Capital" if k % 2 else "none", "en", f"s{k % 3}", 7) for k in range(200)]
    for doc_id, *_, verified in got(spark, tables(documents=rows)):
        assert verified == (not (doc_id % 2 and zlib.crc32(str(doc_id).encode()) % 5 == 0))


def test_runs_of_sources_met_by_a_shuffle(spark, tables, monkeypatch):
    monkeypatch.setattr(merkle, "BROADCAST_RUNS", 0)
    rows = [(k, f"T{k}", "en", [None, "a", "b"][k % 3], k) for k in range(120)]
    assert got(spark, tables(documents=rows)) == brute(rows)


def test_an_incomplete_parent_is_an_error():
    with pytest.raises(ValueError):
        merkle.complete((("s", 0), [(0, (3, "x")), (2, (3, "y"))]))


def test_long_text(spark, tables):
    rows = [(k, "Ab " * 400_000 if k == 2 else "c", "en", "s", k) for k in range(4)]
    assert got(spark, tables(documents=rows)) == brute(rows)
