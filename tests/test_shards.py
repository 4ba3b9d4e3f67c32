"""Numbered lines against files read in plain Python."""

import bz2
import gzip
import random

import pytest
from pyspark.sql import functions as F

from sketchmill.operators import curate
from sketchmill.sources import shards


def plain(data: bytes) -> list[bytes]:
    lines = data.split(b"\n")
    return lines[:-1] if lines[-1] == b"" else lines


def made(folder):
    draw, files = random.Random(2), {}
    for k in range(6):
        data = b"".join("".join(draw.choice("aé\r;x") for _ in range(draw.choice([0, 3, 40, 900]))).encode() + b"\n" for _ in range(draw.randint(0, 80)))
        files[f"p{k}.txt"] = data + draw.choice([b"", b"open end", b"\n\n"])
    files["long.txt"] = b"a" * 5000 + b"\n" + b"b" * 5000 + b"\nc\n"
    files["empty.txt"] = b""
    for name, data in files.items():
        (folder / name).write_bytes(data)
    with gzip.open(folder / "z1.gz", "wb") as f:
        f.write(b"one\ntwo\n")
    with open(folder / "z1.gz", "ab") as f:  # a second member, as joined archives have
        f.write(gzip.compress(b"three\nfour"))
    (folder / "z2.bz2").write_bytes(bz2.compress(b"x\n\ny\n"))
    return files | {"z1.gz": b"one\ntwo\nthree\nfour", "z2.bz2": b"x\n\ny\n"}


@pytest.mark.parametrize("block", [300, 1000, 1 << 20])
def test_numbers_whatever_the_blocks(spark, tmp_path, block):
    files = made(tmp_path)
    got = shards.numbered_lines(spark, str(tmp_path), overall=True, block_bytes=block).collect()
    want, at = set(), 0
    for name in sorted(files):
        for k, line in enumerate(plain(files[name])):
            at += 1
            want.add((name, k + 1, at, line.decode()))
    assert {(r["shard"].rsplit("/", 1)[1], r["line_no"], r["row_no"], r["value"]) for r in got} == want
    assert len(got) == len(want) and all(r["reason"] is None for r in got)


def test_small_pieces(tmp_path, monkeypatch):
    """Lines over piece borders, read without Spark."""
    monkeypatch.setattr(shards, "PIECE_BYTES", 3)
    data = b"ab\nc\n\nlonger line\nz"
    (tmp_path / "f").write_bytes(data)
    for block in (1, 2, 3, 5, 50):
        reader = shards.LineReader({"shards": f'[["{tmp_path}/f", {len(data)}]]', "blockSize": str(block)})
        lines = [v for p in reader.partitions() for b in reader.read(p) for v in b.column("value").to_pylist()]
        assert lines == [x.decode() for x in plain(data)]


def test_bad_rows_are_rows(spark, tmp_path):
    (tmp_path / "bad.txt").write_bytes(b"fine\nb\xffd\nfine too\n")
    whole = gzip.compress(b"line\n" * 50_000)
    (tmp_path / "cut.gz").write_bytes(whole[: len(whole) // 2])
    rows = shards.numbered_lines(spark, str(tmp_path), overall=True).collect()
    bad = {r["line_no"]: r for r in rows if r["shard"].endswith("bad.txt")}
    assert bad[2]["reason"] == "bad UTF-8 at byte 1" and bad[2]["value"] == "b�d" and bad[3]["reason"] is None
    cut = sorted((r for r in rows if r["shard"].endswith("cut.gz")), key=lambda r: r["line_no"])
    assert cut[-1]["reason"].startswith("unreadable") and cut[-1]["value"] is None
    assert all(r["reason"] is None and r["value"] == "line" for r in cut[:-2])
    assert sorted(r["row_no"] for r in rows) == list(range(1, len(rows) + 1))


def test_missing_shard(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        shards.numbered_lines(spark, str(tmp_path / "none"))


def test_no_sort_and_no_shuffle_of_text(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"k{i % 7};v{i}\n" for i in range(1000)))
    lines = shards.numbered_lines(spark, str(tmp_path), overall=True, block_bytes=100)
    plan = lines._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan and "BroadcastHashJoin" in plan
    firsts = curate.first_by_key(curate.path_records(lines.drop("reason", "row_no")), "blob_id", "shard", "line_no")
    assert {r["blob_id"]: (r["line_no"], r["file_path"]) for r in firsts.collect()} == {f"k{i}": (i + 1, f"v{i}") for i in range(7)}


def test_an_index_that_is_kept(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"{i}\n" for i in range(500)))
    index = shards.count_lines(spark, str(tmp_path), block_bytes=64)
    assert index.agg(F.sum("n")).first()[0] == 500
    lines = shards.numbered_lines(spark, str(tmp_path), block_bytes=64, index=index)
    assert all(int(r["value"]) + 1 == r["line_no"] for r in lines.collect())
