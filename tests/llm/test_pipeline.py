import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

import corpus_pipeline
from sketchmill.llm import queries


def build(folder, spark):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 8)))
    good = lambda: "\n".join(" ".join(word() for _ in range(12)).capitalize() + "." for _ in range(4))
    bad = lambda: "\n".join(" ".join(word().upper() + "!!" for _ in range(12)) for _ in range(4))
    rows = [(k, good(), "en") for k in range(80)] + [(100 + k, bad(), "en") for k in range(30)]
    item = " ".join(word() for _ in range(30))
    rows += [(200, rows[0][1], "en"), (201, rows[1][1] + " tail", "en"), (202, item + ".", "en"), (203, None, "en"), (204, "", None), (205, "12 34.", "en"), (206, good(), None), (None, good(), "en"), (2, rows[2][1], "en")]
    labels = [(k, int(k < 100), 0) for k in [*range(60), *range(100, 125)]]
    pq.write_table(pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows], "lang": pa.array([r[2] for r in rows], pa.string()), "source": ["s"] * len(rows), "n_chars": pa.array([0] * len(rows), pa.int64()), "score": ["extra"] * len(rows), "n_words": [1] * len(rows)}), folder / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([l[0] for l in labels], pa.int64()), "quality": pa.array([l[1] for l in labels], pa.int32()), "toxic": pa.array([l[2] for l in labels], pa.int32())}), folder / "labels.parquet")
    pq.write_table(pa.table({"item_id": pa.array([1], pa.int64()), "text": [item]}), folder / "benchmark.parquet")
    return rows


def test_stages(spark, tmp_path):
    rows = build(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids, columns = [], docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == columns, name
        docs.write.mode("overwrite").parquet(str(tmp_path / f"out-{name}"))
        docs = spark.read.parquet(str(tmp_path / f"out-{name}"))
        ids.append([r["doc_id"] for r in docs.select("doc_id").collect()])
    good = {r[0] for r in rows if r[0] is not None and (r[0] < 100 or r[0] in (200, 201, 206))}
    assert good <= set(ids[0]) and not any(d is not None and 100 <= d < 130 for d in ids[0])
    assert not {203, 204, 205} & set(ids[1]) and good <= set(ids[1])
    assert {200, 201} & set(ids[2]) == set() and ids[2].count(2) == 1 and None in ids[2]
    assert 202 not in ids[3] and set(ids[3]) == set(ids[2]) - {202}


def test_near_duplicates_by_row(spark):
    """Null ids and repeated ids: only rows of one group go."""
    words = lambda x: " ".join(f"{x}{k}" for k in range(60))
    rows = [(None, words("a")), (None, words("b")), (None, words("b")), (None, words("c") + " tail"), (1, words("c")), (5, words("d")), (5, words("e")), (5, words("e")), (5, words("c")), (3, words("d").upper())]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, text_hash string")
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert got == sorted([(None, words("a")), (None, words("b")), (1, words("c")), (3, words("d").upper()), (5, words("e"))], key=str)


def test_run_and_registry(spark, tmp_path):
    build(tmp_path, spark)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() >= 80
    assert sorted(int(q[2:].split("_")[0]) for q in queries.QUERIES) == list(range(1, 14))
    assert len(corpus_pipeline.STAGES) == 5


def test_empty(spark, tmp_path):
    build(tmp_path, spark)
    for name in ("documents", "labels", "benchmark"):
        t = pq.read_table(tmp_path / f"{name}.parquet")
        pq.write_table(t.slice(0, 0), tmp_path / f"{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
