import pytest
from pyspark.sql import functions as F

from sketchmill.functions import text
from sketchmill.operators import blocks, classify, consistency, curate, elements, images, stages, stats


def test_markers(column):
    r = column(curate.extraction_outcome, "@StartUML x @enduml", "@startuml", "none", "", None)
    assert [x["status"] for x in r] == ["valid", "invalid", "invalid", "error", "error"]
    assert [x["reason"] for x in r] == [None, "missing @enduml", "missing @startuml, missing @enduml", "Empty content", "Blob not found"]


def test_path_records(spark):
    rows = spark.createDataFrame([("a;b;c",), (" ",), ("x",), ("k;p.PUML ",)], "value string")
    assert sorted(map(tuple, curate.path_records(rows).collect())) == [("a", "b;c"), ("k", "p.PUML")]
    assert rows.where(curate.has_diagram_extension(F.trim("value"))).count() == 1


def test_blob_ids(column):
    assert column(curate.is_blob_id, "a" * 40, "A" * 40 + "\n", "g" * 40) == [True, False, False]
    assert column(curate.git_blob_id, "") == "e69de29bb2d1d6434b8b29ae775ad8c2e48c5391"


def test_first_by_key_and_batches(spark):
    rows = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 3, "z")], "k string, o int, v string")
    assert sorted(map(tuple, curate.first_by_key(rows, "k", "o").collect())) == [("a", 1, "x"), ("b", 3, "z")]
    got = curate.assign_batches(spark.range(25), 10, "id").orderBy("id").collect()
    assert [r["batch"] for r in got] == [1] * 10 + [2] * 10 + [3] * 5
    assert got[-1]["directory"] == "batch_0003"


def test_names(column):
    assert column(curate.sanitize_id, "a.b.puml", "x.puml.puml", "y" * 70) == ["a_b", "x", "y" * 64]
    assert column(curate.sanitize_path, "//a/b\\c:d") == "a_b_c_d"


def test_blocks(column):
    text = "' h\n\n@startuml\nA\n@startuml\nB\n@enduml\nzz\n @EndUml\n@StartSalt\nC\n@endfoo\n@startuml\nD"
    assert column(blocks.header, text) == "' h\n\n"
    assert column(blocks.diagram_blocks, text) == ["@startuml\nB\n@enduml\n", "@StartSalt\nC\n@endfoo\n"]
    assert column(blocks.diagram_blocks, "", "no") == [[], []]


def test_split_files(spark):
    rows = spark.createDataFrame([("s", "' h\n@startuml\nA\n@enduml\n@startuml\nB\n@enduml\n"), ("t", "@startuml\nC\n@enduml")], "stem string, content string")
    got = {r["file_name"]: r["content"] for r in blocks.split_files(rows).collect()}
    assert got == {"s_01.puml": "' h\n@startuml\nA\n@enduml\n", "s_02.puml": "' h\n@startuml\nB\n@enduml\n", "t.puml": "@startuml\nC\n@enduml"}


def test_normalize(column):
    want = {
        "@startuml foo": "@startuml", "@startuml{x}": "@startuml", "@startuml(id=1)": "@startuml(id=1)", "@startuml (id=1)": "@startuml (id=1)", "@startuml  (id=1)": "@startuml",
        "@startuml ": "@startuml ", "@STARTUML foo": "@STARTUML foo", "@startuml \\x": "@startuml \\x", "a\n@startuml b\nc": "a\n@startuml\nc",
    }
    assert column(blocks.normalize_tags, *want) == list(want.values())
    assert column(blocks.normalize_tags, *want.values()) == list(want.values())


def test_images(spark):
    shown = spark.createDataFrame([("a.png",), ("b_001.SVG",), ("c_01.png",), ("d_0001.png",), ("n.txt",)], "path string")
    puml = spark.createDataFrame([(x,) for x in ("a", "b", "b_001", "c", "d")], "stem string")
    stems = images.image_stems(shown)
    assert sorted(r[0] for r in images.with_image(puml, stems).collect()) == ["a", "b", "b_001"]
    assert sorted(r[0] for r in images.without_image(puml, stems).collect()) == ["c", "d"]
    log = spark.createDataFrame([("Error line 2 in file: /x/a.puml",), ("Error line 3 in file: /x/a.puml",), ("/x/b.puml:7:error:bad",)], "value string")
    assert tuple(images.render_stats(log, 10).first()) == (10, 1, 9, 90)
    assert images.render_stats(log.limit(0), 0).first()["percent"] == 0


@pytest.mark.parametrize(
    "kind, text, want",
    [
        ("class", "class Foo\nclass foo\nabstract class Bar as B\ninterface Baz<T>\nFoo --> Qux\nB --> Baz", {"class": 2, "abstract class": 1, "interface": 1}),
        ("sequence", "participant Alice\nAlice -> Bob : hi\nBob --> Alice: ok\ngroup G1\nCarol ->> Bob : x", {"participant": 3}),
        ("class", "participant Alice\nAlice -> Bob : hi\nBob --> Alice: ok\ngroup G1\nCarol ->> Bob : x", {"participant": 1, "group": 1, "class": 2}),
        ("component", "[Web] as W\n[Web] --> [DB]\n() API\nW --> API", {"component": 2, "interface": 1}),
        ("usecase", ":User: as U\n(Log in) as (L)\nU --> (Log in)\nU --> (Pay)", {"usecase": 2, "actor": 1}),
        ("class", "A -> B -> C", {"class": 2}),
        ("class", "abstract  class X", {"abstract class": 1}),
        ("class", "A ->xyz", {"class": 2}),
        ("state", "[*] --> S1", {}),
        ("unclassified", "class A", {}),
        ("class", "", {}),
    ],
)
def test_elements(kind, text, want):
    assert elements.count_elements(text, kind) == want


def test_bodies():
    assert elements.without_bodies("class A {\n x { y }\n}\nB -> A") == "class A { }\nB -> A"
    assert elements.without_bodies("enum E {\n open") == "enum E { }"
    assert elements.without_bodies("class A\nB -> A") == "class A\nB -> A"


def test_consistency(spark):
    cases = [
        ("sequence", 0.9, {"participant": 3}, 1.0, "sequence", 0.5, [], True),
        ("timing", 0.9, {"participant": 3}, 1.0, "sequence", 0.5, [], True),
        ("class", 0.8, {"class": 3, "actor": 1}, 0.8, "class", 1.0, ["FORBIDDEN_ELEMENTS"], False),
        ("usecase", 0.9, {"class": 2}, 0.1, "class", 1.0, ["FORBIDDEN_ELEMENTS", "MISSING_PRIMARY_ELEMENTS", "TYPE_MISMATCH", "HIGH_CONFIDENCE_MISMATCH"], False),
        ("state", 0.6, {}, 0.5, "unknown", 0.0, ["NO_ELEMENTS"], True),
        ("activity", 0.6, {}, 0.9, "unknown", 0.0, [], True),
        ("class", 0.6, {}, 0.3, "unknown", 0.0, ["NO_ELEMENTS"], False),
        ("unclassified", None, {}, 1.0, "unknown", 0.0, [], True),
        ("unclassified", None, {"class": 1}, 0.3, "class", 1.0, ["TYPE_MISMATCH", "LOW_CONFIDENCE"], False),
        ("component", 0.4, {"component": 1, "interface": 1}, 1.0, "component", 0.5714, ["LOW_CONFIDENCE"], True),
    ]
    rows = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, primary_type string, confidence double, elements map<string,int>")
    for r in consistency.validate(rows).collect():
        kind, _, _, score, suggested, sure, codes, ok = cases[r["i"]]
        assert (r["consistency_score"], r["suggested_type"], r["suggestion_confidence"], [f["code"] for f in r["flags"]], r["is_consistent"]) == (score, suggested, sure, codes, ok), kind


def test_ranks(spark):
    def run(*values):
        return tuple(stats.rank_stats(spark.createDataFrame([(v,) for v in values], "v int"), "v").first())

    assert run(1, 2, 3, 4) == (4, 1, 2, 3, 4, 4, 2.5)
    assert run(5) == (1, 5, 5, 5, 5, 5, 5.0)
    assert run() == (0, 0, 0, 0, 0, 0, 0.0)


def test_buckets(spark):
    got = stats.bucket_counts(spark.createDataFrame([(0,), (1,), (10,), (11,), (500,)], "v int"), "v").orderBy("ord").collect()
    assert [r["n"] for r in got] == [2, 1, 0, 0, 1]


def test_classifier_answers(spark):
    rows = [("a", "succeeded", '{"primary_type": "class", "types": {"class": 0.8}}'), ("b", "succeeded", "x\n```json\n{\"primary_type\": \"state\", \"types\": {}}\n```"), ("c", "succeeded", "nothing"), ("d", "succeeded", " "), ("e", "expired", None)]
    got = {r["custom_id"]: r for r in classify.shape_results(spark.createDataFrame(rows, "custom_id string, result_type string, text string")).collect()}
    assert [got[k]["primary_type"] for k in "abcde"] == ["class", "state", "unclassified", "unclassified", "unclassified"]
    assert [got[k]["confidence"] for k in "abcde"] == [0.8, 0.0, None, None, None]
    assert got["c"]["parse_error"] and got["c"]["raw_response"] == "nothing"
    assert (got["d"]["error"], got["e"]["error"]) == ("Empty response", "API error: expired")


def test_empty_frames(spark):
    empty = spark.createDataFrame([], "primary_type string, confidence double, elements map<string,int>")
    v = consistency.validate(empty)
    assert v.count() == 0 and consistency.validation_stats(v).first()["total"] == 0
    assert curate.assign_batches(spark.range(0), 10, "id").count() == 0
    assert stats.top_buckets(spark.range(0), "id").count() == 0


def test_once_keeps_filters_above(spark):
    """A filter on a column of `once` stays above it, so what the column is built of is in the plan a single time."""
    rows = spark.range(5).select("id", (F.col("id") % 3).alias("m"))
    filtered = stages.once(rows.withColumn("x", F.md5(F.col("m").cast("string"))), "x").where("x > '0' AND length(x) = 32")
    assert filtered.columns == ["id", "m", "x"] and filtered.count() == 5
    assert filtered._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 1


def test_nonempty_lines(spark):
    cases = {"": 0, "\n \n\t\n": 0, "a": 1, "a\n\n b \n\x1c\n \nc": 3, "a\rb\nc d": 2, "\x0bx\n": 1}
    rows = spark.createDataFrame([(t, n) for t, n in cases.items()] + [(None, None)], "t string, n int")
    assert [r for r in rows.select("n", text.nonempty_lines(F.col("t")).alias("got")).collect() if r.n != r.got] == []
