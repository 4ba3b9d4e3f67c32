from pyspark.sql import functions as F

from sketchmill.functions import metrics, preprocess, text


def test_strip_and_lines(column):
    assert column(text.strip, " \t\x1c a b  \n") == "a b"
    assert column(text.nonempty_lines, "a\n \n\t\n\x1c\nb\n", "", "x") == [2, 0, 1]
    assert column(text.line_count, "a\n\n") == 3
    assert column(text.words, "  a  b\nc ") == ["a", "b", "c"]
    assert column(text.words, " ") == []


def test_base64(column):
    assert column(lambda c: text.utf8(text.decode_base64(c)), "w6k=", "w 6 k=", "YQ", "/w==", "") == ["é", "é", None, "", ""]
    assert column(lambda c: text.utf8(text.decode_base64(c), "replace"), "/w==") == "�"
    assert "\n" not in column(text.encode_base64, "x" * 300)


def test_inline_comments(column):
    same = ["Alice's x", 'say "\' a" ok', "a 'text' b", 'x "q \' open', 'a "s"\'', "x '\"y\""]
    assert column(preprocess.strip_inline_comment, *same) == same
    cut = {"A -> B ' hi": "A -> B", "tail '": "tail", "p 'q' r ' c": "p 'q' r", 'x "a" \' "b"': 'x "a"', "' all": ""}
    assert column(preprocess.strip_inline_comment, *cut) == list(cut.values())
    assert column(preprocess.strip_inline_comment, "y" * 60_000 + " ' c") == "y" * 60_000


def test_cleaning(column):
    assert column(preprocess.strip_comments, "a\n' c\nb /' x\ny '/ d") == "a\n\nb  d"
    assert column(preprocess.strip_styling, "skinparam class {\n A b\n}\nclass X\nhide\nclass Y\nshow z") == "\nclass X\n\n"
    assert column(preprocess.strip_notes, 'note left: hi\nA\nnote right of B\n text\nend note\nnote "x" as N1\nnote over C,D : t') == "\nA\n\nnote over C,D : t"
    assert column(preprocess.strip_frames, "title\nclass Foo\nclass Bar") == "\nclass Bar"
    assert column(preprocess.preprocess, "A -> B\nB -> A") == "A -> B\nB -> A"


def test_loc(column):
    raw = "' Blob ID: x\n' Original Path: y\n' Source: z\n\n@startuml T\nA -> B ' c\n\n' z\n/' m\nn '/\n@enduml\n"
    m = column(metrics.loc_metrics, raw)
    assert (m["loc"], m["total_lines"], m["blank_lines"], m["comment_lines"]) == (2, 12, 4, 1)


def test_arrows(column):
    want = {
        "A -> B": 1, "A *-- B": 1, "A -->> B": 1, "A o-- B": 1, "A <-- B": 1, "A *--> B": 2, "A <--> B": 1, "A o--> B": 2, "A -- B": 0, "A --o B": 1, "A .. B": 0, "A --other": 0,
        "A ..> B": 1, "A <-left-> B": 2, "A <|-- B": 1, "A -up-> B": 1, "A ..|> B": 1, 'A "1" --> "0..*" B': 2, "A ->x B": 1, "to-do list": 1, "@startuml -> x": 0, "!define A ->": 0,
    }
    assert column(metrics.arrow_count, *want) == list(want.values())


def test_truncation(column):
    r = column(lambda c: metrics.truncate_words(c, c, 3, 2), "a b c", "a b c d", "")
    assert [(x["text"], x["truncated"]) for x in r] == [("a b c", False), ("a b", True), ("", False)]


def test_ignored_bytes_are_the_bad_ones_alone(spark):
    """As Python's decoder ignores them, also where U+FFFD and the marks that stand for it occur in the text itself."""
    import random

    draw = random.Random(6)
    pieces = [b"a", "é".encode(), b"\xff", b"\xc3", b"\xe2\x82", "\ufffd".encode(), "\ue000".encode(), "\ue001".encode(), "\ue002".encode(), "😀".encode(), b"\xf0\x9f", b"\xed\xa0\x80"]
    rows = [b"".join(draw.choice(pieces) for _ in range(draw.randint(0, 9))) for _ in range(400)]
    frame = spark.createDataFrame([(bytearray(r),) for r in rows], "b binary")
    assert all(r["t"] == bytes(r["b"]).decode(errors="ignore") for r in frame.select("b", text.utf8(F.col("b"), "ignore").alias("t")).collect())
