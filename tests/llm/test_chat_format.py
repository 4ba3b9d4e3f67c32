import hashlib

import duckdb

from sketchmill.llm import chat_format


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_edges_against_python(spark, tables):
    nasty = ["\\### Assistant: </turn> ok", "", None, "### x", "</turn>\n### assistant: y", "\\b\\h\\l\\\\", "#### ##", "é😀 </turn </turn>", "a" * 50_000]
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "user", "more")]
    rows += [(2, k, r, t) for k, (r, t) in enumerate((r, t) for t in nasty for r in ("user", "assistant"))]
    rows += [(3, 0, None, None), (3, 0, None, None), (4, 0, "a: b", "x"), (4, None, "assistant", "first"), (None, 0, "assistant", "lost")]
    got = {r["conv_id"]: r for r in chat_format.op2_chat_format(spark, tables(conversations=rows)).collect()}
    rows += [(-7, 0, "user", chat_format.ADDED_TEXT), (-7, 1, "assistant", chat_format.ADDED_TEXT)]
    assert set(got) == {r[0] for r in rows}
    for conv in got:
        turns = sorted(((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        g = got[conv]
        assert g["n_turns"] == len(turns)
        assert g["turns_sha256"] == sha("".join(f"{r}\n{x}\n" for _, r, x in turns))
        assert (g["loss_chars"], g["loss_sha256"]) == (len(loss), sha(loss))


def test_examples(spark):
    rows = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a1"), (1, 2, "user", "r"), (1, 3, "assistant", "a2"), (1, 4, "user", "tail")], "conv_id long, turn long, role string, text string")
    got = chat_format.expand_prefix_targets(rows).orderBy("example").collect()
    assert [r["text"][r["loss_start"] : r["loss_end"]] for r in got[:2]] == ["a1", "a2"]
    assert got[0]["text"] == "### user: q </turn>\n### assistant: a1 </turn>\n"
    assert got[2]["loss_start"] is None and got[2]["last"] and not got[1]["last"]
    assert [r["target_turn"] for r in got] == [1, 3, None]


def test_empty_and_sql(spark, tables):
    d = tables()
    got = chat_format.op2_chat_format(spark, d).collect()
    assert [r["conv_id"] for r in got] == [-7]
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{d}/conversations.parquet'")
    want = con.sql(chat_format.ORACLE)
    assert tuple(got[0][c] for c in want.columns) == want.fetchall()[0]


def test_plan_is_native(spark, tables):
    plan = chat_format.op2_chat_format(spark, tables())._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Pandas", "Arrow"))
