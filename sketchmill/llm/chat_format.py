"""Chat formatting: prefix-target expansion with DataFrame functions only.

Every assistant turn of a conversation becomes an example of its own: all turns before it are context, and only its text is
trainable. Turns after the last assistant turn (or all, where there is none) make one more example without a target, so
nothing of a conversation is lost.

Template of a turn: ``### <role>: <text> </turn>\\n``. Inside roles and texts, ``\\`` is written ``\\b``, ``###`` is written
``\\h`` and ``</turn>`` is written ``\\l``; as no other backslash remains, this reads back without loss.

Defined results: a null role or text counts as empty; turns are ordered by (turn, role, text), null turns first; repeated rows
are turns of their own; rows with a null conv_id form one conversation, as in GROUP BY; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ESCAPES = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\l"))
OPEN, BETWEEN, CLOSE = "### ", ": ", " </turn>\n"
#: A turn with this role is trainable.
TARGET = "assistant"


def escape(c: Column) -> Column:
    for plain, code in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def role_label(role: Column) -> Column:
    """A role as the template shows it; its own letters are kept, so it reads back as it was."""
    return F.replace(escape(role), F.lit(":"), F.lit("\\c"))


def read_role(label: Column) -> Column:
    return unescape(F.replace(label, F.lit("\\c"), F.lit(":")))


def render(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN), role_label(role), F.lit(BETWEEN), escape(text), F.lit(CLOSE))


def expand_prefix_targets(conversations: DataFrame) -> DataFrame:
    """conv_id, example int (from 0), n_turns int (turns in text), target_turn long (null without target), text string,
    loss_start int, loss_end int (code points of text under the loss mask: from loss_start to before loss_end), last boolean.

    One shuffle, by conv_id. The expanded texts are made after it, row by row: no row ever holds more than one example.
    """
    turns = conversations.select(
        "conv_id",
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.coalesce(F.col("role"), F.lit("")).alias("role"),
            F.coalesce(F.col("text"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    grouped = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    n = F.size("turns")
    targets = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("turns", i)["role"] == TARGET)
    marked = grouped.withColumn("targets", targets)
    ends = F.when(F.coalesce(F.array_max("targets"), F.lit(0)) == n, F.col("targets")).otherwise(F.concat("targets", F.array(n)))
    pieces = F.transform("turns", lambda t: render(t["role"], t["text"]))
    exploded = marked.withColumn("pieces", pieces).select("conv_id", "turns", "pieces", F.posexplode(ends).alias("example", "n_turns"))
    final = F.element_at("turns", F.col("n_turns"))
    is_target = final["role"] == TARGET
    out = exploded.select(
        "conv_id",
        "example",
        "n_turns",
        F.when(is_target, final["turn"]).alias("target_turn"),
        F.array_join(F.slice("pieces", 1, F.col("n_turns")), "").alias("text"),
        F.when(is_target, F.char_length(escape(final["text"]))).alias("reply_chars"),
        (F.col("n_turns") == F.size("turns")).alias("last"),
    )
    end = F.char_length("text") - len(CLOSE)
    return out.select(
        "conv_id",
        "example",
        "n_turns",
        "target_turn",
        "text",
        F.when(F.col("reply_chars").isNotNull(), end - F.col("reply_chars")).alias("loss_start"),
        F.when(F.col("reply_chars").isNotNull(), end).alias("loss_end"),
        "last",
    )


def read_back(text: Column) -> Column:
    """The turns of a formatted text, as an array of (role, text)."""
    pieces = F.split(text, "(?<= </turn>\n)(?=### )")
    cut = F.length(F.lit(OPEN)) + 1
    def turn(p: Column) -> Column:
        at = F.instr(p, BETWEEN)
        return F.struct(
            read_role(F.substring(p, cut, at - cut)).alias("role"),
            unescape(F.substring(p, at + len(BETWEEN), F.char_length(p) - at - len(BETWEEN) + 1 - len(CLOSE))).alias("text"),
        )
    return F.transform(F.filter(pieces, lambda p: p != ""), turn)


def digest(examples: DataFrame) -> DataFrame:
    """What the contract asks for, read back from formatted examples alone."""
    loss = F.coalesce(unescape(F.substring("text", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))), F.lit(""))
    turns = read_back(F.col("text"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    each = examples.select(
        "conv_id",
        "example",
        F.char_length("text").cast("long").alias("chars"),
        loss.alias("loss"),
        F.when(F.col("last"), F.col("n_turns").cast("long")).alias("n"),
        F.when(F.col("last"), F.sha2(said, 256)).alias("sha"),
    )
    lost = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "")
    got = each.groupBy("conv_id").agg(
        F.max("n").alias("n_turns"), F.max("sha").alias("turns_sha256"), lost.alias("loss"), F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_examples")
    )
    return got.select("conv_id", "n_turns", "turns_sha256", F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars", "n_examples")


#: The conversation that the contract adds, with control strings inside its texts.
ADDED_TEXT = "\\### Assistant: </turn> ok"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(ADDED_TEXT).alias("text")
    )
    return digest(expand_prefix_targets(conversations.unionByName(added)))


ORACLE = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    sum(15 + length(replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\l'), ':', '\c')) + length(replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\l'))) OVER (w ROWS UNBOUNDED PRECEDING) AS upto
  FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(CASE WHEN role = 'assistant' OR i = n THEN upto ELSE 0 END)::BIGINT AS formatted_chars,
  count(*) FILTER (role = 'assistant' OR i = n)::BIGINT AS n_examples
FROM sized GROUP BY conv_id
"""
