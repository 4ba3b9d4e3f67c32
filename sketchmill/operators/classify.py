"""Requests to an outside classifier and its answers. No network is ever called: requests go out and responses come in as tables."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.metrics import truncate_words
from ..functions.preprocess import preprocess
from .curate import sanitize_id

TYPES = "map<string,double>"
ANSWER = f"primary_type string, types {TYPES}, reasoning string"


def build_requests(files: DataFrame, prompt: str, model: str = "any", max_tokens: int = 500) -> DataFrame:
    """file_name, content -> custom_id, file_name, truncated, request (JSON). `{content}` in the prompt is the cleaned text."""
    cut = truncate_words(F.col("content"), preprocess(F.col("content")))
    text = F.replace(F.lit(prompt), F.lit("{content}"), F.col("_c.text"))
    params = F.struct(F.lit(model).alias("model"), F.lit(max_tokens).alias("max_tokens"), F.array(F.struct(F.lit("user").alias("role"), text.alias("content"))).alias("messages"))
    rows = files.withColumn("_c", cut).withColumn("custom_id", sanitize_id(F.col("file_name")))
    return rows.select("custom_id", "file_name", F.col("_c.truncated").alias("truncated"), F.to_json(F.struct("custom_id", params.alias("params"))).alias("request"))


def answer_json(text: Column) -> Column:
    """The first that parses of: the whole text, a fenced block, the first flat object that mentions "types"."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*\n?(.*?)\n?```", 1)
    flat = F.regexp_extract(text, r'(?s)\{[^{}]*"types"[^{}]*\}', 0)
    def parsed(c: Column) -> Column:
        return F.when(F.try_parse_json(c).isNotNull() & F.trim(c).startswith("{"), c)
    return F.coalesce(parsed(F.trim(text)), parsed(fenced), parsed(flat))


def shape_results(responses: DataFrame) -> DataFrame:
    """custom_id, result_type, text -> custom_id, primary_type, types, confidence, reasoning, parse_error, raw_response, error."""
    rows = responses.withColumn("_j", answer_json(F.col("text"))).withColumn("_a", F.from_json("_j", ANSWER))
    failed = F.col("result_type") != "succeeded"
    empty = F.coalesce(F.trim("text"), F.lit("")) == ""
    bad = ~failed & ~empty & F.col("_j").isNull()
    ok = ~failed & ~empty & ~bad
    types = F.coalesce("_a.types", F.create_map().cast(TYPES))
    return rows.select(
        "custom_id",
        F.when(ok, F.coalesce("_a.primary_type", F.lit("unclassified"))).otherwise("unclassified").alias("primary_type"),
        F.when(ok, types).otherwise(F.create_map().cast(TYPES)).alias("types"),
        F.when(ok, F.coalesce(F.array_max(F.map_values(types)), F.lit(0.0))).alias("confidence"),
        F.when(ok, F.col("_a.reasoning")).alias("reasoning"),
        bad.alias("parse_error"),
        F.when(bad, F.substring("text", 1, 500)).alias("raw_response"),
        F.when(failed, F.concat(F.lit("API error: "), "result_type")).when(empty, "Empty response").alias("error"),
    )


def classification_stats(results: DataFrame) -> DataFrame:
    """One row: total, successful, errored (errors and answers that did not parse), unparsed, truncated (where the results say so) and
    the average confidence to four places, of those that have one."""
    bad = F.col("error").isNotNull() | F.coalesce("parse_error", F.lit(False))
    cut = F.coalesce(F.col("truncated"), F.lit(False)) if "truncated" in results.columns else F.lit(False)
    return results.agg(
        F.count("*").alias("total"), F.count_if(~bad).alias("successful"), F.count_if(bad).alias("errored"), F.count_if("parse_error").alias("unparsed"), F.count_if(cut).alias("truncated"),
        F.coalesce(F.bround(F.avg("confidence"), 4), F.lit(0.0)).alias("avg_confidence"),
    )


def type_distribution(results: DataFrame) -> DataFrame:
    return results.groupBy("primary_type").agg(F.count("*").alias("n"))


#: What a feature's weight counts by tier, from decisive to weak (fixed values).
TIERS = {1: 100.0, 2: 10.0, 3: 1.0, 4: 0.1}
#: Features of the configurable scorer: name, pattern. Patterns are this library's own.
FEATURES = {
    "participant": r"(?im)^\s*(participant|activate|deactivate|autonumber)\b",
    "alt_loop": r"(?im)^\s*(alt|loop|opt|par)\b",
    "message": r"(?m)->>?\s*\S+\s*:",
    "class": r"(?im)^\s*(abstract\s+)?class\s+\S",
    "member_visibility": r"(?m)^\s*[+\-#~]\s*\w+\s*(\(|:)",
    "inheritance": r"<\|--|--\|>|<\|\.\.|\.\.\|>",
    "interface": r"(?im)^\s*interface\s+\S",
    "actor": r"(?im)^\s*actor\s+\S|(?m)^\s*:[^:\n;]+:\s",
    "usecase": r"(?im)^\s*usecase\b|(?m)(^|\s)\([A-Za-z][^)\n]*\)",
    "component": r"(?im)^\s*component\b|(?m)^\s*\[[^\]*\n]+\]",
    "port": r"(?im)^\s*port(in|out)\b",
    "node": r"(?im)^\s*node\b",
    "artifact": r"(?im)^\s*artifact\b",
    "cloud": r"(?im)^\s*(cloud|storage)\b",
    "pseudo_state": r"\[\*\]",
    "state": r"(?im)^\s*state\b",
    "flow": r"(?im)^\s*(start|stop|endif|endwhile|fork|end fork)\s*$",
    "action": r"(?m)^\s*:[^;\n]*;\s*$",
    "activity_only": r"(?im)^\s*(switch|backward|kill)\b",
    "object": r"(?im)^\s*(object|map|json)\s+\S",
    "clock": r"(?im)^\s*(robust|concise|clock)\b",
    "time": r"(?m)^@[+]?\d+",
}
#: Type, feature, weight, tier; and for weights that depend on others, the features of which one has to be there and the weight else.
#: The weights of interface, node and actor are fixed values; the others are this library's own.
DEFAULT_RULES = (
    ("sequence", "participant", 1.5, 1, (), None),
    ("sequence", "alt_loop", 2.5, 2, (), None),
    ("sequence", "message", 1.0, 3, (), None),
    ("sequence", "actor", 0.8, 3, ("message",), 0.4),
    ("class", "class", 1.5, 1, (), None),
    ("class", "member_visibility", 1.5, 1, (), None),
    ("class", "inheritance", 2.0, 2, (), None),
    ("class", "interface", 2.8, 2, ("class", "member_visibility"), 0.5),
    ("usecase", "usecase", 1.5, 1, (), None),
    ("usecase", "actor", 1.2, 2, ("usecase",), 0.4),
    ("component", "component", 1.5, 1, (), None),
    ("component", "port", 1.5, 1, (), None),
    ("component", "interface", 2.8, 2, ("component",), 0.5),
    ("component", "node", 1.8, 3, ("component",), 0.4),
    ("deployment", "artifact", 1.5, 1, (), None),
    ("deployment", "node", 2.0, 2, ("artifact",), 0.4),
    ("deployment", "cloud", 1.0, 2, (), None),
    ("state", "pseudo_state", 1.5, 1, (), None),
    ("state", "state", 1.5, 1, (), None),
    ("activity", "flow", 1.5, 1, (), None),
    ("activity", "action", 1.5, 1, (), None),
    ("activity", "activity_only", 2.0, 1, (), None),
    ("object", "object", 1.5, 1, (), None),
    ("timing", "clock", 1.5, 1, (), None),
    ("timing", "time", 1.5, 1, (), None),
)
#: Type, feature of another type that speaks against it, factor (of the ranges given for them, the middle).
DEFAULT_PENALTIES = (("sequence", "activity_only", 0.35), ("class", "port", 0.5), ("component", "artifact", 0.675))


def with_rule_scores(diagrams: DataFrame, content: str = "content", name: str = "scores", rules=DEFAULT_RULES, penalties=DEFAULT_PENALTIES, features=FEATURES, floor: float = 0.3) -> DataFrame:
    """Adds map<type, share of all weight> of the types with at least `floor`, the heaviest first (ties: the order of the rules).

    Each feature is looked for once. A rule gives its weight times its tier's; where it names other features and none of them is there,
    its other weight. Penalties multiply a type's sum.
    """
    kinds = list(dict.fromkeys(r[0] for r in rules))
    has = lambda f: F.col(f"_has_{f}")
    rows = diagrams.withColumns({f"_has_{f}": F.coalesce(F.col(content).rlike(p), F.lit(False)) for f, p in features.items()})

    def weight(rule) -> Column:
        _, feature, base, tier, needs, other = rule
        full = F.lit(base * TIERS[tier])
        if needs:
            full = F.when(functools.reduce(Column.__or__, map(has, needs)), full).otherwise(other * TIERS[4])
        return F.when(has(feature), full).otherwise(0.0)

    raw = {}
    for kind in kinds:
        total = functools.reduce(Column.__add__, [weight(r) for r in rules if r[0] == kind])
        for _, feature, factor in (p for p in penalties if p[0] == kind):
            total = total * F.when(has(feature), factor).otherwise(1.0)
        raw[f"_raw_{kind}"] = total
    rows = rows.withColumns(raw).withColumn("_all", functools.reduce(Column.__add__, [F.col(c) for c in raw]))
    shares = F.array(*[F.struct(F.coalesce(F.try_divide(F.col(f"_raw_{kind}"), F.col("_all")), F.lit(0.0)).alias("v"), F.lit(-k).alias("at"), F.lit(kind).alias("k")) for k, kind in enumerate(kinds)])
    best = F.sort_array(F.filter(shares, lambda x: x["v"] >= floor), asc=False)
    out = F.map_from_entries(F.transform(best, lambda x: F.struct(x["k"], x["v"])))
    return rows.select(*[c for c in diagrams.columns if c != name], out.alias(name))
