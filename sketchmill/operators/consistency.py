"""Does a diagram's label agree with its elements? All rules are expressions over the map of element counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .stages import once

#: Element types that are primary, allowed or forbidden in each diagram type (fixed values); the order settles ties.
TABLE = {
    "sequence": (
        ["participant", "actor", "boundary", "control", "entity", "database", "collections", "queue"],
        ["box"],
        ["class", "interface", "enum", "abstract class", "state", "usecase", "component", "node", "artifact"],
    ),
    "class": (
        ["class", "abstract class", "interface", "enum", "annotation", "struct", "protocol", "exception", "metaclass"],
        ["package", "namespace", "rectangle"],
        ["participant", "actor", "state", "usecase", "node", "artifact", "component"],
    ),
    "usecase": (["actor", "usecase"], ["rectangle", "package"], ["class", "interface", "participant", "state", "component", "node", "artifact"]),
    "component": (["component", "interface"], ["package", "folder", "frame", "cloud", "database", "node", "rectangle"], ["class", "participant", "actor", "state", "usecase"]),
    "deployment": (
        ["node", "artifact", "cloud", "database", "storage", "file", "folder", "frame", "component"],
        ["rectangle", "package", "card", "agent", "stack"],
        ["class", "participant", "actor", "usecase", "state"],
    ),
    "state": (["state"], ["rectangle", "partition"], ["class", "participant", "actor", "usecase", "component", "node", "artifact"]),
    "activity": (["partition"], ["rectangle", "group"], ["class", "participant", "state", "usecase", "component", "node", "artifact"]),
    "object": (["object", "map", "json"], ["package", "rectangle", "diamond"], ["class", "interface", "participant", "actor", "state", "usecase", "component", "node"]),
    "timing": (["participant"], [], ["class", "interface", "actor", "state", "usecase", "component", "node", "artifact"]),
}
SEVERITY = {"info": 0, "warning": 1, "error": 2}
THRESHOLD = 0.5


def _literal_map(values: dict) -> Column:
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])


def _type_number(kind: Column) -> Column:
    """The place of a type in the table, from 0; -1 if it has none."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, TABLE)), kind), F.lit(0)).cast("int") - 1


def with_sums(analysis: DataFrame, kind: str = "primary_type", counts: str = "elements") -> DataFrame:
    """Adds _total (elements), _known (is the diagram's type in the table), _primary, _allowed, _forbidden (what its own type says of the
    elements) and _scores: array<struct<score, at, type>> of all types.

    The table is one map from an element to its weights, three for each type; a row's elements look up their weights, which are summed as
    one array. So the plan's size doesn't grow with the table.
    """
    parts = [part for of_type in TABLE.values() for part in of_type]
    names = sorted({e for part in parts for e in part})
    weights = _literal_map({e: F.array(*[F.lit(int(e in part)) for part in parts]) for e in names})
    none = F.array_repeat(F.lit(0), len(parts))
    map_ = F.coalesce(F.col(counts), F.create_map().cast("map<string,int>"))

    def add(sums: Column, entry: Column) -> Column:
        own = F.coalesce(F.try_element_at(weights, entry["key"]), none)
        return F.zip_with(sums, own, lambda x, w: x + w * entry["value"])

    rows = analysis.withColumn("_total", F.aggregate(F.map_values(map_), F.lit(0), lambda x, v: x + v)).withColumn("_sums", F.aggregate(F.map_entries(map_), none, add))
    rows = once(rows.withColumn("_number", _type_number(F.col(kind))), "_total", "_sums", "_number")

    def own(k: int) -> Column:
        return F.when(F.col("_number") < 0, F.lit(0)).otherwise(F.get("_sums", 3 * F.col("_number") + k))

    def score(t: Column) -> Column:
        share = lambda k: F.try_divide(F.get("_sums", 3 * t + k), F.col("_total"))
        return F.greatest(F.lit(0.0), F.coalesce(share(0) - 0.5 * share(2), F.lit(0.0)))

    # `at` falls, so that the first of equals is the greatest
    numbers, types = F.array(*map(F.lit, range(len(TABLE)))), F.array(*map(F.lit, TABLE))
    scores = F.transform(numbers, lambda t: F.struct(score(t).alias("score"), (-t).alias("at"), F.get(types, t).alias("type")))
    return rows.select(*analysis.columns, "_total", (F.col("_number") >= 0).alias("_known"), own(0).alias("_primary"), own(1).alias("_allowed"), own(2).alias("_forbidden"), scores.alias("_scores"))


def consistency_score(kind: Column) -> Column:
    """Of rows with_sums."""
    total = F.col("_total")
    mixed = 0.4 * F.try_divide(F.col("_primary") + F.col("_allowed"), total) + 0.4 * (1 - F.least(F.lit(1.0), F.try_divide(F.col("_forbidden"), total))) + 0.2 * F.when(F.col("_primary") > 0, 1.0).otherwise(0.5)
    empty = F.when(kind == "activity", 0.9).when(kind == "state", 0.5).otherwise(0.3)
    return F.when(kind == "unclassified", F.when(total == 0, 1.0).otherwise(0.3)).when(~F.col("_known"), 0.0).when(total == 0, empty).otherwise(F.bround(mixed, 4))


def two_places(c: Column) -> Column:
    return F.format_string("%.2f", F.bround(c, 2))


def flags(kind: Column, counts: Column, confidence: Column) -> Column:
    """array<struct<code, severity, details>> in rule order, of rows with consistency_score, suggested_type and suggestion_confidence."""
    score, suggested, sure_of = F.col("consistency_score"), F.col("suggested_type"), F.col("suggestion_confidence")

    def flag(code: str, severity: str, when: Column, *details) -> Column:
        said = F.concat(*[F.lit(x) if isinstance(x, str) else x for x in details])
        return F.when(when, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), said.alias("details")))

    banned = F.try_element_at(_literal_map({t: F.array(*map(F.lit, forbidden_)) for t, (_, _, forbidden_) in TABLE.items()}), kind)
    shown = F.try_element_at(_literal_map({t: F.lit("[" + ", ".join(f"'{e}'" for e in primary[:3]) + "]") for t, (primary, _, _) in TABLE.items()}), kind)
    held = F.filter(F.map_entries(counts), lambda e: F.array_contains(banned, e["key"]))
    listed = F.concat(F.lit("{"), F.array_join(F.transform(held, lambda e: F.concat(F.lit("'"), e["key"], F.lit("': "), e["value"].cast("string"))), ", "), F.lit("}"))
    forbidden = F.col("_forbidden") > 0
    mismatch = (suggested != kind) & (suggested != "unknown") & (sure_of > 0.5)
    sure = (confidence >= 0.7) & (score < 0.5)
    rules = F.array_compact(
        F.array(
            flag("FORBIDDEN_ELEMENTS", "error", forbidden, "Found forbidden elements: ", listed),
            flag("MISSING_PRIMARY_ELEMENTS", "warning", F.col("_known") & (F.col("_primary") == 0), "No primary elements (", shown, "...) found"),
            flag("TYPE_MISMATCH", "error", mismatch, "Elements suggest ", suggested, " (conf: ", two_places(sure_of), ") not ", kind),
            flag("HIGH_CONFIDENCE_MISMATCH", "error", sure, "High classification confidence (", two_places(confidence), ") but low consistency (", two_places(score), ")"),
            flag("LOW_CONFIDENCE", "info", confidence < 0.5, "Classification confidence ", two_places(confidence), " below 0.5 threshold"),
            flag("MULTI_TYPE_AMBIGUOUS", "info", (score < 0.7) & ~(forbidden | mismatch | sure), "Elements not strongly aligned with any single type"),
        )
    )
    none = F.array_compact(F.array(flag("NO_ELEMENTS", "warning", ~kind.isin("activity", "unclassified"), "No elements detected for ", kind, " diagram")))
    return F.when(F.col("_total") == 0, none).otherwise(rules)


def validate(analysis: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """analysis: primary_type, elements, confidence, ... -> consistency_score, suggested_type, suggestion_confidence, flags, is_consistent."""
    kind = F.col("primary_type")
    summed = with_sums(analysis)
    whole = F.aggregate("_scores", F.lit(0.0), lambda x, s: x + s["score"])
    scored = summed.withColumn("consistency_score", consistency_score(kind)).withColumn("_best", F.array_max("_scores")).withColumn("_whole", whole)
    found = F.col("_best.score") > 0
    guessed = scored.withColumn("suggested_type", F.when(found, F.col("_best.type")).otherwise("unknown"))
    guessed = guessed.withColumn("suggestion_confidence", F.when(found, F.bround(F.try_divide(F.col("_best.score"), F.col("_whole")), 4)).otherwise(0.0))
    flagged = guessed.withColumn("flags", flags(kind, F.coalesce("elements", F.create_map().cast("map<string,int>")), F.coalesce("confidence", F.lit(0.0))))
    verdict = (F.col("consistency_score") >= threshold) & ~F.exists("flags", lambda f: f["severity"] == "error")
    found = ("consistency_score", "suggested_type", "suggestion_confidence", "flags", "is_consistent")
    return once(flagged.withColumn("is_consistent", verdict).select(*analysis.columns, *found), *found)


def at_least(validated: DataFrame, severity: str) -> DataFrame:
    """Rows with a flag of that severity or a higher one."""
    names = [s for s, k in SEVERITY.items() if k >= SEVERITY[severity]]
    return validated.where(F.exists("flags", lambda f: f["severity"].isin(names)))


def inconsistent(validated: DataFrame) -> DataFrame:
    return validated.where(~F.col("is_consistent"))


def confusion_matrix(validated: DataFrame) -> DataFrame:
    return validated.where("primary_type <> ''").groupBy(F.col("primary_type").alias("classified"), F.col("suggested_type").alias("suggested")).agg(F.count("*").alias("n"))


def validation_stats(validated: DataFrame) -> DataFrame:
    """One row: total, consistent, inconsistent, rate and average score (four places), and flags by severity (rows are counted before any filter)."""
    flagged = lambda s: F.coalesce(F.sum(F.size(F.filter("flags", lambda f: f["severity"] == s))), F.lit(0)).alias(s + "s")
    return validated.agg(
        F.count("*").alias("total"), F.count_if("is_consistent").alias("consistent"), F.count_if(~F.col("is_consistent")).alias("inconsistent"),
        F.coalesce(F.bround(F.avg(F.col("is_consistent").cast("double")), 4), F.lit(0.0)).alias("rate"), F.coalesce(F.bround(F.avg("consistency_score"), 4), F.lit(0.0)).alias("avg_score"),
        *[flagged(s) for s in SEVERITY],
    )


def flag_counts(validated: DataFrame) -> DataFrame:
    return validated.select(F.explode("flags").alias("f")).groupBy("f.code", "f.severity").agg(F.count("*").alias("n"))
