"""Exact order statistics of a column by distributed selection.

Each round cuts the interval that holds a wanted rank into BUCKETS parts and counts rows by part (map-side, so that a task sends a row a
part); the part that holds the rank, between its least and its largest value, is the next round's interval. Rows are never sorted, and no
task sees more than counts. Rounds end once an interval holds one value: after two or three on usual columns, and on 64-bit integers
after six at most.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 4096


@dataclass(frozen=True)
class Summary:
    """n counts what isn't null; NaN counts as a value and is the largest. least, most and total leave out NaN and infinities."""

    n: int
    least: float | int | None
    most: float | int | None
    low: int  # rows at minus infinity
    high: int  # rows at plus infinity
    nan: int


def _finite(c: Column, kind: T.DataType) -> Column:
    return ~F.isnan(c) & (F.abs(c) < math.inf) if isinstance(kind, (T.DoubleType, T.FloatType)) else F.lit(True)


def summarize(rows: DataFrame, column: str) -> Summary:
    c, kind = F.col(column), rows.schema[column].dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        odd = [F.count_if(c == -math.inf), F.count_if((c == math.inf) & ~F.isnan(c)), F.count_if(F.isnan(c))]
    elif isinstance(kind, T.IntegralType):
        odd = [F.lit(0)] * 3
    else:
        raise TypeError(f"{column} is of type {kind.simpleString()}; order statistics need a number")
    whole = F.when(_finite(c, kind), c)
    got = rows.agg(F.count(c).alias("n"), F.min(whole).alias("a"), F.max(whole).alias("b"), *[x.alias(k) for x, k in zip(odd, ("low", "high", "nan"))]).first()
    return Summary(got["n"], got["a"], got["b"], got["low"], got["high"], got["nan"])


def _part(name: str, lo, hi, integral: bool) -> Column:
    """The part of [lo, hi] that a value lies in: it never falls as the value rises."""
    c = F.col(name)
    if integral:
        if hi - lo >= 1 << 62:  # the difference of two values may not fit a long
            return F.shiftright(c.cast("long"), 52)
        return F.expr(f"(CAST(`{name}` AS long) - ({lo}L)) div {(hi - lo) // BUCKETS + 1}L")
    width = hi / 2 / BUCKETS - lo / 2 / BUCKETS  # halves: the difference of two doubles may be infinite
    part = F.floor((c.cast("double") / 2 - F.lit(lo / 2)) / F.lit(width)) if width > 0 else F.when(c > lo, F.lit(1)).otherwise(F.lit(0))
    return F.least(part.cast("long"), F.lit(BUCKETS).cast("long"))


def select_ranks(rows: DataFrame, column: str, ranks: list[int], known: Summary | None = None) -> list:
    """The values at these ranks (from 0) of the column's values in ascending order; nulls take no part."""
    known = known or summarize(rows, column)
    if any(not 0 <= r < known.n for r in ranks):
        raise ValueError(f"ranks {ranks} of {known.n} values")
    kind = rows.schema[column].dataType
    integral, c = isinstance(kind, T.IntegralType), F.col(column)
    done: dict[int, float | int] = {}
    open_: dict[int, tuple] = {}  # rank -> (lo, hi, rows below lo)
    for r in ranks:
        if r < known.low:
            done[r] = -math.inf
        elif r >= known.n - known.nan:
            done[r] = math.nan
        elif r >= known.n - known.nan - known.high:
            done[r] = math.inf
        else:
            open_[r] = (known.least, known.most, known.low)
    while open_:
        for r, (lo, hi, _) in list(open_.items()):
            if lo == hi:
                done[r] = lo
                del open_[r]
        spans = sorted({x for x in open_.values()})
        if not spans:
            break
        which = F.lit(None).cast("int")
        part = F.lit(None).cast("long")
        for k, (lo, hi, _) in enumerate(spans):  # intervals of different ranks are equal or apart
            inside = c.between(lo, hi)
            which, part = F.when(inside, k).otherwise(which), F.when(inside, _part(column, lo, hi, integral)).otherwise(part)
        cut = rows.where(_finite(c, kind)).select(which.alias("k"), part.alias("part"), c.alias("v")).where("k IS NOT NULL")
        counts = cut.groupBy("k", "part").agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).collect()  # a row a part
        for r, span in open_.items():
            below, k = span[2], spans.index(span)
            for x in sorted((x for x in counts if x["k"] == k), key=lambda x: x["part"]):
                if r < below + x["n"]:
                    open_[r] = (x["a"], x["b"], below)
                    break
                below += x["n"]
    return [done[r] for r in ranks]
