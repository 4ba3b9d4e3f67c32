"""Boundaries within a plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def once(rows: DataFrame, *columns: str) -> DataFrame:
    """The same rows; the named columns are computed here, once a row, whatever later steps do with them.

    The optimizer moves a filter below the projection it reads, and puts the projection's expressions into it in place of their names:
    a column that is built in several steps, each naming the last one more than once, then grows by a power of its steps. It doesn't
    move a filter below a generator whose output the filter reads, so the columns go through one that yields each row once.
    """
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in columns]
    one = F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in columns])))
    return rows.select(*kept, one).select(*[F.col(f"`{c}`") for c in rows.columns])
