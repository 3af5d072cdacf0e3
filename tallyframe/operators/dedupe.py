"""Deterministic dedupe / latest-row operators (CL-17, WN-02…04, WN-07, JN-04).

Input order does not exist in Spark, so "first"/"last" always take an explicit order with
key tiebreaks.  Implemented as ``row_number() = 1``: Spark keeps the first row of each key inside
every task before the shuffle (WindowGroupLimit), so a hot key (one account holding a third of all
rows) is not sorted whole in one task, and columns that nobody reads are not carried along, as they
were in the struct of a ``max_by``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import col


def _order_by(order: Sequence, last: bool) -> list:
    """Sort keys of ``order``, for the greatest row first if ``last``; a (column, "desc") part counts negated."""
    out = []
    for o in order:
        c, direction = o if isinstance(o, tuple) else (o, "asc")
        c = -col(c) if direction == "desc" else col(c)
        out.append(c.desc_nulls_last() if last else c.asc_nulls_first())
    return out


def _first_row(df: DataFrame, keys: Sequence[str], order: list, cols: Sequence[str] | None) -> DataFrame:
    cols = list(cols) if cols is not None else [c for c in df.columns if c not in keys]
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__place", place).where(F.col("__place") == 1).select(*keys, *[F.col(c) for c in cols])


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence, cols: Sequence[str] | None = None) -> DataFrame:
    """WN-02/03/07: one row per key, the greatest by ``order`` (NULLs in order sort first)."""
    return _first_row(df, keys, _order_by(order, True), cols)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence, cols: Sequence[str] | None = None) -> DataFrame:
    """CL-17 / WN-07: one row per key, the smallest by ``order``."""
    return _first_row(df, keys, _order_by(order, False), cols)


def latest_per(df: DataFrame, key: str, order: Sequence, value_cols: Sequence[str]) -> DataFrame:
    """WN-04 / JN-04 helper: latest values per key (as-of-latest lookup table)."""
    return keep_last(df, [key], order, value_cols)
