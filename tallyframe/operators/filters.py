"""Predicates and filters (FL-01…11).

Presets and default populations are resolved first, by one aggregate whose single row
(two dates, two flags) comes to the driver; the filter itself then holds literals on bare
columns, so partitions are pruned and Parquet row groups skipped.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import col, in_month, utrim

PRESETS = ("all", "this_month", "last_month", "last_7", "last_30", "custom")


def preset_bounds(df: DataFrame, date_col: str, preset: str, start=None, end=None) -> DataFrame:
    """FL-01: one row (start_d, end_d, month) relative to the max date in the data.

    ``custom`` bounds are clamped to the data range and swapped when reversed.  ``month`` is
    set only for the single-month presets.
    """
    if preset not in PRESETS:
        raise ValueError(preset)
    d = F.to_date(col(date_col))
    mm = df.agg(F.min(d).alias("dmin"), F.max(d).alias("dmax"))
    mx, mn = F.col("dmax"), F.col("dmin")
    if preset == "all":
        s, e, m = mn, mx, F.lit(None).cast("string")
    elif preset == "this_month":
        s, e, m = F.trunc(mx, "month"), mx, F.date_format(mx, "yyyy-MM")
    elif preset == "last_month":
        s = F.add_months(F.trunc(mx, "month"), -1)
        s, e, m = s, F.last_day(s), F.date_format(s, "yyyy-MM")
    elif preset == "last_7":
        s, e, m = F.date_sub(mx, 6), mx, F.lit(None).cast("string")
    elif preset == "last_30":
        s, e, m = F.date_sub(mx, 29), mx, F.lit(None).cast("string")
    else:
        a = F.lit(start).cast("date") if start is not None else mn
        b = F.lit(end).cast("date") if end is not None else mx
        lo, hi = F.least(a, b), F.greatest(a, b)
        s, e, m = F.greatest(lo, mn), F.least(hi, mx), F.lit(None).cast("string")
    return mm.select(s.alias("start_d"), e.alias("end_d"), m.alias("month"))


def date_preset(df: DataFrame, date_col: str, preset: str = "all", start=None, end=None) -> DataFrame:
    """FL-01: rows whose day lies in [start_d, end_d] (half-open on end_d + 1 day)."""
    if preset == "all":
        return df
    b = preset_bounds(df, date_col, preset, start, end).first()
    if b["start_d"] is None or b["end_d"] is None:
        return df.where(F.lit(False))
    kind = "timestamp_ntz" if dict(df.dtypes).get(date_col, "").startswith("timestamp") else "date"
    lo, hi = (F.lit(d.isoformat()).cast(kind) for d in (b["start_d"], b["end_d"] + timedelta(days=1)))
    return df.where((col(date_col) >= lo) & (col(date_col) < hi))


def align_period(df2: DataFrame, date_col: str, month: str | None = None, start=None, end=None) -> DataFrame:
    """FL-02: the same month (``yyyy-MM``) or the same inclusive day range on a second table."""
    c = col(date_col)
    if month is not None:
        return df2.where(in_month(c, month))
    if start is not None and end is not None:
        return df2.where((c >= F.lit(start).cast("date")) & (c < F.date_add(F.lit(end).cast("date"), 1)))
    return df2


def filter_options(df: DataFrame, c: str) -> DataFrame:
    """FL-03: selectable options = distinct non-blank text values, sorted."""
    t = utrim(col(c).cast("string"))
    return df.select(t.alias(c)).where(F.col(c).isNotNull() & (F.col(c) != "")).distinct()


def filter_in(df: DataFrame, c: str, values: Sequence | None) -> DataFrame:
    """FL-03: ``values=None`` = no filter; explicit values drop NULL rows; empty list -> empty result."""
    if values is None:
        return df
    vals = [str(v) for v in values]
    if not vals:
        return df.where(F.lit(False))
    return df.where(col(c).cast("string").isin(vals))


# fixed values: default member population markers
STATUS_ENABLED = "启用"
NOT_AGENT = "非代理"


def default_members(df: DataFrame, source=None, vip=None, register_channel=None, agent=None,
                    tag_contains: str | None = None) -> DataFrame:
    """FL-04: enabled, non-agent members (each condition only when that value occurs) + optional filters."""
    has = df.agg(F.max(F.col("status") == STATUS_ENABLED).alias("enabled"), F.max(F.col("is_agent") == NOT_AGENT).alias("member")).first()
    j = df.where(F.col("status") == STATUS_ENABLED) if has["enabled"] else df
    j = j.where(F.col("is_agent") == NOT_AGENT) if has["member"] else j
    for c, v in (("source", source), ("vip", vip), ("register_channel", register_channel), ("agent", agent)):
        j = filter_in(j, c, v)
    if tag_contains:
        j = j.where(F.coalesce(F.col("tags"), F.lit("")).contains(tag_contains))
    return j


def search(df: DataFrame, cols: Sequence[str], pattern: str, literal: bool = False) -> DataFrame:
    """FL-05: case-insensitive search over any of the columns; regex by default, literal on request. [SC-04]"""
    if not pattern:
        return df
    cond: Column = F.lit(False)
    for c in cols:
        v = F.coalesce(col(c).cast("string"), F.lit(""))
        if literal:
            cond = cond | F.lower(v).contains(pattern.lower())
        else:
            cond = cond | v.rlike("(?i)" + pattern)
    return df.where(cond)


# fixed values: success status word of bonus / payment tables
SUCCESS = "成功"


def only_success(df: DataFrame, status: str = "status", word: str = SUCCESS) -> DataFrame:
    """FL-07: rows whose trimmed status equals the success word."""
    return df.where(utrim(col(status)) == word)


def success_counts(df: DataFrame, status: str = "status", word: str = SUCCESS) -> DataFrame:
    """FL-07: kept and excluded row counts."""
    ok = utrim(col(status)) == word
    return df.agg(F.count_if(ok).alias("kept"), F.count_if(~ok | col(status).isNull()).alias("excluded"))


def filter_deposit(df: DataFrame, mode: str = "all", flag: str = "has_first_deposit") -> DataFrame:
    """FL-08: 'with' / 'without' first deposit, or 'all'."""
    if mode == "with":
        return df.where(F.col(flag))
    if mode == "without":
        return df.where(~F.col(flag))
    return df


def agent_lookup(df: DataFrame, q: str, name: str = "agent_name", number: str = "agent_no") -> DataFrame:
    """FL-09: case-insensitive equality on agent name OR number."""
    ql = q.lower()
    return df.where((F.lower(col(name)) == ql) | (F.lower(col(number).cast("string")) == ql))
