"""Data health and upload quality checks (AG-127…133, IO-20).

All checks are aggregates (counts, min/max, rates) evaluated inside the plan; the
missing-days check explodes only the calendar range between min and max date, which is
bounded by the number of days, not by the data size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import clean_text, month_key, ratio, to_num_commas


def latest_imported(*dfs: DataFrame, col: str = "_imported_at") -> DataFrame:
    """IO-20: freshest import time over several frames, formatted to the minute (NULL when none)."""
    parts = [d.agg(F.max(col).alias("m")) for d in dfs if col in d.columns]
    if not parts:
        raise ValueError("no frame carries the import column")
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    return u.agg(F.date_format(F.max("m"), "yyyy-MM-dd HH:mm").alias("latest_import"))


def freshness(spark, tables: Mapping[str, tuple[DataFrame | None, str, str]]) -> DataFrame:
    """AG-127: per table: latest 10-char period (month keys normalised) and row count; absent table -> NULL / 0. [SO-02]

    ``tables`` maps name -> (frame or None, period column, kind 'daily' | 'monthly').
    """
    parts = []
    for name, (df, col, kind) in tables.items():
        if df is None or col not in df.columns:
            parts.append(spark.range(1).select(F.lit(name).alias("table"), F.lit(kind).alias("kind"),
                                               F.lit(None).cast("string").alias("latest"),
                                               F.lit(0).cast("bigint").alias("rows")))
            continue
        p = F.col(col).cast("string")
        key = month_key(p) if kind == "monthly" else F.substring(p, 1, 10)
        parts.append(df.agg(F.max(key).alias("latest"), F.count(F.lit(1)).alias("rows"))
                       .select(F.lit(name).alias("table"), F.lit(kind).alias("kind"), "latest", "rows"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


SEVERITY = (("bad", 3), ("check", 2), ("warn", 1), ("ok", 0))


def freshness_status(fresh: DataFrame, as_of: str) -> DataFrame:
    """AG-128: daily tables: gap <= 1 day ok, <= 3 warn, > 3 bad; monthly tables: month gap 0 ok, [SL-06]
    1 warn, > 1 bad; unparsable / missing -> check.  Sorted by severity desc, table."""
    ref = F.lit(as_of).cast("date")
    d = F.try_to_date(F.col("latest"), "yyyy-MM-dd")
    m = F.try_to_date(F.concat(F.col("latest"), F.lit("-01")), "yyyy-MM-dd")
    day_gap = F.datediff(ref, d)
    month_gap = (F.year(ref) * 12 + F.month(ref)) - (F.year(m) * 12 + F.month(m))
    daily = F.when(d.isNull(), "check").when(day_gap <= 1, "ok").when(day_gap <= 3, "warn").otherwise("bad")
    monthly = F.when(m.isNull(), "check").when(month_gap <= 0, "ok").when(month_gap == 1, "warn").otherwise("bad")
    st = F.when(F.col("kind") == "monthly", monthly).otherwise(daily)
    sev = F.lit(0)
    for name, v in SEVERITY:
        sev = F.when(F.col("status") == name, F.lit(v)).otherwise(sev)
    out = fresh.withColumn("gap", F.when(F.col("kind") == "monthly", month_gap).otherwise(day_gap)).withColumn("status", st)
    return out.withColumn("severity", sev).orderBy(F.col("severity").desc(), "table")


NOT_AGENT = "非代理"


def check_completeness(member: DataFrame, platform: DataFrame, threshold: float = 0.8,
                       daily_ops: DataFrame | None = None) -> DataFrame:
    """AG-129 / JN-10: newest register month of the member file; its rows marked as non-agents vs the
    registrations of the same month up to the member file's max register day, taken from the daily
    operations sheet (date, registrations) or, where that has none, from the platform report.

    The member file is read once, grouped by month; the other tables by their days.
    """
    per_month = (member.where(F.col("registered_at").isNotNull())
                 .groupBy(F.trunc("registered_at", "MM").alias("first_day"))
                 .agg(F.max(F.to_date("registered_at")).alias("max_day"), F.count_if(F.col("is_agent") == NOT_AGENT).alias("member_regs")))
    latest = per_month.agg(F.max(F.struct("first_day", "max_day", "member_regs")).alias("l")).select("l.*")

    def registered(df: DataFrame, name: str) -> DataFrame:
        days = df.groupBy(F.to_date("date").alias("day")).agg(F.sum("registrations").alias("n"))
        inside = (F.col("day") >= F.col("first_day")) & (F.col("day") <= F.col("max_day"))
        return days.join(F.broadcast(latest.select("first_day", "max_day")), inside).agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias(name))

    regs = registered(platform, "platform_regs")
    if daily_ops is not None:
        both = regs.crossJoin(registered(daily_ops, "daily_regs"))
        regs = both.select(F.when(F.col("daily_regs") != 0, F.col("daily_regs")).otherwise(F.col("platform_regs")).alias("platform_regs"))
    j = latest.select(F.date_format("first_day", "yyyy-MM").alias("month"), "max_day", "member_regs").crossJoin(regs)
    r = ratio(F.col("member_regs").cast("double"), F.col("platform_regs").cast("double"))
    return j.withColumn("coverage", r).withColumn("warn", F.coalesce(r < threshold, F.lit(False)))


def check_row_drop(new: DataFrame, existing: DataFrame, min_existing: int = 20, ratio_floor: float = 0.7) -> DataFrame:
    """AG-130: warn when the table has >= min_existing rows and the batch < ratio_floor of it."""
    a = new.agg(F.count(F.lit(1)).alias("new_rows"))
    b = existing.agg(F.count(F.lit(1)).alias("existing_rows"))
    j = a.crossJoin(b)
    return j.withColumn("warn", (F.col("existing_rows") >= min_existing) &
                        (F.col("new_rows") < F.col("existing_rows") * ratio_floor))


def check_missing_days(df: DataFrame, date_col: str, first: int = 5) -> DataFrame:
    """AG-131: days inside [min, max] without rows: count and the first ``first`` of them. [SC-10, SO-04]"""
    d = df.select(F.to_date(date_col).alias("d")).where(F.col("d").isNotNull()).distinct()
    rng = d.agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    cal = rng.select(F.explode(F.sequence("lo", "hi")).alias("d"))
    missing = cal.join(d, "d", "left_anti")
    cnt = missing.agg(F.count(F.lit(1)).alias("missing_days"))
    head = missing.orderBy("d").limit(first).agg(F.array_sort(F.collect_list(F.date_format("d", "yyyy-MM-dd")))
                                                 .alias("first_missing"))
    return cnt.crossJoin(head)


def check_zero_metric(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """AG-132: the first present key metric that is entirely zero, NULL or no number (flag + name)."""
    m = next((c for c in metrics if c in df.columns), None)
    if m is None:
        return df.sparkSession.range(1).select(F.lit(None).cast("string").alias("metric"), F.lit(False).alias("all_zero"))
    g = df.agg(F.count_if(F.coalesce(to_num_commas(m), F.lit(0.0)) != 0).alias("nz"))
    return g.select(F.lit(m).alias("metric"), (F.col("nz") == 0).alias("all_zero"))


def looks_month_aggregated(df: DataFrame, date_col: str, share: float = 0.8) -> DataFrame:
    """AG-133: more than ``share`` of the date values look like 'YYYY-MM' (a month-aggregated upload)."""
    t = clean_text(date_col)  # blank and 'nan' dates do not count
    g = df.where(t.isNotNull()).agg(F.avg(t.rlike(r"^\d{4}-\d{2}$").cast("double")).alias("month_share"))
    return g.withColumn("month_aggregated", F.coalesce(F.col("month_share") > share, F.lit(False)))
