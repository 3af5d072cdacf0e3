"""Realtime hour-slot reports (AG-41…45) over the (day, slot, type) snapshot table.

The slot table is parsed once (CL-29) and aggregated to (day, slot) before any
comparison, so the anomaly detector touches at most days x 24 rows after the first
aggregation; the "latest day" is a one-row aggregate broadcast back, never collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import ratio, slot_hour
from .clean import parse_slot
from .common import long_form, moving_average, pivot_sum


def slot_kpis(slots: DataFrame) -> DataFrame:
    """AG-41: average daily bettor-visits (mean over days of daily sums, a DAU approximation) + totals."""
    p = parse_slot(slots)
    daily = p.groupBy("day").agg(F.sum("slot_bettors").alias("visits"))
    a = daily.agg(F.avg("visits").alias("avg_daily_visits"), F.count(F.lit(1)).alias("days"))
    t = p.agg(F.sum("slot_bettors").alias("slot_bettors"), F.sum("stake").alias("stake"),
              F.sum("turnover").alias("turnover"), F.sum("company_win").alias("company_win"))
    return a.crossJoin(t)


def slot_anomaly(slots: DataFrame, metric: str = "turnover", days: int = 7, pct: float = 20.0) -> DataFrame:
    """AG-42: latest day per slot vs the mean over the days present in the previous ``days`` days. [JN-01]

    deviation % = (latest - baseline) / baseline x 100; slots with no baseline or a zero
    baseline are not reported; flag 'drop' at <= -pct, 'spike' at >= pct, else 'normal'.
    Ordered by slot hour.
    """
    return day_deviations(parse_slot(slots).groupBy("day", "slot").agg(F.sum(metric).alias("v")), days, pct)


def day_deviations(sd: DataFrame, days: int = 7, pct: float = 20.0) -> DataFrame:
    """AG-42 on (day, slot, v) rows, one per slot of a day (also the state of ST-02)."""
    from pyspark.sql.window import Window
    # (day, slot) rows are bounded by days x 24, so the latest day comes from a window over them
    # and latest value + baseline come out of ONE conditional aggregation: one scan of the input
    sd = sd.withColumn("latest", F.max("day").over(Window.partitionBy()))
    in_base = (F.col("day") < F.col("latest")) & (F.col("day") >= F.date_sub(F.col("latest"), days))
    g = sd.groupBy("slot").agg(F.max(F.when(F.col("day") == F.col("latest"), F.col("v"))).alias("latest_value"),
                               F.avg(F.when(in_base, F.col("v").cast("double"))).alias("baseline"))
    out = g.where(F.col("latest_value").isNotNull() & F.col("baseline").isNotNull())
    dev = ratio((F.col("latest_value") - F.col("baseline")).cast("double"), F.col("baseline").cast("double")) * 100.0
    out = out.withColumn("deviation_pct", dev).where(F.col("deviation_pct").isNotNull())
    flag = F.when(F.col("deviation_pct") <= -pct, F.lit("drop")).when(F.col("deviation_pct") >= pct, F.lit("spike")) \
            .otherwise(F.lit("normal"))
    return out.withColumn("flag", flag).withColumn("hour", slot_hour("slot")).orderBy("hour", "slot")


def daily_visits_ma(slots: DataFrame, n: int = 7) -> DataFrame:
    """AG-43 / WN-01: daily bettor-visits with an n-row moving average (min periods 1)."""
    daily = parse_slot(slots).groupBy("day").agg(F.sum("slot_bettors").alias("visits"))
    return moving_average(daily, "day", "visits", n, "visits_ma")


def slot_daily_long(slots: DataFrame, metrics: Sequence[str] = ("turnover", "company_win")) -> DataFrame:
    """AG-44: daily sums in long form."""
    d = parse_slot(slots).groupBy("day").agg(*[F.sum(m).alias(m) for m in metrics])
    return long_form(d, ["day"], list(metrics))


def heat_matrix(slots: DataFrame, known_slots: Sequence[str], metric: str = "turnover") -> DataFrame:
    """AG-45: game type x slot matrix (explicit slot list, missing -> 0)."""
    return pivot_sum(parse_slot(slots), "type", "slot", known_slots, metric)


def hour_slots() -> list[str]:
    """The 24 slot labels 'h~h+1' in hour order (the explicit pivot list)."""
    return [f"{h}~{h + 1}" for h in range(24)]
