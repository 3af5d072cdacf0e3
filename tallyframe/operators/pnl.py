"""Overview / profit & loss (AG-10…22) and recent-trend reports (AG-23…26).

Inputs are day-grain report tables (``platform``, ``finance``), so every global aggregate
is a two-phase aggregation over at most one row per day; windows here only run over
day- or month-level aggregates (bounded by the calendar), never over raw rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import LBL_EMPTY, fill_label, in_month, ratio, venue_category, ym
from .common import long_form, safe_sum


def headline_kpis(platform: DataFrame, finance: DataFrame) -> DataFrame:
    """AG-10: win/loss, turnover, actual deposits, net flow, registrations, first-deposit conversion."""
    p = platform.agg(
        safe_sum(platform, "company_win").alias("company_win"),
        safe_sum(platform, "turnover").alias("turnover"),
        safe_sum(platform, "net_flow").alias("net_flow"),
        safe_sum(platform, "registrations").alias("registrations"),
        safe_sum(platform, "first_depositors").alias("first_depositors"),
    )
    f = finance.agg(safe_sum(finance, "actual_deposits").alias("actual_deposits"))
    return p.crossJoin(f).withColumn("first_deposit_conversion", ratio("first_depositors", "registrations"))


@dataclass(frozen=True)
class ProfitParams:
    """Manual inputs of the true-profit calculation (AG-11)."""
    channel_fee: float = 0.0
    project_adjust: float = 0.0
    manual_commission: float = 0.0
    agent_refund: float = 0.0


def platform_profit(platform: DataFrame, params: ProfitParams = ProfitParams(), bonus: DataFrame | None = None,
                    agent_acts: Sequence[str] | None = None) -> DataFrame:
    """AG-11: true platform profit.

    gross = win + early settlement + account adjustment + tips
    costs = bonus* + rebate + group share + channel fee - project adjustment
    commission = manual commission if > 0 else system commission
    profit = gross - costs - commission + refund
    bonus* = platform bonus minus agent-related activity bonus, only when a manual
    commission is given and agent activities are selected (avoids double counting).
    """
    p = platform.agg(*[safe_sum(platform, c).cast("double").alias(c) for c in (
        "company_win", "early_settlement", "account_adjustment", "tips", "bonus", "rebate", "group_share",
        "agent_commission", "turnover")])
    if params.manual_commission > 0 and agent_acts and bonus is not None:
        ab = bonus.agg(F.coalesce(F.sum(F.when(F.col("activity").isin(list(agent_acts)), F.col("amount"))),
                                  F.lit(0)).cast("double").alias("agent_bonus"))
    else:
        ab = p.sparkSession.range(1).select(F.lit(0.0).alias("agent_bonus"))
    j = p.crossJoin(ab)
    gross = F.col("company_win") + F.col("early_settlement") + F.col("account_adjustment") + F.col("tips")
    bonus_used = F.col("bonus") - F.col("agent_bonus")
    costs = bonus_used + F.col("rebate") + F.col("group_share") + F.lit(params.channel_fee) - F.lit(params.project_adjust)
    comm = F.lit(params.manual_commission) if params.manual_commission > 0 else F.col("agent_commission")
    return j.select(
        gross.alias("gross_income"), bonus_used.alias("bonus_used"), F.col("rebate"), F.col("group_share"),
        F.lit(params.channel_fee).alias("channel_fee"), F.lit(params.project_adjust).alias("project_adjust"),
        costs.alias("costs"), comm.alias("commission"), F.lit(params.agent_refund).alias("refund"),
        (gross - costs - comm + F.lit(params.agent_refund)).alias("profit"), F.col("turnover"),
    )


# fixed values: the summary item holding the paid-out total in a settlement summary
SETTLE_TOTAL_ITEM = "总计发放"
STAR_MARK = "⭐️"


def default_commission(settle_sum: DataFrame, month: str | None = None) -> DataFrame:
    """AG-12: |amount| of the '总计发放' item (star mark removed, trimmed) for a month (all months if None)."""
    df = settle_sum
    if month is not None:
        df = df.where(F.col("month") == month)
    item = F.trim(F.replace(F.col("item"), F.lit(STAR_MARK), F.lit("")))
    return (df.where(item == SETTLE_TOTAL_ITEM)
              .groupBy("month").agg(F.abs(F.min_by("amount", F.col("item"))).alias("default_commission")))


def bonus_split(bonus: DataFrame, agent_acts: Sequence[str]) -> DataFrame:
    """AG-13: total bonus, agent-related part (listed activities), member part, agent share."""
    g = bonus.agg(F.coalesce(F.sum("amount"), F.lit(0)).alias("total_bonus"),
                  F.coalesce(F.sum(F.when(F.col("activity").isin(list(agent_acts)), F.col("amount"))), F.lit(0))
                  .alias("agent_bonus"))
    return (g.withColumn("member_bonus", F.col("total_bonus") - F.col("agent_bonus"))
             .withColumn("agent_share", ratio(F.col("agent_bonus").cast("double"), F.col("total_bonus").cast("double"))))


# fixed values: waterfall steps (label, column, sign, kind) of the profit bridge
WATERFALL = (("毛收入", "gross_income", 1, "start"), ("红利", "bonus_used", -1, "cost"),
             ("返水", "rebate", -1, "cost"), ("集团分成", "group_share", -1, "cost"),
             ("渠道费", "channel_fee", -1, "cost"), ("项目调整", "project_adjust", 1, "gain"),
             ("代理佣金", "commission", -1, "cost"), ("代理回帐", "refund", 1, "gain"))


def pnl_waterfall(profit_row: DataFrame) -> DataFrame:
    """AG-14 / WN-08: profit bridge rows (step, label, delta, kind, running) + the final total row.

    All 9 rows come from one ``stack`` over the single profit row (one reference to its plan);
    the running total is a window over those <= 9 rows.
    """
    n = len(WATERFALL)
    parts = [f"{i}, '{lbl}', CAST({c} AS DOUBLE) * {s}, '{k}'" for i, (lbl, c, s, k) in enumerate(WATERFALL)]
    parts.append(f"{n}, '净盈利', CAST(profit AS DOUBLE), 'total'")
    rows = profit_row.select(F.expr(f"stack({n + 1}, {', '.join(parts)}) AS (step, label, delta, kind)"))
    w = Window.orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    running = F.sum(F.when(F.col("kind") != "total", F.col("delta"))).over(w)
    return rows.withColumn("running", F.when(F.col("kind") == "total", F.col("delta")).otherwise(running))


def fx_view(profit_row: DataFrame, rate: float) -> DataFrame:
    """AG-15: profit in a second currency and hold% = profit / turnover x 100."""
    return profit_row.select(
        F.col("profit"), (F.col("profit") * F.lit(rate)).alias("profit_fx"),
        (ratio("profit", "turnover") * 100.0).alias("hold_pct"))


def contribution_by_line(venue: DataFrame, month: str | None = None, metric: str = "company_win") -> DataFrame:
    """AG-16: numeric sum of a venue metric by product line (CL-35) for a month, desc."""
    df = venue if month is None else venue.where(in_month("date", month))
    v = F.col(metric)
    if dict(df.dtypes)[metric] == "string":
        v = F.translate(F.regexp_replace(v, r'^="|"$', ""), ",", "").try_cast("double")
    g = df.groupBy(venue_category("venue").alias("category")).agg(F.sum(v).alias(metric))
    return g.orderBy(F.col(metric).desc(), "category")


def month_over_month(platform: DataFrame, month: str | None = None) -> DataFrame:
    """AG-17 / JN-09 / WN-06: monthly turnover & win with change vs the previous calendar month.

    turnover change = (c - p) / p; win change = (c - p) / |p|; NULL unless the previous
    month exists and is non-zero.
    """
    m = platform.groupBy(ym("date").alias("month")).agg(F.sum("turnover").alias("turnover"),
                                                         F.sum("company_win").alias("company_win"))
    w = Window.orderBy("month")
    prev_m = F.lag("month").over(w)
    m = m.select("*", prev_m.alias("prev_month"), F.lag("turnover").over(w).alias("prev_turnover"),
                 F.lag("company_win").over(w).alias("prev_win"))
    expected_prev = F.date_format(F.add_months(F.to_date(F.concat(F.col("month"), F.lit("-01"))), -1), "yyyy-MM")
    ok = F.col("prev_month") == expected_prev
    out = m.select(
        "month", "turnover", "company_win",
        F.when(ok, ratio((F.col("turnover") - F.col("prev_turnover")).cast("double"),
                         F.col("prev_turnover").cast("double"))).alias("turnover_mom"),
        F.when(ok, ratio((F.col("company_win") - F.col("prev_win")).cast("double"),
                         F.abs(F.col("prev_win")).cast("double"))).alias("win_mom"),
    )
    return out if month is None else out.where(F.col("month") == month)


COST_ITEMS = (("红利", "bonus_used"), ("返水", "rebate"), ("集团分成", "group_share"),
              ("渠道费", "channel_fee"), ("代理佣金", "commission"))


def ranked_costs(profit_row: DataFrame, top: int = 2) -> DataFrame:
    """AG-18: cost items ranked by |amount| with the share of the top-``top`` items in all costs
    (windows over the <= 5 stacked rows: the profit row is referenced once)."""
    n = len(COST_ITEMS)
    stack = ", ".join(f"'{lbl}', CAST({c} AS DOUBLE)" for lbl, c in COST_ITEMS)
    rows = profit_row.select(F.expr(f"stack({n}, {stack}) AS (item, amount)"))
    rows = rows.withColumn("rank", F.row_number().over(Window.orderBy(F.abs("amount").desc(), "item")))
    allw = Window.partitionBy()
    t = F.sum(F.abs("amount")).over(allw)
    tk = F.sum(F.when(F.col("rank") <= top, F.abs("amount"))).over(allw)
    return rows.withColumn("top_share", ratio(tk, t))


def daily_sum(df: DataFrame, date: str, metrics: Sequence[str]) -> DataFrame:
    """AG-19: per-day sums of the given metrics."""
    return df.groupBy(F.to_date(date).alias("date")).agg(*[F.sum(m).alias(m) for m in metrics])


def daily_long(df: DataFrame, date: str, metrics: Sequence[str]) -> DataFrame:
    """AG-20 / AG-44: per-day sums in long form (date, metric, value)."""
    return long_form(daily_sum(df, date, metrics), ["date"], metrics)


COST_STRUCTURE = (("红利", "bonus"), ("返水", "rebate"), ("代理佣金", "agent_commission"), ("集团分成", "group_share"))


def cost_structure(platform: DataFrame) -> DataFrame:
    """AG-21: cost items (item, amount), their total and cost / win ratio."""
    sums = platform.agg(*[safe_sum(platform, c).cast("double").alias(c) for _, c in COST_STRUCTURE],
                        safe_sum(platform, "company_win").cast("double").alias("company_win"))
    n = len(COST_STRUCTURE)
    stack = ", ".join(f"'{lbl}', {c}" for lbl, c in COST_STRUCTURE)
    rows = sums.select("company_win", F.expr(f"stack({n}, {stack}) AS (item, amount)"))
    tot = rows.agg(F.sum("amount").alias("total_cost"))
    return (rows.crossJoin(tot)
                .withColumn("cost_win_ratio", ratio("total_cost", "company_win"))
                .select("item", "amount", "total_cost", "cost_win_ratio"))


def daily_detail(platform: DataFrame, cols: Sequence[str]) -> DataFrame:
    """AG-22 / AG-34: projection newest first."""
    return platform.select("date", *cols).orderBy(F.col("date").desc())


# ---------------------------------------------------------------- recent trend (AG-23…26)

def period_overview(daily: DataFrame) -> DataFrame:
    """AG-23: days, sums, mean daily registrations, first-deposit conversion, hold."""
    g = daily.agg(F.count_distinct("date").alias("days"), F.sum("registrations").alias("registrations"),
                  F.sum("first_depositors").alias("first_depositors"), F.sum("turnover").alias("turnover"),
                  F.sum("company_win").alias("company_win"))
    return (g.withColumn("avg_daily_registrations", ratio(F.col("registrations").cast("double"), "days"))
             .withColumn("conversion", ratio(F.col("first_depositors").cast("double"), "registrations"))
             .withColumn("hold", ratio(F.col("company_win").cast("double"), F.col("turnover").cast("double"))))


def daily_ratios(daily: DataFrame) -> DataFrame:
    """AG-24: conversion % (1dp), hold % (2dp), withdraw/deposit % (1dp); zero divisor -> NULL."""
    d = lambda c: F.col(c).cast("double")
    return daily.select(
        "date",
        F.round(ratio(d("first_depositors"), d("registrations")) * 100.0, 1).alias("conversion_pct"),
        F.round(ratio(d("company_win"), d("turnover")) * 100.0, 2).alias("hold_pct"),
        F.round(ratio(d("withdrawals"), d("deposits")) * 100.0, 1).alias("wd_dep_pct"),
    )


def peak_days(daily: DataFrame, metric: str) -> DataFrame:
    """AG-25: day of the max and of the min of a metric (earliest day on ties)."""
    v = F.col(metric)
    return daily.agg(
        F.max_by("date", F.struct(v, -F.unix_date("date"))).alias("max_day"),
        F.max(v).alias("max_value"),
        F.min_by("date", F.struct(v, F.unix_date("date"))).alias("min_day"),
        F.min(v).alias("min_value"),
    )


def compare_segments(daily: DataFrame, a: tuple[str, str], b: tuple[str, str], metrics: Sequence[str]) -> DataFrame:
    """AG-26: mean per metric over range A and range B (inclusive days), change = B/A - 1 (NULL if A = 0)."""
    in_a = F.col("date").between(F.lit(a[0]).cast("date"), F.lit(a[1]).cast("date"))
    in_b = F.col("date").between(F.lit(b[0]).cast("date"), F.lit(b[1]).cast("date"))
    aggs = []
    for m in metrics:
        aggs += [F.avg(F.when(in_a, F.col(m).cast("double"))).alias(f"a__{m}"),
                 F.avg(F.when(in_b, F.col(m).cast("double"))).alias(f"b__{m}")]
    row = daily.agg(*aggs)
    n = len(metrics)
    stack = ", ".join(f"'{m}', `a__{m}`, `b__{m}`" for m in metrics)
    out = row.select(F.expr(f"stack({n}, {stack}) AS (metric, a_mean, b_mean)"))
    return out.withColumn("change", ratio("b_mean", "a_mean") - 1.0)


def label_or_empty(c):
    return fill_label(c, LBL_EMPTY)
