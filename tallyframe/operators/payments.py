"""Payments (AG-114…120), call win-back (AG-121…123) and market-agent settlement (AG-124…126)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import clean_text, minutes_between, ratio, utrim

# fixed values: payment status words
DEP_SUCCESS = "存款成功"
DEP_CANCELLED = "已取消"
WD_SUCCESS = "提款成功"
WD_REJECTED = "审核拒绝"
WD_FAILED = "提款失败"


def with_minutes(df: DataFrame, start: str, end: str = "completed_at") -> DataFrame:
    """AG-114: minutes from order/apply time to completion."""
    return df.withColumn("minutes", minutes_between(start, end))


def deposit_kpis(dep: DataFrame) -> DataFrame:
    """AG-115: rows, success rate, drop (cancel) rate, mean minutes over successful orders with minutes >= 0. [FL-10, FL-11]"""
    d = with_minutes(dep, "ordered_at")
    ok = utrim("status") == DEP_SUCCESS
    return d.agg(F.count(F.lit(1)).alias("orders"),
                 F.avg(ok.cast("double")).alias("success_rate"),
                 F.avg((utrim("status") == DEP_CANCELLED).cast("double")).alias("drop_rate"),
                 F.avg(F.when(ok & (F.col("minutes") >= 0), F.col("minutes"))).alias("avg_minutes"))


def deposit_by_channel(dep: DataFrame) -> DataFrame:
    """AG-116: per channel: orders, success %, drop %, mean minutes (0 when none), by orders desc."""
    d = with_minutes(dep, "ordered_at")
    ok = utrim("status") == DEP_SUCCESS
    g = d.where(F.col("channel").isNotNull()).groupBy("channel").agg(
        F.count(F.lit(1)).alias("orders"),
        (F.avg(ok.cast("double")) * 100.0).alias("success_pct"),
        (F.avg((utrim("status") == DEP_CANCELLED).cast("double")) * 100.0).alias("drop_pct"),
        F.coalesce(F.avg(F.when(ok & (F.col("minutes") >= 0), F.col("minutes"))), F.lit(0.0)).alias("avg_minutes"))
    return g.orderBy(F.col("orders").desc(), "channel")


def low_success_channels(dep: DataFrame, min_orders: int = 20, max_success: float = 0.6) -> DataFrame:
    """AG-117: channels with orders >= min_orders and success < max_success."""
    return deposit_by_channel(dep).where((F.col("orders") >= min_orders) & (F.col("success_pct") < max_success * 100.0))


def cancel_reasons(dep: DataFrame, k: int = 8) -> DataFrame:
    """AG-118: most frequent reasons of cancelled orders (blank / 'nan' removed)."""
    r = clean_text("cancel_reason")
    return dep.where(utrim("status") == DEP_CANCELLED).select(r.alias("reason")).where(F.col("reason").isNotNull()).groupBy("reason") \
              .agg(F.count(F.lit(1)).alias("orders")).orderBy(F.col("orders").desc(), "reason").limit(k)


def withdraw_kpis(wd: DataFrame, slow_minutes: float = 60.0) -> DataFrame:
    """AG-119: success / reject / fail rates; mean, exact median and p90 minutes of successful
    withdrawals with minutes >= 0; count slower than ``slow_minutes``.  The quantiles come from the
    distributed exact quantile (``operators/quantiles.py``), never one task holding all values."""
    from .quantiles import exact_quantiles
    d = with_minutes(wd, "applied_at")
    st = utrim("status")
    ok_m = F.when((st == WD_SUCCESS) & (F.col("minutes") >= 0), F.col("minutes"))
    extra = {"orders": F.count(F.lit(1)), "success_rate": F.avg((st == WD_SUCCESS).cast("double")),
             "reject_rate": F.avg((st == WD_REJECTED).cast("double")),
             "fail_rate": F.avg((st == WD_FAILED).cast("double")), "avg_minutes": F.avg("__v"),
             "slow_count": F.count_if(F.col("__v") > slow_minutes)}
    q = exact_quantiles(d, ok_m, [0.5, 0.9], extra=extra)
    return q.withColumnRenamed("q_0_5", "median_minutes").withColumnRenamed("q_0_9", "p90_minutes")


def slow_withdrawals(wd: DataFrame, minutes: float = 60.0, k: int = 50) -> DataFrame:
    """AG-120: slowest successful withdrawals over ``minutes``, worst first. [FL-11]"""
    d = with_minutes(wd, "applied_at")
    return d.where((utrim("status") == WD_SUCCESS) & (F.col("minutes") > minutes)) \
            .select("order_no", "account", "channel", "amount", "applied_at", "completed_at", "minutes") \
            .orderBy(F.col("minutes").desc(), "order_no").limit(k)


# ---------------------------------------------------------------- call win-back (AG-121…123)

WB_SUMS = ("listed", "dialled", "connected", "valid", "bonus_requests", "relogins", "recharge")


def winback_month(wb: DataFrame) -> DataFrame:
    """AG-121: per month: sums and connect / valid / re-login rates (0 divisor -> 0)."""
    g = wb.groupBy("month").agg(*[F.sum(c).alias(c) for c in WB_SUMS])
    return g.withColumns({
        "connect_rate": ratio(F.col("connected").cast("double"), "dialled", "zero"),
        "valid_rate": ratio(F.col("valid").cast("double"), "connected", "zero"),
        "relogin_rate": ratio(F.col("relogins").cast("double"), "listed", "zero"),
    })


def winback_funnel(wb: DataFrame, month: str | None = None) -> DataFrame:
    """AG-122: dialled -> connected -> valid with % of the initial step (long form)."""
    df = wb if month is None else wb.where(F.col("month") == month)
    g = df.agg(F.sum("dialled").alias("a"), F.sum("connected").alias("b"), F.sum("valid").alias("c"))
    rows = g.select(F.expr("stack(3, 0, '已播', a, a, 1, '接通', b, a, 2, '有效通话', c, a) AS (step, label, n, base)"))
    return rows.select("step", "label", "n", (ratio(F.col("n").cast("double"), "base", "zero") * 100.0).alias("pct_of_initial"))


def winback_callers(wb: DataFrame, month: str | None = None) -> DataFrame:
    """AG-122: per caller sums sorted by recharge, with the best caller flagged."""
    df = wb if month is None else wb.where(F.col("month") == month)
    g = df.groupBy("caller").agg(*[F.sum(c).alias(c) for c in WB_SUMS])
    best = g.agg(F.max_by("caller", F.struct("recharge", F.col("caller"))).alias("__best"))
    return g.crossJoin(F.broadcast(best)).withColumn("best", F.col("caller") == F.col("__best")).drop("__best") \
            .orderBy(F.col("recharge").desc(), "caller")


def winback_compare(wb: DataFrame) -> DataFrame:
    """AG-123: month-by-month totals with deltas vs the previous available month."""
    m = winback_month(wb)
    w = Window.orderBy("month")  # one row per month
    return m.select("month", "dialled", "connected", "recharge", "connect_rate",
                    (F.col("dialled") - F.lag("dialled").over(w)).alias("dialled_delta"),
                    (F.col("recharge") - F.lag("recharge").over(w)).alias("recharge_delta"),
                    (F.col("connect_rate") - F.lag("connect_rate").over(w)).alias("connect_rate_delta"))


# ---------------------------------------------------------------- market-agent settlement (AG-124…126)

MARKET_SUMS = ("registrations", "first_depositors", "active", "total_deposit", "total_withdraw", "turnover",
               "total_win", "bonus", "rebate", "commission_paid", "platform_net")


def market_month(market: DataFrame, month: str) -> DataFrame:
    """AG-124: month KPIs (agents + sums)."""
    df = market.where(F.col("month") == month)
    return df.agg(F.count_distinct("agent_account").alias("agents"), *[F.sum(c).alias(c) for c in MARKET_SUMS])


def market_agents(market: DataFrame, month: str) -> DataFrame:
    """AG-124: agent list of a month by platform profit."""
    return market.where(F.col("month") == month).orderBy(F.col("platform_net").desc(), "agent_account")


def market_trend(market: DataFrame) -> DataFrame:
    """AG-125: monthly trend of four sums."""
    return market.groupBy("month").agg(*[F.sum(c).alias(c) for c in ("total_deposit", "turnover", "total_win",
                                                                      "platform_net")])


def market_compare(market: DataFrame, a: str, b: str, metrics: Sequence[str] = ("turnover", "total_win", "platform_net")) -> DataFrame:
    """AG-126: per metric: month A, month B, B - A (conditional sums, long form)."""
    aggs = []
    for m in metrics:
        aggs += [F.sum(F.when(F.col("month") == a, F.col(m))).cast("double").alias(f"a__{m}"),
                 F.sum(F.when(F.col("month") == b, F.col(m))).cast("double").alias(f"b__{m}")]
    row = market.where(F.col("month").isin(a, b)).agg(*aggs)
    stack = ", ".join(f"'{m}', `a__{m}`, `b__{m}`" for m in metrics)
    out = row.select(F.expr(f"stack({len(metrics)}, {stack}) AS (metric, month_a, month_b)"))
    return out.withColumn("diff", F.coalesce(F.col("month_b"), F.lit(0.0)) - F.coalesce(F.col("month_a"), F.lit(0.0)))


def market_compare_agents(market: DataFrame, a: str, b: str, metric: str = "platform_net") -> DataFrame:
    """AG-126 / JN-06: per agent: month A vs month B of one metric (full outer, missing -> 0), B - A sorted."""
    x = market.where(F.col("month") == a).groupBy("agent_account").agg(F.sum(metric).cast("double").alias("month_a"))
    y = market.where(F.col("month") == b).groupBy("agent_account").agg(F.sum(metric).cast("double").alias("month_b"))
    j = x.join(y, "agent_account", "full_outer").na.fill(0.0, ["month_a", "month_b"])
    return j.withColumn("diff", F.col("month_b") - F.col("month_a")).orderBy(F.col("diff").desc(), "agent_account")
