"""Agent commission (AG-50…60) and settlement (AG-61…63) reports.

All inputs are month x agent tables; every report is one grouped aggregate (or a
filter + top-k) on the selected commission month.  The month is picked inside the plan
(``max(month)`` as a one-row broadcast) when not given, so nothing is collected.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import ratio
from .common import band, band_counts, histogram


def pick_month(df: DataFrame, month_col: str, month: str | None) -> DataFrame:
    """AG-50: rows of the chosen month (latest when None)."""
    if month is not None:
        return df.where(F.col(month_col) == month)
    mx = df.agg(F.max(month_col).alias("__m"))
    return df.join(F.broadcast(mx), F.col(month_col) == F.col("__m"), "left_semi")


def commission_kpis(comm: DataFrame, month: str | None = None) -> DataFrame:
    """AG-50: agents, active agents (net != 0), net, deficit agents (balance < 0) and their total."""
    df = pick_month(comm, "commission_month", month)
    bal = F.coalesce(F.col("carried_balance"), F.lit(0))
    return df.agg(
        F.count(F.lit(1)).alias("agents"),
        F.count_if(F.coalesce(F.col("net_after_reversal"), F.lit(0)) != 0).alias("active_agents"),
        F.coalesce(F.sum("net_after_reversal"), F.lit(0)).alias("net"),
        F.count_if(bal < 0).alias("deficit_agents"),
        F.coalesce(F.sum(F.when(bal < 0, F.col("carried_balance"))), F.lit(0)).alias("deficit_total"),
    )


# fixed values: payment fee rates: charged to agents, paid to the processor, platform gap
FEE_RATES = (Decimal("0.015"), Decimal("0.016"), Decimal("0.001"))


def fee_structure(comm: DataFrame, month: str | None = None, rates=FEE_RATES) -> DataFrame:
    """AG-51: fee base = deposit + withdrawal base; charged / paid / gap amounts; gap annualised x 12 (long form)."""
    df = pick_month(comm, "commission_month", month)
    charged, paid, gap = (F.lit(r) for r in rates)
    b = df.agg((F.coalesce(F.sum("deposit_fee_base"), F.lit(0)) + F.coalesce(F.sum("withdraw_fee_base"), F.lit(0)))
               .alias("base"))
    row = b.select(F.col("base"), (F.col("base") * charged).alias("charged"), (F.col("base") * paid).alias("paid"),
                   (F.col("base") * gap).alias("gap"), (F.col("base") * gap * 12).alias("gap_annual"))
    row = row.select(*[F.col(c).cast("double").alias(c) for c in row.columns])
    return row.unpivot([], ["base", "charged", "paid", "gap", "gap_annual"], "item", "amount")


def top_net(comm: DataFrame, k: int = 20, month: str | None = None) -> DataFrame:
    """AG-52: top-k agents with net > 0, with a 万 (x10,000) unit column. [FL-11]"""
    df = pick_month(comm, "commission_month", month).where(F.col("net_after_reversal") > 0)
    return df.select("agent", "net_after_reversal", (F.col("net_after_reversal") / 10000).alias("net_wan")) \
             .orderBy(F.col("net_after_reversal").desc(), "agent").limit(k)


def worst_balance(comm: DataFrame, k: int = 20, month: str | None = None) -> DataFrame:
    """AG-52: bottom-k agents by carried balance < 0. [FL-11]"""
    df = pick_month(comm, "commission_month", month).where(F.col("carried_balance") < 0)
    return df.select("agent", "carried_balance", (F.col("carried_balance") / 10000).alias("balance_wan")) \
             .orderBy(F.col("carried_balance").asc(), "agent").limit(k)


def deficit_histogram(comm: DataFrame, bins: int = 30, month: str | None = None) -> DataFrame:
    """AG-53: equal-width histogram of negative carried balances (in 万)."""
    df = pick_month(comm, "commission_month", month).where(F.col("carried_balance") < 0) \
        .select((F.col("carried_balance").cast("double") / 10000.0).alias("deficit_wan"))
    return histogram(df, "deficit_wan", bins)


# fixed values: deficit bands in order (label, upper-exclusive / lower rules in yuan)
DEFICIT_BANDS = ("< 1w", "1w-5w", "5w-10w", "10w+")


def deficit_bands(comm: DataFrame, month: str | None = None) -> DataFrame:
    """AG-54: agents and deficit sum per band (> -1w, (-5w, -1w], (-10w, -5w], <= -10w); all bands emitted."""
    df = pick_month(comm, "commission_month", month).where(F.coalesce(F.col("carried_balance"), F.lit(0)) < 0)
    b = F.col("carried_balance")
    lbl = band(b, [("< 1w", b > -10000), ("1w-5w", b > -50000), ("5w-10w", b > -100000)], "10w+")
    return band_counts(df, lbl, DEFICIT_BANDS, [F.count(F.lit(1)).alias("agents"),
                                                F.sum("carried_balance").cast("double").alias("deficit_total")])


def deficit_list(comm: DataFrame, month: str | None = None) -> DataFrame:
    """AG-55: every deficit agent sorted by balance."""
    df = pick_month(comm, "commission_month", month).where(F.col("carried_balance") < 0)
    return df.select("agent", "parent", "agent_type", "carried_balance", "net_after_reversal") \
             .orderBy("carried_balance", "agent")


def line_stats(team: DataFrame, month: str | None = None) -> DataFrame:
    """AG-56 / UD-02: per line of the chosen month (latest when None): agents, net, sum of negative balances only. [UD-02]"""
    return pick_month(team, "commission_month", month).groupBy("line").agg(F.count("agent").alias("agents"), F.sum("net_after_reversal").alias("net"),
                                    F.coalesce(F.sum(F.when(F.col("carried_balance") < 0, F.col("carried_balance"))),
                                               F.lit(0)).alias("deficit"))


def top_teams(team: DataFrame, k: int = 10, month: str | None = None) -> DataFrame:
    """AG-57: top-k teams of the chosen month (latest when None) by net with agents and deficit. [UD-02]"""
    g = pick_month(team, "commission_month", month).groupBy("team_name").agg(F.count("agent").alias("agents"), F.sum("net_after_reversal").alias("net"),
                                      F.coalesce(F.sum(F.when(F.col("carried_balance") < 0, F.col("carried_balance"))),
                                                 F.lit(0)).alias("deficit"))
    return g.orderBy(F.col("net").desc(), "team_name").limit(k)


ACTIVITY_BANDS = ("0", "1-5", "6-20", "21-100", "100+")


def activity_bands(comm: DataFrame, month: str | None = None) -> DataFrame:
    """AG-58: agents per active-member band (NULL -> 0); every band emitted."""
    df = pick_month(comm, "commission_month", month)
    a = F.coalesce(F.col("active"), F.lit(0)).cast("bigint")
    lbl = band(a, [("0", a == 0), ("1-5", a <= 5), ("6-20", a <= 20), ("21-100", a <= 100)], "100+")
    return band_counts(df, lbl, ACTIVITY_BANDS, [F.count(F.lit(1)).alias("agents")])


def count_by_dim(comm: DataFrame, dim: str, month: str | None = None) -> DataFrame:
    """AG-59: agent counts by type / in-team flag."""
    df = pick_month(comm, "commission_month", month)
    return df.groupBy(dim).agg(F.count(F.lit(1)).alias("agents"))


def agent_detail(comm: DataFrame, month: str | None = None, types: Sequence[str] | None = None,
                 pattern: str | None = None) -> DataFrame:
    """AG-60: agent rows with type filter + regex search over agent/parent, sorted by net desc."""
    df = pick_month(comm, "commission_month", month)
    if types is not None:
        df = df.where(F.col("agent_type").isin(list(types)))
    if pattern:
        df = df.where(F.coalesce(F.col("agent"), F.lit("")).rlike("(?i)" + pattern) |
                      F.coalesce(F.col("parent"), F.lit("")).rlike("(?i)" + pattern))
    return df.orderBy(F.col("net_after_reversal").desc(), "agent")


# ---------------------------------------------------------------- settlement (AG-61…63)

def settlement_map(settle_sum: DataFrame, month: str, items: Sequence[str]) -> DataFrame:
    """AG-61: the month's summary items as one wide row (explicit item list)."""
    df = settle_sum.where(F.col("month") == month)
    return df.groupBy("month").pivot("item", list(items)).agg(F.max("amount"))


def by_treatment(settle_det: DataFrame) -> DataFrame:
    """AG-62: per treatment: rows and commission sum, desc."""
    return settle_det.where(F.col("treatment").isNotNull()).groupBy("treatment").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("commission").alias("commission")) \
        .orderBy(F.col("commission").desc(), "treatment")


# fixed values: the treatment word marking referral shares
REFERRAL_WORD = "退成"
# fixed values: main commission share of referred performance
MAIN_SHARE = Decimal("0.55")


def referral_detail(settle_det: DataFrame) -> DataFrame:
    """AG-63: referral rows sorted by commission desc."""
    return settle_det.where(F.col("treatment").contains(REFERRAL_WORD)) \
                     .select("name", "agent", "total_perf", "rate", "commission") \
                     .orderBy(F.col("commission").desc(), "name")


def commission_cost(df: DataFrame, perf: str = "total_perf", rate: str = "rate", main: Decimal = MAIN_SHARE) -> DataFrame:
    """AG-63: stacked cost of a referral: main commission (perf x 55%) + referral (perf x rate)."""
    p = F.col(perf)
    return df.withColumns({
        "main_commission": p * F.lit(main),
        "referral_commission": p * F.col(rate),
        "platform_cost": p * F.lit(main) + p * F.col(rate),
        "cost_rate": F.lit(main) + F.col(rate),
    })


def hit_ratio(n, d):
    return ratio(n, d)
