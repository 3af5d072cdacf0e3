"""Bonus analysis (AG-46…49), bonus ROI (AG-74…80) and agent quality (AG-81…84).

Every report is a grouped aggregate over the cleaned grant table (CL-21).  The
high-frequency detector is two grouped aggregates with a filter in between (member-day,
then member), each partially aggregated map-side, so a member with a huge number of
grants never lands whole in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import ratio
from .common import first_non_null, with_share
from .filters import only_success


def bonus_kpis(bonus: DataFrame) -> DataFrame:
    """AG-46: amount, rows, distinct members, amount per member."""
    g = bonus.agg(F.coalesce(F.sum("amount"), F.lit(0)).alias("amount"), F.count(F.lit(1)).alias("rows"),
                  F.count_distinct("account").alias("members"))
    return g.withColumn("per_member", ratio(F.col("amount").cast("double"), "members"))


def bonus_by_activity(bonus: DataFrame, k: int | None = 20) -> DataFrame:
    """AG-47: per activity: amount and number of non-null amounts, desc."""
    g = bonus.groupBy("activity").agg(F.sum("amount").alias("amount"), F.count("amount").alias("grants"))
    g = g.orderBy(F.col("amount").desc(), "activity")
    return g.limit(k) if k else g


def bonus_by(bonus: DataFrame, dim: str) -> DataFrame:
    """AG-48: amount and count per type (dim='type') or per day (dim='day')."""
    key = F.to_date("applied_at").alias("day") if dim == "day" else F.col(dim)
    return bonus.where(F.col(dim).isNotNull() if dim != "day" else F.col("applied_at").isNotNull()) \
                .groupBy(key).agg(F.sum("amount").alias("amount"), F.count("amount").alias("grants"))


def top_receivers(bonus: DataFrame, k: int = 20) -> DataFrame:
    """AG-49: top-k members by amount: amount, grants, first non-null level (by apply time, order no)."""
    g = bonus.groupBy("account").agg(F.sum("amount").alias("amount"), F.count("amount").alias("grants"),
                                     first_non_null("vip", ["applied_at", "order_no"]).alias("vip"))
    return g.orderBy(F.col("amount").desc(), "account").limit(k)


# ---------------------------------------------------------------- ROI (AG-74…80)

def roi_kpis(bonus: DataFrame, agent: DataFrame) -> DataFrame:
    """AG-74: bonus cost vs the same-period agent report (win, income); cost share of |win|."""
    b = bonus.agg(F.coalesce(F.sum("amount"), F.lit(0)).alias("bonus_cost"), F.count(F.lit(1)).alias("grants"))
    a = agent.agg(F.coalesce(F.sum("company_win"), F.lit(0)).alias("company_win"),
                  F.coalesce(F.sum("company_income"), F.lit(0)).alias("company_income"))
    j = b.crossJoin(a)
    return j.withColumn("cost_share_of_win", ratio(F.col("bonus_cost").cast("double"),
                                                   F.abs(F.col("company_win").cast("double"))))


def cost_vs_income(bonus: DataFrame, agent: DataFrame) -> DataFrame:
    """AG-75 / JN-02: daily bonus cost full-outer-joined to daily agent income, missing -> 0."""
    b = bonus.groupBy(F.to_date("applied_at").alias("date")).agg(F.sum("amount").cast("double").alias("bonus_cost"))
    a = agent.groupBy("date").agg(F.sum("company_income").cast("double").alias("company_income"))
    return b.join(a, "date", "full_outer").na.fill(0.0, ["bonus_cost", "company_income"])


def roi_by_type(bonus: DataFrame) -> DataFrame:
    """AG-76: per type: rows, amount, members, share % of amount."""
    g = bonus.where(F.col("type").isNotNull()).groupBy("type").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("amount").alias("amount"), F.count_distinct("account").alias("members"))
    return with_share(g, "amount", "share_pct", 2)


def top_titles(bonus: DataFrame, k: int = 30) -> DataFrame:
    """AG-77: top-k titles by amount: rows, sum, mean, members, per member."""
    g = bonus.where(F.col("title").isNotNull()).groupBy("title").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("amount").alias("amount"), F.avg(F.col("amount").cast("double")).alias("mean_amount"),
        F.count_distinct("account").alias("members"))
    g = g.withColumn("per_member", ratio(F.col("amount").cast("double"), "members"))
    return g.orderBy(F.col("amount").desc(), "title").limit(k)


def high_frequency(bonus: DataFrame, min_per_day: int = 3, k: int = 30) -> DataFrame:
    """AG-78: member-days with >= min_per_day grants -> per member: days, grants, amount, max grants/day,
    max amount/day; top-k by amount."""
    md = bonus.groupBy("account", F.to_date("applied_at").alias("day")).agg(
        F.count("amount").alias("n"), F.sum("amount").alias("amt"))
    multi = md.where(F.col("n") >= min_per_day)
    g = multi.groupBy("account").agg(F.count_distinct("day").alias("days"), F.sum("n").alias("grants"),
                                     F.sum("amt").alias("amount"), F.max("n").alias("max_grants_day"),
                                     F.max("amt").alias("max_amount_day"))
    return g.orderBy(F.col("amount").desc(), "account").limit(k)


def wagering_matrix(bonus: DataFrame, k: int = 25) -> DataFrame:
    """AG-79: per (needs wagering, multiple): rows, sum, mean; top-k by sum."""
    g = bonus.groupBy("needs_wagering", "wager_multiple").agg(
        F.count("amount").alias("rows"), F.sum("amount").alias("amount"), F.avg(F.col("amount").cast("double")).alias("mean_amount"))
    return g.orderBy(F.col("amount").desc(), F.col("needs_wagering").asc_nulls_first(),
                     F.col("wager_multiple").asc_nulls_first()).limit(k)


def roi_by_vip(bonus: DataFrame) -> DataFrame:
    """AG-80: per VIP: rows, sum, members, per member."""
    g = bonus.where(F.col("vip").isNotNull()).groupBy("vip").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("amount").alias("amount"), F.count_distinct("account").alias("members"))
    return g.withColumn("per_member", ratio(F.col("amount").cast("double"), "members"))


def successful(bonus: DataFrame) -> DataFrame:
    return only_success(bonus)


# ---------------------------------------------------------------- agent quality (AG-81…84)

def agent_kpis(agent: DataFrame) -> DataFrame:
    """AG-81: agents, agents with sign-ups, sign-ups, first deposits, bonus, income, conversion."""
    g = agent.agg(F.count_distinct("agent_no").alias("agents"),
                  F.count_distinct(F.when(F.col("registrations") > 0, F.col("agent_no"))).alias("agents_with_signups"),
                  F.sum("registrations").alias("registrations"), F.sum("first_depositors").alias("first_depositors"),
                  F.sum("bonus").alias("bonus"), F.sum("company_income").alias("company_income"))
    return g.withColumn("conversion", ratio(F.col("first_depositors").cast("double"), "registrations"))


def agent_type_report(agent: DataFrame) -> DataFrame:
    """AG-82: per agent type: agents and sums."""
    return agent.where(F.col("agent_type").isNotNull()).groupBy("agent_type").agg(
        F.count_distinct("agent_no").alias("agents"), F.sum("registrations").alias("registrations"),
        F.sum("turnover").alias("turnover"), F.sum("bonus").alias("bonus"), F.sum("company_income").alias("company_income"))


def agent_rollup(agent: DataFrame) -> DataFrame:
    """AG-83: per agent: sums + bonus dependency = min(bonus / turnover (0 -> 1), 1) rounded 4dp; active flag."""
    g = agent.groupBy("agent_no", "agent_name", "agent_type").agg(
        F.sum("registrations").alias("registrations"), F.sum("first_depositors").alias("first_depositors"),
        F.sum("turnover").alias("turnover"), F.sum("bonus").alias("bonus"), F.sum("rebate").alias("rebate"),
        F.sum("company_income").alias("company_income"))
    dep = F.round(F.least(ratio(F.col("bonus").cast("double"), F.col("turnover").cast("double"), "one"), F.lit(1.0)), 4)
    return g.withColumn("bonus_dependency", dep) \
            .withColumn("active", (F.col("registrations") > 0) | (F.col("turnover") > 0))


def best_agents(rollup: DataFrame, k: int = 20) -> DataFrame:
    """AG-84: best k active agents by income."""
    return rollup.where("active").orderBy(F.col("company_income").desc(), "agent_no").limit(k)


def worst_agents(rollup: DataFrame, k: int = 20) -> DataFrame:
    """AG-84: worst k active agents by income."""
    return rollup.where("active").orderBy(F.col("company_income").asc(), "agent_no").limit(k)


def bonus_eaters(rollup: DataFrame, dependency: float = 0.5, k: int = 30) -> DataFrame:
    """AG-84: active agents with dependency > threshold and income <= 0, top-k by bonus."""
    return rollup.where(F.col("active") & (F.col("bonus_dependency") > dependency) & (F.col("company_income") <= 0)) \
                 .orderBy(F.col("bonus").desc(), "agent_no").limit(k)
