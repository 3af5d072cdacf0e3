"""Member value (AG-35…40) incl. monthly retention (AG-39) and the agent x member matrix (AG-85…93).

Members are keyed by (account, agent) with a NULL agent as its own value; joins on that
key are null-safe (``<=>``) so direct customers are not lost.  Retention reads each member's
next snapshot row with a ``lead`` window per member (bounded: one row per month) and checks it
is the cohort's next available month — one shuffle on the member key, no driver loop over months.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import LBL_DIRECT, LBL_EMPTY, fill_label, ratio, utrim
from ..functions.text import tag_hits
from .common import member_count, top_and_total


def _key():
    return F.struct(F.col("account"), F.col("agent"))


def member_kpis(member: DataFrame) -> DataFrame:
    """AG-35: members, first depositors (counted once per member), turnover, income, ARPU."""
    g = member.agg(
        member_count(member).alias("members"),
        F.count_distinct(F.when(F.col("first_deposit") > 0, _key())).alias("first_depositors"),
        F.coalesce(F.sum("turnover"), F.lit(0)).alias("turnover"),
        F.coalesce(F.sum("company_income"), F.lit(0)).alias("company_income"),
    )
    return g.withColumn("arpu", ratio(F.col("company_income").cast("double"), "members"))


def top_report(member: DataFrame) -> DataFrame:
    """TOP report stand-in: per (month, user) turnover and the member's own result."""
    return member.groupBy(F.col("snapshot_month"), F.col("account").alias("user")).agg(
        F.sum("turnover").alias("turnover"), F.sum(-F.col("company_win")).alias("personal_win"))


def top_n_share(top: DataFrame, metric: str = "turnover", n: int = 20, month: str | None = None) -> DataFrame:
    """AG-36: sum of the n largest values / total for a snapshot month (all rows when month is None)."""
    df = top if month is None else top.where(F.col("snapshot_month") == month)
    sums = top_and_total(df.select("user", metric), metric, n).withColumnRenamed("top", "top_sum")
    return sums.withColumn("top_share", ratio(F.col("top_sum").cast("double"), F.col("total").cast("double")))


def member_distribution(member: DataFrame, dim: str) -> DataFrame:
    """AG-37: distinct members per dimension value, NULL -> '空值'."""
    return member.groupBy(F.coalesce(F.col(dim), F.lit(LBL_EMPTY)).alias(dim)).agg(member_count(member).alias("members"))


def arpu_by(member: DataFrame, dim: str) -> DataFrame:
    """AG-38: income / distinct members per dimension value."""
    g = member.groupBy(F.coalesce(F.col(dim), F.lit(LBL_EMPTY)).alias(dim)).agg(
        F.sum("company_income").alias("company_income"), member_count(member).alias("members"))
    return g.withColumn("arpu", ratio(F.col("company_income").cast("double"), "members"))


def monthly_retention(member: DataFrame, calendar: bool = False) -> DataFrame:
    """AG-39: next-month active / deposit / first-deposit-cohort retention. [WN-05, JN-07]

    Flags per (member, month): active = deposits > 0 or turnover > 0; deposit = deposits > 0;
    first = first deposit happened in that month.  "Next month" is the next *available*
    snapshot month (``calendar=True``: the next calendar month).  Months without a next
    month are not reported.  Ratios are NULL when the cohort is empty.
    """
    flags = member.groupBy("account", "agent", "snapshot_month").agg(
        F.bool_or((F.coalesce(F.col("deposits"), F.lit(0)) > 0) | (F.coalesce(F.col("turnover"), F.lit(0)) > 0)).alias("active"),
        F.bool_or(F.coalesce(F.col("deposits"), F.lit(0)) > 0).alias("deposit"),
        F.bool_or(F.date_format("first_deposit_at", "yyyy-MM") == F.col("snapshot_month")).alias("first"),
    )
    months = flags.select("snapshot_month").where(F.col("snapshot_month").isNotNull()).distinct()
    if calendar:
        nm = F.date_format(F.add_months(F.to_date(F.concat("snapshot_month", F.lit("-01"))), 1), "yyyy-MM")
        months = months.withColumn("next_month", nm).join(months.select(F.col("snapshot_month").alias("next_month")),
                                                         "next_month", "left_semi")
    else:
        # calendar-bounded (one row per month): a single ordered window is cheap here
        months = months.withColumn("next_month", F.lead("snapshot_month").over(Window.orderBy("snapshot_month")))
        months = months.where(F.col("next_month").isNotNull())
    # the member's own next snapshot row (a window per member: at most one row per month), instead
    # of a self-join of the flags; it counts only when it is the cohort's next month
    wm = Window.partitionBy("account", "agent").orderBy("snapshot_month")
    f = flags.select("*", F.lead("snapshot_month").over(wm).alias("n_month"), F.lead("active").over(wm).alias("n_active"),
                     F.lead("deposit").over(wm).alias("n_deposit"))
    j = f.join(F.broadcast(months), "snapshot_month")
    hit = F.col("n_month") == F.col("next_month")
    na = F.coalesce(hit & F.col("n_active"), F.lit(False))
    nd = F.coalesce(hit & F.col("n_deposit"), F.lit(False))
    g = j.groupBy(F.col("snapshot_month").alias("month"), "next_month").agg(
        F.count_if("active").alias("active_members"),
        F.count_if(F.col("active") & na).alias("active_kept"),
        F.count_if("deposit").alias("deposit_members"),
        F.count_if(F.col("deposit") & nd).alias("deposit_kept"),
        F.count_if("first").alias("first_members"),
        F.count_if(F.col("first") & na).alias("first_kept"),
    )
    return g.select("month", "next_month",
                    ratio(F.col("active_kept").cast("double"), "active_members").alias("active_retention"),
                    ratio(F.col("deposit_kept").cast("double"), "deposit_members").alias("deposit_retention"),
                    ratio(F.col("first_kept").cast("double"), "first_members").alias("first_retention"),
                    "active_members", "deposit_members", "first_members")


def retention_long(ret: DataFrame) -> DataFrame:
    """AG-39 long form (month, kind, retention)."""
    return ret.select("month", "active_retention", "deposit_retention", "first_retention") \
              .unpivot(["month"], ["active_retention", "deposit_retention", "first_retention"], "kind", "retention")


def register_month_check(member: DataFrame) -> DataFrame:
    """AG-40: per register month: members, turnover, income."""
    return member.groupBy(F.date_format("registered_at", "yyyy-MM").alias("register_month")).agg(
        member_count(member).alias("members"), F.sum("turnover").alias("turnover"),
        F.sum("company_income").alias("company_income"))


# ---------------------------------------------------------------- agent x member matrix (AG-85…93)

ADDITIVE = ("deposits", "withdrawals", "turnover", "company_win", "bonus", "rebate", "company_income")


def member_rollup(member: DataFrame, months: Sequence[str] | None = None) -> DataFrame:
    """AG-85: per (account, agent; NULL and blank agents are '(直客)') over a month subset: max VIP (text order), sums, last non-null
    status and tags (by month), distinct months."""
    df = member if months is None else member.where(F.col("snapshot_month").isin(list(months)))
    df = df.withColumn("agent", fill_label("agent", LBL_DIRECT))
    last = lambda c: F.max_by(F.when(F.col(c).isNotNull(), F.col(c)),
                              F.when(F.col(c).isNotNull(), F.col("snapshot_month")))
    return df.groupBy("account", "agent").agg(
        F.max("vip").alias("vip"), *[F.sum(c).alias(c) for c in ADDITIVE],
        last("status").alias("status"), last("tags").alias("tags"),
        F.count_distinct("snapshot_month").alias("months"))


def member_ratios(rollup: DataFrame) -> DataFrame:
    """AG-86: give % = (bonus + rebate) / turnover (2dp) and holding % = win / turnover (3dp); divisor 0 -> 1."""
    give = (F.col("bonus") + F.col("rebate")).cast("double")
    return rollup.withColumns({
        "give_pct": F.round(ratio(give, F.col("turnover").cast("double"), "one") * 100.0, 2),
        "hold_pct": F.round(ratio(F.col("company_win").cast("double"), F.col("turnover").cast("double"), "one") * 100.0, 3),
    })


# fixed values: arbitrage thresholds (turnover, |win| / turnover, bonus + rebate) and risk-tag words
ARBITRAGE = (1_000_000.0, 0.005, 10_000.0)
TAG_KEYWORDS = ("套利", "高风险", "多平台", "跨平台对打", "骗分", "专业玩家", "软件投注")


def arbitrage_flag(rollup: DataFrame, thresholds=ARBITRAGE, keywords=TAG_KEYWORDS) -> DataFrame:
    """AG-87 / AG-88: arbitrage pattern flag and the ordered risk-tag hits."""
    t_to, t_ratio, t_give = thresholds
    to = F.col("turnover").cast("double")
    flag = (to > t_to) & (ratio(F.abs(F.col("company_win").cast("double")), to, "one") < t_ratio) & \
           ((F.col("bonus") + F.col("rebate")).cast("double") > t_give)
    return rollup.withColumn("arbitrage", flag).withColumn("tag_hits", tag_hits("tags", keywords))


def agent_overview(flagged: DataFrame) -> DataFrame:
    """AG-89: per agent (NULL and blank -> '(直客)'): members, sums, flagged members, ratios."""
    g = flagged.groupBy(fill_label("agent", LBL_DIRECT).alias("agent")).agg(
        F.count(F.lit(1)).alias("members"), *[F.sum(c).alias(c) for c in ("turnover", "company_win", "bonus", "rebate",
                                                                           "company_income")],
        F.count_if(F.col("arbitrage") | (F.col("tag_hits") != "")).alias("flagged"))
    return g.withColumns({
        "give_pct": F.round(ratio((F.col("bonus") + F.col("rebate")).cast("double"), F.col("turnover").cast("double"), "one") * 100.0, 2),
        "hold_pct": F.round(ratio(F.col("company_win").cast("double"), F.col("turnover").cast("double"), "one") * 100.0, 3),
    })


def flagged_members(flagged: DataFrame) -> DataFrame:
    """AG-90: members with the arbitrage pattern or a risk tag, by turnover desc."""
    return flagged.where(F.col("arbitrage") | (F.col("tag_hits") != "")) \
                  .orderBy(F.col("turnover").desc(), "account", F.col("agent").asc_nulls_first())


def member_history(member: DataFrame, account: str) -> DataFrame:
    """AG-91: one member's monthly rows."""
    return member.where(F.col("account") == account).groupBy("snapshot_month").agg(
        *[F.sum(c).alias(c) for c in ("deposits", "turnover", "company_win", "company_income")])


def agent_monthly(agent: DataFrame, q: str) -> DataFrame:
    """AG-91: an agent's official monthly report (sums by ``substr(date, 1, 7)``), looked up by name or number."""
    from .filters import agent_lookup
    f = agent_lookup(agent, q)
    return f.groupBy(F.substring(F.col("date").cast("string"), 1, 7).alias("month")).agg(
        *[F.sum(c).alias(c) for c in ("registrations", "turnover", "company_win", "company_income")])


def agent_members(flagged: DataFrame, agent: str | None) -> DataFrame:
    """AG-92: one agent's members (None = direct members) by turnover."""
    cond = F.col("agent").isNull() if agent is None else (F.col("agent") == agent)
    return flagged.where(cond).orderBy(F.col("turnover").desc(), "account")


def all_members(flagged: DataFrame, vips: Sequence[str] | None = None, status: str | None = None,
                pattern: str | None = None, sort: str = "turnover") -> DataFrame:
    """AG-92: all members with VIP / status / regex search filters, sorted desc. [SL-01]"""
    df = flagged
    if vips is not None:
        df = df.where(F.col("vip").isin(list(vips)))
    if status is not None:
        df = df.where(utrim("status") == status)
    if pattern:
        df = df.where(F.coalesce(F.col("account"), F.lit("")).rlike("(?i)" + pattern) |
                      F.coalesce(F.col("agent"), F.lit("")).rlike("(?i)" + pattern))
    return df.orderBy(F.col(sort).desc(), "account", F.col("agent").asc_nulls_first())


def tagged_enabled(flagged: DataFrame, k: int = 100, status_enabled: str = "启用") -> DataFrame:
    """AG-93: members with a risk tag and still enabled, top-k by turnover."""
    return flagged.where((F.col("tag_hits") != "") & (F.col("status") == status_enabled)) \
                  .orderBy(F.col("turnover").desc(), "account", F.col("agent").asc_nulls_first()).limit(k)


def action_list(tagged_top: DataFrame, k: int = 50) -> DataFrame:
    """AG-93: from the tagged-enabled list (already risk-flagged), the loss-making ones (income < 0)."""
    return tagged_top.where(F.col("company_income") < 0) \
                     .orderBy(F.col("company_income").asc(), "account", F.col("agent").asc_nulls_first()).limit(k)
