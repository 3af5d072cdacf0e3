"""New-registration analysis (AG-101…113).

``prepare_newreg`` builds the per-member frame in ONE aggregation keyed by
(account, agent): the latest snapshot's attributes (``max_by`` over the month) and the
lifetime sums of the additive columns come out of the same shuffle, instead of a
dedupe + a second aggregate + a join.  ``max_by`` is partially aggregated map-side,
so a hot member key is reduced in every task before the exchange.

Quality metrics are exposed as unrounded doubles (rounding is presentation).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import (LBL_DIRECT_NO_AGENT, LBL_UNRECORDED, fill_label, hours_between, invite_code, ratio, url_domain,
                               utrim)
from .common import crosstab_top
from .dedupe import keep_last

# latest-snapshot attributes carried into the new-registration frame
ATTRS = ("registered_at", "first_deposit_at", "first_deposit", "first_bet", "vip", "status", "source",
         "register_channel", "register_url", "tags")
ATTR_TYPES = {"registered_at": "timestamp_ntz", "first_deposit_at": "timestamp_ntz", "first_deposit": "double",
              "first_bet": "double"}
# fixed values: additive columns summed over snapshots for the cohort lifetime value
LIFETIME = (("company_income", "net_income"), ("turnover", "lifetime_turnover"), ("bonus", "bonus_n"),
            ("rebate", "rebate_n"))


def prepare_newreg(member: DataFrame, imported_col: str | None = "_imported_at") -> DataFrame:
    """AG-101: one row per (account, agent) with derived registration fields and lifetime sums; a blank
    agent is no agent. [FL-10, JN-05, WN-03]"""
    df = member.withColumn("agent", F.nullif(utrim("agent"), F.lit("")))
    if imported_col and imported_col in df.columns:
        # the same month imported twice counts once: keep the latest import per (member, month); rows of
        # one import are told apart by all their values
        rest = [c for c in df.columns if c not in ("account", "agent", "snapshot_month", imported_col)]
        df = keep_last(df, ["account", "agent", "snapshot_month"], [imported_col, *rest])
    attrs = [a for a in ATTRS if a in df.columns]
    latest = F.max_by(F.struct(*[F.col(a) for a in attrs]), F.col("snapshot_month"))
    g = df.groupBy("account", "agent").agg(
        latest.alias("__l"), *[F.coalesce(F.sum(src), F.lit(0)).alias(dst) for src, dst in LIFETIME if src in df.columns])
    out = g.select("account", "agent", *[F.col("__l")[a].alias(a) for a in attrs],
                   *[dst for src, dst in LIFETIME if src in df.columns])
    # optional report columns may be absent from an upload: missing attributes are NULL, sums 0
    for a in ATTRS:
        if a not in out.columns:
            out = out.withColumn(a, F.lit(None).cast(ATTR_TYPES.get(a, "string")))
    for _src, dst in LIFETIME:
        if dst not in out.columns:
            out = out.withColumn(dst, F.lit(0).cast("decimal(38,4)"))
    out = out.where(F.col("registered_at").isNotNull())
    fd = F.coalesce(F.col("first_deposit").cast("double"), F.lit(0.0))
    fb = F.coalesce(F.col("first_bet").cast("double"), F.lit(0.0))
    ttf = hours_between("registered_at", "first_deposit_at")
    return out.select(
        "*",
        F.date_format("registered_at", "yyyy-MM-dd").alias("reg_day"),
        F.date_format("registered_at", "yyyy-MM").alias("reg_month"),
        fd.alias("first_dep"), (fd > 0).alias("has_first_deposit"),
        fb.alias("first_bet_amt"), (fb > 0).alias("has_first_bet"),
        F.when((fd > 0) & (ttf >= 0), ttf).alias("ttf_hours"),
        fill_label("agent", LBL_DIRECT_NO_AGENT).alias("agent_label"),
        url_domain("register_url").alias("domain"),
        invite_code("register_url").alias("invite_code"),
    )


def newreg_kpis(nr: DataFrame) -> DataFrame:
    """AG-102: registrations, distinct accounts, depositors and %, first-deposit sum, direct vs agent, productive agents."""
    g = nr.agg(F.count(F.lit(1)).alias("registrations"), F.count_distinct("account").alias("accounts"),
               F.count_if("has_first_deposit").alias("depositors"), F.sum("first_dep").alias("first_deposit_sum"),
               F.count_if(F.col("agent").isNull()).alias("direct"),
               F.count_distinct(F.when(F.col("has_first_deposit"), F.col("agent"))).alias("productive_agents"))
    return g.withColumn("agent_sourced", F.col("registrations") - F.col("direct")) \
            .withColumn("depositor_pct", ratio(F.col("depositors").cast("double"), "registrations") * 100.0)


def newreg_daily(nr: DataFrame) -> DataFrame:
    """AG-103: registrations per day split deposited / not deposited."""
    return nr.groupBy("reg_day").agg(F.count_if("has_first_deposit").alias("deposited"),
                                     F.count_if(~F.col("has_first_deposit")).alias("not_deposited"))


def group_quality(nr: DataFrame, dims: Sequence[str]) -> DataFrame:
    """AG-104: per group: registrations, conversion %, no-deposit %, mean first deposit, net income per [UD-05]
    head and total, arbitrage ratio % = (bonus + rebate) / turnover (999 when turnover 0 and give > 0)."""
    g = nr.groupBy(*dims).agg(
        F.count(F.lit(1)).alias("registrations"), F.count_if("has_first_deposit").alias("depositors"),
        F.sum("first_dep").alias("first_dep_sum"), F.sum("net_income").cast("double").alias("net_income_total"),
        F.sum("lifetime_turnover").cast("double").alias("turnover"),
        F.sum(F.col("bonus_n") + F.col("rebate_n")).cast("double").alias("give"))
    n = F.col("registrations").cast("double")
    return g.select(
        *dims, "registrations",
        (F.col("depositors") / n * 100.0).alias("conversion_pct"),
        ((F.col("registrations") - F.col("depositors")) / n * 100.0).alias("no_deposit_pct"),
        (F.col("first_dep_sum") / n).alias("avg_first_deposit"),
        (F.col("net_income_total") / n).alias("net_per_head"),
        "net_income_total",
        F.when(F.col("turnover") > 0, F.col("give") / F.col("turnover") * 100.0)
         .when(F.col("give") > 0, F.lit(999.0)).alias("arbitrage_ratio_pct"),
    )


# fixed values: display order of member sources
SOURCE_ORDER = (("直客", 0), ("普代下线", 1), ("官代下线", 2))
DIRECT_SOURCE = "直客"


def value_by_source(nr: DataFrame) -> DataFrame:
    """AG-105: group quality per member source (NULL -> '(未记录)') in the fixed source order. [SL-05]"""
    df = nr.withColumn("source", F.coalesce(F.col("source"), F.lit(LBL_UNRECORDED)))
    order = F.lit(9)
    for s, i in reversed(SOURCE_ORDER):
        order = F.when(F.col("source") == s, F.lit(i)).otherwise(order)
    return group_quality(df, ["source"]).withColumn("source_order", order).orderBy("source_order", "source")


def direct_vs_agent(nr: DataFrame) -> DataFrame:
    """AG-105 verdict numbers: direct vs agent-sourced count, conversion % and net income per head."""
    df = nr.withColumn("side", F.when(F.coalesce(F.col("source"), F.lit(LBL_UNRECORDED)) == DIRECT_SOURCE, "direct")
                       .otherwise("agent"))
    return df.groupBy("side").agg(F.count(F.lit(1)).alias("members"),
                                  (F.avg(F.col("has_first_deposit").cast("double")) * 100.0).alias("conversion_pct"),
                                  F.avg(F.col("net_income").cast("double")).alias("net_per_head"))


# fixed values: quality-board flags
FLAG_PADDING = "刷量嫌疑"
FLAG_ARBITRAGE = "红利套利"


def agent_quality_board(nr: DataFrame, min_n: int = 5, k: int = 40) -> DataFrame:
    """AG-106: per agent with >= min_n registrations; flags 'volume padding' (n >= max(min_n, 10) and [UD-08]
    no-deposit % >= 80) and 'bonus arbitrage' (ratio >= 100); top-k by registrations."""
    q = group_quality(nr, ["agent_label"]).where(F.col("registrations") >= min_n)
    # the flags compare the displayed (half-even rounded) percentages, like the source report
    pad = (F.col("registrations") >= max(min_n, 10)) & (F.bround("no_deposit_pct", 0) >= 80)
    arb = F.coalesce(F.bround("arbitrage_ratio_pct", 1) >= 100, F.lit(False))
    flags = F.concat_ws(" ", F.when(pad, F.lit(FLAG_PADDING)), F.when(arb, F.lit(FLAG_ARBITRAGE)))
    return q.withColumn("risk", flags).orderBy(F.col("registrations").desc(), "agent_label").limit(k)


def funnel(nr: DataFrame) -> DataFrame:
    """AG-107: registration -> first deposit -> first bet, with step and overall rates (long form)."""
    g = nr.agg(F.count(F.lit(1)).alias("n0"), F.count_if("has_first_deposit").alias("n1"),
               F.count_if("has_first_bet").alias("n2"))
    rows = g.select(F.expr("stack(3, 0, '注册', n0, n0, n0, 1, '首存', n1, n0, n0, 2, '首投', n2, n1, n0) "
                           "AS (step, label, n, prev_n, first_n)"))
    return rows.select("step", "label", "n",
                       ratio(F.col("n").cast("double"), "prev_n").alias("step_rate"),
                       ratio(F.col("n").cast("double"), "first_n").alias("overall_rate"))


def ttf_stats(nr: DataFrame) -> DataFrame:
    """AG-108: median TTF hours, share under 1h, median first deposit of depositors, count (exact
    distributed medians, see ``operators/quantiles.py``)."""
    from .quantiles import exact_quantiles
    base = nr.agg(F.avg(F.when(F.col("ttf_hours").isNotNull(), (F.col("ttf_hours") < 1).cast("double"))).alias("share_under_1h"),
                  F.count("ttf_hours").alias("with_ttf"))
    m1 = exact_quantiles(nr, "ttf_hours", [0.5]).select(F.col("q_0_5").alias("median_ttf_hours"))
    m2 = exact_quantiles(nr.where("has_first_deposit"), "first_dep", [0.5]) \
        .select(F.col("q_0_5").alias("median_first_deposit"))
    return base.crossJoin(F.broadcast(m1)).crossJoin(F.broadcast(m2))


# fixed values: TTF bands in hours (left-closed)
TTF_BANDS = ("<1h", "1-24h", "1-7d", ">7d")


def ttf_bands(nr: DataFrame) -> DataFrame:
    """AG-108: members per TTF band [0,1) [1,24) [24,168) [168,inf); every band emitted."""
    from .common import band, band_counts
    t = F.col("ttf_hours")
    lbl = band(t, [("<1h", t < 1), ("1-24h", t < 24), ("1-7d", t < 168)], ">7d")
    return band_counts(nr.where(t.isNotNull()), lbl, TTF_BANDS, [F.count(F.lit(1)).alias("members")])


def ttf_by(nr: DataFrame, dim: str) -> DataFrame:
    """AG-108: exact median TTF and count per dimension."""
    from .quantiles import exact_quantiles
    df = nr.where(F.col("ttf_hours").isNotNull()).withColumn(dim, F.coalesce(F.col(dim), F.lit(LBL_UNRECORDED)))
    cnt = df.groupBy(dim).agg(F.count(F.lit(1)).alias("members"))
    med = exact_quantiles(df, "ttf_hours", [0.5], group=dim).withColumnRenamed("q_0_5", "median_ttf_hours")
    return cnt.join(med, dim, "left")


def cohort_pl(nr: DataFrame) -> DataFrame:
    """AG-109: group quality per register month."""
    return group_quality(nr, ["reg_month"])


def rank_with_tail(nr: DataFrame, dim: str, k: int = 20) -> DataFrame:
    """AG-110: top-k groups by registrations (depositors, first-deposit sum, share without deposit) plus
    one tail row summarising the rest.

    The tail is all groups less the top ones, so every part comes from one grouped frame, whose
    exchange is reused.
    """
    sums = ("registrations", "depositors", "first_deposit_sum")
    g = nr.groupBy(F.coalesce(F.col(dim), F.lit(LBL_UNRECORDED)).alias(dim)).agg(
        F.count(F.lit(1)).alias("registrations"), F.count_if("has_first_deposit").alias("depositors"),
        F.sum("first_dep").alias("first_deposit_sum"))
    top = g.orderBy(F.col("registrations").desc(), dim).limit(k)
    whole = g.agg(*[F.sum(c).alias(c) for c in sums], F.count(F.lit(1)).alias("groups"))
    shown = top.agg(*[F.sum(c).alias(f"__{c}") for c in sums], F.count(F.lit(1)).alias("__groups"))
    tail = whole.crossJoin(shown).select(F.lit("(其余)").alias(dim), *[(F.col(c) - F.col(f"__{c}")).alias(c) for c in (*sums, "groups")])
    out = top.withColumn("groups", F.lit(1).cast("bigint")).unionByName(tail.where(F.col("groups") > 0))
    return out.select(dim, *sums, no_deposit_pct(), "groups")


def no_deposit_pct() -> Column:
    """Share of registrations without a first deposit, in whole per cent."""
    return F.round((F.col("registrations") - F.col("depositors")).cast("double") / F.col("registrations") * 100.0, 0).alias("no_deposit_pct")


def invite_ranking(nr: DataFrame, k: int = 20) -> DataFrame:
    """AG-111: per invite code: registrations, depositors, first-deposit sum, share without deposit and the
    most frequent agent (smallest on ties). [UD-04]"""
    pairs = nr.where(F.col("invite_code").isNotNull()).groupBy("invite_code", "agent_label").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("has_first_deposit").alias("d"), F.sum("first_dep").alias("fd"))
    g = pairs.groupBy("invite_code").agg(F.sum("n").alias("registrations"), F.sum("d").alias("depositors"),
                                         F.sum("fd").alias("first_deposit_sum"),
                                         F.min_by("agent_label", F.struct(-F.col("n"), F.col("agent_label"))).alias("top_agent"))
    return g.withColumn("no_deposit_pct", no_deposit_pct()).orderBy(F.col("registrations").desc(), "invite_code").limit(k)


def crosstab(nr: DataFrame, a: str, b: str, k: int = 15) -> DataFrame:
    """AG-112: registrations cross-tab of two dimensions, top-k x top-k by marginals (long form)."""
    df = nr.withColumns({a: F.coalesce(F.col(a), F.lit(LBL_UNRECORDED)), b: F.coalesce(F.col(b), F.lit(LBL_UNRECORDED))})
    return crosstab_top(df, a, b, k=k)


def agent_newreg(nr: DataFrame, agent_label: str) -> DataFrame:
    """AG-113: one agent's new members."""
    return nr.where(F.col("agent_label") == agent_label).select(
        "account", "reg_day", "first_dep", "has_first_deposit", "ttf_hours", "domain", "invite_code", "net_income")
