"""Bet-detail reports (AG-64…73, FL-06) over one bet table partitioned by ``bet_month``.

The reference issues up to ten statements per page; here every report is a lazy plan on
the same filtered frame, so Parquet partition pruning and predicate pushdown come from the
filter in ``bet_filter`` and Catalyst collapses each report to scan -> partial agg ->
shuffle(keys) -> final agg.  ``players`` stays an exact distinct count; pass
``approx=True`` to switch to HyperLogLog++ at very large scale.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import numeric_order, ratio
from .common import top_and_total, with_share


def _players(approx: bool):
    return F.approx_count_distinct("account") if approx else F.count_distinct("account")


def bet_filter(bets: DataFrame, start=None, end=None, types: Sequence[str] | None = None,
               vips: Sequence[str] | None = None, venues: Sequence[str] | None = None,
               date_col: str = "bet_at") -> DataFrame:
    """FL-06: AND-ed predicates, each only when narrower than 'all' (None = no filter).

    Dates are half-open [start, end + 1 day) so the whole last day is included.
    """
    df = bets
    if start is not None:
        df = df.where(F.col(date_col) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.where(F.col(date_col) < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz"))
    if types is not None:
        df = df.where(F.col("type").isin(list(types)))
    if vips is not None:
        df = df.where(F.col("vip").isin(list(vips)))
    if venues is not None:
        df = df.where(F.col("venue").isin(list(venues)))
    return df


def hit_rate(filtered: DataFrame, all_bets: DataFrame) -> DataFrame:
    """FL-06: hits of the filter and their share of all bets."""
    a = filtered.agg(F.count(F.lit(1)).alias("hits"))
    b = all_bets.agg(F.count(F.lit(1)).alias("total"))
    return a.crossJoin(b).withColumn("hit_pct", F.col("hits") * 100.0 / F.nullif(F.col("total"), F.lit(0)))


def bet_meta(bets: DataFrame) -> DataFrame:
    """AG-64: rows and bet-date range."""
    return bets.agg(F.count(F.lit(1)).alias("rows"), F.to_date(F.min("bet_at")).alias("min_date"),
                    F.to_date(F.max("bet_at")).alias("max_date"))


def bet_months(bets: DataFrame) -> DataFrame:
    """IO-03: available months (distinct partition values) newest first."""
    return bets.select("bet_month").distinct()


def bet_options(bets: DataFrame) -> DataFrame:
    """AG-65: distinct (type, vip, venue) option triples."""
    return bets.select("type", "vip", "venue").distinct()


def bet_kpis(bets: DataFrame, approx: bool = False) -> DataFrame:
    """AG-66: bets, turnover, stake, pnl, players, hold% = -pnl / turnover x 100 (0 when no turnover)."""
    g = bets.agg(F.count(F.lit(1)).alias("bets"), F.sum("turnover").alias("turnover"), F.sum("stake").alias("stake"),
                 F.sum("player_pnl").alias("pnl"), _players(approx).alias("players"))
    return g.withColumn("hold_pct", F.coalesce(ratio(-F.col("pnl") * 100.0, "turnover"), F.lit(0.0)))


def _by(bets: DataFrame, keys: Sequence[str], approx: bool, extra=()) -> DataFrame:
    return bets.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("bets"), F.sum("turnover").alias("turnover"),
        F.sum("player_pnl").alias("pnl"), _players(approx).alias("players"), *extra)


def venue_report(bets: DataFrame, k: int | None = 15, approx: bool = False) -> DataFrame:
    """AG-67: per (venue, type): bets, turnover, pnl, players, avg bet, platform P&L, hold% (3dp), share% (2dp).

    Ordered by turnover desc (venue, type tiebreak); ``k`` keeps the top rows.
    """
    g = _by(bets, ["venue", "type"], approx)
    g = g.withColumn("avg_bet", ratio("turnover", "bets")) \
         .withColumn("platform_pnl", -F.col("pnl")) \
         .withColumn("hold_pct", F.round(ratio(F.col("platform_pnl") * 100.0, "turnover"), 3))
    g = with_share(g, "turnover", "share_pct", 2)
    g = g.orderBy(F.col("turnover").desc(), "venue", "type")
    return g.limit(k) if k else g


def type_share(bets: DataFrame) -> DataFrame:
    """AG-68: turnover per type with share%."""
    g = bets.groupBy("type").agg(F.sum("turnover").alias("turnover"))
    return with_share(g, "turnover", "share_pct", 2)


def type_report(bets: DataFrame, approx: bool = False) -> DataFrame:
    """AG-69: per type + turnover per player (0 dp) and share%."""
    g = _by(bets, ["type"], approx)
    g = g.withColumn("platform_pnl", -F.col("pnl")) \
         .withColumn("hold_pct", F.round(ratio(F.col("platform_pnl") * 100.0, "turnover"), 3)) \
         .withColumn("turnover_per_player", F.round(ratio("turnover", "players"), 0))
    return with_share(g, "turnover", "share_pct", 2).orderBy(F.col("turnover").desc(), "type")


def vip_report(bets: DataFrame, approx: bool = False) -> DataFrame:
    """AG-70 / SL-03: per VIP level ordered numerically, non-numeric levels last, with turnover per player and share %."""
    g = _by(bets, ["vip"], approx)
    g = g.withColumn("platform_pnl", -F.col("pnl")) \
         .withColumn("hold_pct", F.round(ratio(F.col("platform_pnl") * 100.0, "turnover"), 3)) \
         .withColumn("turnover_per_player", F.round(ratio("turnover", "players"), 0)) \
         .withColumn("vip_order", numeric_order("vip"))
    return with_share(g, "turnover", "share_pct", 2).orderBy("vip_order", "vip")


def vip_type_matrix(bets: DataFrame, types: Sequence[str]) -> DataFrame:
    """AG-71: VIP x type turnover cross table, explicit type list, missing -> 0, numeric VIP order."""
    p = bets.groupBy("vip").pivot("type", list(types)).agg(F.sum("turnover"))
    p = p.na.fill(0.0, subset=list(types))
    return p.withColumn("vip_order", numeric_order("vip")).orderBy("vip_order", "vip")


def top_players(bets: DataFrame, k: int = 100) -> DataFrame:
    """AG-72: top-k (account, vip) by turnover: bets, pnl, distinct venues, hold% (2dp)."""
    g = bets.groupBy("account", "vip").agg(
        F.count(F.lit(1)).alias("bets"), F.sum("turnover").alias("turnover"),
        F.sum("player_pnl").alias("pnl"), F.count_distinct("venue").alias("venues"))
    g = g.withColumn("platform_pnl", -F.col("pnl")) \
         .withColumn("hold_pct", F.round(ratio(F.col("platform_pnl") * 100.0, "turnover"), 2))
    return g.orderBy(F.col("turnover").desc(), "account", "vip").limit(k)


def concentration(bets: DataFrame, k: int = 100) -> DataFrame:
    """AG-73: turnover of the top-k players / total turnover x 100."""
    players = bets.groupBy("account", "vip").agg(F.sum("turnover").alias("turnover"))
    return top_and_total(players, "turnover", k).withColumnsRenamed({"top": "top_turnover", "total": "total_turnover"}).withColumn(
        "concentration_pct", F.coalesce(ratio(F.col("top_turnover") * 100.0, "total_turnover"), F.lit(0.0)))
