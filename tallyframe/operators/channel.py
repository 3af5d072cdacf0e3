"""Agents & channels (AG-27…30) and games & venues (AG-31…34)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import LBL_EMPTY
from .common import hierarchy_totals, safe_sum, top_by


def channel_kpis(agent: DataFrame, promo: DataFrame) -> DataFrame:
    """AG-27: distinct agents, turnover, win, commission (agent report) + promotion income (promo report)."""
    a = agent.agg(F.count_distinct("agent_no").alias("agents"), safe_sum(agent, "turnover").alias("turnover"),
                  safe_sum(agent, "company_win").alias("company_win"),
                  safe_sum(agent, "agent_commission").alias("agent_commission"))
    p = promo.agg(safe_sum(promo, "promo_income").alias("promo_income"))
    return a.crossJoin(p)


def top_agents(agent: DataFrame, k: int = 10) -> DataFrame:
    """AG-28: top-k agents by turnover."""
    return top_by(agent, ["agent_name"], "turnover", k)


def top_channels(promo: DataFrame, k: int = 10) -> DataFrame:
    """AG-28: top-k level-1 channels by turnover."""
    return top_by(promo, ["l1"], "turnover", k)


def agent_scatter(agent: DataFrame) -> DataFrame:
    """AG-29: turnover and win per agent."""
    return agent.groupBy("agent_name").agg(F.sum("turnover").alias("turnover"), F.sum("company_win").alias("company_win"))


def channel_hierarchy(promo: DataFrame, levels=("l1", "l2", "l3", "l4"), metric: str = "turnover") -> DataFrame:
    """AG-30: totals at every level of the 4-level channel tree, NULL labels -> '空值'."""
    return hierarchy_totals(promo, list(levels), metric, fill=LBL_EMPTY)


def venue_kpis(venue: DataFrame) -> DataFrame:
    """AG-31: turnover, win, bettor-visits, distinct venues and sites, single-site notice."""
    g = venue.agg(safe_sum(venue, "turnover").alias("turnover"), safe_sum(venue, "company_win").alias("company_win"),
                  safe_sum(venue, "bettors").alias("bettors"), F.count_distinct("venue").alias("venues"),
                  F.count_distinct("site").alias("sites"))
    return g.withColumn("single_site", F.col("sites") <= 1)


def top_venues(venue: DataFrame, k: int = 15) -> DataFrame:
    """AG-32: top-k venues by turnover."""
    return top_by(venue, ["venue"], "turnover", k)


def game_hierarchy(game: DataFrame, metric: str = "turnover") -> DataFrame:
    """AG-33: type -> venue totals (ROLLUP)."""
    return hierarchy_totals(game, ["type", "venue"], metric, fill=LBL_EMPTY)


def game_detail(game: DataFrame) -> DataFrame:
    """AG-34: game rows newest first."""
    return game.select("date", "type", "venue", "game", "bettors", "turnover", "company_win") \
               .orderBy(F.col("date").desc(), "type", "venue", "game")
