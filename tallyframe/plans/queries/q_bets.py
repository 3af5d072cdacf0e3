"""Bet-detail queries (AG-64…73, FL-06, IO-03) on the bet stand-in."""

import uuid

from pyspark.sql import functions as F

from ...operators import bets as B
from ...session import scratch_path
from ...sources.files import read_bets
from ...sources.publish import write_partitions
from .. import standins as S
from ..catalog import register
from ..oracle_ctes import with_ctes

TYPES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")

_BY = """count(*) AS bets, sum(turnover) AS turnover, sum(player_pnl) AS pnl, count(DISTINCT account) AS players"""


@register("ag67_venue_report", with_ctes("bets", body=f"""
SELECT venue, type, bets, turnover, pnl, players, turnover / nullif(bets, 0) AS avg_bet, -pnl AS platform_pnl,
  round(-pnl*100.0 / nullif(turnover, 0), 3) AS hold_pct,
  round(turnover*100.0 / nullif(sum(turnover) OVER (), 0), 2) AS share_pct
FROM (SELECT venue, type, {_BY} FROM bets GROUP BY venue, type) g
ORDER BY turnover DESC, venue, type LIMIT 15"""))
def ag67(spark, d):
    return B.venue_report(S.bets(spark, d), k=15)


@register("ag64_bet_meta", with_ctes("bets", body="""
SELECT count(*) AS rows, CAST(min(bet_at) AS DATE) AS min_date, CAST(max(bet_at) AS DATE) AS max_date FROM bets"""))
def ag64(spark, d):
    return B.bet_meta(S.bets(spark, d))


@register("io03_bet_months", with_ctes("bets", body="SELECT DISTINCT bet_month FROM bets"))
def io03(spark, d):
    return B.bet_months(S.bets(spark, d))


@register("io03_read_bet_table", with_ctes("bets", body="""
SELECT bet_month, count(*) AS bets, sum(turnover) AS turnover FROM bets GROUP BY bet_month"""))
def io03_table(spark, d):
    """The bet table written by month and read back: months from its folders, then each month through its partition."""
    path = scratch_path(spark, f"io03/{uuid.uuid4().hex}")
    write_partitions(S.bets(spark, d).select("turnover", "bet_month"), path, "bet_month")
    months = [r["bet_month"] for r in B.bet_months(read_bets(spark, path)).collect()]  # calendar-bounded
    return read_bets(spark, path, months).groupBy("bet_month").agg(F.count(F.lit(1)).alias("bets"), F.sum("turnover").alias("turnover"))


@register("ag65_bet_options", with_ctes("bets", body="SELECT DISTINCT type, vip, venue FROM bets"))
def ag65(spark, d):
    return B.bet_options(S.bets(spark, d))


@register("ag66_bet_kpis", with_ctes("bets", body=f"""
SELECT bets, turnover, stake, pnl, players, coalesce(-pnl*100.0 / nullif(turnover, 0), 0.0) AS hold_pct FROM (
SELECT count(*) AS bets, sum(turnover) AS turnover, sum(stake) AS stake, sum(player_pnl) AS pnl,
  count(DISTINCT account) AS players FROM bets)"""))
def ag66(spark, d):
    return B.bet_kpis(S.bets(spark, d))


@register("fl06_bet_filter_hits", with_ctes("bets", body="""
SELECT hits, total, hits*100.0 / nullif(total, 0) AS hit_pct FROM
 (SELECT count(*) AS hits FROM bets WHERE bet_at >= TIMESTAMP '1997-01-01' AND bet_at < DATE '1999-01-01'
    AND type IN ('PROMO','STANDARD') AND vip IN ('1','2','3','10')) a,
 (SELECT count(*) AS total FROM bets) b"""))
def fl06(spark, d):
    b = S.bets(spark, d)
    f = B.bet_filter(b, start="1997-01-01", end="1998-12-31", types=["PROMO", "STANDARD"], vips=["1", "2", "3", "10"])
    return B.hit_rate(f, b)


@register("ag68_type_share", with_ctes("bets", body="""
SELECT type, turnover, round(turnover*100.0 / nullif(sum(turnover) OVER (), 0), 2) AS share_pct
FROM (SELECT type, sum(turnover) AS turnover FROM bets GROUP BY type)"""))
def ag68(spark, d):
    return B.type_share(S.bets(spark, d))


@register("ag69_type_report", with_ctes("bets", body=f"""
SELECT type, bets, turnover, pnl, players, -pnl AS platform_pnl,
  round(-pnl*100.0 / nullif(turnover, 0), 3) AS hold_pct,
  round(turnover / nullif(players, 0), 0) AS turnover_per_player,
  round(turnover*100.0 / nullif(sum(turnover) OVER (), 0), 2) AS share_pct
FROM (SELECT type, {_BY} FROM bets GROUP BY type)"""))
def ag69(spark, d):
    return B.type_report(S.bets(spark, d))


@register("ag70_vip_report", with_ctes("bets", body=f"""
SELECT vip, bets, turnover, pnl, players, -pnl AS platform_pnl,
  round(-pnl*100.0 / nullif(turnover, 0), 3) AS hold_pct,
  round(turnover / nullif(players, 0), 0) AS turnover_per_player,
  round(turnover*100.0 / nullif(sum(turnover) OVER (), 0), 2) AS share_pct,
  coalesce(TRY_CAST(trim(vip) AS INTEGER), 99) AS vip_order
FROM (SELECT vip, {_BY} FROM bets GROUP BY vip)"""))
def ag70(spark, d):
    return B.vip_report(S.bets(spark, d))


@register("ag71_vip_type_matrix", with_ctes("bets", body="SELECT vip, " + ", ".join(
    f"coalesce(sum(CASE WHEN type = '{t}' THEN turnover END), 0.0) AS \"{t}\"" for t in TYPES) +
    ", coalesce(TRY_CAST(trim(vip) AS INTEGER), 99) AS vip_order FROM bets GROUP BY vip"))
def ag71(spark, d):
    return B.vip_type_matrix(S.bets(spark, d), TYPES)


@register("ag72_top_players", with_ctes("bets", body="""
SELECT account, vip, bets, turnover, pnl, venues, -pnl AS platform_pnl,
  round(-pnl*100.0 / nullif(turnover, 0), 2) AS hold_pct FROM (
SELECT account, vip, count(*) AS bets, sum(turnover) AS turnover, sum(player_pnl) AS pnl,
  count(DISTINCT venue) AS venues FROM bets GROUP BY account, vip)
ORDER BY turnover DESC, account, vip LIMIT 100"""))
def ag72(spark, d):
    return B.top_players(S.bets(spark, d), 100)


@register("ag73_concentration", with_ctes("bets", body="""
SELECT top_turnover, total_turnover, coalesce(top_turnover*100.0 / nullif(total_turnover, 0), 0.0) AS concentration_pct
FROM (SELECT sum(turnover) AS top_turnover FROM (
        SELECT account, vip, sum(turnover) AS turnover FROM bets GROUP BY account, vip
        ORDER BY turnover DESC, account, vip LIMIT 100)) a,
     (SELECT sum(turnover) AS total_turnover FROM bets) b"""))
def ag73(spark, d):
    return B.concentration(S.bets(spark, d), 100)
