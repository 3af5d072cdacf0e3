"""Remaining filters (FL-03/04/05/08), long-form KPIs (AG-04), status (SC-14), typing (CL-07/09/12/24), IO-20."""

from pyspark.sql import functions as F

from ...functions import exprs as X
from ...operators import clean as C
from ...operators import common as CO
from ...operators import filters as FL
from ...operators import newreg as NR
from ...operators import quality as Q
from .. import standins as S
from ..catalog import register
from ..oracle_ctes import with_ctes


@register("fl03_filter_options", with_ctes("member", body="""
SELECT DISTINCT trim(source) AS source FROM member WHERE source IS NOT NULL AND trim(source) <> ''"""))
def fl03a(spark, d):
    return FL.filter_options(S.member(spark, d), "source")


@register("fl03_filter_in", with_ctes("member", body="""
SELECT account, agent, snapshot_month, source FROM member WHERE CAST(source AS VARCHAR) IN ('直客', '官代下线')"""))
def fl03b(spark, d):
    return FL.filter_in(S.member(spark, d), "source", ["直客", "官代下线"]).select("account", "agent", "snapshot_month", "source")


@register("fl04_default_members", with_ctes("member", body="""
SELECT account, agent, snapshot_month, vip, tags FROM member
WHERE status = '启用' AND is_agent = '非代理' AND CAST(vip AS VARCHAR) IN ('1', '2', '3')
  AND contains(coalesce(tags, ''), '多平台')"""))
def fl04(spark, d):
    m = FL.default_members(S.member(spark, d), vip=["1", "2", "3"], tag_contains="多平台")
    return m.select("account", "agent", "snapshot_month", "vip", "tags")


@register("fl05_search_literal", with_ctes("cs", body="""
SELECT conversation_id, staff FROM cs WHERE contains(lower(coalesce(CAST(staff AS VARCHAR), '')), 'staff3')
  OR contains(lower(coalesce(CAST(account AS VARCHAR), '')), 'staff3')"""))
def fl05(spark, d):
    return FL.search(S.cs(spark, d), ["staff", "account"], "STAFF3", literal=True).select("conversation_id", "staff")


@register("fl05_search_regex", with_ctes("cs", body="""
SELECT conversation_id, account FROM cs WHERE regexp_matches(coalesce(CAST(account AS VARCHAR), ''), '(?i)^1[0-4]')"""))
def fl05b(spark, d):
    return FL.search(S.cs(spark, d), ["account"], "^1[0-4]").select("conversation_id", "account")


@register("fl08_filter_deposit", with_ctes("member", body="""
SELECT count(*) AS members FROM (SELECT account, nullif(trim(agent), '') AS agent0, arg_max(first_deposit, snapshot_month) AS fd
  FROM member GROUP BY 1, 2 HAVING max(registered_at) IS NOT NULL) WHERE coalesce(CAST(fd AS DOUBLE), 0.0) > 0"""))
def fl08(spark, d):
    nr = NR.prepare_newreg(S.member(spark, d))
    return FL.filter_deposit(nr, "with").agg(F.count(F.lit(1)).alias("members"))


@register("ag04_bet_kpis_long", with_ctes("bets", body="""
SELECT metric, value FROM (SELECT CAST(count(*) AS DOUBLE) AS bets, CAST(sum(turnover) AS DOUBLE) AS turnover,
  CAST(count(DISTINCT account) AS DOUBLE) AS players FROM bets)
UNPIVOT (value FOR metric IN (bets, turnover, players))"""))
def ag04(spark, d):
    b = S.bets(spark, d)
    return CO.kpis(b, [("bets", F.count(F.lit(1))), ("turnover", F.sum("turnover")),
                       ("players", F.count_distinct("account"))])


@register("sc14_sign_status", with_ctes("platform", body="""
SELECT status, count(*) AS days FROM (SELECT CASE WHEN company_win > 0 THEN 'good' WHEN company_win < 0 THEN 'bad' END AS status
  FROM platform) GROUP BY 1"""))
def sc14(spark, d):
    p = S.platform(spark, d)
    return p.groupBy(X.sign_status("company_win").alias("status")).agg(F.count(F.lit(1)).alias("days"))


def _text_orders(spark, d):
    o = S.load(spark, d, "orders")
    k = F.col("o_orderkey") % 4
    ts = (F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
          .when(k == 1, F.concat(F.lit('="'), F.date_format("o_orderdate", "yyyy/MM/dd HH:mm:ss"), F.lit('"')))
          .when(k == 2, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.lit("garbage")))
    price = F.when(F.col("o_orderkey") % 5 == 0, F.lit("n/a")).otherwise(F.concat(F.lit(" "), F.col("o_totalprice").cast("string")))
    return o.select(F.col("o_orderkey").cast("string").alias("key"), ts.alias("ordered"), price.alias("price"),
                    F.date_format("o_orderdate", "yyyyMM").alias("_snapshot_month"))


_TEXT = """SELECT CAST(o_orderkey AS VARCHAR) AS "key", CASE o_orderkey % 4
  WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN '="' || strftime(o_orderdate, '%Y/%m/%d %H:%M:%S') || '"'
  WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'garbage' END AS ordered,
  CASE WHEN o_orderkey % 5 = 0 THEN 'n/a' ELSE ' ' || CAST(o_totalprice AS VARCHAR) END AS price, o_orderdate AS od,
  strftime(o_orderdate, '%Y%m') AS sm FROM orders"""


@register("cl07_coerce_numeric", with_ctes(extra={"t": _TEXT}, body="""
SELECT "key", ordered, TRY_CAST(trim(price) AS DOUBLE) AS price, sm AS _snapshot_month FROM t"""))
def cl07(spark, d):
    return C.coerce_numeric(_text_orders(spark, d), ["key", "ordered", "_snapshot_month"])


@register("cl09_to_ts", with_ctes(extra={"t": _TEXT}, body="""
SELECT "key", CASE WHEN ordered = 'garbage' THEN NULL ELSE od END AS ts FROM t"""))
def cl09(spark, d):
    return _text_orders(spark, d).select("key", X.to_ts("ordered").alias("ts"))


@register("cl12_snapshot_month", with_ctes(extra={"t": _TEXT}, body="""
SELECT "key", substr(sm, 1, 4) || '-' || substr(sm, 5, 2) AS snapshot_month FROM t"""))
def cl12(spark, d):
    return C.with_snapshot_month(_text_orders(spark, d)).select("key", "snapshot_month")


def _market_text(spark, d):
    m = S.market(spark, d)
    mon = F.when(F.col("agent_account").cast("int") % 2 == 0, F.regexp_replace("month", "-", "/")).otherwise(F.col("month"))
    acc = F.when(F.col("agent_account").cast("int") % 9 == 0, F.lit(" ")).otherwise(F.col("agent_account"))
    return m.select(mon.alias("month"), F.col("agent_name"), acc.alias("agent_account"),
                    F.format_string("%d", F.col("registrations")).alias("registrations"),
                    F.col("turnover").cast("string").alias("turnover"))


@register("cl24_clean_agent_monthly", with_ctes("market", body="""
SELECT month, agent_name, agent_account, CAST(registrations AS DOUBLE) AS registrations, CAST(turnover AS DOUBLE) AS turnover
FROM market WHERE CAST(agent_account AS INTEGER) % 9 <> 0"""))
def cl24(spark, d):
    return C.clean_agent_monthly(_market_text(spark, d), ("month", "agent_name", "agent_account"))


@register("io20_latest_imported", with_ctes("bonus", body="""
SELECT strftime(max(m), '%Y-%m-%d %H:%M') AS latest_import FROM (
  SELECT max(applied_at) AS m FROM bonus UNION ALL SELECT max(o_orderdate) FROM orders)"""))
def io20(spark, d):
    b = S.bonus(spark, d).withColumn("_imported_at", F.col("applied_at"))
    o = S.load(spark, d, "orders").withColumn("_imported_at", F.col("o_orderdate"))
    return Q.latest_imported(b, o)
