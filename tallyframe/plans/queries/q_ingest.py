"""Landed files of each kind through the ingest job (IO-21): stand-ins rendered as the exports spell them
(thousands separators, units in headers, tabs, blanks, cells over several lines), ingested, read back typed."""

import uuid

from pyspark.sql import functions as F

from ...functions import exprs as X
from ...session import scratch_path
from ...sources.files import ingest_files, read_raw
from .. import standins as S
from ..catalog import register
from ..oracle_ctes import with_ctes


def _landed(spark, table, *frames):
    """Write each frame as landed CSV files, ingest all of them, return the published table."""
    run = scratch_path(spark, f"io21/{uuid.uuid4().hex}")
    for i, df in enumerate(frames):
        (df.write.option("header", True).option("quote", '"').option("escape", '"').option("quoteAll", True)
         .option("emptyValue", "").csv(f"{run}/landing/{i}"))
    log = ingest_files(spark, [f"{run}/landing/{i}" for i in range(len(frames))], f"{run}/tables", raise_failures=True)
    assert [r["report_type"] for r in log.collect()] == [table]
    return read_raw(spark, table, root=f"{run}/tables")


@register("io21_ingest_bonus", with_ctes("bonus", body="""
SELECT DISTINCT order_no || '/' || activity || '/' || CAST(amount AS VARCHAR) || '/' || strftime(applied_at, '%Y-%m-%d') || '/'
    || CAST(CAST(wager_multiple AS BIGINT) AS VARCHAR) AS order_no, activity, CAST(amount AS DOUBLE) AS amount, wager_multiple,
  strftime(applied_at, '%Y-%m') AS month FROM (
SELECT *, coalesce(nullif(trim(title), ''), nullif(trim(note), ''), '未知') AS activity FROM bonus)"""))
def io21_bonus(spark, d):
    act = F.coalesce("title", "note", F.lit("未知"))
    number = F.concat_ws("/", "order_no", act, F.col("amount").cast("string"), F.date_format("applied_at", "yyyy-MM-dd"),
                         F.col("wager_multiple").cast("bigint").cast("string"))  # tells rows of one number apart; equal rows count once
    b = S.bonus(spark, d).select(
        F.concat(F.lit('="'), number, F.lit('"')).alias("订单号"), F.col("title").alias("红利标题"), F.col("note").alias("申请备注"),
        F.format_number("amount", 4).alias("红利金额"), F.col("wager_multiple").cast("string").alias("流水倍数(倍)"),
        F.date_format("applied_at", "yyyy-MM-dd HH:mm:ss").alias("申请时间"))
    first = b.where(F.col("流水倍数(倍)") < "2")
    # the other files hold the columns in another order
    second = b.where(F.col("流水倍数(倍)") >= "2").select("申请时间", "红利金额", "流水倍数(倍)", "申请备注", "红利标题", "订单号")
    out = _landed(spark, "raw_bonus_report", first, second)
    return out.select(F.col("订单号").alias("order_no"), F.col("活动名称").alias("activity"), F.col("红利金额").alias("amount"),
                      F.col("流水倍数").alias("wager_multiple"), F.col("_snapshot_month").alias("month"))


@register("io21_ingest_payments", with_ctes("deposits", body="""
SELECT order_no, status, CASE WHEN trim(cancel_reason) IN ('', 'nan', 'None') THEN NULL ELSE trim(cancel_reason) END AS reason,
  CAST(amount AS DOUBLE) AS amount, strftime(ordered_at, '%Y-%m-%d') AS day FROM deposits"""))
def io21_payments(spark, d):
    p = S.deposits(spark, d).select(
        F.concat("order_no", F.lit("\t")).alias("订单号"), F.date_format("ordered_at", "yyyy-MM-dd HH:mm:ss").alias("订单时间"),
        F.col("status").alias("订单状态"), F.col("cancel_reason").alias("取消原因"), F.format_number("amount", 2).alias("订单金额(元)"))
    out = _landed(spark, "raw_finance_deposit", p)
    return out.select(F.col("订单号").alias("order_no"), F.col("订单状态").alias("status"), F.col("取消原因").alias("reason"),
                      X.to_num_commas("订单金额").alias("amount"), F.substring("订单时间", 1, 10).alias("day"))


@register("io21_ingest_commission", with_ctes("commission", body="""
SELECT commission_month AS month, agent, line, team_name, CAST(commission AS DOUBLE) AS commission, active,
  CASE team_size % 3 WHEN 0 THEN NULL ELSE team_size / 100.0 END AS rate, in_team FROM commission"""))
def io21_commission(spark, d):
    size = F.col("team_size").cast("string")
    c = S.commission(spark, d).select(
        F.col("commission_month").alias("佣金月份"), F.col("agent").alias("代理名称"), F.col("line").alias("主线/副线"),
        F.col("team_name").alias("团队名称"), F.format_number("commission", 3).alias("佣金"), F.format_number("active", 0).alias("活跃人数"),
        F.when(F.col("team_size") % 3 == 0, F.lit("-")).when(F.col("team_size") % 3 == 1, F.concat(size, F.lit("%"))).otherwise(size).alias("佣金比例"),
        F.when(F.col("in_team"), X.YES_WORD).otherwise(X.NO_WORD).alias("是否在团队"))
    out = _landed(spark, "raw_agent_commission_team", c)
    return out.select(F.col("佣金月份").alias("month"), F.col("代理名称").alias("agent"), F.col("线别").alias("line"), F.col("团队名称").alias("team_name"),
                      F.col("佣金").alias("commission"), F.col("活跃人数").alias("active"), F.col("佣金比例").alias("rate"),
                      F.col("是否在团队").alias("in_team"))


@register("io21_ingest_conversations", with_ctes("cs", body="""
SELECT conversation_id, rating, CASE WHEN review = 'nan' THEN NULL ELSE review END AS review, length(content) AS content_chars,
  CAST(started_at AS VARCHAR) AS started_at, first_response_s FROM cs"""))
def io21_conversations(spark, d):
    c = S.cs(spark, d).select(
        F.col("conversation_id").alias("对话ID"), F.date_format("started_at", "yyyy-MM-dd HH:mm:ss").alias("开始时间"),
        F.col("rating").alias("满意度评价"), F.col("review").alias("评价内容"), F.col("topic").alias("服务主题"),
        F.col("first_response_s").cast("string").alias("首次响应"), F.col("content").alias("对话内容"))
    out = _landed(spark, "raw_cs_conversations", c)
    return out.select(F.col("对话ID").alias("conversation_id"), F.col("满意度评价").alias("rating"), F.col("评价内容").alias("review"),
                      F.char_length("对话内容").cast("bigint").alias("content_chars"), F.date_format("开始时间", "yyyy-MM-dd HH:mm:ss").alias("started_at"),
                      F.col("首次响应").alias("first_response_s"))


@register("cl30_member_key", with_ctes("member", body="""
SELECT DISTINCT account || chr(1) || coalesce(agent, 'nan') AS member_key FROM member"""))
def cl30(spark, d):
    return S.member(spark, d).select(X.member_key("account", "agent").alias("member_key")).distinct()


@register("cl31_fill_label", with_ctes("member", body="""
SELECT coalesce(nullif(trim(agent), ''), '(直客)') AS agent, count(*) AS "rows" FROM member GROUP BY 1"""))
def cl31(spark, d):
    return S.member(spark, d).groupBy(X.fill_label("agent", X.LBL_DIRECT).alias("agent")).agg(F.count(F.lit(1)).alias("rows"))


@register("sc01_date_key", """
SELECT substr(CAST(o_orderdate AS VARCHAR), 1, 10) AS day, count(*) AS orders FROM orders GROUP BY 1""")
def sc01(spark, d):
    return S.load(spark, d, "orders").groupBy(X.date_key("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("orders"))


@register("sc02_unwrap_loose", "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name AS name FROM customer")
def sc02(spark, d):
    c = S.load(spark, d, "customer")
    return c.select(X.unwrap_eq_loose(F.concat(F.lit('="'), F.col("c_custkey").cast("string"), F.lit('"'))).alias("id"),
                    X.unwrap_eq_loose(F.concat(F.lit('"'), "c_name", F.lit('"'))).alias("name"))


@register("cl20_pct_to_fraction", """
SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 3 THEN NULL ELSE CAST(l_discount AS DOUBLE) * 100.0 / 100.0 END AS fraction FROM lineitem""")
def cl20(spark, d):
    li = S.load(spark, d, "lineitem")
    pct = (F.col("l_discount") * 100).cast("string")
    spelt = F.when(F.col("l_linenumber") % 4 == 0, F.concat(pct, F.lit("%"))).when(F.col("l_linenumber") % 4 == 3, F.lit("-")).otherwise(pct)
    return li.select("l_orderkey", "l_linenumber", X.pct_to_fraction(spelt).alias("fraction"))
