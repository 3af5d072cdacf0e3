"""Cleaning expressions (CL-05/06/10/11/14/15/16/29/32/35), cell grids (CL-25…28) and set operators (SO/JN)."""

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ...functions import exprs as X
from ...operators import clean as C
from ...operators import grids as G
from .. import standins as S
from ..catalog import register
from ..oracle_ctes import with_ctes

# ---------------------------------------------------------------- CL-05 / CL-06 on messy text renderings


def _messy(spark, d):
    o = S.load(spark, d, "orders")
    label = (F.when(F.col("o_orderkey") % 997 == 0, F.lit(" 总计 ")).when(F.col("o_orderkey") % 991 == 0, F.lit("合计"))
             .otherwise(F.col("o_orderpriority")))
    return o.select(F.col("o_orderkey").cast("string").alias("key"), label.alias("label"),
                    F.col("o_orderstatus").alias("status"), F.col("o_totalprice").cast("string").alias("price"))


_MESSY = """SELECT CAST(o_orderkey AS VARCHAR) AS "key",
  CASE WHEN o_orderkey % 997 = 0 THEN ' 总计 ' WHEN o_orderkey % 991 = 0 THEN '合计' ELSE o_orderpriority END AS label,
  o_orderstatus AS status, CAST(o_totalprice AS VARCHAR) AS price FROM ord"""


@register("cl05_drop_total_rows", with_ctes(extra={"m": _MESSY}, body="""
SELECT * FROM m WHERE NOT (trim("key") IN ('总计', '合计', '小计') OR trim(label) IN ('总计', '合计', '小计')
  OR trim(status) IN ('总计', '合计', '小计') OR trim(price) IN ('总计', '合计', '小计'))"""))
def cl05(spark, d):
    return C.drop_total_rows(_messy(spark, d))


def _zeros(spark, d):
    li = S.load(spark, d, "lineitem")
    return li.select(
        F.to_date("l_shipdate").cast("string").alias("日期"),
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("key"),
        F.when(F.col("l_linenumber") <= 2, F.lit("0")).otherwise(F.col("l_tax").cast("string")).alias("x"),
        F.when(F.col("l_linenumber") <= 2, F.lit("")).otherwise(F.col("l_discount").cast("string")).alias("y"),
        F.when(F.col("l_returnflag") == "N", F.lit("abc")).otherwise(F.lit("0.00")).alias("z"),
        F.when(F.col("l_orderkey") % 5 == 0, F.lit("2")).otherwise(F.lit("0")).alias("单元代理人数"))


_ZEROS = """SELECT CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS "日期",
  CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS "key",
  CASE WHEN l_linenumber <= 2 THEN '0' ELSE CAST(l_tax AS VARCHAR) END AS x,
  CASE WHEN l_linenumber <= 2 THEN '' ELSE CAST(l_discount AS VARCHAR) END AS y,
  CASE WHEN l_returnflag = 'N' THEN 'abc' ELSE '0.00' END AS z,
  CASE WHEN l_orderkey % 5 = 0 THEN '2' ELSE '0' END AS "单元代理人数" FROM li"""

_NUM = "TRY_CAST(trim({c}) AS DOUBLE)"
_VAL = "CASE WHEN {c} IS NULL OR trim({c}) IN ('', 'None', 'nan', 'null') THEN 0.0 ELSE " + _NUM + " END"


@register("cl06_drop_all_zero_rows", with_ctes(extra={"zz": _ZEROS}, body="""
SELECT "日期", "key", x, y, z, "单元代理人数" FROM (
  SELECT *, list_filter([""" + ", ".join(_VAL.format(c=c) for c in ('"key"', "x", "y", "z", '"单元代理人数"')) + """],
                        lambda v: v IS NOT NULL) AS vals FROM zz)
WHERE NOT (len(vals) > 0 AND len(list_filter(vals, lambda v: v <> 0)) = 0
           AND NOT coalesce(""" + _NUM.format(c='"单元代理人数"') + """, 0.0) > 0)"""))
def cl06(spark, d):
    return C.drop_all_zero_rows(_zeros(spark, d))


# ---------------------------------------------------------------- month keys and names

_MONTHS_RAW = """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y%m')
  WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN '' ELSE 'nan' END AS raw FROM ord"""


@register("cl10_month_key", with_ctes(extra={"mr": _MONTHS_RAW}, body=r"""
SELECT mk AS month, count(*) AS n FROM (
  SELECT CASE WHEN t IN ('', 'nan', 'None') THEN NULL WHEN regexp_full_match(t, '\d{6}') THEN substr(t, 1, 4) || '-' || substr(t, 5, 2)
         ELSE t END AS mk FROM (SELECT trim(raw) AS t FROM mr)) GROUP BY 1"""))
def cl10(spark, d):
    o = S.load(spark, d, "orders")
    raw = (F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "yyyyMM"))
           .when(F.col("o_orderkey") % 4 == 1, F.date_format("o_orderdate", "yyyy-MM"))
           .when(F.col("o_orderkey") % 4 == 2, F.lit("")).otherwise(F.lit("nan")))
    return o.select(X.month_key(raw).alias("month")).groupBy("month").agg(F.count(F.lit(1)).alias("n"))


@register("cl11_month_bounds", with_ctes("winback", body="""
SELECT DISTINCT month, CAST(month || '-01' AS DATE) AS month_start, last_day(CAST(month || '-01' AS DATE)) AS month_end
FROM winback"""))
def cl11(spark, d):
    wb = S.winback(spark, d)
    return wb.select("month", X.month_start("month").alias("month_start"), X.month_end("month").alias("month_end")).distinct()


_CN = ("一月", "二月", "三月", "四月", "五月", "六月", "七月", "八月", "九月", "十月", "十一月", "十二月")


@register("cl16_month_from_name", with_ctes(body="""
SELECT name, CASE """ + " ".join(f"WHEN contains(name, '{_CN[i]}') THEN {i + 1}" for i in sorted(range(12), key=lambda i: -len(_CN[i]))) +
    r""" ELSE TRY_CAST(nullif(regexp_extract(name, '(\d{1,2})月', 1), '') AS INTEGER) END AS month FROM (
  SELECT DISTINCT CASE WHEN month(o_orderdate) % 2 = 0
    THEN ['一月', '二月', '三月', '四月', '五月', '六月', '七月', '八月', '九月', '十月', '十一月', '十二月'][month(o_orderdate)] || '客服对话.xlsx'
    ELSE CAST(month(o_orderdate) AS VARCHAR) || '月代理帐.xlsx' END AS name FROM ord)"""))
def cl16(spark, d):
    o = S.load(spark, d, "orders")
    cn = F.array(*[F.lit(x) for x in _CN])
    name = F.when(F.month("o_orderdate") % 2 == 0, F.concat(F.element_at(cn, F.month("o_orderdate")), F.lit("客服对话.xlsx"))) \
            .otherwise(F.concat(F.month("o_orderdate").cast("string"), F.lit("月代理帐.xlsx")))
    return o.select(name.alias("name")).distinct().select("name", X.month_from_name("name").alias("month"))


@register("cl14_modal_month", with_ctes("cs", body="""
SELECT staff, arg_max(month, (n, -epoch(CAST(month || '-01' AS DATE)))) AS modal_month FROM (
  SELECT staff, strftime(started_at, '%Y-%m') AS month, count(*) AS n FROM cs WHERE started_at IS NOT NULL GROUP BY 1, 2)
GROUP BY 1"""))
def cl14(spark, d):
    return C.modal_month(S.cs(spark, d), "started_at", "staff")


_CALLS = """SELECT o_orderpriority AS caller, CASE o_orderkey % 3
  WHEN 0 THEN CAST(year(o_orderdate) AS VARCHAR) || '-' || CAST(month(o_orderdate) AS VARCHAR) || '-' || CAST(day(o_orderdate) AS VARCHAR)
  WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d')
  ELSE CAST(year(o_orderdate) AS VARCHAR) || '年' || CAST(month(o_orderdate) AS VARCHAR) || '月' END AS call_date FROM ord"""


@register("cl15_vote_month", with_ctes(extra={"calls": _CALLS}, body=r"""
SELECT caller, arg_max(month, (n, -epoch(CAST(month || '-01' AS DATE)))) AS month FROM (
  SELECT caller, regexp_extract(call_date, '(\d{4})[-/年](\d{1,2})', 1) || '-' ||
         lpad(regexp_extract(call_date, '(\d{4})[-/年](\d{1,2})', 2), 2, '0') AS month, count(*) AS n
  FROM calls WHERE regexp_extract(call_date, '(\d{4})[-/年](\d{1,2})', 1) <> '' GROUP BY 1, 2)
GROUP BY 1"""))
def cl15(spark, d):
    o = S.load(spark, d, "orders")
    k = F.col("o_orderkey") % 3
    y, m, dd = (F.year("o_orderdate").cast("string"), F.month("o_orderdate").cast("string"),
                F.dayofmonth("o_orderdate").cast("string"))
    cd = F.when(k == 0, F.concat_ws("-", y, m, dd)).when(k == 1, F.date_format("o_orderdate", "yyyy/MM/dd")) \
          .otherwise(F.concat(y, F.lit("年"), m, F.lit("月")))
    return C.vote_month(o.select(F.col("o_orderpriority").alias("caller"), cd.alias("call_date")), "call_date", "caller")


@register("cl29_parse_slot", with_ctes("slots", body=r"""
SELECT raw_time, CAST(regexp_extract(raw_time, '^(\d{4}-\d{2}-\d{2})', 1) AS DATE) AS day,
  regexp_extract(raw_time, '(\d{1,2}~\d{1,2})', 1) AS slot,
  coalesce(TRY_CAST(regexp_extract(regexp_extract(raw_time, '(\d{1,2}~\d{1,2})', 1), '^(\d{1,2})', 1) AS INTEGER), 99) AS hour
FROM slots"""))
def cl29(spark, d):
    return C.parse_slot(S.slots(spark, d)).select("raw_time", "day", "slot", "hour")


@register("cl32_url_domain", r"""
SELECT domain, count(*) AS pages FROM (SELECT CASE WHEN url IS NULL THEN '(未记录)'
  WHEN regexp_extract(url, 'https?://([^/:]+)', 1) <> '' THEN regexp_extract(url, 'https?://([^/:]+)', 1)
  WHEN starts_with(url, 'null') THEN '(仅邀请码)' WHEN trim(url) = '' THEN '(未记录)' ELSE substr(url, 1, 40) END AS domain
  FROM pages) GROUP BY 1""")
def cl32(spark, d):
    p = S.load(spark, d, "pages")
    return p.groupBy(X.url_domain("url").alias("domain")).agg(F.count(F.lit(1)).alias("pages"))


@register("cl35_venue_category", with_ctes("venue_daily", body="""
SELECT DISTINCT venue, CASE WHEN venue LIKE '%真人%' THEN '真人'
  WHEN venue LIKE '%体育%' OR venue LIKE '%體育%' THEN '体育' WHEN venue LIKE '%电竞%' OR venue LIKE '%電競%' THEN '电竞'
  WHEN venue LIKE '%电子%' OR venue LIKE '%電子%' OR venue LIKE '%老虎%' OR upper(venue) LIKE '%PG%' OR upper(venue) LIKE '%PP%' THEN '电子'
  WHEN venue LIKE '%棋牌%' THEN '棋牌' WHEN venue LIKE '%捕鱼%' OR venue LIKE '%捕魚%' THEN '捕鱼'
  WHEN venue LIKE '%哈希%' OR upper(venue) LIKE '%HASH%' THEN '哈希' WHEN venue LIKE '%彩%' THEN '彩票' ELSE '其他' END AS category FROM venue_daily"""))
def cl35(spark, d):
    return S.venue_daily(spark, d).select("venue", X.venue_category("venue").alias("category")).distinct()


# ---------------------------------------------------------------- grids (CL-25…28)

_WB_LABELS = ("名单数", "已播数", "接通数", "有效通话", "召回充值")


def _wb_cells(spark, d):
    wb = S.winback(spark, d)
    i = F.dense_rank().over(Window.partitionBy("month").orderBy("caller")) - 1
    w = wb.withColumn("i", i)
    listed = F.regexp_replace(F.col("listed").cast("string"), r"(\d)(\d{3})$", "$1，$2")
    stack = F.expr("stack(5, 1, '名单数', listed_s, 2, '已播数', CAST(dialled AS STRING), 3, '接通数', CAST(connected AS STRING), "
                   "4, '有效通话', CAST(valid AS STRING), 5, '召回充值', CAST(recharge AS STRING)) AS (r, label, value)")
    pairs = w.withColumn("listed_s", listed).select("month", "i", stack)
    # each name has an earlier block of other values, and each block an earlier row of its first label
    old = pairs.withColumn("value", F.lit("99999999"))
    early = old.where("r = 1").withColumn("r", F.lit(0))
    pairs = (old.withColumn("c", F.col("i") * 4).unionByName(pairs.unionByName(early).withColumn("c", F.col("i") * 4 + 2))
             .withColumn("r", F.col("r") + 1))
    lab = pairs.select("month", "r", "c", F.col("label").alias("v"))
    val = pairs.select("month", "r", (F.col("c") + 1).alias("c"), F.col("value").alias("v"))
    names = w.select("month", F.lit(0).alias("r"), F.explode(F.array(F.col("i") * 4, F.col("i") * 4 + 2)).alias("c"), F.col("caller").alias("v"))
    cells = names.unionByName(lab).unionByName(val)
    return cells.select(F.lit("winback.xlsx").alias("source_file"), F.col("month").alias("sheet"),
                        F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), "v")


@register("cl25_blocks_to_records", with_ctes("winback", body="""
SELECT 'winback.xlsx' AS source_file, month AS sheet, caller AS name, CAST(listed AS DOUBLE) AS "名单数",
  CAST(dialled AS DOUBLE) AS "已播数", CAST(connected AS DOUBLE) AS "接通数", CAST(valid AS DOUBLE) AS "有效通话",
  CAST(recharge AS DOUBLE) AS "召回充值" FROM winback"""))
def cl25(spark, d):
    return G.blocks_to_records(_wb_cells(spark, d), _WB_LABELS)


def _detail_cells(spark, d):
    dep = S.deposits(spark, d)
    ok = dep.withColumn("k", F.col("order_no").cast("bigint"))
    hr = F.when(F.col("channel").isin("1-URGENT", "2-HIGH"), F.lit(1)).otherwise(F.lit(2))
    ch = dep.select("channel").distinct().withColumn("hr", hr)
    hdr = ch.select("channel", F.col("hr").alias("r"),
                    F.expr("stack(4, 0, IF(hr = 1, '会员账号', ' 账号'), 1, '充值金额(元)', 2, '七天回登', 3, '拨打日期') AS (c, v)"))
    # above a header that is the account word, the title may contain it
    title = ch.select("channel", F.lit(0).alias("r"), F.lit(0).alias("c"), F.expr("IF(hr = 1, '召回明细', '账号召回明细')").alias("v"))
    body = ok.join(ch, "channel").withColumn("r", F.col("hr") + 1 + F.col("k"))
    acc = body.where(F.col("k") % 13 != 0).select("channel", "r", F.lit(0).alias("c"), F.col("account").alias("v"))
    rec = body.select("channel", "r", F.lit(1).alias("c"),
                      F.when(F.col("status") == "存款成功", F.col("amount").cast("string")).otherwise(F.lit("")).alias("v"))
    flag = body.select("channel", "r", F.lit(2).alias("c"),
                       F.when(F.col("status") == "存款成功", F.lit("是")).when(F.col("status") == "已取消", F.lit("Y"))
                        .otherwise(F.lit("")).alias("v"))
    dt = body.select("channel", "r", F.lit(3).alias("c"), F.date_format("ordered_at", "yyyy-MM-dd").alias("v"))
    cells = title.unionByName(hdr).unionByName(acc).unionByName(rec).unionByName(flag).unionByName(dt)
    return cells.select(F.lit("calls.xlsx").alias("source_file"), F.col("channel").alias("sheet"),
                        F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), "v")


@register("cl26_detail_totals", with_ctes("deposits", body="""
SELECT 'calls.xlsx' AS source_file, channel AS sheet,
  sum(CASE WHEN status = '存款成功' THEN CAST(amount AS DOUBLE) ELSE 0.0 END) AS recharge,
  count_if(status IN ('存款成功', '已取消')) AS relogins, count(*) AS "rows"
FROM deposits WHERE CAST(order_no AS BIGINT) % 13 <> 0 GROUP BY channel"""))
def cl26(spark, d):
    return G.detail_totals(_detail_cells(spark, d))


def _settle_cells(spark, d):
    det = S.settle_detail(spark, d).withColumn("k", F.regexp_extract("name", r"(\d+)$", 1).cast("bigint"))
    body = det.select("month", (F.lit(8) + F.col("k")).alias("r"), F.expr(
        "stack(9, 0, status, 1, name, 2, agent, 3, CAST(prior_perf AS STRING), 4, CAST(month_perf AS STRING), "
        "5, CAST(total_perf AS STRING), 6, CASE WHEN k % 7 = 0 THEN '' ELSE treatment END, 7, CAST(rate AS STRING), "
        "8, CAST(commission AS STRING)) AS (c, v)"))
    sums = det.groupBy("month").agg(F.sum("month_perf").alias("a"), F.sum("prior_perf").alias("b"),
                                    F.sum("commission").alias("cm"))
    top = sums.select("month", F.expr(
        "stack(10, 1, 1, '本月业绩', 2, 1, CAST(a AS STRING), 1, 2, '先前挂账', 2, 2, CAST(b AS STRING), "
        "4, 3, '实际佣金合计', 5, 3, CAST(cm AS STRING), 4, 4, '备注', 5, 4, 'n/a', "
        "7, 1, '名称', 7, 2, '总代') AS (r, c, v)"))
    cells = top.unionByName(body.select("month", "r", "c", "v"))
    return cells.select(F.lit("4月代理帐.xlsx").alias("source_file"), F.col("month").alias("sheet"),
                        F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), "v")


@register("cl27_settlement_detail", with_ctes("settle_detail", body="""
SELECT '4月代理帐.xlsx' AS source_file, month AS sheet, 8 + CAST(regexp_extract(name, '(\\d+)$', 1) AS BIGINT) AS r,
  status, name, agent, CAST(prior_perf AS DOUBLE) AS prior_perf, CAST(month_perf AS DOUBLE) AS month_perf,
  CAST(total_perf AS DOUBLE) AS total_perf, treatment, CAST(rate AS DOUBLE) AS rate, CAST(commission AS DOUBLE) AS commission
FROM settle_detail WHERE CAST(regexp_extract(name, '(\\d+)$', 1) AS BIGINT) % 7 <> 0"""))
def cl27d(spark, d):
    return G.settlement_detail(_settle_cells(spark, d))


@register("cl27_settlement_summary", with_ctes("settle_detail", body="""
SELECT '4月代理帐.xlsx' AS source_file, month AS sheet, item, amount FROM (
  SELECT month, '本月业绩' AS item, CAST(sum(month_perf) AS DOUBLE) AS amount FROM settle_detail GROUP BY 1
  UNION ALL SELECT month, '先前挂账', CAST(sum(prior_perf) AS DOUBLE) FROM settle_detail GROUP BY 1
  UNION ALL SELECT month, '实际佣金合计', CAST(sum(commission) AS DOUBLE) FROM settle_detail GROUP BY 1)"""))
def cl27s(spark, d):
    return G.settlement_summary(_settle_cells(spark, d))


# ---------------------------------------------------------------- set operators / joins

_PREV = "strftime(CAST(snapshot_month || '-01' AS DATE) - INTERVAL 1 MONTH, '%Y-%m')"


def _month_before():
    return F.date_format(F.add_months(F.to_date(F.concat("snapshot_month", F.lit("-01"))), -1), "yyyy-MM")


@register("so03_intersect_active", with_ctes("member", body=f"""
SELECT snapshot_month, account FROM member INTERSECT SELECT {_PREV}, account FROM member"""))
def so03(spark, d):
    """Accounts active in a month and in the next, for every month."""
    m = S.member(spark, d)
    return m.select("snapshot_month", "account").intersect(m.select(_month_before().alias("snapshot_month"), "account"))


@register("so04_days_without_bonus", with_ctes("platform", "bonus", body="""
SELECT date FROM platform EXCEPT SELECT CAST(applied_at AS DATE) FROM bonus WHERE trim(status) = '成功'"""))
def so04(spark, d):
    b = S.bonus(spark, d).where(X.utrim("status") == "成功").select(F.to_date("applied_at").alias("date"))
    return S.platform(spark, d).select("date").subtract(b)


@register("so05_union_months", with_ctes("winback", "market", body="""
SELECT month FROM winback UNION SELECT month FROM market"""))
def so05(spark, d):
    return S.winback(spark, d).select("month").union(S.market(spark, d).select("month")).distinct()


@register("jn07_semi_next_month_active", with_ctes("member", body=f"""
SELECT snapshot_month, count(*) AS kept FROM (SELECT DISTINCT snapshot_month, account, agent FROM member) a
WHERE EXISTS (SELECT 1 FROM (SELECT {_PREV} AS m, account, agent FROM member) b WHERE b.m = a.snapshot_month AND b.account = a.account
              AND b.agent IS NOT DISTINCT FROM a.agent) GROUP BY 1"""))
def jn07(spark, d):
    """Members of each month that are active in the next one too."""
    m = S.member(spark, d)
    a = m.select("snapshot_month", "account", "agent").distinct()
    b = m.select(_month_before().alias("b_month"), F.col("account").alias("b_account"), F.col("agent").alias("b_agent"))
    j = a.join(b, (a.snapshot_month == b.b_month) & (a.account == b.b_account) & a.agent.eqNullSafe(b.b_agent), "left_semi")
    return j.groupBy("snapshot_month").agg(F.count(F.lit(1)).alias("kept"))
