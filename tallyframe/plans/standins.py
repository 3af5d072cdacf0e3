"""Domain frames built from the supplied test tables.

Each builder returns a lazy DataFrame with the canonical English column names of
FIXTURES.md so the report operators run unchanged on real report tables.  The matching
DuckDB CTEs live in ``plans/oracle.py`` and must stay in step with these definitions.

Scale notes: every builder is a scan + projection, an equi-join on the natural keys, or
one aggregation on the grain of the domain table.  Nothing is collected; dimension joins
(nation, region) are tiny and auto-broadcast by Spark's size check; fact-to-fact joins
(lineitem x orders) are shuffle joins that AQE may re-plan at runtime.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


# money columns are read as exact decimals: sums are then independent of partitioning and
# summation order (doubles would change in the last digits with the partition count)
MONEY = {
    "lineitem": {"l_extendedprice": "decimal(15,2)", "l_discount": "decimal(4,2)", "l_tax": "decimal(4,2)",
                 "l_quantity": "decimal(12,2)"},
    "orders": {"o_totalprice": "decimal(15,2)"},
    "customer": {"c_acctbal": "decimal(15,2)"},
    "supplier": {"s_acctbal": "decimal(15,2)"},
    "events": {"value": "decimal(15,2)"},
}


def load(spark: SparkSession, d: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/{name}.parquet")
    casts = MONEY.get(name)
    if casts:
        df = df.withColumns({c: F.col(c).cast(t) for c, t in casts.items()})
    return df


def D(x) -> "F.Column":
    """Exact decimal literal (a Python float literal would turn decimal math into double)."""
    return F.lit(Decimal(str(x)))


def _hours(n, ts):
    return F.timestamp_add("HOUR", n, ts)


# ---------------------------------------------------------------- bet slips

def bets(spark, d) -> DataFrame:
    """One row per bet slip: lineitem x orders x customer x part."""
    li = load(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    o = load(spark, d, "orders").select("o_orderkey", "o_custkey")
    c = load(spark, d, "customer").select("c_custkey", "c_nationkey")
    p = load(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    j = (li.join(o, li.l_orderkey == o.o_orderkey)
         .join(c, F.col("o_custkey") == F.col("c_custkey"))
         .join(p, F.col("l_partkey") == F.col("p_partkey")))
    return j.select(
        F.col("o_custkey").cast("string").alias("account"),
        F.col("c_nationkey").cast("string").alias("vip"),
        F.col("p_brand").alias("venue"),
        F.col("p_type").alias("type"),
        F.col("l_shipdate").alias("bet_at"),
        (F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("stake"),
        F.col("l_extendedprice").alias("turnover"),
        (F.col("l_extendedprice") * (F.col("l_discount") - F.col("l_tax"))).alias("player_pnl"),
        F.date_format("l_shipdate", "yyyy-MM").alias("bet_month"),
    )


# ---------------------------------------------------------------- daily platform / finance reports

def _line_money(prefix=""):
    e, q = F.col("l_extendedprice"), F.col("l_quantity")
    return [
        F.sum(e * (1 + F.col("l_tax"))).alias("deposits"),
        F.sum(e * (1 - F.col("l_discount"))).alias("withdrawals"),
        F.sum(e).alias("turnover"),
        F.sum(e * (F.col("l_tax") - F.col("l_discount"))).alias("company_win"),
        F.sum(e * F.col("l_discount") * D("0.1")).alias("bonus"),
        F.sum(q * D("2.0")).alias("rebate"),
        F.sum(e * D("0.01")).alias("agent_commission"),
    ]


def platform(spark, d) -> DataFrame:
    """Daily platform report: lineitem grouped by ship day."""
    li = load(spark, d, "lineitem")
    e = F.col("l_extendedprice")
    g = li.groupBy(F.to_date("l_shipdate").alias("date")).agg(
        F.count_if(F.col("l_linenumber") == 1).alias("registrations"),
        F.count_if((F.col("l_linenumber") == 1) & (F.col("l_returnflag") == "R")).alias("first_depositors"),
        F.count(F.lit(1)).alias("bettors"),
        *_line_money(),
        F.sum(e * D("0.005")).alias("group_share"),
        F.sum(F.when(F.col("l_returnflag") == "R", e * D("0.001")).otherwise(D("0"))).alias("early_settlement"),
        F.sum(F.when(F.col("l_linestatus") == "O", -F.col("l_tax") * D("100.0")).otherwise(D("0"))).alias("account_adjustment"),
        F.sum(F.col("l_quantity") * D("0.1")).alias("tips"),
    )
    return (g.withColumn("net_flow", F.col("deposits") - F.col("withdrawals"))
             .withColumn("net_income", F.col("company_win") - F.col("bonus") - F.col("rebate")))


def finance(spark, d) -> DataFrame:
    """Daily finance report: orders grouped by order day."""
    o = load(spark, d, "orders")
    p = F.col("o_totalprice")
    g = o.groupBy(F.to_date("o_orderdate").alias("date")).agg(
        F.sum(p).alias("actual_deposits"),
        F.sum(F.when(F.col("o_orderstatus") == "F", p * D("0.9")).otherwise(D("0"))).alias("actual_withdrawals"),
        F.sum(p * D("0.002")).alias("bonus"),
        F.sum(p * D("0.001")).alias("rebate"),
        F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", p * D("0.01")).otherwise(D("0"))).alias("agent_commission"),
    )
    return g.withColumn("net_flow", F.col("actual_deposits") - F.col("actual_withdrawals"))


# ---------------------------------------------------------------- member monthly snapshot

def member(spark, d) -> DataFrame:
    """Member snapshot: one row per (account, agent, snapshot_month) from orders x customer."""
    o = load(spark, d, "orders")
    c = load(spark, d, "customer")
    p = F.col("o_totalprice")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    agent = F.when((F.col("o_orderpriority") == "4-NOT SPECIFIED") & (F.col("o_orderkey") % 2 == 0), F.lit(None).cast("string")) \
             .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit("")) \
             .otherwise(F.concat(F.lit("ag"), F.col("c_nationkey").cast("string")))
    g = j.groupBy(
        F.col("o_custkey").cast("string").alias("account"),
        agent.alias("agent"),
        F.date_format("o_orderdate", "yyyy-MM").alias("snapshot_month"),
        "c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal",
    ).agg(
        F.count(F.lit(1)).alias("orders_n"),
        F.min("o_orderdate").alias("m_first"),
        F.min(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))).alias("m_first_f"),
        F.sum(p).alias("deposits"),
        F.sum(F.when(F.col("o_orderstatus") == "F", p * D("0.8")).otherwise(D("0"))).alias("withdrawals"),
        F.sum(p * D("1.5")).alias("turnover"),
        F.sum(F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), p * D("0.02")).otherwise(-p * D("0.01"))).alias("company_win"),
        F.sum(p * D("0.003")).alias("bonus"),
        F.sum(p * D("0.002")).alias("rebate"),
    )
    w = Window.partitionBy("account")
    ck = F.col("c_custkey")
    fd_at = _hours((ck % 50 - 5).cast("int"), F.min("m_first_f").over(w))
    url = (F.when(ck % 9 == 0, F.lit(None).cast("string"))
           .when(ck % 9 == 1, F.concat(F.lit("null?i_code="), (ck % 37).cast("string")))
           .when(ck % 9 == 2, F.lit(""))
           .when(ck % 9 == 3, F.concat(F.lit("http://m"), F.col("c_nationkey").cast("string"),
                                       F.lit(".example.net:8080/x?r%20code-"), (ck % 41).cast("string")))
           .otherwise(F.concat(F.lit("https://s"), (ck % 13).cast("string"), F.lit(".example.com/reg?i_code="),
                               (ck % 37).cast("string"))))
    tags = (F.when(F.col("c_acctbal") < 0, F.lit("高风险,套利"))
            .when(ck % 11 == 0, F.lit("多平台"))
            .when(ck % 13 == 0, F.lit("专业玩家 软件投注")))
    source = (F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.lit(None).cast("string"))
              .when(F.col("c_mktsegment").isin("AUTOMOBILE", "MACHINERY"), F.lit("直客"))
              .when(F.col("c_mktsegment") == "BUILDING", F.lit("普代下线"))
              .otherwise(F.lit("官代下线")))
    out = g.select(
        "account", "agent", "snapshot_month",
        F.min("m_first").over(w).alias("registered_at"),
        fd_at.alias("first_deposit_at"),
        F.when(fd_at.isNotNull(), (ck % 90).cast("double") * 10.0).alias("first_deposit"),
        F.when(fd_at.isNotNull(), (ck % 70).cast("double") * 5.0).alias("first_bet"),
        "deposits", "withdrawals", "turnover", "company_win", "bonus", "rebate",
        (F.col("company_win") - F.col("bonus") - F.col("rebate")).alias("company_income"),
        F.col("c_nationkey").cast("string").alias("vip"),
        F.when(F.col("c_acctbal") < 0, F.lit("禁用")).otherwise(F.lit("启用")).alias("status"),
        F.when(ck % 50 == 0, F.lit("代理")).otherwise(F.lit("非代理")).alias("is_agent"),
        source.alias("source"),
        F.col("c_mktsegment").alias("register_channel"),
        url.alias("register_url"),
        tags.alias("tags"),
        "orders_n",
    )
    return out


# ---------------------------------------------------------------- agent daily report

def agent_daily(spark, d) -> DataFrame:
    li = load(spark, d, "lineitem")
    s = load(spark, d, "supplier")
    e = F.col("l_extendedprice")
    j = li.join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    atype = (F.when(F.col("s_nationkey") % 3 == 0, F.lit("官代"))
             .when(F.col("s_nationkey") % 3 == 1, F.lit("普代")))
    g = j.groupBy(
        F.to_date("l_shipdate").alias("date"),
        F.col("s_suppkey").cast("string").alias("agent_no"),
        F.col("s_name").alias("agent_name"),
        atype.alias("agent_type"),
    ).agg(
        F.count_if(F.col("l_linenumber") == 1).alias("registrations"),
        F.count_if((F.col("l_linenumber") == 1) & (F.col("l_returnflag") == "R")).alias("first_depositors"),
        F.count(F.lit(1)).alias("bettors"),
        *_line_money(),
        F.sum(F.when(F.col("l_returnflag") == "R", e * D("0.001")).otherwise(D("0"))).alias("early_settlement"),
        F.sum(e * D("0.002")).alias("venue_fee"),
    )
    return g.withColumn("company_income", F.col("company_win") - F.col("bonus") - F.col("rebate"))


# ---------------------------------------------------------------- promotion channels (4 levels)

def promo(spark, d) -> DataFrame:
    o = load(spark, d, "orders")
    c = load(spark, d, "customer")
    n = load(spark, d, "nation")
    r = load(spark, d, "region")
    j = (o.join(c, F.col("o_custkey") == F.col("c_custkey"))
         .join(n, F.col("c_nationkey") == F.col("n_nationkey"))
         .join(r, F.col("n_regionkey") == F.col("r_regionkey")))
    return j.select(
        F.to_date("o_orderdate").alias("date"),
        F.col("r_name").alias("l1"), F.col("n_name").alias("l2"), F.col("c_mktsegment").alias("l3"),
        F.nullif(F.col("o_orderpriority"), F.lit("4-NOT SPECIFIED")).alias("l4"),
        F.col("o_totalprice").alias("turnover"),
        (F.col("o_totalprice") * D("0.01")).alias("promo_income"),
        (F.col("o_custkey") % 3).cast("bigint").alias("unit_agents"),
    )


# ---------------------------------------------------------------- venue / game reports

# stand-in product-line prefixes per part type (exercise the venue category rules)
TYPE_PREFIX = (("STANDARD", "AG真人"), ("ECONOMY", "沙巴体育"), ("PROMO", "PG"),
               ("LARGE", "开元棋牌"), ("SMALL", "hash"), ("MEDIUM", "VR彩"))


def _type_prefix():
    e = None
    for t, pfx in TYPE_PREFIX:
        e = F.when(F.col("p_type") == t, F.lit(pfx)) if e is None else e.when(F.col("p_type") == t, F.lit(pfx))
    return e.otherwise(F.lit("X"))


def venue_daily(spark, d) -> DataFrame:
    li = load(spark, d, "lineitem")
    p = load(spark, d, "part")
    e = F.col("l_extendedprice")
    j = li.join(p, F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy(
        F.to_date("l_shipdate").alias("date"),
        F.lit("S1").alias("site"),
        F.concat(_type_prefix(), F.lit("-"), F.col("p_brand")).alias("venue"),
    ).agg(
        F.count(F.lit(1)).alias("bettors"),
        F.sum(e).alias("turnover"),
        F.sum(e * (F.col("l_tax") - F.col("l_discount"))).alias("company_win"),
    )


def game_daily(spark, d) -> DataFrame:
    li = load(spark, d, "lineitem")
    p = load(spark, d, "part")
    e = F.col("l_extendedprice")
    j = li.join(p, F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy(
        F.to_date("l_shipdate").alias("date"),
        F.col("p_type").alias("type"), F.col("p_brand").alias("venue"),
        F.concat(F.lit("G"), (F.col("p_size") % 10).cast("string")).alias("game"),
    ).agg(
        F.count(F.lit(1)).alias("bettors"),
        F.sum(e).alias("turnover"),
        F.sum(e * (F.col("l_tax") - F.col("l_discount"))).alias("company_win"),
    )


# ---------------------------------------------------------------- realtime hour slots

def slots(spark, d) -> DataFrame:
    ev = load(spark, d, "events")
    h = F.hour("ts")
    g = ev.groupBy(F.to_date("ts").alias("day"), h.alias("h"), F.col("event_type").alias("type")).agg(
        F.count_distinct("user_id").alias("slot_bettors"),
        F.sum("value").alias("stake"),
        F.sum(F.col("value") * D("0.9")).alias("turnover"),
        F.sum(F.when(F.col("event_type") == "error", -F.col("value")).otherwise(F.col("value") * D("0.05"))).alias("company_win"),
    )
    raw = F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit(" "), F.col("h").cast("string"), F.lit("~"),
                   (F.col("h") + 1).cast("string"))
    return g.select(raw.alias("raw_time"), "type", "slot_bettors", "stake", "turnover", "company_win")


# ---------------------------------------------------------------- bonus grants

def bonus(spark, d) -> DataFrame:
    li = load(spark, d, "lineitem")
    ln = F.col("l_linenumber").cast("string")
    rf = F.col("l_returnflag")
    return li.select(
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), ln).alias("order_no"),
        F.col("l_suppkey").cast("string").alias("account"),
        F.when(F.col("l_linenumber") == 1, F.lit(None).cast("string"))
         .otherwise((F.col("l_suppkey") % 10).cast("string")).alias("vip"),
        F.when(rf == "R", F.lit("充值红利")).when(rf == "A", F.lit("活动彩金")).otherwise(F.lit("返水补发")).alias("type"),
        F.when(rf == "R", F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("promo-"), F.col("l_linestatus"), ln)).alias("title"),
        F.when((rf == "R") & (F.col("l_linenumber") % 2 == 0), F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("note"), ln)).alias("note"),
        F.when(F.col("l_discount") >= 0.05, F.lit("成功"))
         .when(F.col("l_discount") > 0.01, F.lit(" 成功 ")).otherwise(F.lit("失败")).alias("status"),
        F.when(F.col("l_tax") >= 0.04, F.lit("是")).otherwise(F.lit("否")).alias("needs_wagering"),
        (F.col("l_quantity").cast("bigint") % 5).cast("double").alias("wager_multiple"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("amount"),
        F.col("l_shipdate").alias("applied_at"),
    )


# ---------------------------------------------------------------- payments

def _order_ship(spark, d):
    li = load(spark, d, "lineitem")
    return li.groupBy("l_orderkey").agg(F.min("l_shipdate").alias("ship_min"), F.max("l_shipdate").alias("ship_max"))


def deposits(spark, d) -> DataFrame:
    o = load(spark, d, "orders")
    j = o.join(_order_ship(spark, d), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    st = F.col("o_orderstatus")
    k = F.col("o_custkey") % 4
    reason = F.when(st == "O", F.when(k == 0, F.lit("超时")).when(k == 1, F.lit("nan"))
                    .when(k == 2, F.lit("")).otherwise(F.lit("用户取消"))) \
              .when(k == 3, F.lit("通道维护"))  # a reason left on an order that was not cancelled
    return j.select(
        F.col("o_orderkey").cast("string").alias("order_no"),
        F.col("o_custkey").cast("string").alias("account"),
        F.col("o_orderpriority").alias("channel"),
        F.when(st == "F", F.lit("存款成功")).when(st == "O", F.lit("已取消")).otherwise(F.lit("处理中")).alias("status"),
        reason.alias("cancel_reason"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderdate").alias("ordered_at"),
        F.when(st == "F", F.col("ship_min")).alias("completed_at"),
    )


def withdrawals(spark, d) -> DataFrame:
    o = load(spark, d, "orders")
    j = o.join(_order_ship(spark, d), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    st = F.col("o_orderstatus")
    return j.select(
        F.col("o_orderkey").cast("string").alias("order_no"),
        F.col("o_custkey").cast("string").alias("account"),
        F.col("o_orderpriority").alias("channel"),
        F.when(st == "F", F.lit("提款成功")).when(st == "O", F.lit("审核拒绝")).otherwise(F.lit("提款失败")).alias("status"),
        F.col("o_totalprice").alias("amount"),
        F.col("o_orderdate").alias("applied_at"),
        F.when(st == "F", F.col("ship_max")).alias("completed_at"),
    )


# ---------------------------------------------------------------- agent commission (single / team)

def commission(spark, d) -> DataFrame:
    c = load(spark, d, "customer")
    n = load(spark, d, "nation")
    j = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    ck = F.col("c_custkey")
    bal = F.col("c_acctbal")
    return j.select(
        F.concat(F.lit("2026-0"), (ck % 3 + 1).cast("string")).alias("commission_month"),
        F.col("c_name").alias("agent"),
        F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("parent"),
        F.col("c_mktsegment").alias("agent_type"),
        F.when(F.col("n_regionkey") % 2 == 0, F.lit("主线")).otherwise(F.lit("副线")).alias("line"),
        F.col("n_name").alias("team_name"),
        (ck % 4 != 0).alias("in_team"),
        (ck % 130).cast("bigint").alias("active"),
        (ck % 17).cast("bigint").alias("team_size"),
        (bal - D("2000.0")).alias("net_after_reversal"),
        (bal * D("30.0")).alias("carried_balance"),
        (F.abs(bal) * D("10.0")).alias("deposit_fee_base"),
        (F.abs(bal) * D("5.0")).alias("withdraw_fee_base"),
        (F.greatest(bal, D("0")) * D("0.1")).alias("commission"),
    )


# ---------------------------------------------------------------- settlement (summary / detail)

def settle_detail(spark, d) -> DataFrame:
    s = load(spark, d, "supplier")
    k = F.col("s_suppkey") % 4
    treatment = (F.when(k == 0, F.lit("退成5%")).when(k == 1, F.lit("退成3%"))
                 .when(k == 2, F.lit("引荐分成1%")).otherwise(F.lit("标准")))
    rate = F.when(k == 0, D("0.05")).when(k == 1, D("0.03")).when(k == 2, D("0.01")).otherwise(D("0.55"))
    prior = F.col("s_acctbal") * D("10.0")
    this = F.col("s_acctbal") * D("20.0") + D("1000.0")
    return s.select(
        F.concat(F.lit("2026-0"), (F.col("s_suppkey") % 2 + 3).cast("string")).alias("month"),
        F.when(F.col("s_suppkey") % 3 == 0, F.lit("已回款")).otherwise(F.lit("未回款")).alias("status"),
        F.col("s_name").alias("name"),
        F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("agent"),
        treatment.alias("treatment"),
        prior.alias("prior_perf"), this.alias("month_perf"), (prior + this).alias("total_perf"),
        rate.alias("rate"), ((prior + this) * rate).alias("commission"),
    )


def settle_summary(spark, d) -> DataFrame:
    """Settlement summary items per month (item, amount) derived from the detail."""
    det = settle_detail(spark, d)
    g = det.groupBy("month").agg(F.sum("month_perf").cast("decimal(38,6)").alias("a"),
                                 F.sum("commission").cast("decimal(38,6)").alias("b"),
                                 F.sum("prior_perf").cast("decimal(38,6)").alias("c"))
    return g.select("month", F.expr("stack(3, '本月业绩', a, '⭐️ 总计发放 ', -b, '先前挂账', c) as (item, amount)"))


# ---------------------------------------------------------------- call win-back

def winback(spark, d) -> DataFrame:
    o = load(spark, d, "orders")
    st, p = F.col("o_orderstatus"), F.col("o_totalprice")
    return o.groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month"),
                     F.col("o_orderpriority").alias("caller")).agg(
        F.count(F.lit(1)).alias("listed"),
        F.count_if(st != "P").alias("dialled"),
        F.count_if(st == "F").alias("connected"),
        F.count_if((st == "F") & (p > 150000)).alias("valid"),
        F.count_if(p > 300000).alias("bonus_requests"),
        F.count_if(st == "O").alias("relogins"),
        F.sum(F.when(st == "F", p * D("0.01")).otherwise(D("0"))).alias("recharge"),
    )


# ---------------------------------------------------------------- market-agent monthly settlement

def market(spark, d) -> DataFrame:
    li = load(spark, d, "lineitem")
    s = load(spark, d, "supplier")
    e = F.col("l_extendedprice")
    j = li.join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    g = j.groupBy(
        F.date_format("l_shipdate", "yyyy-MM").alias("month"),
        F.col("s_name").alias("agent_name"),
        F.col("s_suppkey").cast("string").alias("agent_account"),
    ).agg(
        F.count_if(F.col("l_linenumber") == 1).alias("registrations"),
        F.count_if((F.col("l_linenumber") == 1) & (F.col("l_returnflag") == "R")).alias("first_depositors"),
        F.count(F.lit(1)).alias("active"),
        F.sum(e * (1 + F.col("l_tax"))).alias("total_deposit"),
        F.sum(e * (1 - F.col("l_discount"))).alias("total_withdraw"),
        F.sum(e).alias("turnover"),
        F.sum(e * (F.col("l_tax") - F.col("l_discount"))).alias("total_win"),
        F.sum(e * F.col("l_discount") * D("0.1")).alias("bonus"),
        F.sum(F.col("l_quantity") * D("2.0")).alias("rebate"),
        F.sum(e * D("0.01")).alias("commission_paid"),
    )
    return g.withColumn("platform_net", F.col("total_win") - F.col("bonus") - F.col("rebate") - F.col("commission_paid"))


# ---------------------------------------------------------------- customer-service conversations

def cs(spark, d) -> DataFrame:
    """One row per conversation; turns packed into one blob with speaker>timestamp : headers."""
    cv = load(spark, d, "conversations")
    lb = load(spark, d, "labels")
    cid = F.col("conv_id")
    speaker = (F.when(F.col("role") == "user", F.concat(F.lit("m"), cid.cast("string")))
               .when(F.col("role") == "assistant", F.concat(F.lit("staff"), (cid % 7).cast("string")))
               .otherwise(F.lit("系统")))
    piece = F.concat(F.lit("\n"), speaker, F.lit(">2024-01-01 00:00:00 :"), F.col("text"))
    g = cv.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", piece.alias("p")))), lambda x: x["p"]), "")
         .alias("body"),
        F.count(F.lit(1)).alias("n_turns"),
        F.min(F.when(F.col("role") == "assistant", F.length("text"))).alias("first_len"),
        F.avg(F.when(F.col("role") == "assistant", F.length("text"))).alias("avg_len"),
    )
    j = g.join(lb, g.conv_id == lb.doc_id, "left")
    rating = (F.when(F.col("doc_id").isNull(), F.lit("未评价"))
              .when((F.col("toxic") == 1) & (F.col("quality") == 0), F.lit("非常不满意"))
              .when(F.col("toxic") == 1, F.lit("不满意"))
              .when(F.col("quality") == 0, F.lit("一般"))
              .when(cid % 2 == 0, F.lit("非常满意")).otherwise(F.lit("满意")))
    review = (F.when(cid % 4 == 0, F.lit("提款太慢,客服态度差")).when(cid % 4 == 1, F.lit("nan")))
    topic = F.when(cid % 5 == 0, F.lit("提款相关"))
    start = F.timestamp_add("MINUTE", (cid * 37).cast("int"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    return j.select(
        cid.cast("string").alias("conversation_id"),
        ((cid * 7) % 1500).cast("string").alias("account"),
        F.concat(F.lit("staff"), (cid % 7).cast("string")).alias("staff"),
        rating.alias("rating"), review.alias("review"), topic.alias("topic"),
        F.concat(F.lit("对话开始>>"), F.col("body")).alias("content"),
        start.alias("started_at"),
        F.timestamp_add("SECOND", (F.col("n_turns") * 90).cast("int"), start).alias("ended_at"),
        (F.col("first_len").cast("double") / 10.0).alias("first_response_s"),
        (F.col("avg_len") / 10.0).alias("avg_response_s"),
        (F.col("n_turns") * 90.0).alias("duration_s"),
        F.col("n_turns").cast("double").alias("turns"),
    )
