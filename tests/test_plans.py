"""Plan assertions: no Python UDF anywhere, no unbroadcast cartesian product, pushdown reaches the scan."""

import pytest

from tallyframe.plans.catalog import spark_queries

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark):
    return {n: plan_of(q(spark, SF)) for n, q in spark_queries().items()}


def test_no_python_udf(plans):
    bad = [n for n, p in plans.items() if "BatchEvalPython" in p or "ArrowEvalPython" in p or "PythonUDF" in p]
    assert bad == []


def test_no_unbroadcast_cartesian(plans):
    bad = [n for n, p in plans.items() if "CartesianProduct" in p]
    assert bad == []


def test_period_filters_reach_the_scan(spark):
    """FL-01, FL-02, FL-04, AG-16 on a plain table: the bounds are pushed filters and no join stands above the scan."""
    from pyspark.sql import functions as F

    from tallyframe.operators import filters as FL
    from tallyframe.operators import pnl
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").select(
        F.col("l_shipdate").alias("date"), F.col("l_returnflag").alias("venue"), F.col("l_quantity").alias("company_win"))
    people = orders.select(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("is_agent"), "o_custkey")
    people = people.withColumnsRenamed({"o_custkey": "account"})
    cases = [(FL.date_preset(orders, "o_orderdate", "last_30").select("o_orderkey"), "o_orderdate"),
             (FL.align_period(orders, "o_orderdate", "1998-07").select("o_orderkey"), "o_orderdate"),
             (pnl.contribution_by_line(lines, "1998-07"), "l_shipdate")]
    for df, date in cases:
        p = plan_of(df)
        assert f"GreaterThanOrEqual({date}" in p and f"LessThan({date}" in p and "Join" not in p
    assert "Join" not in plan_of(FL.default_members(people))
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in plan_of(cases[1][0])


def test_share_reports_scan_their_tables_once(spark):
    """AG-36, AG-73: top k and total come from one grouped frame; also in a k beyond the rows and with NULLs and ties."""
    from tallyframe.operators.common import top_and_total
    queries = spark_queries()
    scans = {n: plan_of(queries[n](spark, SF)).count("FileScan parquet") for n in
             ("ag73_concentration", "ag72_top_players", "ag36_top20_share", "ag37_member_distribution")}
    assert scans["ag73_concentration"] == scans["ag72_top_players"] and scans["ag36_top20_share"] == scans["ag37_member_distribution"]
    df = spark.createDataFrame([(f"a{i}", None if i % 10 == 0 else float(i // 2)) for i in range(500)], "a string, v double")
    values = sorted((i // 2 for i in range(500) if i % 10), reverse=True)
    for k in (1, 7, 100, 1000):
        assert tuple(top_and_total(df, "v", k).first()) == (sum(values[:k]), sum(values))
    assert tuple(top_and_total(df.limit(0), "v", 3).first()) == (None, None)


def test_month_filter_prunes_the_bet_table(spark, tmpdir_path):
    """IO-03: a table written by bet_month is read through its partitions only."""
    from pyspark.sql import functions as F

    from tallyframe.sources.files import read_bets
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", F.date_format("l_shipdate", "yyyy-MM").alias("bet_month"))
    lines.repartition("bet_month").write.partitionBy("bet_month").parquet(f"{tmpdir_path}/bets")
    df = read_bets(spark, f"{tmpdir_path}/bets", ["1998-06", "1998-07"])
    assert "bet_month" in plan_of(df).split("PartitionFilters: [")[1].split("]")[0] and "DataFilters: []" in plan_of(df)
    assert df.count() == lines.where(F.col("bet_month").isin("1998-06", "1998-07")).count() > 0
    assert df.select(F.input_file_name()).distinct().count() == 2


def test_crosstab_computes_its_frame_once(spark):
    """AG-112: marginals and pairs come from one exchange of the registrations."""
    df = spark_queries()["ag112_crosstab_top"](spark, SF)
    df._jdf.collectToPython()
    final = plan_of(df).split("== Initial Plan ==")[0]
    assert final.count("FileScan parquet") == 2 and "ReusedExchange" in final  # orders and customer
