"""Streaming jobs run to completion with availableNow over the given tables (ST-02, ST-03).

Each call streams the table file (a glob that matches exactly that file, as a file-source stream
needs a pattern) into a fresh folder under the shared checkpoint folder and returns the sink table.
"""

import uuid

from pyspark.sql import functions as F

from ...session import scratch_path
from ...streaming import jobs as J
from ..catalog import register
from ..oracle_ctes import with_ctes


def _glob(d, table):
    name = f"{table}.parquet"
    return f"{d}/{name[:-3]}[{name[-3]}]{name[-2:]}"


@register("st02_hour_slot_totals", """
SELECT date_trunc('hour', ts) AS slot_start, date_trunc('hour', ts) + INTERVAL 1 HOUR AS slot_end, event_type AS type,
  count(*) AS events, sum(value) AS amount FROM events GROUP BY 1, 2, 3""")
def st02(spark, d):
    run = uuid.uuid4().hex
    out = scratch_path(spark, f"st02/{run}/out")
    q = J.start_slot_totals(spark, _glob(d, "events"), out, scratch_path(spark, f"st02/{run}/ckpt"))
    q.awaitTermination()
    return J.read_slot_totals(spark, out).select("slot_start", "slot_end", "type", "events", "amount")


@register("st02_slot_anomaly_stream", """
WITH sd AS (SELECT CAST(ts AS DATE) AS day, strftime(ts, '%H:00') AS slot, count(*) AS v FROM events GROUP BY 1, 2),
 g AS (SELECT slot, max(CASE WHEN day = l THEN v END) AS latest_value,
   avg(CASE WHEN day < l AND day >= l - INTERVAL 7 DAY THEN CAST(v AS DOUBLE) END) AS baseline
   FROM (SELECT *, max(day) OVER () AS l FROM sd) GROUP BY slot)
SELECT *, CASE WHEN deviation_pct <= -20 THEN 'drop' WHEN deviation_pct >= 20 THEN 'spike' ELSE 'normal' END AS flag,
  CAST(substr(slot, 1, 2) AS INTEGER) AS hour FROM (
  SELECT *, (latest_value - baseline) / nullif(baseline, 0) * 100.0 AS deviation_pct FROM g
  WHERE latest_value IS NOT NULL AND baseline IS NOT NULL) WHERE deviation_pct IS NOT NULL""")
def st02a(spark, d):
    run = uuid.uuid4().hex
    out, anomalies = scratch_path(spark, f"st02/{run}/out"), scratch_path(spark, f"st02/{run}/anomalies")
    J.start_slot_totals(spark, _glob(d, "events"), out, scratch_path(spark, f"st02/{run}/ckpt"), anomalies=anomalies).awaitTermination()
    return J.read_slot_anomalies(spark, anomalies)


@register("st03_dedupe_orders_stream", with_ctes("bonus", body="SELECT DISTINCT order_no FROM bonus"))
def st03(spark, d):
    from .. import standins as S
    run = uuid.uuid4().hex
    src = scratch_path(spark, f"st03/{run}/src")
    S.bonus(spark, d).select("order_no", "applied_at").write.parquet(src)
    out = scratch_path(spark, f"st03/{run}/out")
    J.start_dedupe_orders(spark, src, out, checkpoint=scratch_path(spark, f"st03/{run}/ckpt")).awaitTermination()
    return spark.read.parquet(out).select(F.col("order_no"))


@register("st01_file_drop_ingest", with_ctes("platform", body="""
SELECT "日期", "注册数", "公司输赢", "首存人数" FROM (
  SELECT CAST(date AS VARCHAR) AS "日期", CAST(registrations AS VARCHAR) AS "注册数",
    CAST(company_win AS VARCHAR) AS "公司输赢", CAST(first_depositors AS VARCHAR) AS "首存人数",
    registrations, company_win, first_depositors FROM platform)
WHERE NOT (registrations = 0 AND company_win = 0 AND first_depositors = 0)"""))
def st01(spark, d):
    """ST-01 / IO-21: platform report rendered as landed CSV (Chinese headers, a total row), then the
    file-drop stream classifies it by header, cleans it and publishes raw_platform_report."""
    from .. import standins as S
    run = uuid.uuid4().hex
    landing = scratch_path(spark, f"st01/{run}/landing")
    root = scratch_path(spark, f"st01/{run}/tables")
    p = S.platform(spark, d).select(F.col("date").cast("string").alias("日期"),
                                    F.col("registrations").cast("string").alias("注册数"),
                                    F.col("company_win").cast("string").alias("公司输赢"),
                                    F.col("first_depositors").cast("string").alias("首存人数"))
    total = p.agg(F.lit("总计").alias("日期"), F.sum(F.col("注册数").cast("bigint")).cast("string").alias("注册数"),
                  F.lit("").alias("公司输赢"), F.lit("").alias("首存人数"))
    p.unionByName(total).write.option("header", True).csv(landing)
    J.file_ingest_stream(spark, landing, root, scratch_path(spark, f"st01/{run}/ckpt")).awaitTermination()
    return spark.read.parquet(f"{root}/raw_platform_report").select("日期", "注册数", "公司输赢", "首存人数")
