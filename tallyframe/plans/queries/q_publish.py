"""Publish disciplines as pure new x existing -> combined plans (IO-11…17) and quality checks (AG-127…133)."""

import uuid

from pyspark.sql import functions as F

from ...operators import quality as Q
from ...session import scratch_path
from ...sources import publish as P
from .. import standins as S
from ..catalog import register
from ..oracle_ctes import with_ctes

_BONUS_COLS = ("account", "vip", "type", "title", "note", "status", "needs_wagering", "wager_multiple", "amount",
               "applied_at")
_ORDER = ", ".join(f"{c} NULLS FIRST" for c in _BONUS_COLS)


def _bonus_split(spark, d):
    b = S.bonus(spark, d)
    return b.where(F.col("applied_at") >= "1998-07-01"), b.where(F.col("applied_at") < "1999-01-01")


_NEW_KEYS = with_ctes("bonus", body=f"""
SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY order_no ORDER BY {_ORDER}) AS rn
  FROM bonus WHERE applied_at >= TIMESTAMP '1998-07-01') n
WHERE rn = 1 AND order_no NOT IN (SELECT order_no FROM bonus WHERE applied_at < TIMESTAMP '1999-01-01' AND order_no IS NOT NULL)""")


@register("io11_append_new_keys", _NEW_KEYS)
def io11(spark, d):
    new, existing = _bonus_split(spark, d)
    return P.append_new_keys(new, existing, "order_no")


@register("io11_upload_to_keyed_table", _NEW_KEYS)
def io11_upload(spark, d):
    """The same upload against the written table, whose rows lie in the order of their keys."""
    new, existing = _bonus_split(spark, d)
    path = scratch_path(spark, f"io11/{uuid.uuid4().hex}")
    P.append_keyed(existing, path, "order_no")
    return P.append_new_keys(new, P.within_key_runs(spark.read.parquet(path), new, "order_no"), "order_no")


_DATED = """SELECT CASE WHEN o_orderkey % 97 = 0 THEN 'nan' WHEN o_orderkey % 89 = 0 THEN '' WHEN o_orderkey % 50 = 0 THEN strftime(o_orderdate, '%Y-%m') ELSE strftime(o_orderdate, '%Y-%m-%d') END
  AS date_txt, o_orderkey, o_totalprice FROM ord"""


def _dated(spark, d):
    o = S.load(spark, d, "orders")
    t = F.when(F.col("o_orderkey") % 97 == 0, F.lit("nan")).when(F.col("o_orderkey") % 89 == 0, F.lit("")) \
         .when(F.col("o_orderkey") % 50 == 0, F.date_format("o_orderdate", "yyyy-MM")) \
         .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select(t.alias("date_txt"), "o_orderkey", "o_totalprice")


def _replace_inputs(spark, d):
    t = _dated(spark, d)
    batch = ((F.col("o_orderkey") % 3 == 0) & (F.col("o_orderkey") % 50 != 0) &
             F.col("date_txt").between("1998-06-01", "1998-08-31"))
    return t.where(batch), t.where(~batch)  # every order is on one side


_REPL_X = {"dated": _DATED,
           "ex": "SELECT * FROM dated WHERE NOT (o_orderkey % 3 = 0 AND o_orderkey % 50 <> 0 AND date_txt BETWEEN '1998-06-01' AND '1998-08-31')",
           "nb": "SELECT * FROM dated WHERE o_orderkey % 3 = 0 AND o_orderkey % 50 <> 0 AND date_txt BETWEEN '1998-06-01' AND '1998-08-31'",
           "keys": "SELECT DISTINCT substr(date_txt, 1, 10) AS k FROM nb UNION SELECT DISTINCT substr(date_txt, 1, 7) FROM nb",
           "combined": r"""SELECT * FROM ex WHERE (CASE WHEN regexp_full_match(date_txt, '\d{4}-\d{2}') THEN date_txt
               ELSE substr(date_txt, 1, 10) END) NOT IN (SELECT k FROM keys) UNION ALL BY NAME SELECT * FROM nb"""}


@register("io12_replace_by_dates", with_ctes(extra=_REPL_X, body="SELECT * FROM combined"))
def io12(spark, d):
    new, existing = _replace_inputs(spark, d)
    return P.replace_by_dates(new, existing, "date_txt")


@register("io12_replace_report", with_ctes(extra=_REPL_X, body="""
SELECT range_start, range_end, before + written - total AS removed, written, total FROM
 (SELECT min(substr(date_txt, 1, 10)) AS range_start, max(substr(date_txt, 1, 10)) AS range_end, count(*) AS written FROM nb) a,
 (SELECT count(*) AS before FROM ex) b, (SELECT count(*) AS total FROM combined) c"""))
def io12r(spark, d):
    new, existing = _replace_inputs(spark, d)
    return P.replace_report(new, existing, "date_txt")


def _merge_inputs(spark, d):
    m = S.member(spark, d)
    existing = m.where(~((F.col("snapshot_month") == "1998-12") & (F.col("account").cast("bigint") % 5 == 0)))
    new = (m.where(F.col("snapshot_month").isin("1998-11", "1998-12") & (F.col("account").cast("bigint") % 2 == 0))
            .withColumn("snapshot_month", F.regexp_replace("snapshot_month", "-", ""))
            .withColumn("turnover", F.col("turnover") * 2))
    return new, existing


_MERGE_X = {
    "ex": "SELECT * FROM member WHERE NOT (snapshot_month = '1998-12' AND CAST(account AS BIGINT) % 5 = 0)",
    "nb": r"""SELECT * REPLACE (CASE WHEN regexp_full_match(sm, '\d{6}') THEN substr(sm, 1, 4) || '-' || substr(sm, 5, 2)
                     ELSE sm END AS snapshot_month) FROM (
              SELECT *, replace(snapshot_month, '-', '') AS sm FROM (SELECT * REPLACE (turnover * 2 AS turnover) FROM member
              WHERE snapshot_month IN ('1998-11', '1998-12') AND CAST(account AS BIGINT) % 2 = 0))""",
    "combined": """SELECT * FROM ex WHERE NOT EXISTS (SELECT 1 FROM nb WHERE nb.snapshot_month = ex.snapshot_month
                     AND nb.account = ex.account AND nb.agent IS NOT DISTINCT FROM ex.agent)
                   UNION ALL BY NAME SELECT * EXCLUDE (sm) FROM nb""",
}


@register("io13_merge_snapshot", with_ctes("member", extra=_MERGE_X, body="SELECT * FROM combined"))
def io13(spark, d):
    new, existing = _merge_inputs(spark, d)
    return P.merge_snapshot(new, existing)


@register("io17_untouched_mismatches", with_ctes("member", extra=_MERGE_X, body="""
SELECT * FROM (
  SELECT coalesce(a.period, b.period) AS period, coalesce(before, 0) AS before, coalesce(after, 0) AS after FROM
  (SELECT snapshot_month AS period, count(*) AS before FROM ex GROUP BY 1) a
  FULL OUTER JOIN (SELECT snapshot_month AS period, count(*) AS after FROM combined GROUP BY 1) b
  ON a.period IS NOT DISTINCT FROM b.period)
WHERE period NOT IN ('1998-11', '1998-12') AND before <> after"""))
def io17(spark, d):
    new, existing = _merge_inputs(spark, d)
    combined = P.merge_snapshot(new, existing)
    touched = spark.createDataFrame([("1998-11",), ("1998-12",)], "period string")
    return P.untouched_mismatches(existing, combined, "snapshot_month", touched)


_WB_NEW = "SELECT * REPLACE (replace(month, '-', '') AS month, recharge * 2 AS recharge) FROM winback WHERE month = '1999-06'"


@register("io14_refresh_months", with_ctes("winback", extra={"nb": _WB_NEW}, body=r"""
SELECT * FROM winback WHERE month NOT IN ('1999-06')
UNION ALL BY NAME SELECT * REPLACE (CASE WHEN regexp_full_match(month, '\d{6}') THEN substr(month, 1, 4) || '-' ||
  substr(month, 5, 2) ELSE month END AS month) FROM nb"""))
def io14(spark, d):
    wb = S.winback(spark, d)
    new = wb.where(F.col("month") == "1999-06").withColumn("month", F.regexp_replace("month", "-", "")) \
            .withColumn("recharge", F.col("recharge") * 2)
    return P.refresh_months(new, wb, "month")


@register("io15_list_periods", with_ctes("winback", body="""
SELECT coalesce(CAST(month AS VARCHAR), '(空)') AS period, count(*) AS "rows" FROM winback GROUP BY 1"""))
def io15(spark, d):
    return P.list_periods(S.winback(spark, d), "month")


@register("io16_delete_report", with_ctes("winback", body="""
SELECT (SELECT count(*) FROM winback) - count(*) AS removed, count(*) AS remaining FROM winback
WHERE NOT coalesce(month IN ('1999-06', '1999-07'), false)"""))
def io16(spark, d):
    return P.delete_report(S.winback(spark, d), "month", ["1999-06", "1999-07"])


# ---------------------------------------------------------------- quality

_FRESH = """SELECT 'platform' AS "table", 'daily' AS kind, max(substr(CAST(date AS VARCHAR), 1, 10)) AS latest, count(*) AS "rows" FROM platform
UNION ALL SELECT 'finance', 'daily', max(substr(CAST(date AS VARCHAR), 1, 10)), count(*) FROM finance
UNION ALL SELECT 'member', 'monthly', max(snapshot_month), count(*) FROM member
UNION ALL SELECT 'winback', 'monthly', max(month), count(*) FROM winback
UNION ALL SELECT 'realtime_deposit_withdraw', 'daily', NULL, 0"""


def _fresh(spark, d):
    return Q.freshness(spark, {
        "platform": (S.platform(spark, d), "date", "daily"),
        "finance": (S.finance(spark, d), "date", "daily"),
        "member": (S.member(spark, d), "snapshot_month", "monthly"),
        "winback": (S.winback(spark, d), "month", "monthly"),
        "realtime_deposit_withdraw": (None, "date", "daily"),
    })


@register("ag127_freshness", with_ctes("platform", "finance", "member", "winback", body=_FRESH))
def ag127(spark, d):
    return _fresh(spark, d)


@register("ag128_freshness_status", with_ctes("platform", "finance", "member", "winback", extra={"f": _FRESH}, body="""
SELECT * EXCLUDE (dd, m), CASE status WHEN 'bad' THEN 3 WHEN 'check' THEN 2 WHEN 'warn' THEN 1 ELSE 0 END AS severity FROM (
SELECT *, CASE WHEN kind = 'monthly' THEN
    CASE WHEN m IS NULL THEN 'check' WHEN gap <= 0 THEN 'ok' WHEN gap = 1 THEN 'warn' ELSE 'bad' END
  ELSE CASE WHEN dd IS NULL THEN 'check' WHEN gap <= 1 THEN 'ok' WHEN gap <= 3 THEN 'warn' ELSE 'bad' END END AS status FROM (
  SELECT * EXCLUDE (dd, m), dd, m FROM (
  SELECT *, CASE WHEN kind = 'monthly' THEN (2001 * 12 + 8) - (year(m) * 12 + month(m))
                 ELSE datediff('day', dd, DATE '2001-08-05') END AS gap FROM (
    SELECT *, CAST(try_strptime(latest, '%Y-%m-%d') AS DATE) AS dd, CAST(try_strptime(latest || '-01', '%Y-%m-%d') AS DATE) AS m
    FROM f))))""".replace("SELECT * EXCLUDE (dd, m), dd, m FROM (", "SELECT * FROM (")))
def ag128(spark, d):
    return Q.freshness_status(_fresh(spark, d), "2001-08-05")


@register("ag129_check_completeness", with_ctes("member", "platform", body="""
SELECT *, CAST(member_regs AS DOUBLE) / nullif(CAST(platform_regs AS DOUBLE), 0) AS coverage,
  coalesce(CAST(member_regs AS DOUBLE) / nullif(CAST(platform_regs AS DOUBLE), 0) < 0.8, false) AS warn FROM (
SELECT month, max_day, member_regs, (SELECT coalesce(sum(registrations), 0) FROM platform
  WHERE strftime(date, '%Y-%m') = month AND CAST(date AS DATE) <= max_day) AS platform_regs FROM (
  SELECT strftime(registered_at, '%Y-%m') AS month, max(CAST(registered_at AS DATE)) AS max_day,
    count_if(is_agent = '非代理') AS member_regs FROM member WHERE registered_at IS NOT NULL
  GROUP BY 1 ORDER BY 1 DESC LIMIT 1))"""))
def ag129(spark, d):
    return Q.check_completeness(S.member(spark, d), S.platform(spark, d))


_DAILY_OPS = """
SELECT source, month, max_day, member_regs, regs AS platform_regs, CAST(member_regs AS DOUBLE) / nullif(CAST(regs AS DOUBLE), 0) AS coverage,
  coalesce(CAST(member_regs AS DOUBLE) / nullif(CAST(regs AS DOUBLE), 0) < 0.8, false) AS warn FROM (
SELECT s.source, l.month, l.max_day, l.member_regs, coalesce(nullif((SELECT sum(registrations + 1) FROM platform
    WHERE s.source = 'sheet' AND strftime(date, '%Y-%m') = l.month AND CAST(date AS DATE) <= l.max_day), 0),
  (SELECT sum(registrations) FROM platform WHERE strftime(date, '%Y-%m') = l.month AND CAST(date AS DATE) <= l.max_day), 0) AS regs
FROM (VALUES ('sheet'), ('sheet of other months')) s(source), (
  SELECT strftime(registered_at, '%Y-%m') AS month, max(CAST(registered_at AS DATE)) AS max_day, count_if(is_agent = '非代理') AS member_regs
  FROM member WHERE registered_at IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 1) l)"""


@register("jn10_daily_ops_first", with_ctes("member", "platform", body=_DAILY_OPS))
def jn10(spark, d):
    """Registrations of the operations sheet where it has some, else of the platform report."""
    member, platform = S.member(spark, d), S.platform(spark, d)
    sheet = platform.select("date", (F.col("registrations") + 1).alias("registrations"))
    other = sheet.withColumn("date", F.add_months("date", -1200))
    both = [Q.check_completeness(member, platform, daily_ops=ops).select(F.lit(name).alias("source"), "*")
            for name, ops in (("sheet", sheet), ("sheet of other months", other))]
    return both[0].unionByName(both[1])


@register("ag130_check_row_drop", """
SELECT new_rows, existing_rows, existing_rows >= 20 AND new_rows < existing_rows * 0.7 AS warn FROM
 (SELECT count(*) AS new_rows FROM orders WHERE o_orderkey % 10 = 0) a,
 (SELECT count(*) AS existing_rows FROM orders WHERE o_orderkey % 10 <> 0) b""")
def ag130(spark, d):
    o = S.load(spark, d, "orders")
    return Q.check_row_drop(o.where(F.col("o_orderkey") % 10 == 0), o.where(F.col("o_orderkey") % 10 != 0))


@register("ag131_check_missing_days", with_ctes("agent_daily", extra={
    "d": "SELECT DISTINCT CAST(date AS DATE) AS d FROM agent_daily",
    "miss": "SELECT CAST(x AS DATE) AS d FROM (SELECT unnest(generate_series(min(d), max(d), INTERVAL 1 DAY)) AS x FROM d) "
            "WHERE CAST(x AS DATE) NOT IN (SELECT d FROM d)"}, body="""
SELECT (SELECT count(*) FROM miss) AS missing_days,
  coalesce((SELECT list(strftime(d, '%Y-%m-%d') ORDER BY d) FROM (SELECT d FROM miss ORDER BY d LIMIT 5)), []) AS first_missing"""))
def ag131(spark, d):
    return Q.check_missing_days(S.agent_daily(spark, d), "date")


@register("ag132_check_zero_metric", with_ctes("agent_daily", body="""
SELECT 'early_settlement' AS metric, count_if(coalesce(early_settlement, 0) <> 0) = 0 AS all_zero FROM agent_daily"""))
def ag132(spark, d):
    # the metric as an upload spells it: text with thousands separators
    a = S.agent_daily(spark, d).withColumn("early_settlement", F.format_number(F.col("early_settlement").cast("double"), 2))
    return Q.check_zero_metric(a, ["not_a_column", "early_settlement", "turnover"])


@register("ag133_looks_month_aggregated", with_ctes(extra={"dated": _DATED}, body=r"""
SELECT month_share, coalesce(month_share > 0.8, false) AS month_aggregated FROM (
SELECT avg(CAST(regexp_full_match(trim(date_txt), '\d{4}-\d{2}') AS DOUBLE)) AS month_share FROM dated
WHERE trim(date_txt) NOT IN ('', 'nan', 'None'))"""))
def ag133(spark, d):
    return Q.looks_month_aggregated(_dated(spark, d), "date_txt")


def _filed(spark, d):
    o = S.load(spark, d, "orders")
    f = F.concat(F.lit("2026-0"), (F.col("o_orderkey") % 3 + 1).cast("string"), F.lit("/part"),
                 (F.col("o_orderkey") % 7).cast("string"), F.lit(".csv"))
    return o.select("o_orderkey", "o_totalprice", f.alias("_source_file"))


@register("io09_only_new_files", with_ctes(extra={"fl": """SELECT o_orderkey, o_totalprice,
  '2026-0' || CAST(o_orderkey % 3 + 1 AS VARCHAR) || '/part' || CAST(o_orderkey % 7 AS VARCHAR) || '.csv' AS _source_file FROM ord"""},
    body=r"""SELECT * FROM fl n WHERE (o_orderkey % 2 = 0 OR o_orderkey % 7 = 6) AND NOT EXISTS (
  SELECT 1 FROM (SELECT DISTINCT CASE WHEN o_orderkey % 7 < 3 THEN 'landing/' || regexp_extract(_source_file, '[^/]+$', 0)
                                  ELSE _source_file END AS p FROM fl WHERE NOT (o_orderkey % 2 = 0 OR o_orderkey % 7 = 6)) e
  WHERE e.p = n._source_file OR regexp_extract(e.p, '[^/]+$', 0) = regexp_extract(n._source_file, '[^/]+$', 0)
     OR ends_with(e.p, '/' || regexp_extract(n._source_file, '[^/]+$', 0)))"""))
def io09(spark, d):
    t = _filed(spark, d)
    upload = (F.col("o_orderkey") % 2 == 0) | (F.col("o_orderkey") % 7 == 6)
    new, ex = t.where(upload), t.where(~upload)  # every row is on one side; part6 files are new
    ex = ex.withColumn("_source_file", F.when(F.col("o_orderkey") % 7 < 3,
                                              F.concat(F.lit("landing/"), F.regexp_extract("_source_file", r"[^/]+$", 0)))
                       .otherwise(F.col("_source_file")))
    return P.only_new_files(new, ex)
