"""New registrations (AG-101…113), payments (AG-114…120), win-back (AG-121…123), market settlement (AG-124…126)."""

from pyspark.sql import functions as F

from ...operators import newreg as NR
from ...operators import payments as PY
from .. import standins as S
from ..catalog import register
from ..oracle_ctes import with_ctes


def _r(n, d):
    return f"CAST({n} AS DOUBLE) / nullif(CAST({d} AS DOUBLE), 0)"


_LATEST = """SELECT account, agent0 AS agent, l.registered_at, l.first_deposit_at, l.first_deposit, l.first_bet, l.vip, l.status, l.source,
  l.register_channel, l.register_url, l.tags, net_income, lifetime_turnover, bonus_n, rebate_n FROM (
  SELECT account, nullif(trim(agent), '') AS agent0,
    arg_max({'registered_at': registered_at, 'first_deposit_at': first_deposit_at, 'first_deposit': first_deposit,
             'first_bet': first_bet, 'vip': vip, 'status': status, 'source': source, 'register_channel': register_channel,
             'register_url': register_url, 'tags': tags}, snapshot_month) AS l,
    coalesce(sum(company_income), 0) AS net_income, coalesce(sum(turnover), 0) AS lifetime_turnover,
    coalesce(sum(bonus), 0) AS bonus_n, coalesce(sum(rebate), 0) AS rebate_n
  FROM member GROUP BY 1, 2)"""

_NR = r"""SELECT * EXCLUDE (ttf), strftime(registered_at, '%Y-%m-%d') AS reg_day, strftime(registered_at, '%Y-%m') AS reg_month,
  coalesce(CAST(first_deposit AS DOUBLE), 0.0) AS first_dep, coalesce(CAST(first_deposit AS DOUBLE), 0.0) > 0 AS has_first_deposit,
  coalesce(CAST(first_bet AS DOUBLE), 0.0) AS first_bet_amt, coalesce(CAST(first_bet AS DOUBLE), 0.0) > 0 AS has_first_bet,
  CASE WHEN coalesce(CAST(first_deposit AS DOUBLE), 0.0) > 0 AND ttf >= 0 THEN ttf END AS ttf_hours,
  coalesce(agent, '(直客/无代理)') AS agent_label,
  CASE WHEN register_url IS NULL THEN '(未记录)'
       WHEN regexp_extract(register_url, 'https?://([^/:]+)', 1) <> '' THEN regexp_extract(register_url, 'https?://([^/:]+)', 1)
       WHEN starts_with(register_url, 'null') THEN '(仅邀请码)'
       WHEN trim(register_url) = '' THEN '(未记录)'
       ELSE substr(register_url, 1, 40) END AS domain,
  nullif(regexp_extract(replace(register_url, '%20', ' '), '[ir][_ ]?code[=\-](\d+)', 1), '') AS invite_code
FROM (SELECT *, (epoch_us(first_deposit_at) - epoch_us(registered_at)) / 3.6e9 AS ttf FROM latest
      WHERE registered_at IS NOT NULL)"""

_X = {"latest": _LATEST, "nr": _NR}


def _gq(dims, src="nr"):
    d = ", ".join(dims)
    return f"""SELECT {d}, registrations,
  CAST(depositors AS DOUBLE) / CAST(registrations AS DOUBLE) * 100.0 AS conversion_pct,
  CAST(registrations - depositors AS DOUBLE) / CAST(registrations AS DOUBLE) * 100.0 AS no_deposit_pct,
  first_dep_sum / CAST(registrations AS DOUBLE) AS avg_first_deposit,
  net_income_total / CAST(registrations AS DOUBLE) AS net_per_head, net_income_total,
  CASE WHEN turnover > 0 THEN give / turnover * 100.0 WHEN give > 0 THEN 999.0 END AS arbitrage_ratio_pct FROM (
  SELECT {d}, count(*) AS registrations, count_if(has_first_deposit) AS depositors, sum(first_dep) AS first_dep_sum,
    CAST(sum(net_income) AS DOUBLE) AS net_income_total, CAST(sum(lifetime_turnover) AS DOUBLE) AS turnover,
    CAST(sum(bonus_n + rebate_n) AS DOUBLE) AS give FROM {src} GROUP BY {d})"""


def _nr(spark, d):
    return NR.prepare_newreg(S.member(spark, d))


@register("ag101_prepare_newreg", with_ctes("member", extra=_X, body="SELECT * FROM nr"))
def ag101(spark, d):
    return _nr(spark, d)


# the months of two thirds of the members were imported again, with another turnover
_TWICE = """SELECT *, TIMESTAMP '2026-01-01' AS _imported_at FROM member UNION ALL
  SELECT * REPLACE (turnover * 2 AS turnover), TIMESTAMP '2026-01-02' FROM member WHERE CAST(account AS BIGINT) % 3 <> 0"""
_REST = ("registered_at", "first_deposit_at", "first_deposit", "first_bet", "deposits", "withdrawals", "turnover", "company_win", "bonus",
         "rebate", "company_income", "vip", "status", "is_agent", "source", "register_channel", "register_url", "tags", "orders_n")
_LAST_IMPORT = f"""SELECT * FROM imported QUALIFY row_number() OVER (PARTITION BY account, nullif(trim(agent), ''), snapshot_month
  ORDER BY {', '.join(f'{c} DESC NULLS LAST' for c in ('_imported_at', *_REST))}) = 1"""


@register("wn03_latest_import", with_ctes("member", extra={
    "imported": _TWICE, "last_import": _LAST_IMPORT, "latest": _LATEST.replace("FROM member", "FROM last_import"), "nr": _NR},
    body="SELECT * FROM nr"))
def wn03(spark, d):
    """A month imported twice counts once, by its latest import."""
    m = S.member(spark, d)
    again = m.where(F.col("account").cast("bigint") % 3 != 0).withColumn("turnover", F.col("turnover") * 2)
    stamped = [df.withColumn("_imported_at", F.lit(t).cast("timestamp_ntz")) for df, t in ((m, "2026-01-01"), (again, "2026-01-02"))]
    return NR.prepare_newreg(stamped[0].unionByName(stamped[1]))


@register("ag102_newreg_kpis", with_ctes("member", extra=_X, body=f"""
SELECT *, registrations - direct AS agent_sourced, {_r('depositors', 'registrations')} * 100.0 AS depositor_pct FROM (
SELECT count(*) AS registrations, count(DISTINCT account) AS accounts, count_if(has_first_deposit) AS depositors,
  sum(first_dep) AS first_deposit_sum, count_if(agent IS NULL) AS direct,
  count(DISTINCT CASE WHEN has_first_deposit THEN agent END) AS productive_agents FROM nr)"""))
def ag102(spark, d):
    return NR.newreg_kpis(_nr(spark, d))


@register("ag103_newreg_daily", with_ctes("member", extra=_X, body="""
SELECT reg_day, count_if(has_first_deposit) AS deposited, count_if(NOT has_first_deposit) AS not_deposited
FROM nr GROUP BY 1"""))
def ag103(spark, d):
    return NR.newreg_daily(_nr(spark, d))


@register("ag104_group_quality_vip", with_ctes("member", extra=_X, body=_gq(["vip"])))
def ag104(spark, d):
    return NR.group_quality(_nr(spark, d), ["vip"])


@register("ag105_value_by_source", with_ctes("member", extra=dict(_X, nrs="SELECT * REPLACE (coalesce(source, '(未记录)') AS source) FROM nr"),
                                             body=f"""SELECT *, CASE source WHEN '直客' THEN 0 WHEN '普代下线' THEN 1
  WHEN '官代下线' THEN 2 ELSE 9 END AS source_order FROM ({_gq(['source'], 'nrs')})"""))
def ag105(spark, d):
    return NR.value_by_source(_nr(spark, d))


@register("ag105_direct_vs_agent", with_ctes("member", extra=_X, body="""
SELECT side, count(*) AS members, avg(CAST(has_first_deposit AS DOUBLE)) * 100.0 AS conversion_pct,
  avg(CAST(net_income AS DOUBLE)) AS net_per_head FROM (
  SELECT *, CASE WHEN coalesce(source, '(未记录)') = '直客' THEN 'direct' ELSE 'agent' END AS side FROM nr) GROUP BY 1"""))
def ag105b(spark, d):
    return NR.direct_vs_agent(_nr(spark, d))


@register("ag106_agent_quality_board", with_ctes("member", extra=_X, body=f"""
SELECT *, concat_ws(' ', CASE WHEN registrations >= 10 AND round_even(no_deposit_pct, 0) >= 80 THEN '刷量嫌疑' END,
                         CASE WHEN coalesce(round_even(arbitrage_ratio_pct, 1) >= 100, false) THEN '红利套利' END) AS risk
FROM ({_gq(['agent_label'])}) WHERE registrations >= 5 ORDER BY registrations DESC, agent_label LIMIT 40"""))
def ag106(spark, d):
    return NR.agent_quality_board(_nr(spark, d), 5, 40)


@register("ag107_funnel", with_ctes("member", extra=_X, body=f"""
SELECT step, label, n, {_r('n', 'prev_n')} AS step_rate, {_r('n', 'first_n')} AS overall_rate FROM (
  SELECT 0 AS step, '注册' AS label, n0 AS n, n0 AS prev_n, n0 AS first_n FROM g UNION ALL
  SELECT 1, '首存', n1, n0, n0 FROM g UNION ALL SELECT 2, '首投', n2, n1, n0 FROM g)""").replace(
    "\nSELECT step, label", ", g AS (SELECT count(*) AS n0, count_if(has_first_deposit) AS n1, "
    "count_if(has_first_bet) AS n2 FROM nr)\nSELECT step, label", 1))
def ag107(spark, d):
    return NR.funnel(_nr(spark, d))


@register("ag108_ttf_stats", with_ctes("member", extra=_X, body="""
SELECT median(ttf_hours) AS median_ttf_hours,
  avg(CASE WHEN ttf_hours IS NOT NULL THEN CAST(ttf_hours < 1 AS DOUBLE) END) AS share_under_1h,
  median(CASE WHEN has_first_deposit THEN first_dep END) AS median_first_deposit, count(ttf_hours) AS with_ttf FROM nr"""))
def ag108a(spark, d):
    return NR.ttf_stats(_nr(spark, d))


@register("ag108_ttf_bands", with_ctes("member", extra=_X, body="""
SELECT b.band_order, b.band, coalesce(g.members, 0) AS members
FROM (VALUES (0, '<1h'), (1, '1-24h'), (2, '1-7d'), (3, '>7d')) b(band_order, band)
LEFT JOIN (SELECT CASE WHEN ttf_hours < 1 THEN '<1h' WHEN ttf_hours < 24 THEN '1-24h' WHEN ttf_hours < 168 THEN '1-7d'
                       ELSE '>7d' END AS band, count(*) AS members FROM nr WHERE ttf_hours IS NOT NULL GROUP BY 1) g
ON b.band = g.band"""))
def ag108b(spark, d):
    return NR.ttf_bands(_nr(spark, d))


@register("ag108_ttf_by_source", with_ctes("member", extra=_X, body="""
SELECT coalesce(source, '(未记录)') AS source, median(ttf_hours) AS median_ttf_hours, count(*) AS members
FROM nr WHERE ttf_hours IS NOT NULL GROUP BY 1"""))
def ag108c(spark, d):
    return NR.ttf_by(_nr(spark, d), "source")


@register("ag109_cohort_pl", with_ctes("member", extra=_X, body=_gq(["reg_month"])))
def ag109(spark, d):
    return NR.cohort_pl(_nr(spark, d))


@register("ag110_rank_with_tail", with_ctes("member", extra=dict(_X, g="""SELECT coalesce(domain, '(未记录)') AS domain,
  count(*) AS registrations, count_if(has_first_deposit) AS depositors, sum(first_dep) AS first_deposit_sum FROM nr GROUP BY 1""",
  t="SELECT * FROM g ORDER BY registrations DESC, domain LIMIT 20"), body="""
SELECT *, round(CAST(registrations - depositors AS DOUBLE) / registrations * 100.0, 0) AS no_deposit_pct FROM (
SELECT *, CAST(1 AS BIGINT) AS groups FROM t
UNION ALL SELECT '(其余)', sum(registrations), sum(depositors), sum(first_deposit_sum), count(*) FROM g
WHERE domain NOT IN (SELECT domain FROM t) HAVING count(*) > 0)"""))
def ag110(spark, d):
    return NR.rank_with_tail(_nr(spark, d), "domain", 20)


@register("ag111_invite_ranking", with_ctes("member", extra=_X, body="""
SELECT invite_code, sum(n) AS registrations, sum(dd) AS depositors, sum(fd) AS first_deposit_sum,
  arg_min(agent_label, (-n, agent_label)) AS top_agent,
  round(CAST(sum(n) - sum(dd) AS DOUBLE) / sum(n) * 100.0, 0) AS no_deposit_pct FROM (
  SELECT invite_code, agent_label, count(*) AS n, count_if(has_first_deposit) AS dd, sum(first_dep) AS fd FROM nr
  WHERE invite_code IS NOT NULL GROUP BY 1, 2)
GROUP BY 1 ORDER BY registrations DESC, invite_code LIMIT 20"""))
def ag111(spark, d):
    return NR.invite_ranking(_nr(spark, d), 20)


@register("ag112_crosstab_top", with_ctes("member", extra=dict(_X, p="""SELECT coalesce(register_channel, '(未记录)') AS register_channel,
  coalesce(vip, '(未记录)') AS vip, CAST(count(*) AS DOUBLE) AS value FROM nr GROUP BY 1, 2"""), body="""
SELECT * FROM p WHERE register_channel IN (SELECT register_channel FROM p GROUP BY 1 ORDER BY sum(value) DESC, 1 LIMIT 15)
  AND vip IN (SELECT vip FROM p GROUP BY 1 ORDER BY sum(value) DESC, 1 LIMIT 15)"""))
def ag112(spark, d):
    return NR.crosstab(_nr(spark, d), "register_channel", "vip", 15)


@register("ag113_agent_newreg", with_ctes("member", extra=_X, body="""
SELECT account, reg_day, first_dep, has_first_deposit, ttf_hours, domain, invite_code, net_income FROM nr
WHERE agent_label = 'ag7'"""))
def ag113(spark, d):
    return NR.agent_newreg(_nr(spark, d), "ag7")


# ---------------------------------------------------------------- payments

_DM = "(epoch_us(completed_at) - epoch_us(ordered_at)) / 6.0e7"
_WM = "(epoch_us(completed_at) - epoch_us(applied_at)) / 6.0e7"


@register("ag114_minutes_between", with_ctes("deposits", body=f"SELECT order_no, {_DM} AS minutes FROM deposits"))
def ag114(spark, d):
    return PY.with_minutes(S.deposits(spark, d), "ordered_at").select("order_no", "minutes")


@register("ag115_deposit_kpis", with_ctes("deposits", body=f"""
SELECT count(*) AS orders, avg(CAST(trim(status) = '存款成功' AS DOUBLE)) AS success_rate,
  avg(CAST(trim(status) = '已取消' AS DOUBLE)) AS drop_rate,
  avg(CASE WHEN trim(status) = '存款成功' AND {_DM} >= 0 THEN {_DM} END) AS avg_minutes FROM deposits"""))
def ag115(spark, d):
    return PY.deposit_kpis(S.deposits(spark, d))


_BYCH = f"""SELECT channel, count(*) AS orders, avg(CAST(trim(status) = '存款成功' AS DOUBLE)) * 100.0 AS success_pct,
  avg(CAST(trim(status) = '已取消' AS DOUBLE)) * 100.0 AS drop_pct,
  coalesce(avg(CASE WHEN trim(status) = '存款成功' AND {_DM} >= 0 THEN {_DM} END), 0.0) AS avg_minutes
FROM deposits WHERE channel IS NOT NULL GROUP BY 1"""


@register("ag116_deposit_by_channel", with_ctes("deposits", body=_BYCH))
def ag116(spark, d):
    return PY.deposit_by_channel(S.deposits(spark, d))


@register("ag117_low_success_channels", with_ctes("deposits", body=f"""
SELECT * FROM ({_BYCH}) WHERE orders >= 20 AND success_pct < 40.0"""))
def ag117(spark, d):
    return PY.low_success_channels(S.deposits(spark, d), 20, 0.4)


@register("ag118_cancel_reasons", with_ctes("deposits", body="""
SELECT reason, count(*) AS orders FROM (SELECT CASE WHEN trim(cancel_reason) IN ('', 'nan', 'None') THEN NULL
  ELSE trim(cancel_reason) END AS reason FROM deposits WHERE trim(status) = '已取消') WHERE reason IS NOT NULL GROUP BY 1
ORDER BY orders DESC, reason LIMIT 8"""))
def ag118(spark, d):
    return PY.cancel_reasons(S.deposits(spark, d), 8)


@register("ag119_withdraw_kpis", with_ctes("withdrawals", body=f"""
SELECT count(*) AS orders, avg(CAST(trim(status) = '提款成功' AS DOUBLE)) AS success_rate,
  avg(CAST(trim(status) = '审核拒绝' AS DOUBLE)) AS reject_rate, avg(CAST(trim(status) = '提款失败' AS DOUBLE)) AS fail_rate,
  avg(m) AS avg_minutes, quantile_cont(m, 0.5) AS median_minutes, quantile_cont(m, 0.9) AS p90_minutes,
  count_if(m > 60.0) AS slow_count
FROM (SELECT *, CASE WHEN trim(status) = '提款成功' AND {_WM} >= 0 THEN {_WM} END AS m FROM withdrawals)"""))
def ag119(spark, d):
    return PY.withdraw_kpis(S.withdrawals(spark, d))


@register("ag120_slow_withdrawals", with_ctes("withdrawals", body=f"""
SELECT order_no, account, channel, amount, applied_at, completed_at, {_WM} AS minutes FROM withdrawals
WHERE trim(status) = '提款成功' AND {_WM} > 60.0 ORDER BY minutes DESC, order_no LIMIT 50"""))
def ag120(spark, d):
    return PY.slow_withdrawals(S.withdrawals(spark, d), 60.0, 50)


# ---------------------------------------------------------------- win-back

_WBM = """SELECT *, coalesce(CAST(connected AS DOUBLE) / nullif(CAST(dialled AS DOUBLE), 0), 0.0) AS connect_rate,
  coalesce(CAST(valid AS DOUBLE) / nullif(CAST(connected AS DOUBLE), 0), 0.0) AS valid_rate,
  coalesce(CAST(relogins AS DOUBLE) / nullif(CAST(listed AS DOUBLE), 0), 0.0) AS relogin_rate FROM (
SELECT month, sum(listed) AS listed, sum(dialled) AS dialled, sum(connected) AS connected, sum(valid) AS valid,
  sum(bonus_requests) AS bonus_requests, sum(relogins) AS relogins, sum(recharge) AS recharge FROM winback GROUP BY 1)"""


@register("ag121_winback_month", with_ctes("winback", body=_WBM))
def ag121(spark, d):
    return PY.winback_month(S.winback(spark, d))


@register("ag122_winback_funnel", with_ctes("winback", body="""
SELECT step, label, n, coalesce(CAST(n AS DOUBLE) / nullif(CAST(base AS DOUBLE), 0), 0.0) * 100.0 AS pct_of_initial FROM (
  SELECT 0 AS step, '已播' AS label, a AS n, a AS base FROM g UNION ALL SELECT 1, '接通', b, a FROM g
  UNION ALL SELECT 2, '有效通话', c, a FROM g)""").replace("\nSELECT step", ", g AS (SELECT sum(dialled) AS a, "
    "sum(connected) AS b, sum(valid) AS c FROM winback WHERE month = '1999-06')\nSELECT step", 1))
def ag122a(spark, d):
    return PY.winback_funnel(S.winback(spark, d), "1999-06")


@register("ag122_winback_callers", with_ctes("winback", body="""
SELECT *, caller = max(best) OVER () AS best FROM (
SELECT caller, sum(listed) AS listed, sum(dialled) AS dialled, sum(connected) AS connected, sum(valid) AS valid,
  sum(bonus_requests) AS bonus_requests, sum(relogins) AS relogins, sum(recharge) AS recharge,
  NULL AS best FROM winback WHERE month = '1999-06' GROUP BY 1) x""".replace("NULL AS best", "NULL::VARCHAR AS best_unused")
    .replace("caller = max(best) OVER () AS best", "caller = arg_max(caller, (recharge, caller)) OVER () AS best")
    .replace("SELECT *,", "SELECT * EXCLUDE (best_unused),")))
def ag122b(spark, d):
    return PY.winback_callers(S.winback(spark, d), "1999-06")


@register("ag123_winback_compare", with_ctes("winback", extra={"m": _WBM}, body="""
SELECT month, dialled, connected, recharge, connect_rate, dialled - lag(dialled) OVER (ORDER BY month) AS dialled_delta,
  recharge - lag(recharge) OVER (ORDER BY month) AS recharge_delta,
  connect_rate - lag(connect_rate) OVER (ORDER BY month) AS connect_rate_delta FROM m"""))
def ag123(spark, d):
    return PY.winback_compare(S.winback(spark, d))


# ---------------------------------------------------------------- market settlement

_MS = ("registrations", "first_depositors", "active", "total_deposit", "total_withdraw", "turnover", "total_win",
       "bonus", "rebate", "commission_paid", "platform_net")


@register("ag124_market_month", with_ctes("market", body="SELECT count(DISTINCT agent_account) AS agents, " +
                                          ", ".join(f"sum({c}) AS {c}" for c in _MS) +
                                          " FROM market WHERE month = '2000-06'"))
def ag124a(spark, d):
    return PY.market_month(S.market(spark, d), "2000-06")


@register("ag124_market_agents", with_ctes("market", body="SELECT * FROM market WHERE month = '2000-06'"))
def ag124b(spark, d):
    return PY.market_agents(S.market(spark, d), "2000-06")


@register("ag125_market_trend", with_ctes("market", body="""
SELECT month, sum(total_deposit) AS total_deposit, sum(turnover) AS turnover, sum(total_win) AS total_win,
  sum(platform_net) AS platform_net FROM market GROUP BY 1"""))
def ag125(spark, d):
    return PY.market_trend(S.market(spark, d))


@register("ag126_market_compare", with_ctes("market", body="""
SELECT metric, month_a, month_b, coalesce(month_b, 0.0) - coalesce(month_a, 0.0) AS diff FROM (""" + " UNION ALL ".join(
    f"SELECT '{m}' AS metric, CAST(sum(CASE WHEN month = '2000-05' THEN {m} END) AS DOUBLE) AS month_a, "
    f"CAST(sum(CASE WHEN month = '2000-06' THEN {m} END) AS DOUBLE) AS month_b FROM market WHERE month IN ('2000-05', '2000-06')"
    for m in ("turnover", "total_win", "platform_net")) + ")"))
def ag126a(spark, d):
    return PY.market_compare(S.market(spark, d), "2000-05", "2000-06")


@register("ag126_market_compare_agents", with_ctes("market", body="""
SELECT coalesce(x.agent_account, y.agent_account) AS agent_account, coalesce(month_a, 0.0) AS month_a,
  coalesce(month_b, 0.0) AS month_b, coalesce(month_b, 0.0) - coalesce(month_a, 0.0) AS diff
FROM (SELECT agent_account, CAST(sum(platform_net) AS DOUBLE) AS month_a FROM market WHERE month = '2000-05' GROUP BY 1) x
FULL OUTER JOIN (SELECT agent_account, CAST(sum(platform_net) AS DOUBLE) AS month_b FROM market WHERE month = '2000-06' GROUP BY 1) y
ON x.agent_account = y.agent_account"""))
def ag126b(spark, d):
    return PY.market_compare_agents(S.market(spark, d), "2000-05", "2000-06")
