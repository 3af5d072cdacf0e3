"""Realtime slots (AG-41…45), bonus (AG-46…49), ROI (AG-74…80), agent quality (AG-81…84), commission (AG-50…63)."""

from ...operators import bonus as B
from ...operators import clean as C
from ...operators import commission as CM
from ...operators import realtime as RT
from .. import standins as S
from ..catalog import register
from ..oracle_ctes import with_ctes


def _r(n, d):
    return f"CAST({n} AS DOUBLE) / nullif(CAST({d} AS DOUBLE), 0)"


def _r1(n, d):
    return f"CAST({n} AS DOUBLE) / CASE WHEN CAST({d} AS DOUBLE) = 0 THEN 1 ELSE CAST({d} AS DOUBLE) END"


# ---------------------------------------------------------------- realtime

_P = r"""SELECT CAST(regexp_extract(raw_time, '^(\d{4}-\d{2}-\d{2})', 1) AS DATE) AS day,
  regexp_extract(raw_time, '(\d{1,2}~\d{1,2})', 1) AS slot,
  CAST(regexp_extract(regexp_extract(raw_time, '(\d{1,2}~\d{1,2})', 1), '^(\d{1,2})', 1) AS INTEGER) AS hour,
  type, slot_bettors, stake, turnover, company_win FROM slots"""


@register("ag41_slot_kpis", with_ctes("slots", extra={"p": _P}, body="""
SELECT * FROM (SELECT avg(visits) AS avg_daily_visits, count(*) AS days
               FROM (SELECT day, sum(slot_bettors) AS visits FROM p GROUP BY day)) a,
  (SELECT sum(slot_bettors) AS slot_bettors, sum(stake) AS stake, sum(turnover) AS turnover,
          sum(company_win) AS company_win FROM p) t"""))
def ag41(spark, d):
    return RT.slot_kpis(S.slots(spark, d))


@register("ag42_slot_anomaly", with_ctes("slots", extra={"p": _P}, body=f"""
SELECT slot, latest_value, baseline, deviation_pct,
  CASE WHEN deviation_pct <= -20 THEN 'drop' WHEN deviation_pct >= 20 THEN 'spike' ELSE 'normal' END AS flag,
  coalesce(TRY_CAST(regexp_extract(slot, '^(\\d{{1,2}})', 1) AS INTEGER), 99) AS hour FROM (
  SELECT c.slot, c.v AS latest_value, b.baseline,
    {_r('c.v - b.baseline', 'b.baseline')} * 100.0 AS deviation_pct
  FROM (SELECT slot, v FROM (SELECT day, slot, sum(turnover) AS v FROM p GROUP BY 1, 2) sd,
                             (SELECT max(day) AS latest FROM p) lt WHERE day = latest) c
  JOIN (SELECT slot, avg(CAST(v AS DOUBLE)) AS baseline
        FROM (SELECT day, slot, sum(turnover) AS v FROM p GROUP BY 1, 2) sd, (SELECT max(day) AS latest FROM p) lt
        WHERE day < latest AND day >= latest - 7 GROUP BY slot) b ON c.slot = b.slot)
WHERE deviation_pct IS NOT NULL"""))
def ag42(spark, d):
    return RT.slot_anomaly(S.slots(spark, d))


@register("ag43_visits_moving_avg", with_ctes("slots", extra={"p": _P}, body="""
SELECT day, visits, avg(visits) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS visits_ma
FROM (SELECT day, sum(slot_bettors) AS visits FROM p GROUP BY day)"""))
def ag43(spark, d):
    return RT.daily_visits_ma(S.slots(spark, d), 7)


@register("ag44_slot_daily_long", with_ctes("slots", extra={"p": _P}, body="""
SELECT day, metric, value FROM (SELECT day, CAST(sum(turnover) AS DOUBLE) AS turnover,
  CAST(sum(company_win) AS DOUBLE) AS company_win FROM p GROUP BY day)
UNPIVOT (value FOR metric IN (turnover, company_win))"""))
def ag44(spark, d):
    return RT.slot_daily_long(S.slots(spark, d))


@register("ag45_heat_matrix", with_ctes("slots", extra={"p": _P}, body="SELECT type, " + ", ".join(
    f"coalesce(sum(CASE WHEN slot = '{h}~{h + 1}' THEN turnover END), 0) AS \"{h}~{h + 1}\"" for h in range(24)) +
    " FROM p GROUP BY type"))
def ag45(spark, d):
    return RT.heat_matrix(S.slots(spark, d), RT.hour_slots())


# ---------------------------------------------------------------- bonus

def _bc(spark, d):
    return C.clean_bonus(S.bonus(spark, d))


@register("ag46_bonus_kpis", with_ctes("bonus_clean", body=f"""
SELECT amount, "rows", members, {_r('amount', 'members')} AS per_member FROM (
SELECT coalesce(sum(amount), 0) AS amount, count(*) AS "rows", count(DISTINCT account) AS members FROM bonus_clean)"""))
def ag46(spark, d):
    return B.bonus_kpis(_bc(spark, d))


@register("ag47_bonus_by_activity", with_ctes("bonus_clean", body="""
SELECT activity, sum(amount) AS amount, count(amount) AS grants FROM bonus_clean GROUP BY 1
ORDER BY amount DESC, activity LIMIT 20"""))
def ag47(spark, d):
    return B.bonus_by_activity(_bc(spark, d), 20)


@register("ag48_bonus_by_type", with_ctes("bonus_clean", body="""
SELECT type, sum(amount) AS amount, count(amount) AS grants FROM bonus_clean WHERE type IS NOT NULL GROUP BY 1"""))
def ag48a(spark, d):
    return B.bonus_by(_bc(spark, d), "type")


@register("ag48_bonus_by_day", with_ctes("bonus_clean", body="""
SELECT CAST(applied_at AS DATE) AS day, sum(amount) AS amount, count(amount) AS grants FROM bonus_clean
WHERE applied_at IS NOT NULL GROUP BY 1"""))
def ag48b(spark, d):
    return B.bonus_by(_bc(spark, d), "day")


@register("ag49_top_receivers", with_ctes("bonus_clean", body="""
SELECT account, sum(amount) AS amount, count(amount) AS grants,
  arg_min(vip, (applied_at, order_no)) AS vip FROM bonus_clean GROUP BY 1
ORDER BY amount DESC, account LIMIT 20"""))
def ag49(spark, d):
    return B.top_receivers(_bc(spark, d), 20)


@register("fl07_success_counts", with_ctes("bonus", body="""
SELECT count_if(trim(status) = '成功') AS kept, count_if(trim(status) <> '成功' OR status IS NULL) AS excluded FROM bonus"""))
def fl07(spark, d):
    from ...operators.filters import success_counts
    return success_counts(S.bonus(spark, d))


@register("ag74_roi_kpis", with_ctes("bonus_clean", "agent_daily", body=f"""
SELECT bonus_cost, grants, company_win, company_income, {_r('bonus_cost', 'abs(company_win)')} AS cost_share_of_win FROM
 (SELECT coalesce(sum(amount), 0) AS bonus_cost, count(*) AS grants FROM bonus_clean WHERE trim(status) = '成功') b,
 (SELECT coalesce(sum(company_win), 0) AS company_win, coalesce(sum(company_income), 0) AS company_income FROM agent_daily) a"""))
def ag74(spark, d):
    return B.roi_kpis(B.successful(_bc(spark, d)), S.agent_daily(spark, d))


@register("ag75_cost_vs_income", with_ctes("bonus_clean", "agent_daily", body="""
SELECT coalesce(b.date, a.date) AS date, coalesce(bonus_cost, 0.0) AS bonus_cost, coalesce(company_income, 0.0) AS company_income
FROM (SELECT CAST(applied_at AS DATE) AS date, CAST(sum(amount) AS DOUBLE) AS bonus_cost FROM bonus_clean
      WHERE trim(status) = '成功' GROUP BY 1) b
FULL OUTER JOIN (SELECT date, CAST(sum(company_income) AS DOUBLE) AS company_income FROM agent_daily GROUP BY 1) a
ON b.date = a.date"""))
def ag75(spark, d):
    return B.cost_vs_income(B.successful(_bc(spark, d)), S.agent_daily(spark, d))


@register("ag76_roi_by_type", with_ctes("bonus_clean", body="""
SELECT type, "rows", amount, members, round(amount*100.0 / nullif(sum(amount) OVER (), 0), 2) AS share_pct FROM (
SELECT type, count(*) AS "rows", sum(amount) AS amount, count(DISTINCT account) AS members FROM bonus_clean
WHERE type IS NOT NULL GROUP BY 1)"""))
def ag76(spark, d):
    return B.roi_by_type(_bc(spark, d))


@register("ag77_top_titles", with_ctes("bonus_clean", body=f"""
SELECT title, "rows", amount, mean_amount, members, {_r('amount', 'members')} AS per_member FROM (
SELECT title, count(*) AS "rows", sum(amount) AS amount, avg(CAST(amount AS DOUBLE)) AS mean_amount,
  count(DISTINCT account) AS members FROM bonus_clean WHERE title IS NOT NULL GROUP BY 1)
ORDER BY amount DESC, title LIMIT 30"""))
def ag77(spark, d):
    return B.top_titles(_bc(spark, d), 30)


@register("ag78_high_frequency", with_ctes("bonus_clean", body="""
SELECT account, count(DISTINCT day) AS days, sum(n) AS grants, sum(amt) AS amount, max(n) AS max_grants_day,
  max(amt) AS max_amount_day FROM (
  SELECT account, CAST(applied_at AS DATE) AS day, count(amount) AS n, sum(amount) AS amt FROM bonus_clean GROUP BY 1, 2)
WHERE n >= 2 GROUP BY account ORDER BY amount DESC, account LIMIT 30"""))
def ag78(spark, d):
    return B.high_frequency(_bc(spark, d), min_per_day=2, k=30)


@register("ag79_wagering_matrix", with_ctes("bonus_clean", body="""
SELECT needs_wagering, wager_multiple, count(amount) AS "rows", sum(amount) AS amount,
  avg(CAST(amount AS DOUBLE)) AS mean_amount FROM bonus_clean GROUP BY 1, 2
ORDER BY amount DESC, needs_wagering NULLS FIRST, wager_multiple NULLS FIRST LIMIT 25"""))
def ag79(spark, d):
    return B.wagering_matrix(_bc(spark, d), 25)


@register("ag80_roi_by_vip", with_ctes("bonus_clean", body=f"""
SELECT vip, "rows", amount, members, {_r('amount', 'members')} AS per_member FROM (
SELECT vip, count(*) AS "rows", sum(amount) AS amount, count(DISTINCT account) AS members FROM bonus_clean
WHERE vip IS NOT NULL GROUP BY 1)"""))
def ag80(spark, d):
    return B.roi_by_vip(_bc(spark, d))


# ---------------------------------------------------------------- agent quality

@register("ag81_agent_kpis", with_ctes("agent_daily", body=f"""
SELECT *, {_r('first_depositors', 'registrations')} AS conversion FROM (
SELECT count(DISTINCT agent_no) AS agents, count(DISTINCT CASE WHEN registrations > 0 THEN agent_no END) AS agents_with_signups,
  sum(registrations) AS registrations, sum(first_depositors) AS first_depositors, sum(bonus) AS bonus,
  sum(company_income) AS company_income FROM agent_daily)"""))
def ag81(spark, d):
    return B.agent_kpis(S.agent_daily(spark, d))


@register("ag82_agent_type_report", with_ctes("agent_daily", body="""
SELECT agent_type, count(DISTINCT agent_no) AS agents, sum(registrations) AS registrations, sum(turnover) AS turnover,
  sum(bonus) AS bonus, sum(company_income) AS company_income FROM agent_daily WHERE agent_type IS NOT NULL GROUP BY 1"""))
def ag82(spark, d):
    return B.agent_type_report(S.agent_daily(spark, d))


_AROLL = f"""SELECT *, round(least({_r1('bonus', 'turnover')}, 1.0), 4) AS bonus_dependency,
  registrations > 0 OR turnover > 0 AS active FROM (
SELECT agent_no, agent_name, agent_type, sum(registrations) AS registrations, sum(first_depositors) AS first_depositors,
  sum(turnover) AS turnover, sum(bonus) AS bonus, sum(rebate) AS rebate, sum(company_income) AS company_income
FROM agent_daily GROUP BY 1, 2, 3)"""


@register("ag83_agent_rollup", with_ctes("agent_daily", extra={"ar": _AROLL}, body="SELECT * FROM ar"))
def ag83(spark, d):
    return B.agent_rollup(S.agent_daily(spark, d))


@register("ag84_best_agents", with_ctes("agent_daily", extra={"ar": _AROLL}, body="""
SELECT * FROM ar WHERE active ORDER BY company_income DESC, agent_no LIMIT 20"""))
def ag84a(spark, d):
    return B.best_agents(B.agent_rollup(S.agent_daily(spark, d)), 20)


@register("ag84_worst_agents", with_ctes("agent_daily", extra={"ar": _AROLL}, body="""
SELECT * FROM ar WHERE active ORDER BY company_income ASC, agent_no LIMIT 20"""))
def ag84b(spark, d):
    return B.worst_agents(B.agent_rollup(S.agent_daily(spark, d)), 20)


@register("ag84_bonus_eaters", with_ctes("agent_daily", extra={"ar": _AROLL}, body="""
SELECT * FROM ar WHERE active AND bonus_dependency > 0.004 AND company_income <= 0
ORDER BY bonus DESC, agent_no LIMIT 30"""))
def ag84c(spark, d):
    return B.bonus_eaters(B.agent_rollup(S.agent_daily(spark, d)), dependency=0.004, k=30)


# ---------------------------------------------------------------- commission

_CM = "(SELECT * FROM commission WHERE commission_month = (SELECT max(commission_month) FROM commission))"


@register("ag50_commission_kpis", with_ctes("commission", body=f"""
SELECT count(*) AS agents, count_if(coalesce(net_after_reversal, 0) <> 0) AS active_agents,
  coalesce(sum(net_after_reversal), 0) AS net, count_if(coalesce(carried_balance, 0) < 0) AS deficit_agents,
  coalesce(sum(CASE WHEN coalesce(carried_balance, 0) < 0 THEN carried_balance END), 0) AS deficit_total FROM {_CM}"""))
def ag50(spark, d):
    return CM.commission_kpis(S.commission(spark, d))


@register("ag51_fee_structure", with_ctes("commission", body=f"""
SELECT item, amount FROM (SELECT CAST(base AS DOUBLE) AS base, CAST(base*0.015 AS DOUBLE) AS charged,
  CAST(base*0.016 AS DOUBLE) AS paid, CAST(base*0.001 AS DOUBLE) AS gap, CAST(base*0.001*12 AS DOUBLE) AS gap_annual FROM (
  SELECT coalesce(sum(deposit_fee_base), 0) + coalesce(sum(withdraw_fee_base), 0) AS base FROM {_CM}))
UNPIVOT (amount FOR item IN (base, charged, paid, gap, gap_annual))"""))
def ag51(spark, d):
    return CM.fee_structure(S.commission(spark, d))


@register("ag52_top_net", with_ctes("commission", body=f"""
SELECT agent, net_after_reversal, net_after_reversal / 10000 AS net_wan FROM {_CM} WHERE net_after_reversal > 0
ORDER BY net_after_reversal DESC, agent LIMIT 20"""))
def ag52a(spark, d):
    return CM.top_net(S.commission(spark, d), 20)


@register("ag52_worst_balance", with_ctes("commission", body=f"""
SELECT agent, carried_balance, carried_balance / 10000 AS balance_wan FROM {_CM} WHERE carried_balance < 0
ORDER BY carried_balance, agent LIMIT 20"""))
def ag52b(spark, d):
    return CM.worst_balance(S.commission(spark, d), 20)


@register("ag53_deficit_histogram", with_ctes("commission", body=f"""
SELECT bucket, lo + (bucket - 1) * (hi - lo) / 30 AS bin_lo, lo + bucket * (hi - lo) / 30 AS bin_hi, n FROM (
SELECT CASE WHEN hi = lo THEN 1 ELSE least(CAST(floor((x - lo) / ((hi - lo) / 30)) AS INTEGER) + 1, 30) END AS bucket,
  lo, hi, count(*) AS n
FROM (SELECT CAST(carried_balance AS DOUBLE) / 10000.0 AS x FROM {_CM} WHERE carried_balance < 0) v,
     (SELECT min(CAST(carried_balance AS DOUBLE) / 10000.0) AS lo, max(CAST(carried_balance AS DOUBLE) / 10000.0) AS hi
      FROM {_CM} WHERE carried_balance < 0) m
GROUP BY 1, 2, 3)"""))
def ag53(spark, d):
    return CM.deficit_histogram(S.commission(spark, d), 30)


@register("ag54_deficit_bands", with_ctes("commission", body=f"""
SELECT b.band_order, b.band, coalesce(g.agents, 0) AS agents, coalesce(g.deficit_total, 0) AS deficit_total
FROM (VALUES (0, '< 1w'), (1, '1w-5w'), (2, '5w-10w'), (3, '10w+')) b(band_order, band)
LEFT JOIN (SELECT CASE WHEN carried_balance > -10000 THEN '< 1w' WHEN carried_balance > -50000 THEN '1w-5w'
                       WHEN carried_balance > -100000 THEN '5w-10w' ELSE '10w+' END AS band,
                  count(*) AS agents, CAST(sum(carried_balance) AS DOUBLE) AS deficit_total
           FROM {_CM} WHERE coalesce(carried_balance, 0) < 0 GROUP BY 1) g ON b.band = g.band"""))
def ag54(spark, d):
    return CM.deficit_bands(S.commission(spark, d))


@register("ag55_deficit_list", with_ctes("commission", body=f"""
SELECT agent, parent, agent_type, carried_balance, net_after_reversal FROM {_CM} WHERE carried_balance < 0"""))
def ag55(spark, d):
    return CM.deficit_list(S.commission(spark, d))


@register("ag56_line_stats", with_ctes("commission", body=f"""
SELECT line, count(agent) AS agents, sum(net_after_reversal) AS net,
  coalesce(sum(CASE WHEN carried_balance < 0 THEN carried_balance END), 0) AS deficit FROM {_CM} GROUP BY 1"""))
def ag56(spark, d):
    return CM.line_stats(S.commission(spark, d))


@register("ag57_top_teams", with_ctes("commission", body=f"""
SELECT team_name, count(agent) AS agents, sum(net_after_reversal) AS net,
  coalesce(sum(CASE WHEN carried_balance < 0 THEN carried_balance END), 0) AS deficit FROM {_CM} GROUP BY 1
ORDER BY net DESC, team_name LIMIT 10"""))
def ag57(spark, d):
    return CM.top_teams(S.commission(spark, d), 10)


@register("ag58_activity_bands", with_ctes("commission", body=f"""
SELECT b.band_order, b.band, coalesce(g.agents, 0) AS agents
FROM (VALUES (0, '0'), (1, '1-5'), (2, '6-20'), (3, '21-100'), (4, '100+')) b(band_order, band)
LEFT JOIN (SELECT CASE WHEN coalesce(active, 0) = 0 THEN '0' WHEN coalesce(active, 0) <= 5 THEN '1-5'
                       WHEN coalesce(active, 0) <= 20 THEN '6-20' WHEN coalesce(active, 0) <= 100 THEN '21-100'
                       ELSE '100+' END AS band, count(*) AS agents FROM {_CM} GROUP BY 1) g ON b.band = g.band"""))
def ag58(spark, d):
    return CM.activity_bands(S.commission(spark, d))


@register("ag59_count_by_type", with_ctes("commission", body=f"""
SELECT agent_type, count(*) AS agents FROM {_CM} GROUP BY 1"""))
def ag59a(spark, d):
    return CM.count_by_dim(S.commission(spark, d), "agent_type")


@register("ag59_count_in_team", with_ctes("commission", body=f"""
SELECT in_team, count(*) AS agents FROM {_CM} GROUP BY 1"""))
def ag59b(spark, d):
    return CM.count_by_dim(S.commission(spark, d), "in_team")


@register("ag60_agent_detail", with_ctes("commission", body=f"""
SELECT * FROM {_CM} WHERE agent_type IN ('BUILDING', 'FURNITURE')
  AND (regexp_matches(coalesce(agent, ''), '(?i)00000[0-4]') OR regexp_matches(coalesce(parent, ''), '(?i)^n1$'))"""))
def ag60(spark, d):
    return CM.agent_detail(S.commission(spark, d), types=["BUILDING", "FURNITURE"], pattern="00000[0-4]|^n1$")


@register("ag61_settlement_map", with_ctes("settle_summary", body="""
SELECT month, max(CASE WHEN item = '本月业绩' THEN amount END) AS "本月业绩",
  max(CASE WHEN item = '⭐️ 总计发放 ' THEN amount END) AS "⭐️ 总计发放 ",
  max(CASE WHEN item = '先前挂账' THEN amount END) AS "先前挂账" FROM settle_summary WHERE month = '2026-04' GROUP BY 1"""))
def ag61(spark, d):
    return CM.settlement_map(S.settle_summary(spark, d), "2026-04", ["本月业绩", "⭐️ 总计发放 ", "先前挂账"])


@register("ag62_by_treatment", with_ctes("settle_detail", body="""
SELECT treatment, count(*) AS "rows", sum(commission) AS commission FROM settle_detail
WHERE treatment IS NOT NULL GROUP BY 1"""))
def ag62(spark, d):
    return CM.by_treatment(S.settle_detail(spark, d))


@register("ag63_referral_cost", with_ctes("settle_detail", body="""
SELECT name, agent, total_perf, rate, commission, total_perf * 0.55 AS main_commission,
  total_perf * rate AS referral_commission, total_perf * 0.55 + total_perf * rate AS platform_cost,
  0.55 + rate AS cost_rate FROM settle_detail WHERE contains(treatment, '退成')"""))
def ag63(spark, d):
    return CM.commission_cost(CM.referral_detail(S.settle_detail(spark, d)))
