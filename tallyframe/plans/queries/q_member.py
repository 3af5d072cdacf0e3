"""Channel & venue (AG-27…34), member value and retention (AG-35…40), agent x member matrix (AG-85…93)."""

from ...operators import channel as CH
from ...operators import member as M
from .. import standins as S
from ..catalog import register
from ..oracle_ctes import with_ctes


def _r(n, d):
    return f"CAST({n} AS DOUBLE) / nullif(CAST({d} AS DOUBLE), 0)"


def _r1(n, d):
    return f"CAST({n} AS DOUBLE) / CASE WHEN CAST({d} AS DOUBLE) = 0 THEN 1 ELSE CAST({d} AS DOUBLE) END"


# ---------------------------------------------------------------- channels / venues

@register("ag27_channel_kpis", with_ctes("agent_daily", "promo", body="""
SELECT * FROM (SELECT count(DISTINCT agent_no) AS agents, coalesce(sum(turnover), 0) AS turnover,
  coalesce(sum(company_win), 0) AS company_win, coalesce(sum(agent_commission), 0) AS agent_commission FROM agent_daily) a,
 (SELECT coalesce(sum(promo_income), 0) AS promo_income FROM promo) p"""))
def ag27(spark, d):
    return CH.channel_kpis(S.agent_daily(spark, d), S.promo(spark, d))


@register("ag28_top_agents", with_ctes("agent_daily", body="""
SELECT agent_name, sum(turnover) AS turnover FROM agent_daily GROUP BY 1 ORDER BY 2 DESC, 1 NULLS FIRST LIMIT 10"""))
def ag28a(spark, d):
    return CH.top_agents(S.agent_daily(spark, d), 10)


@register("ag28_top_channels", with_ctes("promo", body="""
SELECT l1, sum(turnover) AS turnover FROM promo GROUP BY 1 ORDER BY 2 DESC, 1 NULLS FIRST LIMIT 10"""))
def ag28b(spark, d):
    return CH.top_channels(S.promo(spark, d), 10)


@register("ag29_agent_scatter", with_ctes("agent_daily", body="""
SELECT agent_name, sum(turnover) AS turnover, sum(company_win) AS company_win FROM agent_daily GROUP BY 1"""))
def ag29(spark, d):
    return CH.agent_scatter(S.agent_daily(spark, d))


@register("ag30_channel_hierarchy", with_ctes("promo", body="""
SELECT l1, l2, l3, l4, sum(turnover) AS turnover,
  4 - (grouping(l1) + grouping(l2) + grouping(l3) + grouping(l4)) AS depth
FROM (SELECT coalesce(l1, '空值') AS l1, coalesce(l2, '空值') AS l2, coalesce(l3, '空值') AS l3,
             coalesce(l4, '空值') AS l4, turnover FROM promo)
GROUP BY ROLLUP (l1, l2, l3, l4)"""))
def ag30(spark, d):
    return CH.channel_hierarchy(S.promo(spark, d))


@register("ag31_venue_kpis", with_ctes("venue_daily", body="""
SELECT *, sites <= 1 AS single_site FROM (SELECT coalesce(sum(turnover), 0) AS turnover,
  coalesce(sum(company_win), 0) AS company_win, coalesce(sum(bettors), 0) AS bettors,
  count(DISTINCT venue) AS venues, count(DISTINCT site) AS sites FROM venue_daily)"""))
def ag31(spark, d):
    return CH.venue_kpis(S.venue_daily(spark, d))


@register("ag32_top_venues", with_ctes("venue_daily", body="""
SELECT venue, sum(turnover) AS turnover FROM venue_daily GROUP BY 1 ORDER BY 2 DESC, 1 NULLS FIRST LIMIT 15"""))
def ag32(spark, d):
    return CH.top_venues(S.venue_daily(spark, d), 15)


@register("ag33_game_hierarchy", with_ctes("game_daily", body="""
SELECT type, venue, sum(turnover) AS turnover, 2 - (grouping(type) + grouping(venue)) AS depth
FROM (SELECT coalesce(type, '空值') AS type, coalesce(venue, '空值') AS venue, turnover FROM game_daily)
GROUP BY ROLLUP (type, venue)"""))
def ag33(spark, d):
    return CH.game_hierarchy(S.game_daily(spark, d))


@register("ag34_game_detail", with_ctes("game_daily", body="""
SELECT date, type, venue, game, bettors, turnover, company_win FROM game_daily"""))
def ag34(spark, d):
    return CH.game_detail(S.game_daily(spark, d))


# ---------------------------------------------------------------- member value / retention

@register("ag35_member_kpis", with_ctes("member", body=f"""
SELECT members, first_depositors, turnover, company_income, {_r('company_income', 'members')} AS arpu FROM (
SELECT count(DISTINCT (account, agent)) AS members,
  count(DISTINCT CASE WHEN first_deposit > 0 THEN (account, agent) END) AS first_depositors,
  coalesce(sum(turnover), 0) AS turnover, coalesce(sum(company_income), 0) AS company_income FROM member)"""))
def ag35(spark, d):
    return M.member_kpis(S.member(spark, d))


_TOP = "SELECT snapshot_month, account AS \"user\", sum(turnover) AS turnover FROM member GROUP BY 1, 2"


@register("ag36_top20_share", with_ctes("member", extra={"top": _TOP}, body=f"""
SELECT top_sum, total, {_r('top_sum', 'total')} AS top_share FROM
 (SELECT sum(turnover) AS top_sum FROM (SELECT turnover FROM top WHERE snapshot_month = '1998-07'
   ORDER BY turnover DESC, "user" LIMIT 20)) a,
 (SELECT sum(turnover) AS total FROM top WHERE snapshot_month = '1998-07') b"""))
def ag36(spark, d):
    return M.top_n_share(M.top_report(S.member(spark, d)), "turnover", 20, "1998-07")


@register("ag37_member_distribution", with_ctes("member", body="""
SELECT coalesce(source, '空值') AS source, count(DISTINCT (account, agent)) AS members FROM member GROUP BY 1"""))
def ag37(spark, d):
    return M.member_distribution(S.member(spark, d), "source")


@register("ag38_arpu_by_vip", with_ctes("member", body=f"""
SELECT vip, company_income, members, {_r('company_income', 'members')} AS arpu FROM (
SELECT coalesce(vip, '空值') AS vip, sum(company_income) AS company_income, count(DISTINCT (account, agent)) AS members
FROM member GROUP BY 1)"""))
def ag38(spark, d):
    return M.arpu_by(S.member(spark, d), "vip")


_FLAGS = """SELECT account, agent, snapshot_month,
  bool_or(coalesce(deposits, 0) > 0 OR coalesce(turnover, 0) > 0) AS active,
  bool_or(coalesce(deposits, 0) > 0) AS deposit,
  bool_or(strftime(first_deposit_at, '%Y-%m') = snapshot_month) AS "first"
FROM member GROUP BY 1, 2, 3"""


def _retention_sql(months_sql):
    return f"""
SELECT month, next_month, {_r('active_kept', 'active_members')} AS active_retention,
  {_r('deposit_kept', 'deposit_members')} AS deposit_retention, {_r('first_kept', 'first_members')} AS first_retention,
  active_members, deposit_members, first_members FROM (
SELECT c.snapshot_month AS month, m.next_month,
  count_if(c.active) AS active_members, count_if(c.active AND coalesce(n.active, false)) AS active_kept,
  count_if(c.deposit) AS deposit_members, count_if(c.deposit AND coalesce(n.deposit, false)) AS deposit_kept,
  count_if(c."first") AS first_members, count_if(c."first" AND coalesce(n.active, false)) AS first_kept
FROM flags c JOIN ({months_sql}) m ON c.snapshot_month = m.snapshot_month
LEFT JOIN flags n ON c.account = n.account AND c.agent IS NOT DISTINCT FROM n.agent AND n.snapshot_month = m.next_month
GROUP BY 1, 2)"""


@register("ag39_monthly_retention", with_ctes("member", extra={"flags": _FLAGS}, body=_retention_sql(
    "SELECT * FROM (SELECT snapshot_month, lead(snapshot_month) OVER (ORDER BY snapshot_month) AS next_month "
    "FROM (SELECT DISTINCT snapshot_month FROM flags WHERE snapshot_month IS NOT NULL)) WHERE next_month IS NOT NULL")))
def ag39(spark, d):
    return M.monthly_retention(S.member(spark, d))


@register("ag39_retention_calendar", with_ctes("member", extra={"flags": _FLAGS}, body=_retention_sql(
    "SELECT snapshot_month, next_month FROM (SELECT snapshot_month, "
    "strftime(CAST(snapshot_month || '-01' AS DATE) + INTERVAL 1 MONTH, '%Y-%m') AS next_month "
    "FROM (SELECT DISTINCT snapshot_month FROM flags WHERE snapshot_month IS NOT NULL)) "
    "WHERE next_month IN (SELECT snapshot_month FROM flags)")))
def ag39c(spark, d):
    return M.monthly_retention(S.member(spark, d), calendar=True)


@register("ag40_register_month_check", with_ctes("member", body="""
SELECT strftime(registered_at, '%Y-%m') AS register_month, count(DISTINCT (account, agent)) AS members,
  sum(turnover) AS turnover, sum(company_income) AS company_income FROM member GROUP BY 1"""))
def ag40(spark, d):
    return M.register_month_check(S.member(spark, d))


# ---------------------------------------------------------------- agent x member matrix

MONTHS_1998 = [f"1998-{m:02d}" for m in range(1, 13)]
_IN = ", ".join(f"'{m}'" for m in MONTHS_1998)
_ROLLUP = f"""SELECT account, coalesce(nullif(trim(agent), ''), '(直客)') AS agent, max(vip) AS vip, sum(deposits) AS deposits, sum(withdrawals) AS withdrawals,
  sum(turnover) AS turnover, sum(company_win) AS company_win, sum(bonus) AS bonus, sum(rebate) AS rebate,
  sum(company_income) AS company_income, arg_max(status, snapshot_month) AS status, arg_max(tags, snapshot_month) AS tags,
  count(DISTINCT snapshot_month) AS months
FROM member WHERE snapshot_month IN ({_IN}) GROUP BY 1, 2"""
_TAGS = "['套利', '高风险', '多平台', '跨平台对打', '骗分', '专业玩家', '软件投注']"
_FLAGGED = f"""SELECT *, round({_r1('bonus + rebate', 'turnover')} * 100.0, 2) AS give_pct,
  round({_r1('company_win', 'turnover')} * 100.0, 3) AS hold_pct,
  (CAST(turnover AS DOUBLE) > 1000000.0 AND {_r1('abs(CAST(company_win AS DOUBLE))', 'turnover')} < 0.005
   AND CAST(bonus + rebate AS DOUBLE) > 10000.0) AS arbitrage,
  array_to_string(list_filter({_TAGS}, lambda k: contains(coalesce(tags, ''), k)), ',') AS tag_hits
FROM rollup"""
_MX = {"rollup": _ROLLUP, "flagged": _FLAGGED}


def _flagged(spark, d):
    return M.arbitrage_flag(M.member_ratios(M.member_rollup(S.member(spark, d), MONTHS_1998)))


@register("ag85_member_rollup", with_ctes("member", extra=_MX, body="SELECT * FROM rollup"))
def ag85(spark, d):
    return M.member_rollup(S.member(spark, d), MONTHS_1998)


@register("ag87_arbitrage_flags", with_ctes("member", extra=_MX, body="SELECT * FROM flagged"))
def ag87(spark, d):
    return _flagged(spark, d)


@register("ag89_agent_overview", with_ctes("member", extra=_MX, body=f"""
SELECT *, round({_r1('bonus + rebate', 'turnover')} * 100.0, 2) AS give_pct,
  round({_r1('company_win', 'turnover')} * 100.0, 3) AS hold_pct FROM (
SELECT agent, count(*) AS members, sum(turnover) AS turnover,
  sum(company_win) AS company_win, sum(bonus) AS bonus, sum(rebate) AS rebate, sum(company_income) AS company_income,
  count_if(arbitrage OR tag_hits <> '') AS flagged FROM flagged GROUP BY 1)"""))
def ag89(spark, d):
    return M.agent_overview(_flagged(spark, d))


@register("ag90_flagged_members", with_ctes("member", extra=_MX, body="""
SELECT * FROM flagged WHERE arbitrage OR tag_hits <> ''"""))
def ag90(spark, d):
    return M.flagged_members(_flagged(spark, d))


@register("ag91_member_history", with_ctes("member", body="""
SELECT snapshot_month, sum(deposits) AS deposits, sum(turnover) AS turnover, sum(company_win) AS company_win,
  sum(company_income) AS company_income FROM member WHERE account = '100' GROUP BY 1"""))
def ag91a(spark, d):
    return M.member_history(S.member(spark, d), "100")


@register("ag91_agent_monthly", with_ctes("agent_daily", body="""
SELECT substr(CAST(date AS VARCHAR), 1, 7) AS month, sum(registrations) AS registrations, sum(turnover) AS turnover,
  sum(company_win) AS company_win, sum(company_income) AS company_income FROM agent_daily
WHERE lower(agent_name) = '7' OR lower(CAST(agent_no AS VARCHAR)) = '7' GROUP BY 1"""))
def ag91b(spark, d):
    return M.agent_monthly(S.agent_daily(spark, d), "7")


@register("ag92_agent_members", with_ctes("member", extra=_MX, body="SELECT * FROM flagged WHERE agent = 'ag3'"))
def ag92a(spark, d):
    return M.agent_members(_flagged(spark, d), "ag3")


@register("ag92_direct_members", with_ctes("member", extra=_MX, body="SELECT * FROM flagged WHERE agent IS NULL"))
def ag92b(spark, d):
    return M.agent_members(_flagged(spark, d), None)


@register("ag92_all_members", with_ctes("member", extra=_MX, body="""
SELECT * FROM flagged WHERE vip IN ('1', '2', '10') AND trim(status) = '启用'
  AND (regexp_matches(coalesce(account, ''), '(?i)^1[0-9]') OR regexp_matches(coalesce(agent, ''), '(?i)^1[0-9]'))"""))
def ag92c(spark, d):
    return M.all_members(_flagged(spark, d), vips=["1", "2", "10"], status="启用", pattern="^1[0-9]")


_TAGGED = """SELECT * FROM flagged WHERE tag_hits <> '' AND status = '启用'
ORDER BY turnover DESC, account, agent NULLS FIRST LIMIT 100"""


@register("ag93_tagged_enabled", with_ctes("member", extra=dict(_MX, tagged=_TAGGED), body="SELECT * FROM tagged"))
def ag93a(spark, d):
    return M.tagged_enabled(_flagged(spark, d), 100)


@register("ag93_action_list", with_ctes("member", extra=dict(_MX, tagged=_TAGGED), body="""
SELECT * FROM tagged WHERE company_income < 0 ORDER BY company_income, account, agent NULLS FIRST LIMIT 50"""))
def ag93b(spark, d):
    return M.action_list(M.tagged_enabled(_flagged(spark, d), 100), 50)
