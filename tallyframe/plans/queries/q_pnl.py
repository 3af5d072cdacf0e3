"""Overview / P&L (AG-10…22), recent trend (AG-23…26), date filters (FL-01/02), bonus cleaning (CL-18/21)."""

from ...operators import clean as C
from ...operators import filters as FL
from ...operators import pnl as P
from .. import standins as S
from ..catalog import register
from ..oracle_ctes import with_ctes

AGENT_ACTS = ("promo-F1", "promo-O2")
PARAMS = P.ProfitParams(channel_fee=12345.5, project_adjust=1000.0, manual_commission=50000.0, agent_refund=2500.0)


def _r(n, d):
    return f"CAST({n} AS DOUBLE) / nullif(CAST({d} AS DOUBLE), 0)"


PROFIT_ROW = f"""
SELECT gross AS gross_income, bonus_used, rebate, group_share, 12345.5::DOUBLE AS channel_fee,
  1000.0::DOUBLE AS project_adjust,
  bonus_used + rebate + group_share + 12345.5::DOUBLE - 1000.0::DOUBLE AS costs, 50000.0::DOUBLE AS commission,
  2500.0::DOUBLE AS refund,
  gross - (bonus_used + rebate + group_share + 12345.5::DOUBLE - 1000.0::DOUBLE) - 50000.0::DOUBLE + 2500.0::DOUBLE AS profit,
  turnover
FROM (SELECT company_win + early_settlement + account_adjustment + tips AS gross, bonus - agent_bonus AS bonus_used,
             rebate, group_share, turnover
      FROM (SELECT CAST(sum(company_win) AS DOUBLE) AS company_win, CAST(sum(early_settlement) AS DOUBLE) AS early_settlement,
                   CAST(sum(account_adjustment) AS DOUBLE) AS account_adjustment, CAST(sum(tips) AS DOUBLE) AS tips,
                   CAST(sum(bonus) AS DOUBLE) AS bonus, CAST(sum(rebate) AS DOUBLE) AS rebate,
                   CAST(sum(group_share) AS DOUBLE) AS group_share, CAST(sum(turnover) AS DOUBLE) AS turnover
            FROM platform) p,
           (SELECT CAST(coalesce(sum(CASE WHEN activity IN ('promo-F1','promo-O2') THEN amount END), 0) AS DOUBLE) AS agent_bonus
            FROM bonus_clean) b)"""


def _profit(spark, d):
    return P.platform_profit(S.platform(spark, d), PARAMS, C.clean_bonus(S.bonus(spark, d)), AGENT_ACTS)


@register("ag10_headline_kpis", with_ctes("platform", "finance", body=f"""
SELECT company_win, turnover, net_flow, registrations, first_depositors, actual_deposits,
  {_r('first_depositors', 'registrations')} AS first_deposit_conversion
FROM (SELECT coalesce(sum(company_win), 0) AS company_win, coalesce(sum(turnover), 0) AS turnover,
             coalesce(sum(net_flow), 0) AS net_flow, coalesce(sum(registrations), 0) AS registrations,
             coalesce(sum(first_depositors), 0) AS first_depositors FROM platform) p,
     (SELECT coalesce(sum(actual_deposits), 0) AS actual_deposits FROM finance) f"""))
def ag10(spark, d):
    return P.headline_kpis(S.platform(spark, d), S.finance(spark, d))


@register("ag11_platform_profit", with_ctes("platform", "bonus_clean", body=f"SELECT * FROM ({PROFIT_ROW})"))
def ag11(spark, d):
    return _profit(spark, d)


@register("ag12_default_commission", with_ctes("settle_summary", body="""
SELECT month, abs(arg_min(amount, item)) AS default_commission FROM settle_summary
WHERE trim(replace(item, '⭐️', '')) = '总计发放' GROUP BY month"""))
def ag12(spark, d):
    return P.default_commission(S.settle_summary(spark, d))


@register("ag13_bonus_split", with_ctes("bonus_clean", body=f"""
SELECT total_bonus, agent_bonus, total_bonus - agent_bonus AS member_bonus, {_r('agent_bonus', 'total_bonus')} AS agent_share
FROM (SELECT coalesce(sum(amount), 0) AS total_bonus,
             coalesce(sum(CASE WHEN activity IN ('promo-F1','promo-O2') THEN amount END), 0) AS agent_bonus FROM bonus_clean)"""))
def ag13(spark, d):
    return P.bonus_split(C.clean_bonus(S.bonus(spark, d)), AGENT_ACTS)


_WF = [("毛收入", "gross_income", 1, "start"), ("红利", "bonus_used", -1, "cost"), ("返水", "rebate", -1, "cost"),
       ("集团分成", "group_share", -1, "cost"), ("渠道费", "channel_fee", -1, "cost"),
       ("项目调整", "project_adjust", 1, "gain"), ("代理佣金", "commission", -1, "cost"), ("代理回帐", "refund", 1, "gain")]


@register("ag14_pnl_waterfall", with_ctes("platform", "bonus_clean", extra={"pr": PROFIT_ROW}, body=
    "SELECT step, label, delta, kind, sum(delta) OVER (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM (" +
    " UNION ALL ".join(f"SELECT {i} AS step, '{lbl}' AS label, CAST({c} AS DOUBLE) * {s} AS delta, '{k}' AS kind FROM pr"
                       for i, (lbl, c, s, k) in enumerate(_WF)) +
    f") UNION ALL SELECT {len(_WF)}, '净盈利', profit, 'total', profit FROM pr"))
def ag14(spark, d):
    return P.pnl_waterfall(_profit(spark, d))


@register("ag15_fx_view", with_ctes("platform", "bonus_clean", extra={"pr": PROFIT_ROW}, body=f"""
SELECT profit, profit * 7.1::DOUBLE AS profit_fx, {_r('profit', 'turnover')} * 100.0 AS hold_pct FROM pr"""))
def ag15(spark, d):
    return P.fx_view(_profit(spark, d), 7.1)


_CAT = """CASE WHEN venue LIKE '%真人%' THEN '真人'
  WHEN venue LIKE '%体育%' OR venue LIKE '%體育%' THEN '体育'
  WHEN venue LIKE '%电竞%' OR venue LIKE '%電競%' THEN '电竞'
  WHEN venue LIKE '%电子%' OR venue LIKE '%電子%' OR venue LIKE '%老虎%' OR upper(venue) LIKE '%PG%' OR upper(venue) LIKE '%PP%' THEN '电子'
  WHEN venue LIKE '%棋牌%' THEN '棋牌'
  WHEN venue LIKE '%捕鱼%' OR venue LIKE '%捕魚%' THEN '捕鱼'
  WHEN venue LIKE '%哈希%' OR upper(venue) LIKE '%HASH%' THEN '哈希'
  WHEN venue LIKE '%彩%' THEN '彩票' ELSE '其他' END"""


@register("ag16_contribution_by_line", with_ctes("venue_daily", body=f"""
SELECT {_CAT} AS category, sum(company_win) AS company_win FROM venue_daily
WHERE strftime(date, '%Y-%m') = '1998-07' GROUP BY 1"""))
def ag16(spark, d):
    return P.contribution_by_line(S.venue_daily(spark, d), "1998-07")


@register("ag17_month_over_month", with_ctes("platform", body=f"""
SELECT month, turnover, company_win,
  CASE WHEN prev_month = strftime(CAST(month || '-01' AS DATE) - INTERVAL 1 MONTH, '%Y-%m')
       THEN {_r('turnover - prev_turnover', 'prev_turnover')} END AS turnover_mom,
  CASE WHEN prev_month = strftime(CAST(month || '-01' AS DATE) - INTERVAL 1 MONTH, '%Y-%m')
       THEN {_r('company_win - prev_win', 'abs(prev_win)')} END AS win_mom
FROM (SELECT month, turnover, company_win, lag(month) OVER (ORDER BY month) AS prev_month,
        lag(turnover) OVER (ORDER BY month) AS prev_turnover, lag(company_win) OVER (ORDER BY month) AS prev_win
      FROM (SELECT strftime(date, '%Y-%m') AS month, sum(turnover) AS turnover, sum(company_win) AS company_win
            FROM platform GROUP BY 1))"""))
def ag17(spark, d):
    return P.month_over_month(S.platform(spark, d))


_COSTS = [("红利", "bonus_used"), ("返水", "rebate"), ("集团分成", "group_share"), ("渠道费", "channel_fee"),
          ("代理佣金", "commission")]


@register("ag18_ranked_costs", with_ctes("platform", "bonus_clean", extra={"pr": PROFIT_ROW}, body=
    "SELECT item, amount, rank, tk / nullif(t, 0) AS top_share FROM (SELECT item, amount, "
    "row_number() OVER (ORDER BY abs(amount) DESC, item) AS rank, sum(abs(amount)) OVER () AS t FROM (" +
    " UNION ALL ".join(f"SELECT '{lbl}' AS item, CAST({c} AS DOUBLE) AS amount FROM pr" for lbl, c in _COSTS) +
    ")) x, (SELECT sum(abs(a)) AS tk FROM (SELECT amount AS a FROM (" +
    " UNION ALL ".join(f"SELECT '{lbl}' AS item, CAST({c} AS DOUBLE) AS amount FROM pr" for lbl, c in _COSTS) +
    ") ORDER BY abs(amount) DESC, item LIMIT 2)) y"))
def ag18(spark, d):
    return P.ranked_costs(_profit(spark, d), 2)


@register("ag19_daily_sum", with_ctes("bets", body="""
SELECT CAST(bet_at AS DATE) AS date, sum(turnover) AS turnover, sum(player_pnl) AS player_pnl FROM bets GROUP BY 1"""))
def ag19(spark, d):
    return P.daily_sum(S.bets(spark, d), "bet_at", ["turnover", "player_pnl"])


@register("ag20_daily_long", with_ctes("finance", body="""
SELECT date, metric, value FROM (
  SELECT CAST(date AS DATE) AS date, CAST(sum(actual_deposits) AS DOUBLE) AS actual_deposits,
         CAST(sum(actual_withdrawals) AS DOUBLE) AS actual_withdrawals, CAST(sum(net_flow) AS DOUBLE) AS net_flow
  FROM finance GROUP BY 1)
UNPIVOT (value FOR metric IN (actual_deposits, actual_withdrawals, net_flow))"""))
def ag20(spark, d):
    return P.daily_long(S.finance(spark, d), "date", ["actual_deposits", "actual_withdrawals", "net_flow"])


_COST_SUMS = """SELECT CAST(coalesce(sum(bonus),0) AS DOUBLE) AS bonus,
  CAST(coalesce(sum(rebate),0) AS DOUBLE) AS rebate, CAST(coalesce(sum(agent_commission),0) AS DOUBLE) AS agent_commission,
  CAST(coalesce(sum(group_share),0) AS DOUBLE) AS group_share, CAST(coalesce(sum(company_win),0) AS DOUBLE) AS company_win
  FROM platform"""


@register("ag21_cost_structure", with_ctes("platform", extra={"s": _COST_SUMS}, body=f"""
SELECT item, amount, total_cost, {_r('total_cost', 'company_win')} AS cost_win_ratio FROM (
  SELECT item, amount, company_win, sum(amount) OVER () AS total_cost FROM (
    SELECT company_win, '红利' AS item, bonus AS amount FROM s UNION ALL
    SELECT company_win, '返水', rebate FROM s UNION ALL
    SELECT company_win, '代理佣金', agent_commission FROM s UNION ALL
    SELECT company_win, '集团分成', group_share FROM s))"""))
def ag21(spark, d):
    return P.cost_structure(S.platform(spark, d))


@register("ag22_daily_detail", with_ctes("platform", body="""
SELECT date, registrations, turnover, company_win, net_income FROM platform ORDER BY date DESC"""))
def ag22(spark, d):
    return P.daily_detail(S.platform(spark, d), ["registrations", "turnover", "company_win", "net_income"])


_OVERVIEW = f"""SELECT days, registrations, first_depositors, turnover, company_win,
  {_r('registrations', 'days')} AS avg_daily_registrations, {_r('first_depositors', 'registrations')} AS conversion,
  {_r('company_win', 'turnover')} AS hold
FROM (SELECT count(DISTINCT date) AS days, sum(registrations) AS registrations, sum(first_depositors) AS first_depositors,
             sum(turnover) AS turnover, sum(company_win) AS company_win FROM {{src}})"""


@register("fl01_last_30_overview", with_ctes("platform", body=_OVERVIEW.format(
    src="platform, (SELECT max(date) AS mx FROM platform) b WHERE date >= mx - 29 AND date < mx + 1")))
def fl01_last30(spark, d):
    p = S.platform(spark, d)
    return P.period_overview(FL.date_preset(p, "date", "last_30"))


@register("ag23_period_overview", with_ctes("platform", body=_OVERVIEW.format(src="platform")))
def ag23(spark, d):
    return P.period_overview(S.platform(spark, d))


@register("fl01_this_month", with_ctes("platform", body="""
SELECT date, turnover FROM platform, (SELECT max(date) AS mx FROM platform) b
WHERE date >= date_trunc('month', mx) AND date < mx + 1"""))
def fl01_this_month(spark, d):
    return FL.date_preset(S.platform(spark, d), "date", "this_month").select("date", "turnover")


@register("fl01_last_month", with_ctes("platform", body="""
SELECT date, turnover FROM platform, (SELECT max(date) AS mx FROM platform) b
WHERE date >= date_trunc('month', mx) - INTERVAL 1 MONTH AND date < date_trunc('month', mx)"""))
def fl01_last_month(spark, d):
    return FL.date_preset(S.platform(spark, d), "date", "last_month").select("date", "turnover")


@register("fl01_last_7", with_ctes("bets", body="""
SELECT count(*) AS bets, sum(turnover) AS turnover FROM bets, (SELECT CAST(max(bet_at) AS DATE) AS mx FROM bets) b
WHERE bet_at >= CAST(mx - 6 AS TIMESTAMP) AND bet_at < CAST(mx + 1 AS TIMESTAMP)"""))
def fl01_last_7(spark, d):
    from pyspark.sql import functions as F
    f = FL.date_preset(S.bets(spark, d), "bet_at", "last_7")
    return f.agg(F.count(F.lit(1)).alias("bets"), F.sum("turnover").alias("turnover"))


@register("fl01_custom_swapped", with_ctes("platform", body="""
SELECT date, turnover FROM platform, (SELECT min(date) AS mn, max(date) AS mx FROM platform) b
WHERE date >= greatest(DATE '1999-06-15', mn) AND date < least(DATE '2005-01-01', mx) + 1"""))
def fl01_custom(spark, d):
    return FL.date_preset(S.platform(spark, d), "date", "custom", "2005-01-01", "1999-06-15").select("date", "turnover")


@register("fl02_align_period", with_ctes("finance", body="""
SELECT date, actual_deposits FROM finance WHERE strftime(date, '%Y-%m') = '1999-03'"""))
def fl02(spark, d):
    return FL.align_period(S.finance(spark, d), "date", month="1999-03").select("date", "actual_deposits")


@register("ag24_daily_ratios", with_ctes("platform", body=f"""
SELECT date, round({_r('first_depositors', 'registrations')} * 100.0, 1) AS conversion_pct,
  round({_r('company_win', 'turnover')} * 100.0, 2) AS hold_pct,
  round({_r('withdrawals', 'deposits')} * 100.0, 1) AS wd_dep_pct FROM platform"""))
def ag24(spark, d):
    return P.daily_ratios(S.platform(spark, d))


@register("ag25_peak_days", with_ctes("platform", body="""
SELECT arg_max(date, (turnover, -epoch(date))) AS max_day, max(turnover) AS max_value,
       arg_min(date, (turnover, epoch(date))) AS min_day, min(turnover) AS min_value FROM platform"""))
def ag25(spark, d):
    return P.peak_days(S.platform(spark, d), "turnover")


@register("ag26_compare_segments", with_ctes("platform", body="""
SELECT metric, a_mean, b_mean, b_mean / nullif(a_mean, 0) - 1.0 AS change FROM (
  SELECT 'turnover' AS metric,
    avg(CASE WHEN date BETWEEN DATE '1998-01-01' AND DATE '1998-01-31' THEN CAST(turnover AS DOUBLE) END) AS a_mean,
    avg(CASE WHEN date BETWEEN DATE '1998-02-01' AND DATE '1998-02-28' THEN CAST(turnover AS DOUBLE) END) AS b_mean FROM platform
  UNION ALL SELECT 'registrations',
    avg(CASE WHEN date BETWEEN DATE '1998-01-01' AND DATE '1998-01-31' THEN CAST(registrations AS DOUBLE) END),
    avg(CASE WHEN date BETWEEN DATE '1998-02-01' AND DATE '1998-02-28' THEN CAST(registrations AS DOUBLE) END) FROM platform
  UNION ALL SELECT 'company_win',
    avg(CASE WHEN date BETWEEN DATE '1998-01-01' AND DATE '1998-01-31' THEN CAST(company_win AS DOUBLE) END),
    avg(CASE WHEN date BETWEEN DATE '1998-02-01' AND DATE '1998-02-28' THEN CAST(company_win AS DOUBLE) END) FROM platform)"""))
def ag26(spark, d):
    return P.compare_segments(S.platform(spark, d), ("1998-01-01", "1998-01-31"), ("1998-02-01", "1998-02-28"),
                              ["turnover", "registrations", "company_win"])


@register("cl21_clean_bonus", with_ctes("bonus_clean", body="""
SELECT order_no, account, vip, type, title, note, status, needs_wagering, wager_multiple, amount, applied_at,
  activity, bonus_month FROM bonus_clean"""))
def cl21(spark, d):
    return C.clean_bonus(S.bonus(spark, d))
