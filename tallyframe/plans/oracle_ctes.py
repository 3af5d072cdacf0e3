"""DuckDB CTEs that rebuild the stand-in domain frames of ``standins.py`` from the test views.

``with_ctes('bets', 'member', body=...)`` returns ``WITH bets AS (...), member AS (...) <body>``;
dependencies between CTEs are resolved in declaration order.
"""

from __future__ import annotations

LINE_MONEY = """
  sum(l_extendedprice*(1+l_tax)) AS deposits,
  sum(l_extendedprice*(1-l_discount)) AS withdrawals,
  sum(l_extendedprice) AS turnover,
  sum(l_extendedprice*(l_tax-l_discount)) AS company_win,
  sum(l_extendedprice*l_discount*0.1) AS bonus,
  sum(l_quantity*2.0) AS rebate,
  sum(l_extendedprice*0.01) AS agent_commission"""

BASE = {
    "li": "SELECT * REPLACE (CAST(l_extendedprice AS DECIMAL(15,2)) AS l_extendedprice, CAST(l_discount AS DECIMAL(4,2)) AS l_discount, CAST(l_tax AS DECIMAL(4,2)) AS l_tax, CAST(l_quantity AS DECIMAL(12,2)) AS l_quantity) FROM lineitem",
    "ord": "SELECT * REPLACE (CAST(o_totalprice AS DECIMAL(15,2)) AS o_totalprice) FROM orders",
    "cust": "SELECT * REPLACE (CAST(c_acctbal AS DECIMAL(15,2)) AS c_acctbal) FROM customer",
    "supp": "SELECT * REPLACE (CAST(s_acctbal AS DECIMAL(15,2)) AS s_acctbal) FROM supplier",
    "ev": "SELECT * REPLACE (CAST(value AS DECIMAL(15,2)) AS value) FROM events",
}

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "bets": ((), """
SELECT CAST(o_custkey AS VARCHAR) AS account, CAST(c_nationkey AS VARCHAR) AS vip, p_brand AS venue, p_type AS type,
       l_shipdate AS bet_at, l_extendedprice*(1+l_tax) AS stake, l_extendedprice AS turnover,
       l_extendedprice*(l_discount-l_tax) AS player_pnl, strftime(l_shipdate, '%Y-%m') AS bet_month
FROM li JOIN ord ON l_orderkey = o_orderkey JOIN cust ON o_custkey = c_custkey
JOIN part ON l_partkey = p_partkey"""),

    "platform": ((), f"""
SELECT *, deposits - withdrawals AS net_flow, company_win - bonus - rebate AS net_income FROM (
SELECT CAST(l_shipdate AS DATE) AS date,
  count_if(l_linenumber = 1) AS registrations,
  count_if(l_linenumber = 1 AND l_returnflag = 'R') AS first_depositors,
  count(*) AS bettors, {LINE_MONEY},
  sum(l_extendedprice*0.005) AS group_share,
  sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice*0.001 ELSE 0.0 END) AS early_settlement,
  sum(CASE WHEN l_linestatus = 'O' THEN -l_tax*100.0 ELSE 0.0 END) AS account_adjustment,
  sum(l_quantity*0.1) AS tips
FROM li GROUP BY 1)"""),

    "finance": ((), """
SELECT *, actual_deposits - actual_withdrawals AS net_flow FROM (
SELECT CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) AS actual_deposits,
  sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice*0.9 ELSE 0.0 END) AS actual_withdrawals,
  sum(o_totalprice*0.002) AS bonus, sum(o_totalprice*0.001) AS rebate,
  sum(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice*0.01 ELSE 0.0 END) AS agent_commission
FROM ord GROUP BY 1)"""),

    "member": ((), """
SELECT account, agent, snapshot_month,
  min(m_first) OVER (PARTITION BY account) AS registered_at,
  min(m_first_f) OVER (PARTITION BY account) + to_hours(CAST(c_custkey % 50 - 5 AS BIGINT)) AS first_deposit_at,
  CASE WHEN min(m_first_f) OVER (PARTITION BY account) IS NOT NULL THEN CAST(c_custkey % 90 AS DOUBLE)*10.0 END AS first_deposit,
  CASE WHEN min(m_first_f) OVER (PARTITION BY account) IS NOT NULL THEN CAST(c_custkey % 70 AS DOUBLE)*5.0 END AS first_bet,
  deposits, withdrawals, turnover, company_win, bonus, rebate, company_win - bonus - rebate AS company_income,
  CAST(c_nationkey AS VARCHAR) AS vip,
  CASE WHEN c_acctbal < 0 THEN '禁用' ELSE '启用' END AS status,
  CASE WHEN c_custkey % 50 = 0 THEN '代理' ELSE '非代理' END AS is_agent,
  CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN NULL WHEN c_mktsegment IN ('AUTOMOBILE','MACHINERY') THEN '直客'
       WHEN c_mktsegment = 'BUILDING' THEN '普代下线' ELSE '官代下线' END AS source,
  c_mktsegment AS register_channel,
  CASE WHEN c_custkey % 9 = 0 THEN NULL
       WHEN c_custkey % 9 = 1 THEN 'null?i_code=' || CAST(c_custkey % 37 AS VARCHAR)
       WHEN c_custkey % 9 = 2 THEN ''
       WHEN c_custkey % 9 = 3 THEN 'http://m' || CAST(c_nationkey AS VARCHAR) || '.example.net:8080/x?r%20code-' || CAST(c_custkey % 41 AS VARCHAR)
       ELSE 'https://s' || CAST(c_custkey % 13 AS VARCHAR) || '.example.com/reg?i_code=' || CAST(c_custkey % 37 AS VARCHAR) END AS register_url,
  CASE WHEN c_acctbal < 0 THEN '高风险,套利' WHEN c_custkey % 11 = 0 THEN '多平台'
       WHEN c_custkey % 13 = 0 THEN '专业玩家 软件投注' END AS tags,
  orders_n
FROM (
  SELECT CAST(o_custkey AS VARCHAR) AS account,
         CASE WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderkey % 2 = 0 THEN NULL WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '' ELSE 'ag' || CAST(c_nationkey AS VARCHAR) END AS agent,
         strftime(o_orderdate, '%Y-%m') AS snapshot_month, c_custkey, c_nationkey, c_mktsegment, c_acctbal,
         count(*) AS orders_n, min(o_orderdate) AS m_first,
         min(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END) AS m_first_f,
         sum(o_totalprice) AS deposits,
         sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice*0.8 ELSE 0.0 END) AS withdrawals,
         sum(o_totalprice*1.5) AS turnover,
         sum(CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN o_totalprice*0.02 ELSE -o_totalprice*0.01 END) AS company_win,
         sum(o_totalprice*0.003) AS bonus, sum(o_totalprice*0.002) AS rebate
  FROM ord JOIN cust ON o_custkey = c_custkey
  GROUP BY 1, 2, 3, 4, 5, 6, 7) g"""),

    "agent_daily": ((), f"""
SELECT *, company_win - bonus - rebate AS company_income FROM (
SELECT CAST(l_shipdate AS DATE) AS date, CAST(s_suppkey AS VARCHAR) AS agent_no, s_name AS agent_name,
  CASE WHEN s_nationkey % 3 = 0 THEN '官代' WHEN s_nationkey % 3 = 1 THEN '普代' END AS agent_type,
  count_if(l_linenumber = 1) AS registrations,
  count_if(l_linenumber = 1 AND l_returnflag = 'R') AS first_depositors,
  count(*) AS bettors, {LINE_MONEY},
  sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice*0.001 ELSE 0.0 END) AS early_settlement,
  sum(l_extendedprice*0.002) AS venue_fee
FROM li JOIN supp ON l_suppkey = s_suppkey GROUP BY 1, 2, 3, 4)"""),

    "promo": ((), """
SELECT CAST(o_orderdate AS DATE) AS date, r_name AS l1, n_name AS l2, c_mktsegment AS l3,
  nullif(o_orderpriority, '4-NOT SPECIFIED') AS l4, o_totalprice AS turnover, o_totalprice*0.01 AS promo_income,
  CAST(o_custkey % 3 AS BIGINT) AS unit_agents
FROM ord JOIN cust ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey"""),

    "venue_daily": ((), """
SELECT CAST(l_shipdate AS DATE) AS date, 'S1' AS site,
  CASE p_type WHEN 'STANDARD' THEN 'AG真人' WHEN 'ECONOMY' THEN '沙巴体育' WHEN 'PROMO' THEN 'PG'
              WHEN 'LARGE' THEN '开元棋牌' WHEN 'SMALL' THEN 'hash' WHEN 'MEDIUM' THEN 'VR彩' ELSE 'X' END || '-' || p_brand AS venue,
  count(*) AS bettors, sum(l_extendedprice) AS turnover, sum(l_extendedprice*(l_tax-l_discount)) AS company_win
FROM li JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3"""),

    "game_daily": ((), """
SELECT CAST(l_shipdate AS DATE) AS date, p_type AS type, p_brand AS venue, 'G' || CAST(p_size % 10 AS VARCHAR) AS game,
  count(*) AS bettors, sum(l_extendedprice) AS turnover, sum(l_extendedprice*(l_tax-l_discount)) AS company_win
FROM li JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3, 4"""),

    "slots": ((), """
SELECT strftime(day, '%Y-%m-%d') || ' ' || CAST(h AS VARCHAR) || '~' || CAST(h + 1 AS VARCHAR) AS raw_time,
  type, slot_bettors, stake, turnover, company_win FROM (
  SELECT CAST(ts AS DATE) AS day, hour(ts) AS h, event_type AS type, count(DISTINCT user_id) AS slot_bettors,
    sum(value) AS stake, sum(value*0.9) AS turnover,
    sum(CASE WHEN event_type = 'error' THEN -value ELSE value*0.05 END) AS company_win
  FROM ev GROUP BY 1, 2, 3)"""),

    "bonus": ((), """
SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS order_no,
  CAST(l_suppkey AS VARCHAR) AS account,
  CASE WHEN l_linenumber = 1 THEN NULL ELSE CAST(l_suppkey % 10 AS VARCHAR) END AS vip,
  CASE WHEN l_returnflag = 'R' THEN '充值红利' WHEN l_returnflag = 'A' THEN '活动彩金' ELSE '返水补发' END AS type,
  CASE WHEN l_returnflag = 'R' THEN NULL ELSE 'promo-' || l_linestatus || CAST(l_linenumber AS VARCHAR) END AS title,
  CASE WHEN l_returnflag = 'R' AND l_linenumber % 2 = 0 THEN NULL ELSE 'note' || CAST(l_linenumber AS VARCHAR) END AS note,
  CASE WHEN l_discount >= 0.05 THEN '成功' WHEN l_discount > 0.01 THEN ' 成功 ' ELSE '失败' END AS status,
  CASE WHEN l_tax >= 0.04 THEN '是' ELSE '否' END AS needs_wagering,
  CAST(CAST(l_quantity AS BIGINT) % 5 AS DOUBLE) AS wager_multiple,
  l_extendedprice*l_discount AS amount, l_shipdate AS applied_at
FROM li"""),

    "bonus_clean": (("bonus",), """
SELECT * EXCLUDE (rn) FROM (
  SELECT c.*, coalesce(c.title, c.note, '未知') AS activity, strftime(c.applied_at, '%Y-%m') AS bonus_month,
    row_number() OVER (PARTITION BY c.order_no ORDER BY c.applied_at NULLS FIRST, c.account NULLS FIRST,
      c.amount NULLS FIRST, c.wager_multiple NULLS FIRST, c.status NULLS FIRST, c.needs_wagering NULLS FIRST,
      c.vip NULLS FIRST, c.type NULLS FIRST, c.title NULLS FIRST, c.note NULLS FIRST) AS rn
  FROM (SELECT order_no, account, vip, type,
          CASE WHEN trim(title) IN ('', 'nan', 'None') THEN NULL ELSE trim(title) END AS title,
          CASE WHEN trim(note) IN ('', 'nan', 'None') THEN NULL ELSE trim(note) END AS note,
          CASE WHEN trim(status) IN ('', 'nan', 'None') THEN NULL ELSE trim(status) END AS status,
          needs_wagering, wager_multiple, amount, applied_at FROM bonus) c)
WHERE rn = 1"""),

    "order_ship": ((), """
SELECT l_orderkey, min(l_shipdate) AS ship_min, max(l_shipdate) AS ship_max FROM li GROUP BY 1"""),

    "deposits": (("order_ship",), """
SELECT CAST(o_orderkey AS VARCHAR) AS order_no, CAST(o_custkey AS VARCHAR) AS account, o_orderpriority AS channel,
  CASE o_orderstatus WHEN 'F' THEN '存款成功' WHEN 'O' THEN '已取消' ELSE '处理中' END AS status,
  CASE WHEN o_orderstatus = 'O' THEN CASE o_custkey % 4 WHEN 0 THEN '超时' WHEN 1 THEN 'nan' WHEN 2 THEN '' ELSE '用户取消' END
    WHEN o_custkey % 4 = 3 THEN '通道维护' END AS cancel_reason,
  o_totalprice AS amount, o_orderdate AS ordered_at,
  CASE WHEN o_orderstatus = 'F' THEN ship_min END AS completed_at
FROM ord LEFT JOIN order_ship ON o_orderkey = l_orderkey"""),

    "withdrawals": (("order_ship",), """
SELECT CAST(o_orderkey AS VARCHAR) AS order_no, CAST(o_custkey AS VARCHAR) AS account, o_orderpriority AS channel,
  CASE o_orderstatus WHEN 'F' THEN '提款成功' WHEN 'O' THEN '审核拒绝' ELSE '提款失败' END AS status,
  o_totalprice AS amount, o_orderdate AS applied_at,
  CASE WHEN o_orderstatus = 'F' THEN ship_max END AS completed_at
FROM ord LEFT JOIN order_ship ON o_orderkey = l_orderkey"""),

    "commission": ((), """
SELECT '2026-0' || CAST(c_custkey % 3 + 1 AS VARCHAR) AS commission_month, c_name AS agent,
  'n' || CAST(c_nationkey AS VARCHAR) AS parent, c_mktsegment AS agent_type,
  CASE WHEN n_regionkey % 2 = 0 THEN '主线' ELSE '副线' END AS line, n_name AS team_name,
  c_custkey % 4 <> 0 AS in_team, CAST(c_custkey % 130 AS BIGINT) AS active, CAST(c_custkey % 17 AS BIGINT) AS team_size,
  c_acctbal - 2000.0 AS net_after_reversal, c_acctbal*30.0 AS carried_balance,
  abs(c_acctbal)*10.0 AS deposit_fee_base, abs(c_acctbal)*5.0 AS withdraw_fee_base,
  greatest(c_acctbal, 0.0)*0.1 AS commission
FROM cust JOIN nation ON c_nationkey = n_nationkey"""),

    "settle_detail": ((), """
SELECT '2026-0' || CAST(s_suppkey % 2 + 3 AS VARCHAR) AS month,
  CASE WHEN s_suppkey % 3 = 0 THEN '已回款' ELSE '未回款' END AS status, s_name AS name,
  'n' || CAST(s_nationkey AS VARCHAR) AS agent,
  CASE s_suppkey % 4 WHEN 0 THEN '退成5%' WHEN 1 THEN '退成3%' WHEN 2 THEN '引荐分成1%' ELSE '标准' END AS treatment,
  s_acctbal*10.0 AS prior_perf, s_acctbal*20.0 + 1000.0 AS month_perf,
  s_acctbal*10.0 + (s_acctbal*20.0 + 1000.0) AS total_perf,
  CASE s_suppkey % 4 WHEN 0 THEN 0.05 WHEN 1 THEN 0.03 WHEN 2 THEN 0.01 ELSE 0.55 END::DOUBLE AS rate,
  (s_acctbal*10.0 + (s_acctbal*20.0 + 1000.0)) * (CASE s_suppkey % 4 WHEN 0 THEN 0.05 WHEN 1 THEN 0.03 WHEN 2 THEN 0.01 ELSE 0.55 END::DOUBLE) AS commission
FROM supp"""),

    "settle_summary": (("settle_detail",), """
SELECT month, '本月业绩' AS item, sum(month_perf) AS amount FROM settle_detail GROUP BY 1
UNION ALL SELECT month, '⭐️ 总计发放 ', -sum(commission) FROM settle_detail GROUP BY 1
UNION ALL SELECT month, '先前挂账', sum(prior_perf) FROM settle_detail GROUP BY 1"""),

    "winback": ((), """
SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority AS caller, count(*) AS listed,
  count_if(o_orderstatus <> 'P') AS dialled, count_if(o_orderstatus = 'F') AS connected,
  count_if(o_orderstatus = 'F' AND o_totalprice > 150000) AS valid,
  count_if(o_totalprice > 300000) AS bonus_requests, count_if(o_orderstatus = 'O') AS relogins,
  sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice*0.01 ELSE 0.0 END) AS recharge
FROM ord GROUP BY 1, 2"""),

    "market": ((), """
SELECT *, total_win - bonus - rebate - commission_paid AS platform_net FROM (
SELECT strftime(l_shipdate, '%Y-%m') AS month, s_name AS agent_name, CAST(s_suppkey AS VARCHAR) AS agent_account,
  count_if(l_linenumber = 1) AS registrations,
  count_if(l_linenumber = 1 AND l_returnflag = 'R') AS first_depositors, count(*) AS active,
  sum(l_extendedprice*(1+l_tax)) AS total_deposit, sum(l_extendedprice*(1-l_discount)) AS total_withdraw,
  sum(l_extendedprice) AS turnover, sum(l_extendedprice*(l_tax-l_discount)) AS total_win,
  sum(l_extendedprice*l_discount*0.1) AS bonus, sum(l_quantity*2.0) AS rebate, sum(l_extendedprice*0.01) AS commission_paid
FROM li JOIN supp ON l_suppkey = s_suppkey GROUP BY 1, 2, 3)"""),

    "cs": ((), """
SELECT CAST(g.conv_id AS VARCHAR) AS conversation_id, CAST((g.conv_id * 7) % 1500 AS VARCHAR) AS account,
  'staff' || CAST(g.conv_id % 7 AS VARCHAR) AS staff,
  CASE WHEN lb.doc_id IS NULL THEN '未评价' WHEN lb.toxic = 1 AND lb.quality = 0 THEN '非常不满意'
       WHEN lb.toxic = 1 THEN '不满意' WHEN lb.quality = 0 THEN '一般'
       WHEN g.conv_id % 2 = 0 THEN '非常满意' ELSE '满意' END AS rating,
  CASE WHEN g.conv_id % 4 = 0 THEN '提款太慢,客服态度差' WHEN g.conv_id % 4 = 1 THEN 'nan' END AS review,
  CASE WHEN g.conv_id % 5 = 0 THEN '提款相关' END AS topic,
  '对话开始>>' || body AS content,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(g.conv_id * 37 AS BIGINT)) AS started_at,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(g.conv_id * 37 AS BIGINT)) + to_seconds(CAST(n_turns * 90 AS BIGINT)) AS ended_at,
  CAST(first_len AS DOUBLE)/10.0 AS first_response_s, avg_len/10.0 AS avg_response_s,
  n_turns*90.0 AS duration_s, CAST(n_turns AS DOUBLE) AS turns
FROM (
  SELECT conv_id,
    string_agg(chr(10) || CASE WHEN role = 'user' THEN 'm' || CAST(conv_id AS VARCHAR)
                              WHEN role = 'assistant' THEN 'staff' || CAST(conv_id % 7 AS VARCHAR) ELSE '系统' END
               || '>2024-01-01 00:00:00 :' || text, '' ORDER BY turn) AS body,
    count(*) AS n_turns,
    min(CASE WHEN role = 'assistant' THEN length(text) END) AS first_len,
    avg(CASE WHEN role = 'assistant' THEN length(text) END) AS avg_len
  FROM conversations GROUP BY conv_id) g
LEFT JOIN labels lb ON g.conv_id = lb.doc_id"""),
}


def with_ctes(*names: str, body: str, extra: dict[str, str] | None = None) -> str:
    """Compose ``WITH`` over the requested stand-ins (plus dependencies) and optional extra CTEs."""
    order: list[str] = []

    def add(n):
        if n in order:
            return
        for dep in CTES[n][0]:
            add(dep)
        order.append(n)

    for n in names:
        add(n)
    parts = [f"{k} AS ({v})" for k, v in BASE.items()]
    parts += [f"{n} AS ({CTES[n][1]}\n)" for n in order]
    for k, v in (extra or {}).items():
        parts.append(f"{k} AS ({v}\n)")
    if not parts:
        return body
    return "WITH " + ",\n".join(parts) + "\n" + body
