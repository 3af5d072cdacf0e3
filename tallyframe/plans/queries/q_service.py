"""Customer service (AG-94…100) and conversation text analytics (TX-01…07)."""

from ...functions.text import TURN_RE
from ...operators import clean as C
from ...operators import service as SV
from .. import standins as S
from ..catalog import register
from ..oracle_ctes import with_ctes

# test-table stand-in dictionary: frequent word pieces of the four prose languages
TEST_CATEGORIES = (("fr", ("que", "eau", "ç")), ("de", ("sch", "und", "ü")), ("es", ("ción", "los", "ñ")),
                   ("en", ("the", "ing")))
TEST_KEYWORDS = ("que", "sch", "und", "the", "ing", "los", "ción", "é", "ü", "ñ", "ou", "en", "ie", "ZZZ")

_CANNED = ("平台入款渠道", "官方认证场馆", "极速提款渠道", "亿兆专属通讯软件", "注册后,添加专属客服", "为您带来更流畅的游戏体验",
           "千里马VPN", "电脑网址", "手机网址", "综合APP", "体育APP", "fafa")
_ISSUES = (
    ("提款问题", ("提款", "取款", "出款", "提现", "到账", "未到", "迟迟", "挂起", "卡住", "审核中", "不出款", "没收到钱")),
    ("充值问题", ("充值", "入款", "存款", "没到帐", "没到账", "充不进", "储值", "入金", "充错", "充值失败")),
    ("红利彩金", ("红利", "彩金", "优惠", "加赠", "没有发", "没发", "没派发", "没派", "没收到红利", "彩金未发", "活动金")),
    ("返水问题", ("返水", "回水", "水钱", "返点", "没有返水", "少给")),
    ("活动规则", ("活动规则", "不符合", "规则", "资格", "条件", "说明不清", "没说", "看不懂规则")),
    ("客服态度", ("态度", "不耐烦", "骂", "凶", "生气", "不专业", "冷淡", "敷衍", "机器人", "回得慢", "不理")),
    ("风控锁定", ("冻结", "锁定", "封号", "禁用", "风控", "审核", "资料审核", "实名", "账号停", "套利")),
    ("账号登录", ("登录", "登入", "密码", "验证码", "账号", "忘记密码", "改密码", "登不进", "账号丢失")),
    ("系统异常", ("系统", "卡", "当机", "bug", "错误", "error", "闪退", "加载", "页面", "打不开", "连不上", "app")),
    ("VIP问题", ("VIP", "vip", "升级", "降级", "等级", "层级")),
    ("代理佣金", ("代理", "佣金", "团队", "抽成", "分红", "上级")),
    ("游戏问题", ("游戏", "场馆", "注单", "盘口", "体育", "真人", "电子", "彩票", "棋牌", "退款", "走盘")),
    ("链接下载", ("网址", "链接", "下载", "官网", "APP", "app", "二维码", "QR")),
)


def _q(s):
    return "'" + s.replace("'", "''") + "'"


def _cats_sql(text, cats):
    parts = ", ".join(f"CASE WHEN {' OR '.join(f'contains({text}, {_q(k)})' for k in kws)} THEN {_q(c)} END"
                      for c, kws in cats)
    return f"CASE WHEN concat_ws(',', {parts}) = '' THEN '(未匹配)' ELSE concat_ws(',', {parts}) END"


_STRIP = ("array_to_string(list_filter(string_split(coalesce(content, ''), chr(10)), lambda l: NOT ("
          + " OR ".join(f"contains(l, {_q(p)})" for p in _CANNED) + ") AND NOT starts_with(ltrim(l), '系统>')), chr(10))")

_PARSED = f"""SELECT *, regexp_extract_all(content, '{TURN_RE}', 1) AS sp, string_split_regex(content, '{TURN_RE}') AS bd FROM cs"""
_MTEXT = """array_to_string(list_transform(list_filter(list_transform(generate_series(1, len(sp)),
  lambda i: {'s': trim(sp[i]), 't': bd[i + 1]}), lambda x: x.s <> '系统' AND (trim(coalesce(staff, '')) = '' OR x.s <> trim(staff))),
  lambda x: x.t), ' ')"""

_CLEAN = f"""SELECT *, strftime(started_at, '%Y-%m') AS snapshot_month,
  CASE WHEN rating IN ('不满意', '非常不满意') THEN
    CASE WHEN topic IS NOT NULL AND lower(trim(topic)) NOT IN ('nan', 'none', '') THEN trim(topic)
         WHEN review IS NOT NULL AND lower(trim(review)) NOT IN ('nan', 'none', '') THEN {_cats_sql('trim(review)', _ISSUES)}
         WHEN content IS NOT NULL AND lower(trim(content)) NOT IN ('nan', 'none', '') AND trim(stripped) <> ''
           THEN {_cats_sql('stripped', _ISSUES)}
         ELSE '(未匹配)' END
  ELSE '' END AS issue
FROM (SELECT *, {_STRIP} AS stripped FROM cs)"""


def _clean_cs(spark, d):
    return C.clean_conversations(S.cs(spark, d))


@register("ag94_service_kpis", with_ctes("cs", body="""
SELECT *, coalesce(CAST(rated AS DOUBLE) / nullif(CAST(conversations AS DOUBLE), 0), 0.0) * 100.0 AS rated_pct FROM (
SELECT count(*) AS conversations, count(DISTINCT staff) AS staff, count(DISTINCT account) AS members,
  coalesce(avg(first_response_s), 0.0) AS avg_first_response_s, coalesce(avg(duration_s), 0.0) AS avg_duration_s,
  count_if(rating <> '未评价') AS rated, count_if(rating = '非常不满意') AS very_unhappy FROM cs)"""))
def ag94(spark, d):
    return SV.service_kpis(S.cs(spark, d))


@register("ag95_satisfaction_dist", with_ctes("cs", body="""
SELECT rating, conversations, round(conversations*100.0 / nullif(sum(conversations) OVER (), 0), 2) AS share_pct FROM (
SELECT rating, count(*) AS conversations FROM cs WHERE rating IS NOT NULL GROUP BY 1)"""))
def ag95(spark, d):
    return SV.satisfaction_dist(S.cs(spark, d))


@register("ag96_staff_ranking", with_ctes("cs", body="""
SELECT *, round(CAST(very_happy AS DOUBLE) / CASE WHEN CAST(rated AS DOUBLE) = 0 THEN 1 ELSE CAST(rated AS DOUBLE) END * 100.0, 1)
  AS good_rate_pct FROM (
SELECT staff, count(conversation_id) AS volume, round(coalesce(avg(first_response_s), 0.0), 1) AS avg_first_response_s,
  round(coalesce(avg(avg_response_s), 0.0), 1) AS avg_response_s, round(coalesce(avg(duration_s), 0.0), 1) AS avg_duration_s,
  round(coalesce(avg(turns), 0.0), 1) AS avg_turns, count_if(rating <> '未评价') AS rated,
  count_if(rating <> '未评价' AND rating = '非常满意') AS very_happy,
  count_if(rating <> '未评价' AND rating = '非常不满意') AS very_unhappy
FROM cs WHERE staff IS NOT NULL GROUP BY 1)"""))
def ag96(spark, d):
    return SV.staff_ranking(S.cs(spark, d))


@register("ag97_by_hour", with_ctes("cs", body="""
SELECT hour(started_at) AS hour, count(*) AS conversations FROM cs WHERE started_at IS NOT NULL GROUP BY 1"""))
def ag97a(spark, d):
    return SV.by_hour(S.cs(spark, d))


@register("ag97_by_weekday", with_ctes("cs", body="""
SELECT weekday, conversations, ['周一', '周二', '周三', '周四', '周五', '周六', '周日'][weekday + 1] AS label FROM (
SELECT (dayofweek(started_at) + 6) % 7 AS weekday, count(*) AS conversations FROM cs WHERE started_at IS NOT NULL GROUP BY 1)"""))
def ag97b(spark, d):
    return SV.by_weekday(S.cs(spark, d))


@register("ag98_top_topics", with_ctes("cs", body="""
SELECT topic, count(*) AS conversations FROM cs WHERE topic IS NOT NULL GROUP BY 1
ORDER BY conversations DESC, topic LIMIT 20"""))
def ag98(spark, d):
    return SV.top_topics(S.cs(spark, d), 20)


@register("ag99_unhappy_cases", with_ctes("cs", extra={"cc": _CLEAN}, body="""
SELECT conversation_id, started_at, account, staff, rating, topic, review, issue FROM cc
WHERE rating IN ('不满意', '非常不满意')"""))
def ag99a(spark, d):
    return SV.unhappy_cases(_clean_cs(spark, d))


@register("ag99_root_causes", with_ctes("cs", extra={"cc": _CLEAN}, body="""
SELECT label, count(*) AS n FROM (SELECT trim(unnest(string_split(coalesce(issue, ''), ','))) AS label FROM cc)
WHERE label NOT IN ('(未匹配)', '') GROUP BY 1"""))
def ag99b(spark, d):
    return SV.label_counts(_clean_cs(spark, d), "issue")


@register("ag100_conversations_by_vip", with_ctes("cs", "member", body="""
SELECT vip, conversations, coalesce(CAST(m AS DOUBLE) / nullif(CAST(t AS DOUBLE), 0), 0.0) AS match_rate FROM (
  SELECT vip, conversations, sum(conversations) OVER () AS t,
    sum(CASE WHEN vip <> '(未匹配)' THEN conversations END) OVER () AS m FROM (
    SELECT coalesce(l.vip, '(未匹配)') AS vip, count(*) AS conversations
    FROM cs LEFT JOIN (SELECT account, arg_max(vip, snapshot_month) AS vip FROM member GROUP BY 1) l
    ON cs.account = l.account GROUP BY 1))"""))
def ag100(spark, d):
    return SV.conversations_by_vip(S.cs(spark, d), S.member(spark, d))


@register("tx01_parse_turns", with_ctes("cs", extra={"pc": _PARSED}, body="""
SELECT conversation_id, pos, trim(sp[pos]) AS speaker, bd[pos + 1] AS text FROM (
  SELECT conversation_id, sp, bd, unnest(generate_series(1, len(sp))) AS pos FROM pc WHERE len(sp) > 0)"""))
def tx01(spark, d):
    return SV.turns(S.cs(spark, d))


@register("tx02_member_text", with_ctes("cs", extra={"pc": _PARSED}, body=f"""
SELECT conversation_id, {_MTEXT} AS member_text FROM pc"""))
def tx02(spark, d):
    return SV.with_member_text(S.cs(spark, d)).select("conversation_id", "member_text")


@register("tx03_strip_canned", with_ctes("cs", body=f"SELECT conversation_id, {_STRIP} AS stripped FROM cs"))
def tx03(spark, d):
    return SV.with_stripped(S.cs(spark, d)).select("conversation_id", "stripped")


@register("tx04_issue_label", with_ctes("cs", extra={"cc": _CLEAN}, body="SELECT conversation_id, rating, issue FROM cc"))
def tx04(spark, d):
    return _clean_cs(spark, d).select("conversation_id", "rating", "issue")


@register("tx05_keyword_categories", with_ctes("cs", extra={"pc": _PARSED}, body=f"""
SELECT conversation_id, {_cats_sql('mt', TEST_CATEGORIES)} AS categories FROM (
  SELECT conversation_id, {_MTEXT} AS mt FROM pc)"""))
def tx05(spark, d):
    df = SV.with_member_text(S.cs(spark, d))
    return SV.with_categories(df, "member_text", TEST_CATEGORIES).select("conversation_id", "categories")


@register("tx06_keyword_heat", with_ctes("cs", extra={"pc": _PARSED}, body="""
SELECT keyword, count(*) AS conversations FROM (
  SELECT unnest(list_filter([""" + ", ".join(_q(k) for k in TEST_KEYWORDS) + f"""],
                            lambda k: contains(lower(mt), lower(k)))) AS keyword
  FROM (SELECT {_MTEXT} AS mt FROM pc))
GROUP BY 1 ORDER BY conversations DESC, keyword LIMIT 25"""))
def tx06(spark, d):
    df = SV.with_member_text(S.cs(spark, d))
    return SV.keyword_heat(df, "member_text", TEST_KEYWORDS, 25)


@register("tx07_label_counts", with_ctes("cs", extra={"pc": _PARSED}, body=f"""
SELECT label, count(*) AS n FROM (
  SELECT trim(unnest(string_split(coalesce(c, ''), ','))) AS label FROM (
    SELECT {_cats_sql('mt', TEST_CATEGORIES)} AS c FROM (SELECT {_MTEXT} AS mt FROM pc)))
WHERE label NOT IN ('(未匹配)', '') GROUP BY 1"""))
def tx07(spark, d):
    df = SV.with_categories(SV.with_member_text(S.cs(spark, d)), "member_text", TEST_CATEGORIES)
    return SV.label_counts(df, "categories")


@register("tx02_conversation_member_text", """
SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS member_text FROM conversations WHERE role = 'user' GROUP BY 1""")
def tx02b(spark, d):
    return SV.turns_member_text(S.load(spark, d, "conversations"))
