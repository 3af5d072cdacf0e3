"""Text expressions for customer-service conversations (TX-01…05, TX-07 helpers).

All rules are higher-order SQL functions over arrays (split / filter / transform /
exists), evaluated JVM-side per row; no Python UDF is involved.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .exprs import LBL_UNMATCHED, col, utrim

# fixed values: a turn header inside a conversation blob is "speaker>YYYY-MM-DD HH:MM:SS :"
TURN_RE = r"\n\s*([^\n>]{1,40})>\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}\s*:"
SYSTEM_SPEAKER = "系统"
SYSTEM_LINE_PREFIX = "系统>"

# fixed values: template phrases of the operator's canned greeting (a line holding any is dropped)
CANNED_PHRASES = ("平台入款渠道", "官方认证场馆", "极速提款渠道", "亿兆专属通讯软件",
                  "注册后,添加专属客服", "为您带来更流畅的游戏体验", "千里马VPN",
                  "电脑网址", "手机网址", "综合APP", "体育APP", "fafa")

# fixed values: root-cause categories of unhappy conversations, in priority order (category, keywords)
ISSUE_CATEGORIES = (
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

# fixed values: keyword-heat words scanned in member text (literal, case-insensitive)
HEAT_KEYWORDS = ("充值", "提款", "红利", "彩金", "活动", "登录", "登入", "密码", "注册",
                 "验证", "体育", "真人", "电子", "老虎机", "棋牌", "彩票",
                 "风控", "冻结", "禁用", "解封", "套利", "客诉", "投诉",
                 "代理", "佣金", "VIP", "返水", "USDT", "虚拟币",
                 "APP", "下载", "链接")

# fixed values: words meaning "no value" in free-text cells (compared lower-cased)
NULL_WORDS_LOWER = ("nan", "none", "")


def blank_to_null(c) -> Column:
    """Trimmed text, NULL when blank / 'nan' / 'none' (any case)."""
    return _blank_to_null(c)


def _blank_to_null(c) -> Column:
    t = utrim(c)
    return F.when(F.lower(t).isin(*NULL_WORDS_LOWER), F.lit(None).cast("string")).otherwise(t)


def turn_speakers(c) -> Column:
    """TX-01: speakers of every turn header, in order."""
    return F.regexp_extract_all(col(c).cast("string"), F.lit(TURN_RE), F.lit(1))


def turn_bodies(c) -> Column:
    """TX-01: text after every turn header (the opening before the first header is dropped)."""
    parts = F.split(col(c).cast("string"), TURN_RE, -1)
    return F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))


def parse_turns(c) -> Column:
    """TX-01: array<struct<speaker,text>> of a conversation blob."""
    sp = turn_speakers(c)
    bd = turn_bodies(c)
    return F.transform(sp, lambda s, i: F.struct(utrim(s).alias("speaker"), F.element_at(bd, i + 1).alias("text")))


def member_text(content, agent=None) -> Column:
    """TX-02: what the member said: drop system and serving-staff turns, join with a space. [UD-06]"""
    turns = parse_turns(content)
    a = utrim(F.coalesce(col(agent).cast("string"), F.lit(""))) if agent is not None else F.lit("")

    def keep(t):
        return (t["speaker"] != F.lit(SYSTEM_SPEAKER)) & ((a == F.lit("")) | (t["speaker"] != a))

    return F.array_join(F.transform(F.filter(turns, keep), lambda t: t["text"]), " ")


def strip_canned(c, phrases=CANNED_PHRASES) -> Column:
    """TX-03: drop lines containing any template phrase or starting with the system marker."""
    lines = F.split(F.coalesce(col(c).cast("string"), F.lit("")), "\n", -1)

    def keep(ln):
        hit = F.lit(False)
        for p in phrases:
            hit = hit | ln.contains(p)
        return ~hit & ~F.ltrim(ln).startswith(SYSTEM_LINE_PREFIX) & ~utrim(ln).startswith(SYSTEM_LINE_PREFIX)

    return F.array_join(F.filter(lines, keep), "\n")


def keyword_categories(c, categories=ISSUE_CATEGORIES, unmatched: str = LBL_UNMATCHED) -> Column:
    """TX-05: comma list of categories whose keywords occur (case-sensitive), dictionary order."""
    t = F.coalesce(col(c).cast("string"), F.lit(""))
    hits = []
    for cat, kws in categories:
        cond = F.lit(False)
        for k in kws:
            cond = cond | t.contains(k)
        hits.append(F.when(cond, F.lit(cat)))
    joined = F.concat_ws(",", *hits)
    return F.when(joined == "", F.lit(unmatched)).otherwise(joined)


def issue_label(unhappy, topic=None, review=None, content=None,
                categories=ISSUE_CATEGORIES, phrases=CANNED_PHRASES) -> Column:
    """TX-04: root cause of an unhappy conversation; '' when the row is not unhappy. [UD-06]

    Priority: service topic > keyword categories of the review > of the de-templated
    conversation > '(未匹配)'.
    """
    out = None
    if topic is not None:
        t = _blank_to_null(topic)
        out = F.when(t.isNotNull(), t)
    if review is not None:
        r = _blank_to_null(review)
        br = F.when(r.isNotNull(), keyword_categories(r, categories))
        out = br if out is None else out.when(r.isNotNull(), keyword_categories(r, categories))
    if content is not None:
        cleaned = strip_canned(_blank_to_null(content), phrases)
        has = F.trim(cleaned) != ""
        cc = keyword_categories(cleaned, categories)
        out = F.when(has, cc) if out is None else out.when(has & _blank_to_null(content).isNotNull(), cc)
    label = (out if out is not None else F.when(F.lit(False), F.lit(""))).otherwise(F.lit(LBL_UNMATCHED))
    return F.when(col(unhappy), label).otherwise(F.lit(""))


def keyword_hits(c, keywords=HEAT_KEYWORDS) -> Column:
    """TX-06 helper: array of keywords contained in the text (literal, case-insensitive)."""
    t = F.lower(F.coalesce(col(c).cast("string"), F.lit("")))
    kws = F.array(*[F.lit(k) for k in keywords])
    return F.filter(kws, lambda k: t.contains(F.lower(k)))


def tag_hits(c, keywords) -> Column:
    """AG-88: ordered keywords contained in a tag text, comma-joined ('' when none)."""
    t = F.coalesce(col(c).cast("string"), F.lit(""))
    kws = F.array(*[F.lit(k) for k in keywords])
    return F.array_join(F.filter(kws, lambda k: t.contains(k)), ",")
