"""Unit tests of column expressions on hand-built edge-case frames (FIXTURES §3)."""

import datetime as dt

from pyspark.sql import functions as F

from tallyframe.functions import exprs as X
from tallyframe.functions import text as T


def one_col(spark, values, name="v"):
    return spark.createDataFrame([(v,) for v in values], f"{name} string")


def test_messy_cells(spark):
    df = one_col(spark, ['="123"', " 12 ", "1,234", "nan", "None", "", "　中文　", None])
    out = df.select(X.clean_text(X.unwrap_eq("v")).alias("t"), X.to_num(X.unwrap_eq("v")).alias("n"),
                    X.to_num_commas("v").alias("nc")).collect()
    assert [r.t for r in out] == ["123", "12", "1,234", None, None, None, "中文", None]
    assert [r.n for r in out][:3] == [123.0, 12.0, None]
    assert out[2].nc == 1234.0 and out[3].n is None


def test_month_keys(spark):
    df = one_col(spark, ["202605", "2026-05", "", "nan", "May"])
    assert [r.m for r in df.select(X.month_key("v").alias("m")).collect()] == ["2026-05", "2026-05", None, None, "May"]
    b = one_col(spark, ["2026-02"]).select(X.month_start("v").alias("s"), X.month_end("v").alias("e")).first()
    assert b.s == dt.date(2026, 2, 1) and b.e == dt.date(2026, 2, 28)


def test_slot_times(spark):
    df = one_col(spark, ["2026-01-31 23~24", '="2026-01-31 9~10"', "2026-01-31 23:10:00", "garbage"])
    out = df.select(X.slot_date("v").alias("d"), X.slot_label("v").alias("s"),
                    X.slot_hour(X.slot_label("v")).alias("h")).collect()
    assert [r.s for r in out] == ["23~24", "9~10", "23:00", None]
    assert [r.h for r in out] == [23, 9, 23, 99]
    assert out[0].d == dt.date(2026, 1, 31) and out[3].d is None


def test_urls(spark):
    df = one_col(spark, ["https://a.b:80/x?i_code=12", "null?i%20code-7", "r_code=5", None, "", "x" * 50])
    out = df.select(X.url_domain("v").alias("d"), X.invite_code("v").alias("c")).collect()
    assert [r.d for r in out] == ["a.b", "(仅邀请码)", "r_code=5", "(未记录)", "(未记录)", "x" * 40]
    assert [r.c for r in out] == ["12", "7", "5", None, None, None]


def test_ratio_modes(spark):
    df = spark.createDataFrame([(1.0, 0.0), (0.0, 0.0), (3.0, 2.0)], "n double, d double")
    r = df.select(*[X.ratio("n", "d", m).alias(m) for m in ("null", "zero", "one", "sentinel")]).collect()
    assert (r[0]["null"], r[0]["zero"], r[0]["one"], r[0]["sentinel"]) == (None, 0.0, 1.0, 999.0)
    assert r[1]["sentinel"] is None and r[2]["null"] == 1.5


def test_venue_category_and_month_names(spark):
    df = one_col(spark, ["AG真人", "沙巴體育", "pg电子", "PP slots", "开元棋牌", "HASH-1", "VR彩", "其它"])
    assert [r.c for r in df.select(X.venue_category("v").alias("c")).collect()] == \
        ["真人", "体育", "电子", "电子", "棋牌", "哈希", "彩票", "其他"]
    n = one_col(spark, ["十一月客服.xlsx", "一月.xlsx", "5月代理帐", "none"])
    assert [r.m for r in n.select(X.month_from_name("v").alias("m")).collect()] == [11, 1, 5, None]


def test_wb_scalars(spark):
    df = one_col(spark, ["1，200", " 3,4 ", "-", "", "是", "Y", "no"])
    out = df.select(X.wb_num("v").alias("n"), X.wb_yes("v").alias("y")).collect()
    assert [r.n for r in out][:4] == [1200.0, 34.0, 0.0, 0.0]
    assert [r.y for r in out][4:] == [True, True, False]


def test_turns_and_member_text(spark):
    blob = ("对话开始>>欢迎\n系统>2024-01-01 00:00:00 :平台入款渠道 提款\n"
            "m1>2024-01-01 00:00:01 :我要提款\nstaffA>2024-01-01 00:00:02 :请稍等 充值\n"
            "m1>2024-01-01 00:00:03 :客服态度差")
    df = spark.createDataFrame([(blob, "staffA"), ("no marker", "x")], "c string, a string")
    out = df.select(X.col("c"), T.member_text("c", "a").alias("m"), T.strip_canned("c").alias("s"),
                    F.size(T.parse_turns("c")).alias("n")).collect()
    assert out[0].n == 4 and out[1].n == 0
    assert out[0].m == "我要提款 客服态度差" and out[1].m == ""
    assert "平台入款渠道" not in out[0].s and "系统>" not in out[0].s


def test_issue_label_priority(spark):
    rows = [(True, "提款相关", "态度差", "x"), (True, None, "提款太慢,客服态度差", "x"), (True, "nan", None, "m>2024-01-01 00:00:00 :登录不了"),
            (True, None, None, None), (False, "提款", None, None)]
    df = spark.createDataFrame(rows, "u boolean, topic string, review string, content string")
    out = [r.l for r in df.select(T.issue_label("u", "topic", "review", "content").alias("l")).collect()]
    assert out == ["提款相关", "提款问题,客服态度", "账号登录", "(未匹配)", ""]


def test_referral_golden(spark):
    from tallyframe.operators.commission import commission_cost
    df = spark.createDataFrame([(246971.0, 0.05), (285386.0, 0.03), (374806.0, 0.01)], "total_perf double, rate double")
    df = df.select(F.col("total_perf").cast("decimal(15,2)").alias("total_perf"), F.col("rate").cast("decimal(4,2)").alias("rate"))
    out = commission_cost(df).collect()
    for r, (main, ref, tot) in zip(out, [(135834, 12349, 148183), (156963, 8562, 165525), (206143, 3748, 209891)]):
        assert abs(float(r.main_commission) - main) <= 1
        assert abs(float(r.referral_commission) - ref) <= 1
        assert r.platform_cost == r.main_commission + r.referral_commission
        # the printed totals add parts that were each rounded up (285,386 x 55% = 156,962.3 is printed
        # as 156,963), so a printed total can sit up to 2 away from the exact stacked cost
        assert abs(float(r.platform_cost) - tot) <= 2
