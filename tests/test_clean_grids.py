"""Cleaning pipelines and grid parsers on hand-built frames."""

from tallyframe.operators import clean as C
from tallyframe.operators import grids as G


def test_total_and_zero_rows(spark):
    rows = [("2026-01-01", "a", "1", "0"), ("2026-01-02", " 总计 ", "5", "0"), ("2026-01-03", "b", "0", ""),
            ("2026-01-04", "c", "0", "2"), ("2026-01-05", "d", "x", None), ("2026-01-06", "e", None, "")]
    df = spark.createDataFrame(rows, "`日期` string, `代理名称` string, `金额` string, `单元代理人数` string")
    out = C.drop_all_zero_rows(C.drop_total_rows(df))
    assert sorted(r["代理名称"] for r in out.collect()) == ["a", "c"]  # d: "x" ignored, blank -> 0
    lit = C.drop_all_zero_rows(df.where(df["代理名称"] == "e"), literal_nan=True)
    assert lit.count() == 1


def test_type_columns_and_renames(spark):
    df = spark.createDataFrame([("1,234.5", "12%", "是", "2026-05-01 10:00:00", "-", "x\ty")],
                               "a string, b string, c string, d string, e string, `流水倍数(倍)` string")
    t = C.type_columns(C.rename_cols(df), {"a": "num", "b": "pct", "c": "bool", "d": "ts", "e": "num"}).first()
    assert t.a == 1234.5 and abs(t.b - 0.12) < 1e-12 and t.c is True and t.e is None and t["流水倍数"] == "xy"


def test_one_row_per_key_by_any_order(spark):
    """CL-17, WN-02/03: nulls in the order come first, null keys are one key, "desc" turns one part; and the first row of
    a key is found inside every task, before the shuffle, of needed columns only."""
    from tallyframe.operators.dedupe import keep_first, keep_last
    data = [(k, a, b, f"{k}{a}{b}") for k in ("x", "y", None) for a in (None, 1, 2) for b in (1.0, 2.0)]
    df = spark.createDataFrame(data, "k string, a int, b double, v string").repartition(5)
    for keep, order, best in ((keep_first, ["a", "b"], (None, 1.0)), (keep_last, ["a", "b"], (2, 2.0)),
                              (keep_first, ["b", ("a", "desc")], (None, 1.0)), (keep_last, [("a", "desc"), "b"], (1, 2.0))):
        got = {r.k: r.v for r in keep(df, ["k"], order).collect()}
        assert got == {k: f"{k}{best[0]}{best[1]}" for k in ("x", "y", None)}
    plan = keep_first(df, ["k"], ["a"], ["a"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "min_by" not in plan and "SortAggregate" not in plan and "v#" not in plan.split("Exchange hashpartitioning")[0]


def test_project_text_is_clean_text(spark):
    from tallyframe.functions import exprs as X
    df = spark.createDataFrame([(x,) for x in ("", " ", "nan", " None\t", "None ", "Nan", "x nan", "\u3000a b\ufeff", None)], "s string")
    rows = df.select(X.clean_text("s").alias("a"), X.project_text("s").alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows] == [None] * 5 + ["Nan", "x nan", "a b", None]


def test_dedupe_and_modal(spark):
    df = spark.createDataFrame([("o1", 2, "f1"), ("o1", 1, "f2"), ("o2", 5, "f1")], "k string, ord long, f string")
    out = sorted((r.k, r.f) for r in C.dedupe_first(df, ["k"], ["ord"]).collect())
    assert out == [("o1", "f2"), ("o2", "f1")]
    ts = spark.createDataFrame([("2026-05-01 00:00:00",), ("2026-05-02 00:00:00",), ("2026-04-01 00:00:00",),
                                ("2026-04-02 00:00:00",)], "t string").selectExpr("to_timestamp_ntz(t) AS t")
    assert C.modal_month(ts, "t").first().modal_month == "2026-04"


def cells(spark, rows, sheet="s1"):
    return spark.createDataFrame([("f.xlsx", sheet, r, c, v) for r, c, v in rows],
                                 "source_file string, sheet string, r int, c int, v string")


def test_blocks_and_details(spark):
    g = cells(spark, [(0, 0, "张三"), (0, 2, "李四"), (1, 0, "名单数"), (1, 1, "1，200"), (1, 2, "名单数"), (1, 3, "-"),
                      (2, 0, "召回充值"), (2, 1, "50"), (2, 2, "召回充值"), (2, 3, "")])
    out = {r.name: (r["名单数"], r["召回充值"]) for r in G.blocks_to_records(g, ["名单数", "召回充值"]).collect()}
    assert out == {"张三": (1200.0, 50.0), "李四": (0.0, 0.0)}
    d = cells(spark, [(0, 0, "标题"), (2, 0, "会员账号"), (2, 1, "充值金额"), (2, 2, "七天登入"),
                      (3, 0, "u1"), (3, 1, "1,000"), (3, 2, "是"), (4, 1, "5"), (5, 0, "u2"), (5, 2, "y")])
    t = G.detail_totals(d).first()
    assert (t.recharge, t.relogins, t.rows) == (1000.0, 2, 2)  # "是" and "y" are both yes-flags


def test_header_is_the_account_word(spark):
    d = cells(spark, [(0, 0, "会员账号召回明细"), (1, 0, " 账号 "), (1, 1, "充值金额"), (2, 0, "u1"), (2, 1, "7")])
    t = G.detail_totals(d).first()
    assert (t.recharge, t.rows) == (7.0, 1)


def test_last_block_and_label_win(spark):
    g = cells(spark, [(0, 0, "a"), (1, 0, "x"), (1, 1, "9"), (2, 0, "y"), (2, 1, "5"), (0, 2, "b"), (0, 4, "a"), (1, 4, "x"), (1, 5, "9"),
                      (2, 4, "x"), (2, 5, "10"), (0, 6, "c"), (1, 6, "x"), (1, 7, "3"), (2, 6, "x"), (0, 8, "nan"), (1, 8, "x"), (1, 9, "1")])
    out = {r.name: (r.x, r.y) for r in G.blocks_to_records(g, ["x", "y"]).collect()}
    assert out == {"a": (10.0, 0.0), "b": (0.0, 0.0), "c": (0.0, 0.0)}


def test_settlement_marker_required(spark):
    base = [(1, 1, "项目A"), (2, 1, "100"), (1, 2, "项目B"), (2, 2, "abc"), (7, 1, "名称"), (7, 2, "总代"),
            (8, 0, "已回款"), (8, 1, "n1"), (8, 2, "ag1"), (8, 5, "10"), (8, 6, "退成5%"), (8, 8, "0.5"),
            (9, 1, "n2"), (9, 2, "ag2")]
    good = cells(spark, base)
    assert [(r.item, r.amount) for r in G.settlement_summary(good).collect()] == [("项目A", 100.0)]
    det = G.settlement_detail(good).collect()
    assert len(det) == 1 and det[0].treatment == "退成5%" and det[0].commission == 0.5
    no_marker = cells(spark, [x for x in base if x[0] != 7])
    assert G.settlement_detail(no_marker).count() == 0


def test_infer_snapshot_month(spark):
    rows = [("/land/member_2026-05.csv", "2026-04-30 10:00:00"), ("/land/member_2026-05.csv", "2026-05-02 10:00:00"),
            ("/land/members.csv", "2026-03-01 00:00:00"), ("/land/members.csv", "2026-02-27 00:00:00"),
            ("/land/202604会员.csv", None)]
    df = spark.createDataFrame(rows, "_source_file string, registered_at string")
    out = {r._source_file: (r._snapshot_month, str(r._snapshot_date))
           for r in C.infer_snapshot_month(df).select("_source_file", "_snapshot_month", "_snapshot_date").distinct().collect()}
    assert out["/land/member_2026-05.csv"] == ("2026-05", "2026-05-01")   # month in the name wins
    assert out["/land/members.csv"] == ("2026-03", "2026-03-01")          # else month of max register time
    assert out["/land/202604会员.csv"] == ("2026-04", "2026-04-01")        # 20YYMM in the name
    top = spark.createDataFrame([("/land/top 202512 报表.csv",)], "_source_file string")
    assert C.infer_snapshot_month(top, reg_col=None, top_report=True).first()._snapshot_month == "2025-12"


def call_book(spark, name="/land/calls.xlsx", months=("2026-4-30", "2026年5月2日", "2026/05/03")):
    """A call workbook: two callers in the statistics sheet, one with a sheet of their own, and a sheet of nobody's."""
    stats = [(0, 0, "Ann"), (0, 2, "李四"), (1, 0, "名单数"), (1, 1, "1，200"), (2, 0, "是否申请彩金"), (2, 1, "7"), (1, 2, "已播数"), (1, 3, "40")]
    own = [(0, 0, "明细"), (1, 1, " 账号 "), (1, 2, "充值金额"), (1, 3, "登入"), (1, 4, "七天回登"), (1, 5, "日期"), (1, 6, "拨打日期")]
    for i, m in enumerate(months):
        own += [(2 + i, 1, f"u{i}"), (2 + i, 2, "1,000.5"), (2 + i, 3, "是"), (2 + i, 4, "是" if i else "否"), (2 + i, 5, "2020-01-01"), (2 + i, 6, m)]
    own += [(9, 1, "  "), (9, 2, "99")]
    other = [(0, 0, "账号"), (0, 1, "拨打日期")] + [(i, c, v) for i in range(1, 9) for c, v in ((0, "x"), (1, "2020-01-01"))]
    rows = [("统计结果", *x) for x in stats] + [(" ANN ", *x) for x in own] + [("别人", *x) for x in other]
    return spark.createDataFrame([(name, *x) for x in rows], "source_file string, sheet string, r int, c int, v string")


def test_call_records(spark):
    got = {r["专员"]: r for r in G.call_records(call_book(spark)).collect()}
    a, b = got["Ann"], got["李四"]
    assert (a["名单数"], a["申请彩金"], a["七天回登"], a["召回充值"], a["月份"]) == (1200, 7, 2, 3001.5, "2026-05")
    assert (b["名单数"], b["已播数"], b["七天回登"], b["召回充值"], b["月份"]) == (0, 40, 0, 0.0, "2026-05")
    undated = call_book(spark, "/2025-01/五月.xlsx", ("", "x", "2026-13-01"))
    assert {r["月份"] for r in G.call_records(undated.where("v <> '2026-13-01'"), 2026).collect()} == {"2026-05"}
    assert {r["月份"] for r in G.call_records(undated.where("v <> '2026-13-01'")).collect()} == {None}
    assert G.call_records(undated.limit(0)).count() == 0


def test_month_of_name(spark):
    names = {"/x/2026年5月.xlsx": "2026-05", "a 2025-11 b": "2025-11", "2025/3月/十一月.xlsx": "2024-11", "12月代理帐": "2024-12", "x": None,
             "2026-13": None, "99月": None, None: None}
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.m for r in df.select("n", G.month_of_name(df.n, 2024).alias("m")).collect()} == names


def test_rows_of_a_hot_sheet_are_dealt(spark):
    """One sheet with nearly all rows: the fold of its rows uses the join's partitioning (sheet and share), totals are partial."""
    n = 3000
    head = cells(spark, [(0, 0, "账号"), (0, 1, "充值金额")], "hot")
    body = spark.range(1, n + 1).selectExpr("'f.xlsx' AS source_file", "'hot' AS sheet", "int(id) AS r", "explode(array(0, 1)) AS c", "string(id) AS v")
    df = G.detail_totals(head.unionByName(body))
    t = df.first()
    assert (t.recharge, t.rows) == (n * (n + 1) / 2, n)
    spread = G.detail_rows(head.unionByName(body))
    assert spread.count() == n and "Window" not in df._jdf.queryExecution().executedPlan().toString()
