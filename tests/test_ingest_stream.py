"""Batch ingest (IO-21/22) end to end on a landing folder, file reads (IO-05/06/07) and streaming (ST-01…03)."""

import os
import time

from pyspark.sql import functions as F

from tallyframe.sources import files as FS
from tallyframe.streaming import jobs as J


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(text)


def landing(root):
    land = os.path.join(root, "landing")
    write(os.path.join(land, "business-report-2026-01.csv"),
          "日期,注册数,公司输赢,首存人数,\n2026-01-01,5,100.5,2,\n2026-01-02,0,0,0,\n总计,5,100.5,2,\n")
    write(os.path.join(land, "top-202601.csv"), "用户名,个人输赢,有效投注额\nu1,3,10\n")
    write(os.path.join(land, "bonus_202601.csv"),
          "订单号,会员账号,红利金额,申请时间\n=\"A1\",m1,10,2026-01-01 10:00:00\nA2,m2,5,2026-01-02 11:00:00\n")
    write(os.path.join(land, "readme.csv"), "a,b\n1,2\n")
    return land


def test_classify_and_dry_run(spark, tmpdir_path):
    land = landing(tmpdir_path)
    types = {os.path.basename(r.path): r.report_type for r in FS.classify_files(spark, land).collect()}
    assert types == {"business-report-2026-01.csv": "raw_platform_report", "top-202601.csv": "raw_top_report",
                     "bonus_202601.csv": "raw_bonus_report", "readme.csv": "unknown"}
    log = {r.report_type: (r.rows, r.status) for r in FS.ingest_batch(spark, land, None, dry_run=True).collect()}
    assert log["raw_platform_report"] == (1, "dry run")  # total row and all-zero row removed
    assert log["unknown"][1].startswith("skipped")


def test_ingest_idempotent(spark, tmpdir_path):
    land = landing(tmpdir_path)
    root = os.path.join(tmpdir_path, "tables")
    FS.ingest_batch(spark, land, root)
    FS.ingest_batch(spark, land, root)  # same files again: nothing duplicated
    plat = spark.read.parquet(os.path.join(root, "raw_platform_report"))
    assert plat.count() == 1
    bonus = spark.read.parquet(os.path.join(root, "raw_bonus_report"))
    assert sorted(r["订单号"] for r in bonus.collect()) == ["A1", "A2"]


def test_landed_files_are_parsed_and_cleaned_once(spark, tmpdir_path, monkeypatch):
    """IO-21: checks and publishing scan the staged rows: no CSV and no grouping is behind what they are given; the
    staged copies are gone afterwards; rows and log are those of a plain read."""
    land, root = landing(tmpdir_path), os.path.join(tmpdir_path, "tables")
    write(os.path.join(land, "pay.csv"), "订单号,订单时间,订单状态,订单金额(元)\n" + "".join(
        f"p{i},2026-01-0{i % 3 + 1} 10:00:00, 存款成功 ,1\n" for i in range(9)) + "p9,2026-01-01 10:00:00,x,1,surplus\n")
    write(os.path.join(land, "bonus_2.csv"), "申请时间,订单号,红利金额\n2026-01-03 11:00:00,A2,7\n2026-01-03 11:00:00,A3,nan\n")
    seen, publish, check = {}, FS.publish_table, FS.upload_checks

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    def watch(of):
        def inner(spark, table, df, *more, **named):
            seen.setdefault(table, []).append(plan(df))
            return of(spark, table, df, *more, **named)
        return inner

    monkeypatch.setattr(FS, "publish_table", watch(publish))
    monkeypatch.setattr(FS, "upload_checks", watch(check))
    log = {r.report_type: r for r in FS.ingest_batch(spark, land, root).collect()}
    assert set(seen) == {"raw_platform_report", "raw_top_report", "raw_bonus_report", "raw_finance_deposit"}
    for table, plans in seen.items():
        assert len(plans) == 2 and all("FileScan parquet" in p and "FileScan csv" not in p and "Exchange" not in p for p in plans), table
    pay = log["raw_finance_deposit"]
    assert (pay.rows, pay.landed, pay.faulty) == (9, 9, 1) and log["raw_bonus_report"].rows == 3
    bonus = {r["订单号"]: r["红利金额"] for r in spark.read.parquet(os.path.join(root, "raw_bonus_report")).collect()}
    assert bonus["A1"] == 10.0 and bonus["A3"] is None and bonus["A2"] in (5.0, 7.0) and len(bonus) == 3
    assert {r["订单状态"] for r in spark.read.parquet(os.path.join(root, "raw_finance_deposit")).collect()} == {"存款成功"}
    left = FS.scratch_path(spark, "ingest")
    assert not os.path.exists(left) or os.listdir(left) == []


def test_sheets_months_daily_ops(spark, tmpdir_path):
    s = os.path.join(tmpdir_path, "sheets")
    write(os.path.join(s, "sheet=01", "p.csv"), "对话ID,满意度评价\nc1,满意\n,\n")
    write(os.path.join(s, "sheet=总表", "p.csv"), "对话ID,满意度评价\nall,x\n")
    u = FS.union_sheets(spark, s)
    assert [(r["对话ID"], r["_sheet"]) for r in u.collect()] == [("c1", "01")]
    m = os.path.join(tmpdir_path, "months")
    write(os.path.join(m, "202605", "a.csv"), "k\n1\n")
    write(os.path.join(m, "2026-06", "b.csv"), "k\n2\n")
    got = sorted((r._snapshot_month, r._source_file) for r in FS.read_month_folders(spark, m).collect())
    assert got == [("2026-05", "202605/a.csv"), ("2026-06", "2026-06/b.csv")]
    tabs = spark.createDataFrame([(0, 1, "2026-05-01", "12%", "1,000"), (1, 1, "2026-05-01", "13%", "2,000"),
                                  (1, 2, "合计", "1", "1")], "tab_ord int, row_ord int, `日期` string, a string, b string")
    d = FS.daily_ops(tabs).collect()
    assert [(r["日期"], r.a, r.b) for r in d] == [("2026-05-01", 13.0, 2000.0)]


def test_folders_are_read_by_header(spark, tmpdir_path):
    s, m = os.path.join(tmpdir_path, "sheets"), os.path.join(tmpdir_path, "months")
    write(os.path.join(s, "sheet=01", "p.csv"), 'id,text,win\nc1,"one\ntwo, three",5\n')
    write(os.path.join(s, "sheet=b c", "p.csv"), 'win,id,"text, long"\n7,c2,x\n,,\n')
    got = sorted((r["id"], r["win"], r["text"], r["text, long"], r["_sheet"]) for r in FS.union_sheets(spark, s).collect())
    assert got == [("c1", "5", "one\ntwo, three", None, "01"), ("c2", "7", None, "x", "b c")]
    write(os.path.join(m, "202605", "a.csv"), "registrations,win\n1,2\n")
    write(os.path.join(m, "2026-06", "b.csv"), "win,registrations\n30,4\n")
    got = sorted((r["_snapshot_month"], r["registrations"], r["win"], r["_source_file"]) for r in FS.read_month_folders(spark, m).collect())
    assert got == [("2026-05", "1", "2", "202605/a.csv"), ("2026-06", "4", "30", "2026-06/b.csv")]


def test_lines_with_surplus_cells_are_put_aside(spark, tmpdir_path):
    land, root = os.path.join(tmpdir_path, "landing"), os.path.join(tmpdir_path, "tables")
    write(os.path.join(land, "business-report-1.csv"), '日期,注册数,公司输赢,首存人数,\n2026-01-01,5,"1,000",2,\n2026-01-02,6,1,2,3,4\n2026-01-03,7\n2026-01-04,8,1,2,,,\n')
    for _ in range(2):
        log = FS.ingest_batch(spark, land, root).collect()
        assert [(r.rows, r.landed, r.faulty) for r in log] == [(3, 3, 1)]
    assert sorted((r["日期"], r["注册数"], r["公司输赢"]) for r in table(spark, root, "raw_platform_report").collect()) == [
        ("2026-01-01", "5", "1,000"), ("2026-01-03", "7", None), ("2026-01-04", "8", "1")]
    aside = spark.read.parquet(os.path.join(root, "_quarantine", "raw_platform_report")).collect()
    assert [r.line for r in aside] == ["2026-01-02,6,1,2,3,4"] and aside[0]["_source_file"].endswith("business-report-1.csv")


def test_log_tells_what_was_loaded_before(spark, tmpdir_path):
    land, root = os.path.join(tmpdir_path, "landing"), os.path.join(tmpdir_path, "tables")
    chat = "对话ID,开始时间,满意度评价,对话内容\nc{0},2026-01-03 10:00:00,满意,hello\n"
    write(os.path.join(land, "m1", "chat.csv"), chat.format(1))
    write(os.path.join(land, "b1", "b.csv"), "订单号,红利标题,红利金额,申请时间\nA1,t,1,2026-01-01 10:00:00\n")
    log = {r.report_type: r for r in FS.ingest_batch(spark, [f"{land}/m1", f"{land}/b1"], root).collect()}
    assert {k: (r.rows, r.status) for k, r in log.items()} == {"raw_cs_conversations": (1, "written (files)"), "raw_bonus_report": (1, "written (keys)")}
    write(os.path.join(land, "m2", "chat.csv"), chat.format(2))
    write(os.path.join(land, "b2", "b2.csv"), "订单号,红利标题,红利金额,申请时间\nA1,t,1,2026-01-01 10:00:00\nA2,t,1,2026-01-01 10:00:00\n")
    log = {r.report_type: r for r in FS.ingest_batch(spark, [f"{land}/m2", f"{land}/b2"], root).collect()}
    c, b = log["raw_cs_conversations"], log["raw_bonus_report"]
    assert (c.rows, c.landed, c.status) == (0, 1, "skipped: already loaded (files)")
    assert (b.rows, b.landed, b.status) == (1, 2, "written in part (keys)")
    assert table(spark, root, "raw_cs_conversations").count() == 1 and table(spark, root, "raw_bonus_report").count() == 2


def test_upload_checks_in_the_job(spark, tmpdir_path):
    land, root = os.path.join(tmpdir_path, "landing"), os.path.join(tmpdir_path, "tables")
    head = "日期,注册数,公司输赢,首存人数\n"

    def warnings(name, text, dry=False):
        write(os.path.join(land, name, "business-report.csv"), head + text)
        return [w[:6] for w in FS.ingest_batch(spark, os.path.join(land, name), root, dry_run=dry).first().warnings]

    month = "".join(f"2026-01-{d:02},{d},100,2\n" for d in range(1, 31))
    assert warnings("whole", month) == []
    assert warnings("gap", "2026-02-01,1,1,1\n2026-02-05,1,1,1\n") == ["AG-131"]
    assert warnings("zero", "2026-03-01,0,1,1\n2026-03-02,0,1,1\n") == ["AG-132"]
    assert warnings("months", "2026-04,5,1,1\n", dry=True) == ["AG-133"]
    assert warnings("less", "2026-01-01,1,1,1\n" + "2026-01-02,1,1,1\n" * 8 + "2026-01-30,1,1,1\n", dry=True) == ["AG-131", "AG-130"]
    assert warnings("other month", "2026-05-01,1,1,1\n2026-05-02,1,1,1\n") == []  # few rows, but none for these days before


def test_slot_totals_of_two_batches_out_of_order(spark, tmpdir_path):
    src = os.path.join(tmpdir_path, "events")
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    cut = ev.agg(F.expr("percentile_approx(unix_micros(cast(ts as timestamp_ltz)), 0.5)")).first()[0]
    late = F.unix_micros(F.col("ts").cast("timestamp_ltz")) < cut
    ev.where(~late).coalesce(1).write.parquet(src)  # the later half arrives first
    out, ck = os.path.join(tmpdir_path, "slot_out"), os.path.join(tmpdir_path, "ck1")
    J.start_slot_totals(spark, src, out, ck).awaitTermination(300)
    ev.where(late).coalesce(1).write.mode("append").parquet(src)
    J.start_slot_totals(spark, src, out, ck).awaitTermination(300)
    batch = ev.groupBy(F.date_trunc("hour", "ts").alias("slot_start"), F.col("event_type").alias("type")) \
              .agg(F.count(F.lit(1)).alias("events"))
    exp = {(r.slot_start, r.type): r.events for r in batch.collect()}
    assert {(r.slot_start, r.type): r.events for r in J.read_slot_totals(spark, out).collect()} == exp


def test_slot_anomalies_and_compaction(spark, tmpdir_path):
    """ST-02: after each of three batches, out of order, totals and deviations equal the batch answer; old versions go."""
    from tallyframe.operators.realtime import day_deviations
    src, out, an, ck = (os.path.join(tmpdir_path, x) for x in ("events", "out", "anomalies", "ck"))
    rows = [(f"2026-03-{d:02d} {h:02d}:10:00", "bet", 1.0, "u") for d in range(1, 12) for h in range(0, 24, 6) for _ in range(d + h)]
    ev = spark.createDataFrame(rows, "t string, event_type string, value double, user_id string") \
              .select(F.to_timestamp_ntz("t").alias("ts"), "event_type", "value", "user_id")
    parts = [F.col("ts") >= "2026-03-09", F.col("ts") < "2026-03-05", F.col("ts").between("2026-03-05", "2026-03-08 23:59:59")]
    seen = None
    for part in parts:
        seen = part if seen is None else seen | part
        ev.where(part).coalesce(1).write.mode("append").parquet(src)
        J.start_slot_totals(spark, src, out, ck, anomalies=an, compact_every=2).awaitTermination(300)
        sd = ev.where(seen).groupBy(F.to_date("ts").alias("day"), F.date_format("ts", "HH:00").alias("slot")).agg(F.count(F.lit(1)).alias("v"))
        assert sorted(map(tuple, J.read_slot_anomalies(spark, an).collect())) == sorted(map(tuple, day_deviations(sd).collect()))
        assert sum(r.events for r in J.read_slot_totals(spark, out).collect()) == ev.where(seen).count()
    assert sorted(n for n in os.listdir(out) if n.startswith("version=")) == ["version=1", "version=2"]
    J.compact_slot_totals(spark, out, 1)  # repeated: nothing older is left
    assert sum(r.events for r in J.read_slot_totals(spark, out).collect()) == len(rows)


def test_dedupe_orders_of_two_batches_out_of_order(spark, tmpdir_path):
    src, out, ck = (os.path.join(tmpdir_path, x) for x in ("orders", "dedup", "ck2"))

    def land(rows):
        spark.createDataFrame(rows, "order_no string, t string").selectExpr("order_no", "to_timestamp_ntz(t) AS applied_at") \
             .coalesce(1).write.mode("append").parquet(src)
        J.start_dedupe_orders(spark, src, out, checkpoint=ck).awaitTermination(300)

    land([("o1", "2026-01-20 00:00:00"), ("o1", "2026-01-20 01:00:00"), ("o2", "2026-01-20 02:00:00")])
    land([("o1", "2026-01-25 00:00:00"), ("o3", "2026-01-01 00:00:00")])  # a repeat days later, an order days late
    assert sorted((r.order_no, str(r.applied_at)[:10]) for r in spark.read.parquet(out).collect()) == [
        ("o1", "2026-01-20"), ("o2", "2026-01-20"), ("o3", "2026-01-01")]


def test_file_ingest_stream(spark, tmpdir_path):
    land = landing(tmpdir_path)
    root = os.path.join(tmpdir_path, "stream_tables")
    q = J.file_ingest_stream(spark, land, root, os.path.join(tmpdir_path, "ck3"))
    q.awaitTermination(300)
    assert spark.read.parquet(os.path.join(root, "raw_platform_report")).count() == 1
    time.sleep(0.1)


def test_writers_evolving_and_export(spark, tmpdir_path):
    from tallyframe.sources import publish as P
    t = os.path.join(tmpdir_path, "tbl")
    P.append_evolving(spark.createDataFrame([("a", 1)], "k string, v long"), t)
    P.append_evolving(spark.createDataFrame([("b", 2, "x")], "k string, v long, extra string"), t)
    got = sorted((r.k, r.extra) for r in P.read_evolving(spark, t).collect())
    assert got == [("a", None), ("b", "x")]
    P.write_partitions(spark.createDataFrame([("2026-01", 1), ("2026-02", 2)], "m string, v long"), t + "_p", "m")
    P.write_partitions(spark.createDataFrame([("2026-02", 9)], "m string, v long"), t + "_p", "m")
    assert sorted((r.m, r.v) for r in spark.read.parquet(t + "_p").collect()) == [("2026-01", 1), ("2026-02", 9)]
    P.export_csv(spark.createDataFrame([("甲", 1.5)], "name string, v double"), t + "_csv")
    assert spark.read.option("header", True).csv(t + "_csv").first()["name"] == "甲"


def table(spark, root, name):
    return FS.read_raw(spark, name, root=root)


def test_records_of_other_kinds_are_kept(spark, tmpdir_path):
    land, root = os.path.join(tmpdir_path, "landing"), os.path.join(tmpdir_path, "tables")
    write(os.path.join(land, "b.csv"), '订单号,红利标题,红利金额,申请时间\nA1,,"1,000",2026-01-01 10:00:00\nA1,later,5,2026-01-01 10:00:00\n')
    write(os.path.join(land, "存款管理 1.csv"), '订单号,订单时间,订单状态,取消原因,订单金额(元)\n\tP1\t,2026-01-01 10:00:00,已取消,,"2,000"\n')
    write(os.path.join(land, "c.csv"), '对话ID,开始时间,满意度评价,对话内容,首次响应\nc1,2026-01-03 10:00:00,不满意,"a, ""b""\nc",\n')
    write(os.path.join(land, "k.csv"), "佣金月份,是否在团队,代理名称,佣金比例,佣金\n2026-01,是,x,5,\"1,234\"\n2026-01,否,y,5%,-\n")
    write(os.path.join(land, "m.csv"), "代理帐号,月份,发放佣金\ng1,2026/01,\"1,000\"\n,2026/01,5\ng2,no,5\n")
    log = {r.report_type: r.status for r in FS.ingest_batch(spark, land, root).collect()}
    assert all(v.startswith("written") for v in log.values()) and len(log) == 5, log
    b = table(spark, root, "raw_bonus_report").collect()
    assert [(r["订单号"], r["红利金额"], r["活动名称"], r["_snapshot_month"]) for r in b] == [("A1", 1000.0, "未知", "2026-01")]
    p = table(spark, root, "raw_finance_deposit").first()
    assert (p["订单号"], p["订单金额"]) == ("P1", "2,000")
    c = table(spark, root, "raw_cs_conversations").first()
    assert c["对话内容"] == 'a, "b"\nc' and c["首次响应"] is None and c["_snapshot_month"] == "2026-01" and c["_extracted_issue"] is not None
    k = {r["代理名称"]: (r["佣金比例"], r["佣金"], r["是否在团队"]) for r in table(spark, root, "raw_agent_commission_single").collect()}
    assert k == {"x": (0.05, 1234.0, True), "y": (0.05, None, False)}
    m = table(spark, root, "raw_agent_settlement_monthly").collect()
    assert [(r["代理帐号"], r["月份"], r["发放佣金"]) for r in m] == [("g1", "2026-01", 1000.0)]


def test_columns_in_another_order(spark, tmpdir_path):
    land, root = os.path.join(tmpdir_path, "landing"), os.path.join(tmpdir_path, "tables")
    write(os.path.join(land, "business-report-1.csv"), "日期,注册数,公司输赢,首存人数\n2026-01-01,5,100,2\n")
    write(os.path.join(land, "business-report-2.csv"), "公司输赢,首存人数,日期,注册数\n200,3,2026-01-02,6\n")
    FS.ingest_batch(spark, land, root)
    got = sorted((r["日期"], r["注册数"], r["公司输赢"]) for r in table(spark, root, "raw_platform_report").collect())
    assert got == [("2026-01-01", "5", "100"), ("2026-01-02", "6", "200")]


def test_unreadable_table_aborts(spark, tmpdir_path):
    land, root = os.path.join(tmpdir_path, "landing"), os.path.join(tmpdir_path, "tables")
    write(os.path.join(land, "business-report-1.csv"), "日期,注册数,公司输赢,首存人数\n2026-01-01,5,100,2\n")
    write(os.path.join(root, "raw_platform_report", "_period=p2026-01", "part-0.parquet"), "no parquet")
    log = FS.ingest_batch(spark, land, root).collect()
    assert [r.status[:6] for r in log] == ["failed"]
    assert os.path.exists(os.path.join(root, "raw_platform_report", "_period=p2026-01", "part-0.parquet"))


def test_stream_repeats_what_failed(spark, tmpdir_path):
    import pytest
    land, root, ck = (os.path.join(tmpdir_path, x) for x in ("landing", "tables", "ck"))
    write(os.path.join(land, "business-report-1.csv"), "日期,注册数,公司输赢,首存人数\n2026-01-01,5,100,2\n")
    bad = os.path.join(root, "raw_platform_report", "_period=p2026-01", "part-0.parquet")
    write(bad, "no parquet")
    with pytest.raises(Exception):
        J.file_ingest_stream(spark, land, root, ck).awaitTermination(300)
    os.remove(bad)
    J.file_ingest_stream(spark, land, root, ck).awaitTermination(300)
    assert table(spark, root, "raw_platform_report").count() == 1


def test_stale_months_null_months_and_whole_top_months(spark, tmpdir_path):
    from tallyframe.sources import publish as P
    root = os.path.join(tmpdir_path, "tables")

    def put(name, rows, schema):
        df = spark.createDataFrame(rows, schema).withColumn("_source_file", F.lit("f")) \
            .withColumns({"_split": F.lit(0), "_row": F.monotonically_increasing_id()})
        FS.publish_table(spark, name, df, root)
        return sorted((tuple(r)[:len(rows[0])] for r in table(spark, root, name).drop("_source_file").collect()), key=str)

    day = "`日期` string, v int"
    put("raw_platform_report", [("2026-01", 1), ("2026-01-03", 2), ("2026-02-01", 3)], day)
    untouched = os.path.join(root, "raw_platform_report", "_period=p2026-02")
    before = sorted(os.listdir(untouched))
    assert put("raw_platform_report", [("2026-01-05", 9)], day) == [("2026-01-03", 2), ("2026-01-05", 9), ("2026-02-01", 3)]
    assert sorted(os.listdir(untouched)) == before  # other months are not written
    month = "`月份` string, v int"
    put("raw_winback", [(None, 1), ("2026-01", 2)], month)
    FS.publish_table(spark, "raw_winback", spark.createDataFrame([(None, 5), ("202601", 6)], month).withColumn("_source_file", F.lit("g"))
                     .withColumns({"_split": F.lit(0), "_row": F.lit(1)}), root)
    assert sorted((str(r["月份"]), r["v"]) for r in table(spark, root, "raw_winback").collect()) == [("2026-01", 6), ("None", 1), ("None", 5)]
    top = "`用户名` string, _snapshot_month string, v int"
    put("raw_top_report", [("u1", "2026-01", 1), ("u2", "2026-01", 2)], top)
    assert put("raw_top_report", [("u2", "202601", 3)], top) == [("u2", "2026-01", 3)]
    out = P.delete_published(spark, root, "raw_platform_report", "日期", ["2026-01-05", "2026-02"]).first()
    assert tuple(out) == (2, 1)
    assert [r["日期"] for r in table(spark, root, "raw_platform_report").collect()] == ["2026-01-03"]


def test_a_lost_driver_loses_nothing(spark, tmpdir_path):
    from tallyframe.sources import publish as P
    root = os.path.join(tmpdir_path, "tables")
    staged = os.path.join(root, "_pending", "t", "x")
    spark.createDataFrame([("a", "p2026-01")], "v string, _period string").write.partitionBy("_period").parquet(staged)
    write(os.path.join(root, "_pending", "t", "half", "part-0"), "not finished")
    P.finish_pending(spark, root, "t")
    assert [r.v for r in spark.read.parquet(os.path.join(root, "t")).collect()] == ["a"]
    assert os.listdir(os.path.join(root, "_pending", "t")) == []


def test_workbooks_as_landed_cells(spark, tmpdir_path):
    """CL-25…27 in the job: call records and settlements by month, the last workbook of a month, what has no month or place."""
    import csv

    from tests.test_clean_grids import call_book
    land, root = os.path.join(tmpdir_path, "landing"), os.path.join(tmpdir_path, "tables")
    os.makedirs(land)

    def settled(name, amount):
        rows = [(1, 1, "本月业绩"), (2, 1, amount), (1, 2, "备注"), (2, 2, "n/a"), (4, 3, "实际佣金合计"), (5, 3, "50"), (7, 1, "名称"), (7, 2, "总代"),
                (8, 0, "已回款"), (8, 1, "n1"), (8, 2, "g1"), (8, 3, "1,000"), (8, 6, "退成5%"), (8, 8, "9.5"), (9, 1, "n2"), (9, 2, "g2")]
        return [(name, "4月代理帐", *x) for x in rows]

    def book(file, *cells):
        with open(os.path.join(land, file), "w", encoding="utf-8", newline="") as fh:
            csv.writer(fh).writerows([("source_file", "sheet", "r", "c", "v"), *[x for part in cells for x in part]])

    calls = [tuple(r) for r in call_book(spark, "calls.xlsx").collect()]
    book("a.csv", calls, settled("2026年4月a.xlsx", "100"), settled("2026年4月b.xlsx", "200"), settled("no month.xlsx", "7"),
         [("other.xlsx", "s", 0, 0, "line\nbreak, and comma"), ("other.xlsx", "s", "x", 0, "no place")])
    log = {r.report_type: r for r in FS.ingest_batch(spark, land, root).collect()}
    assert {t: (r.files, r.rows, r.status) for t, r in log.items()} == {
        "workbook_cells": (1, 0, "read"), "workbook": (1, 0, "skipped: unrecognised"), "raw_winback": (1, 2, "written (months)"),
        "raw_agent_settlement_summary": (1, 2, "written (months)"), "raw_agent_settlement_detail": (1, 1, "written (months)")}
    assert log["workbook_cells"].faulty == 1 and log["raw_agent_settlement_detail"].warnings == ["no month found for 1 workbooks"]
    assert sorted((r["专员"], r["月份"], r["七天回登"], r["_source_file"]) for r in table(spark, root, "raw_winback").collect()) == [
        ("Ann", "2026-05", 2, "calls.xlsx"), ("李四", "2026-05", 0, "calls.xlsx")]
    assert sorted((r["项目"], r["金额"], r["月份"]) for r in table(spark, root, "raw_agent_settlement_summary").collect()) == [
        ("实际佣金合计", 50.0, "2026-04"), ("本月业绩", 200.0, "2026-04")]
    d = table(spark, root, "raw_agent_settlement_detail").first()
    assert (d["名称"], d["总代账号"], d["先前挂账业绩"], d["适用待遇"], d["实际佣金"], d["月份"]) == ("n1", "g1", 1000.0, "退成5%", 9.5, "2026-04")
    assert spark.read.parquet(os.path.join(root, "_quarantine", "workbook_cells")).count() == 1
    # a later upload replaces the month that it repeats and adds the other
    os.remove(os.path.join(land, "a.csv"))
    book("b.csv", calls, [tuple(r) for r in call_book(spark, "calls6.xlsx", ("2026-06-01",)).collect()])
    FS.ingest_batch(spark, land, root)
    assert sorted((r["专员"], r["月份"]) for r in table(spark, root, "raw_winback").collect()) == [
        ("Ann", "2026-05"), ("Ann", "2026-06"), ("李四", "2026-05"), ("李四", "2026-06")]


def test_delete_from_tables_of_every_kind(spark, tmpdir_path):
    """IO-16: keyed and per-file tables lose rows by file or value, tables with periods by file too, and rows without a period."""
    from tallyframe.sources import publish as P
    root = os.path.join(tmpdir_path, "tables")

    def put(name, rows, schema):
        FS.publish_table(spark, name, spark.createDataFrame(rows, schema).withColumns({"_split": F.lit(0), "_row": F.monotonically_increasing_id()}), root)

    bonus = "`订单号` string, _snapshot_month string, _source_file string"
    put("raw_bonus_report", [("A1", "2026-01", "f 1.csv"), ("A2", "2026-02", "f 1.csv"), ("A3", None, "f 1.csv")], bonus)
    put("raw_bonus_report", [("A4", "2026-01", "f2.csv")], bonus)
    assert tuple(P.delete_published(spark, root, "raw_bonus_report", "_source_file", ["f2.csv"]).first()) == (1, 0)
    assert tuple(P.delete_published(spark, root, "raw_bonus_report", "_snapshot_month", ["2026-02"], include_null=True).first()) == (2, 1)
    assert [r["订单号"] for r in table(spark, root, "raw_bonus_report").collect()] == ["A1"]
    assert tuple(P.delete_published(spark, root, "raw_bonus_report", "no_such_column", ["x"]).first()) == (0, 0)
    # a deletion that a lost driver left is completed by the next one
    staged = os.path.join(root, "_pending_files", "raw_bonus_report", "x")
    old = [r.f for r in spark.read.parquet(os.path.join(root, "raw_bonus_report")).select(F.col("_metadata.file_path").alias("f")).distinct().collect()]
    spark.createDataFrame([("A9", "2026-01", "f9")], bonus).write.parquet(os.path.join(staged, "rows"))
    spark.createDataFrame([(f,) for f in old], "f string").write.parquet(os.path.join(staged, "replaced"))
    P.finish_pending(spark, root, "raw_bonus_report")
    assert [r["订单号"] for r in spark.read.parquet(os.path.join(root, "raw_bonus_report")).collect()] == ["A9"]
    month = "`月份` string, v int, _source_file string"
    put("raw_winback", [(None, 1, "f1"), ("2026-01", 2, "f1"), ("2026-02", 3, "f2")], month)
    assert tuple(P.delete_published(spark, root, "raw_winback", "月份", [], include_null=True).first()) == (1, 0)
    assert tuple(P.delete_published(spark, root, "raw_winback", "_source_file", ["f2"]).first()) == (1, 0)
    assert [r["v"] for r in table(spark, root, "raw_winback").collect()] == [2]
