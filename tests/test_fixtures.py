"""Edge-case fixtures of FIXTURES.md §3: snapshots/retention, 8-day slots, arbitrage boundaries,
payments, time-to-first-deposit bands."""

import datetime as dt

from pyspark.sql import functions as F

from tallyframe.operators import member as M
from tallyframe.operators import newreg as NR
from tallyframe.operators import payments as PY
from tallyframe.operators import realtime as RT

SNAP = "account string, agent string, snapshot_month string, deposits double, turnover double, " \
       "first_deposit_at timestamp_ntz"


def ts(s):
    return dt.datetime.fromisoformat(s)


def test_snapshots_retention(spark):
    rows = [
        ("a", "g1", "2026-01", 10.0, 0.0, ts("2026-01-05 00:00:00")),   # first deposit in Jan
        ("a", "g1", "2026-02", 0.0, 5.0, ts("2026-01-05 00:00:00")),    # active (turnover) in Feb
        ("a", "g2", "2026-01", 0.0, 0.0, None),                          # same account, other agent: inactive
        ("b", None, "2026-01", 3.0, 0.0, ts("2025-12-01 00:00:00")),    # NULL agent, first deposit outside Jan
        ("b", None, "2026-02", 4.0, 0.0, ts("2025-12-01 00:00:00")),
        ("c", "g1", "2026-01", 1.0, 1.0, None),
        ("c", "g1", "2026-04", 1.0, 1.0, None),                          # March missing
    ]
    m = spark.createDataFrame(rows, SNAP)
    r = {x.month: x for x in M.monthly_retention(m).collect()}
    assert set(r) == {"2026-01", "2026-02"}  # months with a next *available* month
    jan = r["2026-01"]
    assert jan.next_month == "2026-02" and jan.active_members == 3 and abs(jan.active_retention - 2 / 3) < 1e-12
    assert jan.deposit_members == 3 and abs(jan.deposit_retention - 1 / 3) < 1e-12
    assert jan.first_members == 1 and jan.first_retention == 1.0
    feb = r["2026-02"]
    assert feb.next_month == "2026-04" and feb.active_retention == 0.0
    cal = {x.month: x.next_month for x in M.monthly_retention(m, calendar=True).collect()}
    assert cal == {"2026-01": "2026-02"}  # no calendar next month for Feb / Apr
    k = M.member_kpis(m.withColumn("first_deposit", F.when(F.col("first_deposit_at").isNotNull(), F.lit(5.0)))
                       .withColumn("company_income", F.lit(1.0))).first()
    assert k.members == 4 and k.first_depositors == 2  # (a,g1),(a,g2),(b,NULL),(c,g1); deduped per member


def test_slots_8days(spark):
    base = [("2026-01-0%d %d~%d" % (d, h, h + 1), "x", 1, 100.0, 100.0, 0.0) for d in range(1, 8) for h in (1, 2, 3)]
    latest = [("2026-01-08 1~2", "x", 1, 120.0, 120.0, 0.0),   # exactly +20 % -> spike
              ("2026-01-08 2~3", "x", 1, 80.0, 80.0, 0.0),     # exactly -20 % -> drop
              ("2026-01-08 3~4", "x", 1, 110.0, 110.0, 0.0),   # normal
              ("2026-01-08 5~6", "x", 1, 50.0, 50.0, 0.0)]     # no baseline -> not reported
    zero = [("2026-01-07 9~10", "x", 1, 0.0, 0.0, 0.0), ("2026-01-08 9~10", "x", 1, 5.0, 5.0, 0.0)]  # baseline 0
    s = spark.createDataFrame(base + latest + zero,
                              "raw_time string, type string, slot_bettors long, stake double, turnover double, company_win double")
    out = {r.slot: r.flag for r in RT.slot_anomaly(s).collect()}
    assert out == {"1~2": "spike", "2~3": "drop", "3~4": "normal"}


def test_arbitrage_boundaries(spark):
    rows = [("a", "g", 1_000_000.0, 4_000.0, 6_000.0, 4_000.0),      # turnover not > 1e6
            ("b", "g", 1_000_000.01, 4_999.0, 6_000.0, 4_000.01),   # all three just beyond -> flagged
            ("c", "g", 2_000_000.0, 10_000.0, 6_000.0, 5_000.0),    # |win|/turnover = 0.005 -> not < 0.005
            ("d", "g", 2_000_000.0, 1.0, 5_000.0, 5_000.0),         # bonus+rebate = 10,000 -> not > 10,000
            ("e", "g", 0.0, 0.0, 20_000.0, 0.0)]                    # turnover 0
    r = spark.createDataFrame(rows, "account string, agent string, turnover double, company_win double, bonus double, rebate double") \
             .withColumn("tags", F.lit(None).cast("string"))
    flags = {x.account: x.arbitrage for x in M.arbitrage_flag(r).collect()}
    assert flags == {"a": False, "b": True, "c": False, "d": False, "e": False}
    ratios = {x.account: x.give_pct for x in M.member_ratios(r).collect()}
    assert ratios["e"] == 2_000_000.0  # divisor 0 -> 1


def test_payments_fixture(spark):
    rows = []
    for i in range(20):  # channel A: 20 rows, 60 % success -> not low
        rows.append((f"A{i}", "u", "A", "存款成功" if i < 12 else "已取消", None, 1.0, ts("2026-01-01 00:00:00"),
                     ts("2026-01-01 00:10:00") if i < 12 else None))
    for i in range(19):  # channel B: 19 rows, 0 % success -> below the volume floor
        rows.append((f"B{i}", "u", "B", "已取消", "nan", 1.0, ts("2026-01-01 00:00:00"), None))
    rows.append(("C0", "u", "C", "存款成功", "", 1.0, ts("2026-01-01 01:00:00"), ts("2026-01-01 00:00:00")))  # negative wait
    dep = spark.createDataFrame(rows, "order_no string, account string, channel string, status string, cancel_reason string, "
                                      "amount double, ordered_at timestamp_ntz, completed_at timestamp_ntz")
    k = PY.deposit_kpis(dep).first()
    assert k.orders == 40 and abs(k.avg_minutes - 10.0) < 1e-9  # the negative wait is excluded
    assert PY.low_success_channels(dep, 20, 0.6).count() == 0
    assert PY.cancel_reasons(dep).count() == 0  # blank / 'nan' reasons removed
    wd = dep.withColumnRenamed("ordered_at", "applied_at").withColumn(
        "status", F.when(F.col("status") == "存款成功", "提款成功").otherwise("审核拒绝"))
    w = PY.withdraw_kpis(wd).first()
    assert w.median_minutes == 10.0 and w.p90_minutes == 10.0 and w.slow_count == 0


def test_ttf_bands(spark):
    rows = [("a", None, ts("2026-01-01 00:00:00"), ts("2026-01-01 00:00:00"), 10.0),   # 0 h
            ("b", None, ts("2026-01-01 00:00:00"), ts("2026-01-01 01:00:00"), 10.0),   # 1 h
            ("c", None, ts("2026-01-01 00:00:00"), ts("2026-01-02 00:00:00"), 10.0),   # 24 h
            ("d", None, ts("2026-01-01 00:00:00"), ts("2026-01-08 00:00:00"), 10.0),   # 168 h
            ("e", None, ts("2026-01-02 00:00:00"), ts("2026-01-01 00:00:00"), 10.0),   # negative -> no TTF
            ("f", None, ts("2026-01-01 00:00:00"), None, None)]                        # no deposit
    m = spark.createDataFrame(rows, "account string, agent string, registered_at timestamp_ntz, "
                                    "first_deposit_at timestamp_ntz, first_deposit double") \
             .withColumn("snapshot_month", F.lit("2026-01")).withColumn("company_income", F.lit(0.0))
    nr = NR.prepare_newreg(m)
    bands = {r.band: r.members for r in NR.ttf_bands(nr).collect()}
    assert bands == {"<1h": 1, "1-24h": 1, "1-7d": 1, ">7d": 1}
    st = NR.ttf_stats(nr).first()
    assert st.median_ttf_hours == 12.5 and st.with_ttf == 4 and st.share_under_1h == 0.25
