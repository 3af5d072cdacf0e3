"""Write-discipline properties: idempotence, untouched periods unchanged, no duplicate keys, row accounting."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyframe.sources import publish as P

DAYS = [f"2026-01-{d:02d}" for d in range(1, 8)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "date string, v long")


@settings(max_examples=8, deadline=None)
@given(existing=st.lists(st.tuples(st.sampled_from(DAYS + ["2026-01"]), st.integers(0, 9)), max_size=12),
       new=st.lists(st.tuples(st.sampled_from(DAYS), st.integers(0, 9)), max_size=6))
def test_replace_by_dates_properties(spark, existing, new):
    ex, nb = frame(spark, existing), frame(spark, new)
    once = P.replace_by_dates(nb, ex, "date")
    twice = P.replace_by_dates(nb, once, "date")
    assert sorted(once.collect()) == sorted(twice.collect())  # idempotent
    touched = set(r[0] for r in new) | ({"2026-01"} if new else set())
    kept_before = sorted(r for r in existing if r[0] not in touched)
    kept_after = sorted(tuple(r) for r in once.collect() if r[0] not in touched)
    assert kept_before == kept_after  # untouched periods unchanged
    assert once.count() == len(kept_before) + len(new)  # total = kept + written


def test_replace_stale_month_and_no_date_col(spark):
    ex = frame(spark, [("2026-01", 1), ("2026-01-03", 2), ("2026-02-01", 3)])
    nb = frame(spark, [("2026-01-05", 9)])
    out = sorted(tuple(r) for r in P.replace_by_dates(nb, ex, "date").collect())
    assert out == [("2026-01-03", 2), ("2026-01-05", 9), ("2026-02-01", 3)]
    assert P.replace_by_dates(nb, ex, None).count() == 4


def test_merge_snapshot(spark):
    ex = spark.createDataFrame([("2026-05", "a", "g1", 1), ("2026-05", "b", None, 2), ("2026-05", "c", "g1", 3),
                                ("2026-04", "a", "g1", 4)], "snapshot_month string, account string, agent string, v long")
    nb = spark.createDataFrame([("202605", "a", "g1", 10), ("202605", "b", None, 20), ("202605", "b", None, 21),
                                ("202605", "d", "g2", 30)], "snapshot_month string, account string, agent string, v long")
    out = sorted((r.snapshot_month, r.account, r.v) for r in P.merge_snapshot(nb, ex).collect())
    assert out == [("2026-04", "a", 4), ("2026-05", "a", 10), ("2026-05", "b", 21), ("2026-05", "c", 3), ("2026-05", "d", 30)]
    again = P.merge_snapshot(nb, P.merge_snapshot(nb, ex))
    assert sorted((r.snapshot_month, r.account, r.v) for r in again.collect()) == out
    whole = P.merge_snapshot(nb.drop("account", "agent"), ex.drop("account", "agent"))
    assert sorted(r.v for r in whole.collect()) == [4, 10, 20, 21, 30]


def test_append_new_keys_and_refresh(spark):
    ex = spark.createDataFrame([("1", 5.0), ("2", 6.0)], "order_no string, amount double")
    nb = spark.createDataFrame([("2", 1.0), ("3", 2.0), ("3", 1.0)], "order_no string, amount double")
    app = P.append_new_keys(nb, ex, "order_no", ["amount"]).collect()
    assert [(r.order_no, r.amount) for r in app] == [("3", 1.0)]
    m_ex = spark.createDataFrame([("2026-01", 1), ("2026-02", 2)], "m string, v long")
    m_nb = spark.createDataFrame([("202602", 9)], "m string, v long")
    assert sorted(tuple(r) for r in P.refresh_months(m_nb, m_ex, "m").collect()) == [("2026-01", 1), ("2026-02", 9)]


def test_loss_guard_and_delete(spark):
    ex = spark.createDataFrame([("2026-01", 1), ("2026-02", 2), (None, 3)], "m string, v long")
    bad = ex.where(~F.col("m").eqNullSafe("2026-01"))  # drop one period; keep the NULL one
    touched = spark.createDataFrame([("2026-02",)], "p string")
    assert P.untouched_mismatches(ex, bad, "m", touched).count() == 1
    P.assert_untouched(ex, ex, "m", touched)
    assert P.delete_periods(ex, "m", [], include_null=True).count() == 2
    assert [tuple(r) for r in P.delete_report(ex, "m", ["2026-01"]).collect()] == [(1, 2)]
    lp = {r.period: r.rows for r in P.list_periods(ex, "m").collect()}
    assert lp["(空)"] == 1


def test_exact_quantiles_match_percentile(spark):
    import random

    from tallyframe.operators.quantiles import exact_quantiles
    random.seed(7)
    rows = [(random.choice("ab"), random.choice([random.random() * 50, 3.0, float(random.randint(0, 2))]))
            for _ in range(5000)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: (r.q_0_5, r.q_0_9) for r in exact_quantiles(df, "v", [0.5, 0.9], group="g").collect()}
    ref = {r.g: (r.m, r.p) for r in df.groupBy("g").agg(F.percentile("v", 0.5).alias("m"),
                                                        F.percentile("v", 0.9).alias("p")).collect()}
    for k in ref:
        assert abs(got[k][0] - ref[k][0]) < 1e-9 and abs(got[k][1] - ref[k][1]) < 1e-9


def test_exact_quantiles_of_wide_and_odd_values(spark):
    import random

    from tallyframe.operators.quantiles import exact_quantiles
    rnd = random.Random(1)
    wide = [10.0 ** rnd.uniform(-300, 200) * rnd.choice((1, 1, -1)) for _ in range(3000)]
    wide += [0.0, -0.0, 5e-324, -5e-324, 2.0 ** -1022, 1.0, 2.0, 4.0, 1 - 2.0 ** -53, 1 + 2.0 ** -52] * 3
    near = [3.0 + k * 2.0 ** -51 for k in range(500)] * 2
    groups = {"wide": wide, "near": near, "huge": [1.7e308, 1.7e308, -1.7e308, -1.7e308], "one": [7.5], "inf": [float("inf"), 1.0, float("-inf")],
              "none": [None, float("nan")], None: [1.0, 2.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in exact_quantiles(df, "v", [0.0, 0.25, 0.5, 0.9, 1.0], group="g", extra={"rows": F.count(F.lit(1))}).collect()}
    assert len(got) == len(groups) and all(got[g]["rows"] == len(vs) for g, vs in groups.items())
    for g, vs in groups.items():
        vs = sorted(v for v in vs if v is not None and v == v)
        for q in (0.0, 0.25, 0.5, 0.9, 1.0):
            mine = got[g][f"q_{str(q).replace('.', '_')}"]
            if not vs:
                assert mine is None
                continue
            pos = q * (len(vs) - 1)
            a, b = vs[int(pos)], vs[min(int(pos) + 1, len(vs) - 1)]
            part = pos - int(pos)
            want = a if a == b else a * (1 - part) + b * part if abs(b - a) == float("inf") else a + (b - a) * part
            assert mine == want or (mine != mine and want != want), (g, q, mine, want)
    empty = exact_quantiles(df.limit(0), "v", [0.5], extra={"rows": F.count(F.lit(1))}).collect()
    assert [tuple(r) for r in empty] == [(None, 0)]


def test_quantile_plans_run_no_job(spark):
    from tallyframe.operators.quantiles import exact_quantiles
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    df = spark.range(1000).select(F.col("id").cast("double").alias("v"))
    sc.setJobGroup("plan", "plan")
    out = exact_quantiles(df, "v", [0.5, 0.9])
    assert not tracker.getJobIdsForGroup("plan")
    sc.setJobGroup("run", "run")
    assert tuple(out.first()) == (499.5, 899.1)


def test_replace_batches_edge_cases(spark, tmpdir_path):
    from tallyframe.sources.files import read_raw
    ex = frame(spark, [("2026-01-01", 1), ("2026-01-02", 2)])
    nb = spark.createDataFrame([("2026-01-02", 9, "new")], "date string, v long, extra string")
    out = sorted((r.date, r.v, r.extra) for r in P.replace_by_dates(nb, ex, "date").collect())
    assert out == [("2026-01-01", 1, None), ("2026-01-02", 9, "new")]  # new column appears, NULL elsewhere
    empty = frame(spark, [])
    assert sorted(tuple(r) for r in P.replace_by_dates(empty, ex, "date").collect()) == [("2026-01-01", 1), ("2026-01-02", 2)]
    missing = read_raw(spark, "raw_not_there", ex.schema, tmpdir_path)
    assert missing.count() == 0 and missing.columns == ["date", "v"]
    assert P.replace_by_dates(nb, missing, "date").count() == 1


def rows_read(df):
    """Rows that the scans of an executed plan gave out."""
    df._jdf.collectToPython()
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


def test_uploads_read_only_the_key_ranges_they_have(spark, tmpdir_path):
    """IO-11, ST-03: a table of three days of orders is skipped by statistics; late keys make a range of their own; the rows stay right."""
    path = f"{tmpdir_path}/orders"
    for day in (1, 2, 3):
        orders = spark.range(4000).select(F.format_string(f"2026010{day}%06d", "id").alias("order_no"), F.lit(day).alias("v"))
        assert P.append_keyed(orders.orderBy(F.rand(1)), path, "order_no") == 4000
    table = spark.read.parquet(path)
    late = [("20260101000007", 9), ("20260104000001", 9), ("20260104000002", 9), ("20260104000002", 8), (None, 9)]
    new = spark.createDataFrame(late, "order_no string, v int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        near = P.within_key_runs(table, new, "order_no")
        assert 0 < rows_read(near) <= 4000 < table.count()
        none = P.within_key_runs(table, new.where("order_no > '20260102'"), "order_no")
        assert rows_read(none) == 0
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    whole = P.append_new_keys(new, table, "order_no").collect()
    assert sorted(map(str, P.append_new_keys(new, near, "order_no").collect())) == sorted(map(str, whole))
    assert sorted((str(r.order_no), r.v) for r in whole) == [("20260104000001", 9), ("20260104000002", 8), ("None", 9)]
    # more runs than the bound: one range; no key at all: no row
    many = spark.range(0, 100).select(F.format_string("%08d-x", "id").alias("order_no"), F.lit(1).alias("v"))
    assert P.within_key_runs(many, many, "order_no").count() == 100
    assert P.within_key_runs(table, new.where("order_no IS NULL"), "order_no").count() == 0
    assert P.within_key_runs(table, new.limit(0), "order_no").count() == 0
    numbers = spark.range(50).withColumnRenamed("id", "order_no")  # keys compare as texts
    assert {r.order_no for r in P.within_key_runs(numbers, numbers.where("order_no IN (5, 41)"), "order_no").collect()} == {5, 41}


def test_the_guard_reads_the_staged_copy(spark, tmpdir_path, monkeypatch):
    """IO-17: a publish that would lose an untouched day stops before the table changes, and leaves nothing to take up again."""
    import os

    import pytest

    from tallyframe.sources import files as FS
    root = f"{tmpdir_path}/tables"
    schema = "`日期` string, v int"

    def put(rows):
        new = spark.createDataFrame(rows, schema).withColumns({"_split": F.lit(0), "_row": F.monotonically_increasing_id(), "_source_file": F.lit("f")})
        return FS.publish_table(spark, "raw_platform_report", new, root)

    def held():
        return sorted((r["日期"], r["v"]) for r in FS.read_raw(spark, "raw_platform_report", root=root).collect())

    put([("2026-01-01", 1), ("2026-01-02", 2), ("2026-02-01", 3)])
    right = P.replace_by_dates
    monkeypatch.setattr(P, "replace_by_dates", lambda new, old, c: right(new, old.where(F.col(c) != "2026-01-01"), c))
    with pytest.raises(RuntimeError, match="loss guard"):
        put([("2026-01-02", 9)])
    assert held() == [("2026-01-01", 1), ("2026-01-02", 2), ("2026-02-01", 3)]
    assert os.listdir(f"{root}/_pending/raw_platform_report") == []
    monkeypatch.undo()
    put([("2026-01-02", 9)])
    assert held() == [("2026-01-01", 1), ("2026-01-02", 9), ("2026-02-01", 3)]
    # a copy that was staged but not yet guarded never counted
    spark.createDataFrame([("2026-01-01", 7, "p2026-01")], "`日期` string, v int, _period string").write.partitionBy("_period").parquet(
        f"{root}/_pending/raw_platform_report/x")
    os.remove(f"{root}/_pending/raw_platform_report/x/_SUCCESS")
    P.finish_pending(spark, root, "raw_platform_report")
    assert held()[0] == ("2026-01-01", 1)
    P.publish_partitions(spark.createDataFrame([], "`日期` string, v int, _period string"), root, "raw_platform_report")
    assert len(held()) == 3


def test_crosstab_groups_top_names_only(spark):
    """AG-112: ties, NULLs, sums, empty input, k beyond the names; against a plain computation."""
    from collections import Counter

    from tallyframe.operators.common import crosstab_top
    rows = [(f"a{i % 7}" if i % 11 else None, f"b{i % 5}" if i % 13 else None, i % 4) for i in range(300)]
    df = spark.createDataFrame(rows, "a string, b string, v int")

    def want(k, weigh):
        ta, tb, pairs = Counter(), Counter(), Counter()
        for a, b, v in rows:
            ta[a] += weigh(v)
            tb[b] += weigh(v)
            pairs[a, b] += weigh(v)

        def top(c):
            return {x for x, _ in sorted(c.items(), key=lambda e: (-e[1], e[0] is not None, e[0] or ""))[:k]} - {None}
        return {p: float(n) for p, n in pairs.items() if p[0] in top(ta) and p[1] in top(tb)}

    for k in (1, 3, 50):
        got = {(r.a, r.b): r.value for r in crosstab_top(df, "a", "b", k=k).collect()}
        assert got == want(k, lambda v: 1)
        got = {(r.a, r.b): r.value for r in crosstab_top(df, "a", "b", "v", k, "sum").collect()}
        assert got == want(k, lambda v: v)
    assert crosstab_top(df.limit(0), "a", "b").count() == 0
