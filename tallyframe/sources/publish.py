"""Idempotent publish disciplines (IO-08…17) as pure ``new x existing -> combined`` plans,
plus thin writers that publish only the touched partitions.

Every discipline is a ``left_anti`` join of the existing table against the (small,
calendar-bounded) set of periods / keys in the new batch, unioned with the batch:

* keys of a date replace are distinct day / month strings  -> bounded by the calendar,
  safe to broadcast;
* keys of a snapshot merge or an order append are member / order keys -> they grow with
  the data, so they are joined with a normal shuffle join (AQE turns it into a broadcast
  at runtime only when the batch really is small);
* on a table partitioned by the period column the writer uses dynamic partition
  overwrite, so only the touched partitions are rewritten (never the whole table).

``assert_untouched`` is the loss guard: per-period row counts of periods the batch does
not touch must be identical before and after.  The writer holds it against the staged copy, from
the period column alone, before the copy counts.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.exprs import LBL_BLANK, month_key
from ..operators.dedupe import keep_first, keep_last

# fixed values: candidate date columns, in priority order
DATE_COLS = ("日期", "时间", "订单时间", "申请时间", "date", "ordered_at", "applied_at")


def choose_date_col(df: DataFrame, candidates: Sequence[str] = DATE_COLS) -> str | None:
    """CL-34: first candidate date column present in the frame."""
    for c in candidates:
        if c in df.columns:
            return c
    return None


def date_keys(df: DataFrame, date_col: str) -> DataFrame:
    """CL-34: distinct 10-character day keys of a batch (blank / 'nan' / 'None' dropped)."""
    k = F.substring(F.col(date_col).cast("string"), 1, 10)
    return df.select(k.alias("k")).where(F.col("k").isNotNull() & ~F.col("k").isin("", "nan", "None")).distinct()


def only_new_files(new: DataFrame, existing: DataFrame, file_col: str = "_source_file") -> DataFrame:
    """IO-09: rows of files not loaded yet: a file counts as loaded when the table holds the exact
    path, the same base name, or a path ending with '/<base name>' (SC-06)."""
    # an equal path, or a path that ends with '/<base name>', has an equal base name: one equality covers
    # all three tests, so this is a plain anti-join on the base name
    base = F.regexp_extract(F.col(file_col), r"[^/]+$", 0)
    have = existing.where(F.col(file_col).isNotNull()).select(base.alias("__b")).distinct()
    return new.withColumn("__nb", base).join(have, F.col("__nb") == F.col("__b"), "left_anti").drop("__nb")


def union_evolving(existing: DataFrame, new: DataFrame) -> DataFrame:
    """IO-08 / SO-01: union by name, columns missing on either side filled with NULL."""
    return existing.unionByName(new, allowMissingColumns=True)


def append_new_keys(new: DataFrame, existing: DataFrame, key: str, order: Sequence[str] | None = None,
                    unique: bool = False) -> DataFrame:
    """IO-11: rows of the batch whose key (compared as text) is not in the table yet. [JN-08]

    The batch is first deduplicated on the key keeping the first row by ``order`` (CL-17), unless it is ``unique`` already.
    """
    batch = new if unique else keep_first(new, [key], list(order) if order else [c for c in new.columns if c != key])
    k = F.col(key).cast("string")
    have = existing.select(k.alias("__k")).where(F.col("__k").isNotNull()).distinct()
    return batch.join(have, batch[key].cast("string") == have["__k"], "left_anti")


#: Characters that tell runs of keys apart, and how many runs a batch may have before one range stands for all.
RUN_PREFIX = 8
MAX_RUNS = 64


def within_key_runs(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """IO-11: the rows of the table whose key may be in the batch, by literal ranges that prune files and row groups.

    Keys that begin alike (order numbers carry their day) are one run, from its least to its greatest key; a batch of more
    than ``MAX_RUNS`` runs is one run.  The ranges only leave out keys that the batch cannot hold, so any table and any batch
    is right; how much is skipped rests on how the keys lie in the files (``append_keyed`` keeps them in order).
    Only the batch is read, and at most ``MAX_RUNS`` + 1 rows reach the driver.  A batch without keys needs no row."""
    k = F.col(key).cast("string")
    batch = new.select(k.alias("k")).where(F.col("k").isNotNull())
    ends = [F.min("k").alias("lo"), F.max("k").alias("hi")]
    runs = batch.groupBy(F.substring("k", 1, RUN_PREFIX)).agg(*ends).select("lo", "hi").limit(MAX_RUNS + 1).collect()
    if len(runs) > MAX_RUNS:
        runs = batch.agg(*ends).collect()
    inside = F.lit(False)
    for r in runs:
        inside = inside | k.between(r["lo"], r["hi"])
    return existing.where(inside)


def append_keyed(df: DataFrame, path: str, key: str) -> int:
    """IO-11 writer: append with the keys in order, one range of keys to a file, so that later uploads skip by statistics;
    returns the rows written."""
    return append_counted(df.repartitionByRange(F.col(key)).sortWithinPartitions(key), path)


def append_counted(df: DataFrame, path: str) -> int:
    """IO-08: append, and the number of rows, which the write itself counts."""
    rows = Observation()
    append_evolving(df.observe(rows, F.count(F.lit(1)).alias("n")), path)
    return rows.get["n"]


def append_new_keys_combined(new: DataFrame, existing: DataFrame, key: str, order: Sequence[str] | None = None) -> DataFrame:
    return union_evolving(existing, append_new_keys(new, existing, key, order))


def replace_by_dates(new: DataFrame, existing: DataFrame, date_col: str | None) -> DataFrame:
    """IO-12: drop existing rows whose day is in the batch, plus stale whole-month rows ('YYYY-MM') [JN-08]
    of the batch's months; keep the rest; append the batch.  No date column -> plain append."""
    if date_col is None or date_col not in new.columns:
        return union_evolving(existing, new)
    days = date_keys(new, date_col)
    months = days.select(F.substring("k", 1, 7).alias("k")).distinct()
    keys = days.unionByName(months)  # calendar-bounded
    t = F.col(date_col).cast("string")
    ekey = F.when(t.rlike(r"^\d{4}-\d{2}$"), t).otherwise(F.substring(t, 1, 10))
    kept = existing.join(keys, ekey == F.col("k"), "left_anti")
    return union_evolving(kept, new)


def replace_report(new: DataFrame, existing: DataFrame, date_col: str) -> DataFrame:
    """IO-12 report: (range start, range end, removed, written, total) as one row."""
    combined = replace_by_dates(new, existing, date_col)
    k = F.substring(F.col(date_col).cast("string"), 1, 10)
    r = new.agg(F.min(k).alias("range_start"), F.max(k).alias("range_end"), F.count(F.lit(1)).alias("written"))
    e = existing.agg(F.count(F.lit(1)).alias("before"))
    c = combined.agg(F.count(F.lit(1)).alias("total"))
    return r.crossJoin(e).crossJoin(c).select("range_start", "range_end",
                                              (F.col("before") + F.col("written") - F.col("total")).alias("removed"),
                                              "written", "total")


def merge_snapshot(new: DataFrame, existing: DataFrame, month_col: str = "snapshot_month",
                   keys: Sequence[str] = ("account", "agent"), order: Sequence[str] | None = None) -> DataFrame:
    """IO-13: snapshot merge.  Months are normalised (YYYYMM -> YYYY-MM) on both sides; the batch is [JN-08]
    deduplicated per (month, key) keeping the last row; existing rows of the batch months whose
    key is in the batch are replaced, other rows of those months are kept, other months are
    untouched.  Without key columns the batch months are replaced whole.  Keys compare NULL-safe."""
    nb = new.withColumn(month_col, month_key(month_col))
    ex = existing.withColumn(month_col, month_key(month_col))
    present = [k for k in keys if k in nb.columns]
    if not present:
        months = nb.select(F.col(month_col).alias("__m")).distinct()
        return union_evolving(ex.join(months, F.col(month_col) == F.col("__m"), "left_anti"), nb)
    nb = keep_last(nb, [month_col, *present], list(order) if order else [c for c in nb.columns
                                                                        if c not in (month_col, *present)])
    nk = nb.select(*[F.col(c).alias(f"__n_{c}") for c in (month_col, *present)]).distinct()
    cond = None
    for c in (month_col, *present):
        e = ex[c].eqNullSafe(nk[f"__n_{c}"])
        cond = e if cond is None else cond & e
    kept = ex.join(nk, cond, "left_anti")
    return union_evolving(kept, nb)


def refresh_months(new: DataFrame, existing: DataFrame, month_col: str) -> DataFrame:
    """IO-14: drop every existing row of the batch's months, append the batch; a NULL month in the batch
    replaces nothing. [JN-08]"""
    nb = new.withColumn(month_col, month_key(month_col))
    ex = existing.withColumn(month_col, month_key(month_col))
    months = nb.select(month_col).distinct()  # calendar-bounded
    return union_evolving(ex.join(months.select(F.col(month_col).alias("__m")), F.col(month_col) == F.col("__m"), "left_anti"), nb)


def list_periods(df: DataFrame, key: str | None, file_col: str = "_source_file") -> DataFrame:
    """IO-15: periods with row counts (period column, else source file); NULL shown as '(空)'."""
    k = key if key and key in df.columns else file_col
    return df.groupBy(F.coalesce(F.col(k).cast("string"), F.lit(LBL_BLANK)).alias("period")) \
             .agg(F.count(F.lit(1)).alias("rows")).orderBy(F.col("period").desc())


def delete_periods(existing: DataFrame, key: str, periods: Sequence[str], include_null: bool = False) -> DataFrame:
    """IO-16: table without the chosen periods (NULL period removable explicitly)."""
    c = F.col(key).cast("string")
    gone = c.isin([str(p) for p in periods])
    if include_null:
        gone = gone | F.col(key).isNull()
    return existing.where(~F.coalesce(gone, F.lit(False)))


def delete_report(existing: DataFrame, key: str, periods: Sequence[str], include_null: bool = False) -> DataFrame:
    """IO-16 report: removed and remaining rows."""
    kept = delete_periods(existing, key, periods, include_null)
    a = existing.agg(F.count(F.lit(1)).alias("before"))
    b = kept.agg(F.count(F.lit(1)).alias("remaining"))
    return a.crossJoin(b).select((F.col("before") - F.col("remaining")).alias("removed"), "remaining")


def untouched_mismatches(existing: DataFrame, combined: DataFrame, key: str, touched: DataFrame) -> DataFrame:
    """IO-17: per-period row counts of periods NOT in ``touched`` (one column ``period``) that differ
    between ``existing`` and ``combined``; empty means nothing outside the batch was lost."""
    def counts(df, name):
        return df.groupBy(F.col(key).cast("string").alias("period")).agg(F.count(F.lit(1)).alias(name))
    a, b = counts(existing, "before"), counts(combined, "after")
    j = a.join(b, a.period.eqNullSafe(b.period), "full_outer").select(
        F.coalesce(a.period, b.period).alias("period"), F.coalesce("before", F.lit(0)).alias("before"),
        F.coalesce("after", F.lit(0)).alias("after"))
    t = touched.select(F.col(touched.columns[0]).cast("string").alias("period")).distinct()
    j = j.join(t, j.period.eqNullSafe(t.period), "left_anti")
    return j.where(F.col("before") != F.col("after"))


def assert_untouched(existing: DataFrame, combined: DataFrame, key: str, touched: DataFrame) -> None:
    """IO-17: raise (abort the publish) when an untouched period changed row count."""
    bad = untouched_mismatches(existing, combined, key, touched)
    if not bad.isEmpty():
        raise RuntimeError(f"loss guard: untouched periods changed: {bad.limit(20).collect()}")


def touched_days(new: DataFrame, date_col: str) -> DataFrame:
    """IO-17: the periods a date replace may change: the batch's days and their months (stale 'YYYY-MM' rows)."""
    days = date_keys(new, date_col)
    return days.unionByName(days.select(F.substring("k", 1, 7).alias("k"))).distinct()


# ---------------------------------------------------------------- writers (IO-08, IO-10, IO-19)

#: Partition column of published tables: 'p' + month, or NO_PERIOD.
PERIOD = "_period"
NO_PERIOD = "none"


def period_of(c) -> "F.Column":
    """Partition of a day or month text: its month ('p' keeps it a text when partitions are read back)."""
    m = F.substring(c, 1, 7)
    return F.when(m.rlike(r"^\d{4}-\d{2}$"), F.concat(F.lit("p"), m)).otherwise(F.lit(NO_PERIOD))


def _fs(spark, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def remove(spark, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def finish_pending(spark, root: str, table: str) -> None:
    """Complete publishes that a lost driver left: a staged copy with its success marker is put into the
    table again (the same partitions, so twice is as once); one without it never counted.  Deletions from
    tables without periods are completed likewise (``_finish_rewrite``)."""
    _finish_rewrite(spark, root, table)
    fs, base = _fs(spark, f"{root.rstrip('/')}/_pending/{table}")
    if not fs.exists(base):
        return
    for status in fs.listStatus(base):
        staged = status.getPath().toString()
        if fs.exists(_fs(spark, f"{staged}/{WHOLE}")[1]):
            _put(spark, staged, f"{root.rstrip('/')}/{table}")
        fs.delete(status.getPath(), True)


#: Marker of a staged copy that is whole and has passed its guard; the write itself leaves none.
WHOLE = "_SUCCESS"


def _put(spark, staged: str, path: str) -> None:
    write_partitions(spark.read.parquet(staged), path, PERIOD)


def publish_partitions(df: DataFrame, root: str, table: str, guard: Callable[[DataFrame], None] | None = None) -> None:
    """Replace the partitions present in ``df`` (column ``_period``) and no others; a frame without rows replaces none.

    The new partitions are staged whole before the table is touched, ``guard`` reads the staged copy and may raise, and
    only then is the copy marked as one that counts.  It stays until the table holds it, so a crash at any point
    loses nothing: ``finish_pending`` repeats the last step, and an unmarked copy never counted.
    """
    spark = df.sparkSession
    staged = f"{root.rstrip('/')}/_pending/{table}/{uuid.uuid4().hex}"
    df = df.hint("rebalance", PERIOD)  # a task holds few months, and a large month is dealt to several, so files stay few
    df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").partitionBy(PERIOD).parquet(staged)
    fs, p = _fs(spark, staged)
    copy = spark.read.schema(df.schema).parquet(staged)
    try:
        if guard is not None:
            guard(copy)
    except RuntimeError:
        fs.delete(p, True)
        raise
    if not copy.isEmpty():
        fs.create(_fs(spark, f"{staged}/{WHOLE}")[1]).close()
        _put(spark, staged, f"{root.rstrip('/')}/{table}")
    fs.delete(p, True)


def _told(key: str, periods: Sequence[str], include_null: bool):
    """Rows of the chosen periods: a day or month also stands for its longer texts, other values for themselves only;
    with ``include_null`` rows without one (NULL, blank, 'nan', 'None') too."""
    k = F.col(f"`{key}`").cast("string")
    gone = F.lit(False)
    for p in map(str, periods):
        gone = gone | (k.startswith(p) if re.fullmatch(r"\d{4}-\d{2}(-\d{2})?", p) else k == p)
    if include_null:
        gone = gone | k.isNull() | F.trim(k).isin("", "nan", "None")
    return F.coalesce(gone, F.lit(False))


def delete_published(spark, root: str, table: str, key: str, periods: Sequence[str], include_null: bool = False) -> DataFrame:
    """IO-16 writer for every discipline: remove the rows whose ``key`` (a day, a month, a source file, ...) is one of ``periods``,
    or has none (``include_null``); returns (removed, remaining) of the months or files that hold such rows.

    Only these are written again: months of a table with periods, single files of a keyed or per-file table.
    A key that the table does not have removes nothing."""
    finish_pending(spark, root, table)
    path = f"{root.rstrip('/')}/{table}"
    whole = spark.read.option("mergeSchema", "true").parquet(path)
    gone = _told(key, periods, include_null) if key in whole.columns else F.lit(False)
    if PERIOD not in whole.columns:
        return _delete_from_files(spark, root, table, whole, gone)
    days = [str(p) for p in periods]
    if not include_null and all(re.fullmatch(r"\d{4}-\d{2}(-\d{2})?", p) for p in days) and period_key(table) == key:
        parts = sorted({f"p{p[:7]}" for p in days})  # the table's own period: its partitions are known without a scan
    else:
        parts = sorted(r[PERIOD] for r in whole.where(gone).select(PERIOD).distinct().collect())  # calendar-bounded
    touched = whole.where(F.col(PERIOD).isin(parts))
    kept = touched.where(~gone)
    left = {r[PERIOD]: r["n"] for r in kept.groupBy(PERIOD).agg(F.count(F.lit(1)).alias("n")).collect()}
    before = touched.count()
    if left:
        publish_partitions(kept, root, table)
    for p in parts:  # a month without rows has no partition to write: its folder goes
        fs, folder = _fs(spark, f"{path}/{PERIOD}={p}")
        if p not in left and fs.exists(folder):
            fs.delete(folder, True)
    return _report(spark, before - sum(left.values()), sum(left.values()))


def period_key(table: str) -> str | None:
    """The column whose month a table is partitioned by."""
    from .files import DISCIPLINE
    return DISCIPLINE.get(table, (None, None))[1]


def _report(spark, removed: int, remaining: int) -> DataFrame:
    return spark.range(1).select(F.lit(removed).cast("long").alias("removed"), F.lit(remaining).cast("long").alias("remaining"))


def _delete_from_files(spark, root: str, table: str, whole: DataFrame, gone) -> DataFrame:
    """A table without periods: the files with such rows are replaced by one staged copy of their other rows.

    The staged copy carries the list of the files that it replaces, and its list is written last: a deletion without
    it never counted, one with it is completed by ``_finish_rewrite`` however often it is begun again."""
    place = F.col("_metadata.file_path")
    files = sorted(r["f"] for r in whole.where(gone).select(place.alias("f")).distinct().collect())  # names of files only
    if not files:
        return _report(spark, 0, 0)
    touched = whole.where(place.isin(files))
    counts = touched.agg(F.count_if(gone).alias("removed"), F.count_if(~gone).alias("remaining")).first()
    staged = f"{root.rstrip('/')}/_pending_files/{table}/{uuid.uuid4().hex}"
    if counts["remaining"]:
        touched.where(~gone).write.parquet(f"{staged}/rows")
    spark.createDataFrame([(f,) for f in files], "f string").coalesce(1).write.parquet(f"{staged}/replaced")
    _finish_rewrite(spark, root, table)
    return _report(spark, counts["removed"], counts["remaining"])


def _finish_rewrite(spark, root: str, table: str) -> None:
    """Put staged files into the table and take out those that they replace; each step may be repeated after a crash.
    Between the two a reader may see rows twice, never too few."""
    path = f"{root.rstrip('/')}/{table}"
    fs, base = _fs(spark, f"{root.rstrip('/')}/_pending_files/{table}")
    if not fs.exists(base):
        return
    for status in fs.listStatus(base):
        staged = status.getPath().toString()
        if fs.exists(_fs(spark, f"{staged}/replaced/_SUCCESS")[1]):
            rows = _fs(spark, f"{staged}/rows")[1]
            for part in fs.listStatus(rows) if fs.exists(rows) else []:
                name = part.getPath().getName()
                if name.endswith(".parquet"):
                    fs.rename(part.getPath(), _fs(spark, f"{path}/{name}")[1])
            for r in spark.read.parquet(f"{staged}/replaced").collect():  # names of files only
                old = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(r["f"]))
                fs.delete(old, False)
        fs.delete(status.getPath(), True)


def stamp(df: DataFrame, source_file: str | None = None) -> DataFrame:
    """IO-18: lineage columns ``_imported_at`` and ``_source_file`` (file path of each row when read from files)."""
    out = df.withColumn("_imported_at", F.current_timestamp().cast("timestamp_ntz"))
    if source_file is not None:
        return out.withColumn("_source_file", F.lit(source_file))
    if "_source_file" not in df.columns:
        out = out.withColumn("_source_file", F.col("_metadata.file_path"))
    return out


def write_partitions(df: DataFrame, path: str, partition_col: str, fmt: str = "parquet") -> None:
    """Publish with dynamic partition overwrite: only the partitions present in ``df`` are replaced."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy(partition_col).format(fmt).save(path))


def overwrite(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """IO-10: full overwrite load."""
    df.write.mode("overwrite").format(fmt).save(path)


def append_evolving(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """IO-08: append; readers use ``mergeSchema`` so added columns appear as NULL in older files."""
    df.write.mode("append").format(fmt).save(path)


def read_evolving(spark, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    """IO-19: cleaned / filtered export as CSV with header (UTF-8)."""
    df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)
