"""Shared report primitives (AG-01…04, SL-02, SO-06/07, AG-53/54/58 style banding, JN-11).

Design rules used by every report module:
* aggregates are plain ``groupBy().agg()`` so Spark plans partial (map-side) + final
  aggregation and shuffles only the grouped keys;
* totals used as divisors are one-row global aggregates cross-joined back (a broadcast of
  exactly one row) instead of an unpartitioned window over raw rows;
* top-k is ``orderBy(metric, tiebreak keys).limit(k)`` -> TakeOrderedAndProject (each task
  keeps k rows, the driver merges k x tasks);
* pivots always get an explicit value list (no extra distinct job, bounded width).
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.exprs import col


def has(df: DataFrame, *cols: str) -> bool:
    return all(c in df.columns for c in cols)


def require(df: DataFrame, *cols: str) -> DataFrame:
    """Raise when a required column is missing (instead of silently skipping a metric)."""
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def with_missing(df: DataFrame, schema) -> DataFrame:
    """Add NULL columns of a declared schema that the frame lacks (tolerant reads)."""
    for f in schema.fields:
        if f.name not in df.columns:
            df = df.withColumn(f.name, F.lit(None).cast(f.dataType))
    return df


# ---------------------------------------------------------------- AG-01 safe aggregates

def safe_sum(df: DataFrame, c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)) if c in df.columns else F.lit(0)


def safe_mean(df: DataFrame, c: str) -> Column:
    return F.coalesce(F.avg(c), F.lit(0.0)) if c in df.columns else F.lit(0.0)


def safe_nunique(df: DataFrame, c: str) -> Column:
    return F.count_distinct(c) if c in df.columns else F.lit(0).cast("bigint")


def member_count(df: DataFrame, account: str = "account", agent: str = "agent") -> Column:
    """AG-02: distinct (account, agent) with NULL agent counted as a value; account only if no agent column. [AG-01]"""
    if agent in df.columns:
        return F.count_distinct(F.struct(col(account), col(agent)))
    return F.count_distinct(col(account))


# ---------------------------------------------------------------- AG-04 long-form KPIs

def kpis(df: DataFrame, spec: Sequence[tuple[str, Column]]) -> DataFrame:
    """One global aggregate unpivoted to (metric, value) rows, values as double."""
    row = df.agg(*[e.cast("double").alias(name) for name, e in spec])
    return row.unpivot([], [n for n, _ in spec], "metric", "value")


def long_form(df: DataFrame, ids: Sequence[str], metrics: Sequence[str],
              var: str = "metric", val: str = "value") -> DataFrame:
    """SO-06: wide -> long with double values."""
    cast = df.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics])
    return cast.unpivot(list(ids), list(metrics), var, val)


# ---------------------------------------------------------------- top-k and shares

def top_by(df: DataFrame, keys: Sequence[str], metric: str, k: int | None, agg: str = "sum",
           desc: bool = True) -> DataFrame:
    """SL-02 / AG-28 / AG-32: group, aggregate one metric, order with key tiebreak, keep k."""
    fn = getattr(F, agg)
    g = df.groupBy(*keys).agg(fn(metric).alias(metric))
    order = [F.col(metric).desc() if desc else F.col(metric).asc()] + [F.col(x).asc_nulls_first() for x in keys]
    g = g.orderBy(*order)
    return g.limit(k) if k else g


def with_share(df: DataFrame, metric: str, name: str = "share_pct", digits: int | None = 2) -> DataFrame:
    """JN-11: value / grand total x 100 on an already *grouped* frame of bounded cardinality
    (venue x type, type, rating ...).  The total is ``sum() over ()`` of the grouped rows, so the
    data behind the groups is scanned once (a separate total aggregate would re-run the whole
    upstream plan, because column pruning makes it differ from the main branch)."""
    tot = F.sum(metric).over(Window.partitionBy())
    v = F.try_divide(F.col(metric) * 100.0, F.nullif(tot, F.lit(0)))
    if digits is not None:
        v = F.round(v, digits)
    return df.withColumn(name, v)


def top_and_total(grouped: DataFrame, metric: str, k: int, buckets: int = 64) -> DataFrame:
    """AG-36 / AG-73: (top, total) of a metric over a *grouped* frame, as one row from one scan of the data.

    Grouped rows are dealt to buckets by all their columns and ranked there; of each bucket the k largest values and the
    sum of the rest remain (``buckets`` x (k + 1) rows at most), and these are ranked once more.  Which of equal values
    counts does not change a sum, so no tie-break is needed."""
    b = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in grouped.columns]), F.lit(buckets)).alias("b")
    largest = F.col("v").desc_nulls_last()
    ranked = grouped.select(b, F.col(metric).alias("v")).withColumn("i", F.row_number().over(Window.partitionBy("b").orderBy(largest)))
    few = ranked.groupBy("b", F.when(F.col("i") <= k, F.col("i")).alias("i")).agg(F.sum("v").alias("v"))
    few = few.withColumn("n", F.row_number().over(Window.partitionBy().orderBy(F.col("i").isNull(), largest)))
    return few.agg(F.sum(F.when(F.col("i").isNotNull() & (F.col("n") <= k), F.col("v"))).alias("top"), F.sum("v").alias("total"))


def hierarchy_totals(df: DataFrame, levels: Sequence[str], metric: str, fill: str | None = None) -> DataFrame:
    """AG-30 / AG-33: totals at every prefix level via ROLLUP; ``depth`` tells subtotal rows apart.

    Real NULL labels are first replaced by ``fill`` so they never collide with rollup NULLs.
    """
    src = df
    if fill is not None:
        src = src.select(*[F.coalesce(F.col(l), F.lit(fill)).alias(l) for l in levels], metric)
    g = src.rollup(*levels).agg(F.sum(metric).alias(metric), F.grouping_id().alias("gid"))
    n = len(levels)
    depth = F.lit(n)
    for i, _ in enumerate(levels):
        depth = depth - F.when(F.col("gid").bitwiseAND(1 << (n - 1 - i)) != 0, 1).otherwise(0)
    return g.withColumn("depth", depth.cast("int")).drop("gid")


def band(c, edges: Sequence[tuple[str, Column]], default: str) -> Column:
    """SC-12: first matching (label, condition) wins."""
    e = None
    for label, cond in edges:
        e = F.when(cond, F.lit(label)) if e is None else e.when(cond, F.lit(label))
    return e.otherwise(F.lit(default)) if e is not None else F.lit(default)


def band_counts(df: DataFrame, label_col: Column, labels: Sequence[str], aggs: Sequence[Column],
                name: str = "band") -> DataFrame:
    """Aggregate per band and emit every band (missing bands -> zero counts), ordered by band."""
    spark = df.sparkSession
    bands = spark.createDataFrame([(i, b) for i, b in enumerate(labels)], f"band_order int, {name} string")
    g = df.groupBy(label_col.alias(name)).agg(*aggs)
    out = F.broadcast(bands).join(g, name, "left")
    fill = {c: 0 for c in g.columns if c != name}
    return out.na.fill(fill)


def histogram(df: DataFrame, c: str, bins: int = 30) -> DataFrame:
    """AG-53: equal-width histogram between min and max (bucket 1..bins, max lands in the last)."""
    mm = df.agg(F.min(c).alias("lo"), F.max(c).alias("hi"))
    j = df.select(c).where(F.col(c).isNotNull()).crossJoin(F.broadcast(mm))
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(F.col("hi") == F.col("lo"), F.lit(1)).otherwise(
        F.least(F.floor((F.col(c) - F.col("lo")) / width).cast("int") + 1, F.lit(bins)))
    g = j.groupBy(b.alias("bucket"), "lo", "hi").agg(F.count(F.lit(1)).alias("n"))
    return g.select("bucket",
                    (F.col("lo") + (F.col("bucket") - 1) * (F.col("hi") - F.col("lo")) / bins).alias("bin_lo"),
                    (F.col("lo") + F.col("bucket") * (F.col("hi") - F.col("lo")) / bins).alias("bin_hi"), "n")


def count_by(df: DataFrame, dim: str, name: str = "n", fill: str | None = None) -> DataFrame:
    """AG-59: rows per dimension value."""
    k = F.coalesce(F.col(dim), F.lit(fill)) if fill is not None else F.col(dim)
    return df.groupBy(k.alias(dim)).agg(F.count(F.lit(1)).alias(name))


def pivot_sum(df: DataFrame, row: str, pivot_col: str, values: Iterable, metric: str, fill=0.0) -> DataFrame:
    """SO-07: long -> wide with an explicit value list, missing cells -> 0."""
    vals = list(values)
    p = df.groupBy(row).pivot(pivot_col, vals).agg(F.sum(metric))
    return p.na.fill(fill, subset=[str(v) for v in vals])


def crosstab_top(df: DataFrame, a: str, b: str, metric: str | None = None, k: int = 15,
                 how: str = "count") -> DataFrame:
    """AG-112: cross-tab of two dimensions restricted to the top-k rows and top-k columns by marginal (ties to the lesser
    value; a NULL takes its place in the order, but gets no row).

    Long form (a, b, value).  Both marginals come from one pass by grouping sets, the k names of each side are one
    row of two arrays, and only pairs of these names are grouped: never all pairs.
    """
    agg = (F.count(F.lit(1)) if how == "count" else F.sum(metric)).cast("double")
    of_b = F.grouping(a).alias("of_b")  # 1 where the row is a value of b
    marginals = df.groupingSets([[a], [b]], a, b).agg(agg.alias("m"), of_b)
    order = Window.partitionBy("of_b").orderBy(F.col("m").desc(), F.coalesce(a, b).asc_nulls_first())
    top = marginals.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k)
    names = top.agg(F.collect_list(F.when(F.col("of_b") == 0, F.col(a))).alias("top_a"),
                    F.collect_list(F.when(F.col("of_b") == 1, F.col(b))).alias("top_b"))  # k values each
    inside = F.array_contains("top_a", F.col(a)) & F.array_contains("top_b", F.col(b))
    return df.join(F.broadcast(names), inside).groupBy(a, b).agg(agg.alias("value"))


def moving_average(daily: DataFrame, order_col: str, c: str, n: int = 7, name: str | None = None) -> DataFrame:
    """WN-01: mean over the last n rows (min periods 1) of a *daily aggregate*.

    The frame is already one row per day (bounded by the calendar), so the single
    ordered window is cheap; never apply it to raw rows.
    """
    w = Window.orderBy(order_col).rowsBetween(-(n - 1), 0)
    return daily.withColumn(name or f"{c}_ma{n}", F.avg(c).over(w))


def first_non_null(value: str, order: Sequence) -> Column:
    """SC-13: first non-null value by an explicit order (min_by over a struct key)."""
    key = F.struct(*[col(o) for o in order])
    return F.min_by(F.when(F.col(value).isNotNull(), F.col(value)),
                    F.when(F.col(value).isNotNull(), key))
