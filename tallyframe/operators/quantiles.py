"""Exact quantiles without gathering a group into one task (used by AG-108, AG-119).

Spark's exact ``percentile`` / ``median`` merge one frequency map per group in a single task,
so a global median over billions of distinct values would pull them all into one reducer.
Here the order statistics at ranks floor(q(n-1)) and the one above are found by descent over the
digits of the values.  Every double has an exponent (with its sign) and 52 bits of mantissa, which order
it; these are cut into four digits of at most 2^18 values.  At each level the values that share the digits so far
with a wanted rank are counted by the next digit, a window over those few counts finds the digit that holds the
rank, and the descent goes on inside it.  After the last digit one value is left.

The plan is lazy and has a fixed number of levels for any range of values; the driver holds no state, and a level
sees one row per digit and rank, never the values of a group.  The values are counted once, by (group, value), and
Spark reuses that exchange in every level.  The result equals the linearly interpolated quantile
(``percentile`` / ``quantile_cont``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of the mantissa behind the second, third and fourth digit.
SHIFTS = (34, 17, 0)
#: Exponents of doubles start here (the least subnormal is 2^-1074).
LEAST_EXPONENT = -1074
INFINITE = 4096


def with_digits(counts: DataFrame) -> DataFrame:
    """``counts`` with the four digits d0 to d3 of ``v``: equal prefixes of digits hold neighbouring values, in order."""
    two, size, near = F.lit(2.0), F.col("size"), F.col("near")
    plain = (size > 0) & (size < float("inf"))
    floor = F.greatest(F.least(F.floor(F.log2(size)), F.lit(1023)), F.lit(LEAST_EXPONENT)).cast("double")
    # the logarithm is rounded: correct it by the exact powers of two beside it
    exact = F.when(F.pow(two, near) > size, near - 1).when((near < 1023) & (F.pow(two, near + 1) <= size), near + 1).otherwise(near)
    scaled = (size / F.pow(two, F.col("exponent")) - 1) * F.lit(float(1 << 52))
    # one step after the other: Spark keeps them apart, so no step is spelt out inside the next
    out = counts.withColumn("size", F.abs("v")).withColumn("near", F.when(plain, floor).otherwise(0.0)).withColumn("exponent", exact)
    out = out.withColumn("bits", F.when(plain, F.signum("v") * scaled).otherwise(0.0).cast("bigint"))
    first = F.when(size == 0, 0.0).when(plain, F.col("exponent") - LEAST_EXPONENT + 1).otherwise(float(INFINITE))
    return out.select("g", "c", "v", (F.signum("v") * first).cast("int").alias("d0"),
                      *[F.shiftright("bits", k).alias(f"d{j + 1}") for j, k in enumerate(SHIFTS)])


def order_statistics(counts: DataFrame, ranks: DataFrame) -> DataFrame:
    """``ranks`` (g, rank) with the value at that rank (from 0) among ``counts`` (g, v, c) of the group."""
    keyed = with_digits(counts)
    found = ranks.select(F.col("g").alias("g0"), "rank", F.col("rank").alias("left"))
    path: list[str] = []
    for k in range(len(SHIFTS) + 1):
        same = F.col("g").eqNullSafe(F.col("g0"))
        for d in path:
            same = same & F.col(d).eqNullSafe(F.col(f"{d}_at"))
        held = [f"{d}_at" for d in path]
        if path:
            here = keyed.join(found, same).groupBy("g0", "rank", "left", *held, f"d{k}")
        else:  # the first digit is the same for all ranks
            here = keyed.groupBy("g", "d0")
        here = here.agg(F.sum("c").alias("n"), F.max("v").alias("v"))
        order = Window.partitionBy(*(["g0", "rank"] if path else ["g"])).orderBy(f"d{k}")
        here = here.withColumn("upto", F.sum("n").over(order))
        if not path:
            here = here.join(found, same)
        found = (here.where((F.col("left") >= F.col("upto") - F.col("n")) & (F.col("left") < F.col("upto")))
                 .select("g0", "rank", (F.col("left") - F.col("upto") + F.col("n")).alias("left"), *held,
                         F.col(f"d{k}").alias(f"d{k}_at"), "v"))
        if k < len(SHIFTS):
            found = found.drop("v")
        path.append(f"d{k}")
    return found.select(F.col("g0").alias("g"), "rank", "v")


def exact_quantiles(df: DataFrame, value, qs: Sequence[float], group: str | None = None,
                    extra: Mapping[str, Column] | None = None) -> DataFrame:
    """Exact interpolated quantiles of ``value`` per ``group`` (one row per group: group, q_<p> ...).

    ``value`` is a column name or Column; NULL and NaN are ignored; a group without values has NULL quantiles, and a
    NULL group is a group.  ``extra`` maps output names to aggregate Columns over ALL rows of the group; there
    the value is called ``__v``.  Without ``group`` there is one row, for an empty frame as well.
    """
    v = (F.col(value) if isinstance(value, str) else value).cast("double")
    base = df.withColumn("__v", F.when(~F.isnan(v), v))
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")) if group else F.lit("")
    base = base.withColumn("__g", key)
    aggs = [F.count("__v").alias("__n"), *[e.alias(k) for k, e in (extra or {}).items()]]
    stats = base.groupBy("__g").agg(*aggs) if group else base.agg(*aggs).withColumn("__g", F.lit(""))
    counts = base.where(F.col("__v").isNotNull()).groupBy(F.col("__g").alias("g"), F.col("__v").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    total = counts.groupBy("g").agg(F.sum("c").alias("n"))

    def place(q: float, n: Column) -> Column:
        return F.lit(float(q)) * (n - 1)

    wanted = []
    for q in qs:
        low = F.floor(place(q, F.col("n")))
        wanted += [low, F.least(low + 1, F.col("n") - 1)]
    ranks = total.select("g", F.explode(F.array_distinct(F.array(*wanted))).alias("rank"))
    if not group:
        ranks = F.broadcast(ranks)  # two rows a quantile at most
    values = order_statistics(counts, ranks).groupBy(F.col("g").alias("g1")).agg(
        F.map_from_entries(F.collect_list(F.struct("rank", "v"))).alias("at"))  # two ranks a quantile at most
    out = stats.join(values if group else F.broadcast(values), F.col("__g") == F.col("g1"), "left")  # without a group: one row

    def quantile(q: float) -> Column:
        pos = place(q, F.col("__n"))
        low = F.floor(pos)
        a, b, part = F.col("at")[low], F.col("at")[F.least(low + 1, F.col("__n") - 1)], pos - low
        apart = b - a  # beyond the largest double for values far apart
        return F.when(a == b, a).when(F.abs(apart) == float("inf"), a * (1 - part) + b * part).otherwise(a + apart * part)

    named = [quantile(q).alias(f"q_{str(q).replace('.', '_')}") for q in qs]
    shown = [F.when(F.col("__g") != "", F.substring("__g", 2, 1 << 30)).alias(group)] if group else []
    return out.select(*shown, *named, *(extra or {}))
