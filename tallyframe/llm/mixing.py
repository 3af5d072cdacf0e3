"""Mixing sources to target weights (native).

Tokens are summed per source, a repetition rate per source follows from the targets, and every
document is emitted ``floor(rate)`` times plus one Bernoulli copy, drawn from a hash of its id, with
probability equal to the fraction.  Hot sources need no care: sums combine map-side, the source
table is joined on one row per source, and copies are decided row by row.

Defined cases: null text has size 0; a null source is a source of its own (last in order); a null
id draws from the text's hash; rows repeated with one id draw alike; a source without words has
target 0 and rate 0; an empty table gives an empty result; texts of any length are counted whole; sources are told
apart by code points, so none tie.  Input columns called like the added ones are
replaced by them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, cut, global_rank, without

WORD = "[^\\x20\\x09-\\x0D]+"
#: The source table is broadcast up to this many bytes, and joined by shuffle beyond.
BROADCAST_BYTES = 8 << 20
ADDED = ["size", "source_size", "target", "copies", "taken"]


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary")), 1, 13), 16, 10)
    return bits.cast("double") / F.lit(float(1 << 52))


def water_level(sources: DataFrame, share: float, cap: float) -> float:
    """The level L with sum(min(cap * size, L * weight)) = share * sum(size).

    Each pass is one aggregate over the source table: sources above their cap are held at it and
    the excess is dealt to the others by weight, until no further source is above.
    """
    total, weights = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    if not total:
        return 0.0
    level, held = share * total / weights, -1
    while True:
        above = F.col("weight") * F.lit(level) > F.col("source_size") * F.lit(cap)
        n, capped, free = sources.agg(
            F.sum(above.cast("long")), F.sum(F.when(above, F.col("source_size") * F.lit(cap)).otherwise(0.0)),
            F.sum(F.when(above, 0).otherwise(F.col("weight")))).first()
        if n == held or not free:
            return level if free else float("inf")
        held, level = n, (share * total - capped) / free


def source_targets(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0,
                   text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per source: source, source_size, weight, target.  Weights repeat in source order."""
    sums = (docs.groupBy(col(source_col).alias("source"))
            .agg(F.sum(word_count(col(text_col))).alias("source_size")))
    ranked = global_rank(sums, [F.col("source").asc_nulls_last()], "rank")
    kinds = F.array(*[F.lit(w) for w in weights])
    ranked = cut(ranked.withColumn("weight", F.get(kinds, F.pmod("rank", F.lit(len(weights))).cast("int"))))
    level = water_level(ranked, share, cap)
    return ranked.select("source", "source_size", "weight", F.least(
        F.col("source_size") * F.lit(cap), F.col("weight") * F.lit(level)).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 42,
        text_col: str = "text", source_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken (= size * copies)."""
    targets = source_targets(docs, weights, share, cap, text_col, source_col)
    if (targets.agg(F.sum(F.coalesce(F.octet_length("source"), F.lit(0)) + 32)).first()[0] or 0) <= BROADCAST_BYTES:
        targets = F.broadcast(targets)
    key = F.coalesce(col(id_col).cast("string"), F.md5(F.coalesce(col(text_col), F.lit("")).cast("binary")))
    left = docs.select(F.struct(*without(docs, ADDED)).alias("row"), word_count(col(text_col)).alias("size"),
                       uniform(key, seed).alias("u"), col(source_col).alias("src"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    out = (left.join(targets, F.col("src").eqNullSafe(F.col("source")))
           .withColumn("rate", rate)
           .withColumn("copies", (F.floor("rate") + (F.col("u") < F.col("rate") - F.floor("rate")).cast("int")).cast("long")))
    return out.select("row.*", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def emit(mixed: DataFrame) -> DataFrame:
    """Every document as often as its ``copies`` say, with the number of the copy."""
    return (mixed.where("copies > 0")
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))))
