"""Small shared helpers: reliable checkpoints, row keys, hash filters and distributed ranks."""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.session import checkpoint_dir

#: Bits of a hash filter: its size on every executor is this many bits (1 MiB), whatever was put in.
FILTER_BITS = 1 << 23


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, without its lineage."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def col(name: str) -> Column:
    """A top-level column by its literal name (dots and blanks in names are kept)."""
    return F.col("`" + name.replace("`", "``") + "`")


def without(df: DataFrame, names: list[str]) -> list[Column]:
    """The columns of ``df`` but those called like ``names`` (Spark compares names without case)."""
    low = {n.lower() for n in names}
    return [col(c) for c in df.columns if c.lower() not in low]


def text_key(text: Column) -> Column:
    """128-bit key of a text; together with the document id it tells rows of one id apart."""
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def hash_filter(keys: DataFrame, column: str) -> np.ndarray:
    """Fixed-size bit filter over 64-bit ``keys``: two bits per key, ``FILTER_BITS`` bits in all.

    The driver gets at most one row for each 64-bit word of the filter (2^17 rows), so neither the
    transfer nor the broadcast grows with the keys.  A full filter lets more rows through to the
    exact join behind it; it never drops one.
    """
    h = F.col(column)
    bit = F.explode(F.array(F.pmod(h, F.lit(FILTER_BITS)),
                            F.pmod(F.shiftrightunsigned(h, 32), F.lit(FILTER_BITS)))).alias("bit")
    words = (keys.select(bit).groupBy(F.shiftright("bit", 6).alias("w"))
             .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")))
    out = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
    for w, bits in words.collect():
        out[w] = np.uint64(bits & 0xFFFFFFFFFFFFFFFF)
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def in_filter(filt: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the unsigned 64-bit hashes ``h`` may be in the filter."""
    mask = np.uint64(FILTER_BITS - 1)
    return filt[h & mask] & filt[(h >> np.uint64(32)) & mask]


def word_hash(word: str) -> int:
    """64-bit hash of a word, the same in every process (unsigned)."""
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


def signed(h: np.ndarray) -> np.ndarray:
    """Unsigned 64-bit hashes as Spark's long."""
    return np.asarray(h, dtype=np.uint64).view(np.int64)


def global_rank(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with a rank from 0 in ``order``, without sorting it in one task.

    Rows are dealt by range, numbered inside each range, and shifted by the counts of the ranges
    before.  The driver sees one count for each range.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(df.repartitionByRange(n, *order).sortWithinPartitions(*order)
                .withColumn("_range", F.spark_partition_id())
                .withColumn("_in_range", F.monotonically_increasing_id() - F.shiftleft(F.spark_partition_id().cast("long"), 33)))
    start, offsets = 0, {}
    for r in sorted(dealt.groupBy("_range").agg((F.max("_in_range") + 1).alias("n")).collect()):
        offsets[r["_range"]] = start
        start += r["n"]
    if not offsets:
        return dealt.withColumn(name, F.lit(0).cast("long")).drop("_range", "_in_range")
    shift = F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv])
    return (dealt.withColumn(name, (F.col("_in_range") + shift[F.col("_range")]).cast("long"))
            .drop("_range", "_in_range"))
