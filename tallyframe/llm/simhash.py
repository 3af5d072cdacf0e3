"""SimHash near-duplicates by covering locality-sensitive hashing.

A fingerprint has a bit for each of 64 positions: 1 if it is set in over half of the hashes of the
text's word shingles.  For radius r, every bit position i gets a non-zero vector m(i) of r + 1 bits;
the mask of table v (v = 1 .. 2^(r+1) - 1) keeps the positions with odd <m(i), v>.  Fingerprints
that differ in at most r positions span at most r dimensions, so some v is orthogonal to all of
them: every pair within the radius collides in that table.  No pair is left to chance.

Work is on distinct fingerprints, so copies never meet in a bucket.  Buckets of up to
``bucket_rows`` fingerprints are verified at once and give a spanning forest of their links, not
all pairs.  Larger buckets take an exact way of linear size (radius 2): each fingerprint is
spelt with at most one flip of the bits that the mask leaves free; two fingerprints of a bucket
share a spelling if and only if they differ in at most two bits, and at most 65 fingerprints share
one.  Components follow by alternating large and small stars, each round cut to the shared folder.

Defined cases: null text and text without words have fingerprint zero and are linked like any other;
repeated rows share a component; a null id never names a component unless all its ids are null; a bit that is set in just
half of the hashes is 0; texts of any length are read whole; an empty table gives no rows.  ``keep_one`` packs the
row, so other columns of any names pass unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, cut, text_key

SEED, CHUNK = 42, 1 << 15


def fingerprint(text: str | None, words: int = 3) -> int:
    """Unsigned 64-bit fingerprint; only A-Z are lower-cased and only ASCII white space splits words."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    n = max(1, len(tokens) - words + 1)
    joined, width = b" ".join(tokens), min(words, len(tokens))
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = (ends - np.fromiter(map(len, tokens), np.int64, len(tokens)) - 1)[:n].tolist()
    stops = (ends - 1)[width - 1:].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, n, CHUNK):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at:at + CHUNK], stops[at:at + CHUNK])], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (of the text) and fp (signed 64 bits) of every row, cut to the shared folder."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), words) for t in b.column(2)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], names=["doc_id", "key", "fp"])

    rows = docs.select(col(id_col).cast("long").alias("doc_id"), text_key(col(text_col)).alias("key"), col(text_col).alias("text"))
    return cut(rows.mapInArrow(task, "doc_id long, key string, fp long"))


def masks(radius: int, bits: int = 64) -> list[int]:
    """The masks of the 2^(radius+1) - 1 tables, as signed longs."""
    tables = (1 << (radius + 1)) - 1
    out = []
    for v in range(1, tables + 1):
        m = sum(1 << i for i in range(bits) if bin((i % tables + 1) & v).count("1") % 2)
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning links among the fingerprints of one bucket."""
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
    todo, links = np.ones(len(fps), dtype=bool), []
    for i in range(len(fps)):
        if not todo[i]:
            continue
        todo[i], wave = False, [i]
        while wave:
            reach = near[wave].any(axis=0) & todo
            wave = np.flatnonzero(reach).tolist()
            todo[wave] = False
            links += [(int(fps[j]), int(fps[i])) for j in wave]
    return links


def links(nodes: DataFrame, radius: int = 2, bucket_rows: int = 256) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) whose components are those of all pairs
    within ``radius`` bits.  ``radius`` is at most 2 where buckets outgrow ``bucket_rows``."""
    ms = masks(radius)
    entries = F.explode(F.array(*[F.struct(F.lit(v).alias("v"), F.col("fp").bitwiseAND(F.lit(m)).alias("key"))
                                  for v, m in enumerate(ms)])).alias("t")
    tables = nodes.select("fp", entries).select("fp", "t.v", "t.key")
    shared = tables.groupBy("v", "key").agg(F.count("*").alias("n")).where("n > 1")
    crowded = cut(tables.join(shared, ["v", "key"]))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [x for fps in b.column(0).to_pylist() for x in _forest(np.array(fps, dtype=np.int64).view(np.uint64), radius)]
            ends = [np.array([x[k] for x in found], dtype=np.uint64).view(np.int64) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([pa.array(e) for e in ends], names=["a", "b"])

    small = (crowded.where(F.col("n") <= bucket_rows).groupBy("v", "key").agg(F.collect_list("fp").alias("fps"))
             .select("fps").mapInArrow(verify, "a long, b long"))
    if radius != 2:
        if not crowded.where(F.col("n") > bucket_rows).isEmpty():
            raise ValueError("buckets above bucket_rows have an exact way for radius 2 only; raise bucket_rows")
        return small.distinct()
    wide = crowded.where(F.col("n") > bucket_rows).select("v", "fp", F.explode(_spellings(ms)).alias("s"))
    group = wide.groupBy("v", "s").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)  # 65 at most
    least = F.array_min("fps")  # any two of a group share a spelling, so each is within two bits of the least
    large = group.select(F.explode("fps").alias("a"), least.alias("b")).where("a != b")
    return small.union(large).distinct()


def _spellings(ms: list[int]) -> Column:
    """The fingerprint itself and with each free bit of its table's mask flipped."""
    by_table = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit((1 << i) - (1 << 64) if i == 63 else 1 << i).cast("long")
                                                       for i in range(64) if not (m >> i) & 1]) for m in ms])
    return F.transform(F.get(by_table, F.col("v")), lambda f: F.col("fp").bitwiseXOR(f))


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) of every node with a link (columns a, b)."""
    def stars(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select("b", "a")) if large else e
        least = both.groupBy(F.col("a").alias("c")).agg(F.min("b").alias("m")).withColumn("m", F.least("c", "m"))
        joined = both.join(least, F.col("a") == F.col("c"))
        if large:
            out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = joined.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
                least.select(F.col("c").alias("a"), F.col("m").alias("b")))
        return out.where("a != b").distinct()

    edges = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct())
    mark = None
    while True:
        edges = cut(stars(stars(edges, True), False))
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2, bucket_rows: int = 256,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key, fp, root and component_id (smallest id of all rows reachable by links) for every row."""
    fps = fingerprints(docs, words, id_col, text_col)
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(nodes.select("fp"), radius, bucket_rows))
    named = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    names = named.groupBy(F.col("root").alias("r")).agg(F.min("first").alias("component_id"))
    by_fp = named.join(names, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "root", "component_id")
    return fps.join(by_fp, F.col("fp") == F.col("f")).select("doc_id", "key", "fp", "root", "component_id")


def keep_one(docs: DataFrame, words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that with the smallest (id, text key); null ids last.
    Of rows equal in both, one is kept."""
    members = near_duplicates(docs, words, radius, id_col=id_col, text_col=text_col)
    order = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "key")
    best = (members.groupBy("root").agg(F.min(order).alias("m")).select(F.col("m.doc_id").alias("d"), F.col("m.key").alias("k")))
    rows = docs.select(F.struct("*").alias("row"), col(id_col).cast("long").alias("id"), text_key(col(text_col)).alias("key"))
    held = rows.join(best, F.col("id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left_semi")
    return held.dropDuplicates(["id", "key"]).select("row.*")
