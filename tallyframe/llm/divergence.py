"""Divergence of sources by a frequent-pattern tree of term rows.

Every source of a language gives each kept term a smoothed share p of its kept words, in parts of ``scale``.
Two sources differ by the sum of abs(p - p') over all kept terms.  A term that a source lacks has the source's
least share z, so the sum is what two sources without any term would differ by, plus a correction for each term that one
of them holds, plus a correction for each term that both hold:

    sum over terms of |p_a - p_b|  =  V |z_a - z_b|
        + sum over terms of a  (|p_a - z_b| - |z_a - z_b|)  +  the same with a and b exchanged
        + sum over terms of both  (|p_a - p_b| - |p_a - z_b| - |z_a - p_b| + |z_a - z_b|)

The last sum is taken on a frequent-pattern tree.  A term's row holds the sources that have it, in their order,
with their counts; equal rows become one with a multiplicity.  Rows that begin alike share a path, and each
node corrects the pair of its source with each ancestor's once, for all terms below it.  Rows are dealt to the
tasks by range and inserted in order, so that a task keeps the open path only: a node is closed,
with its final multiplicity, as soon as a row leaves its path.  Corrections are whole numbers and add up,
so it does not matter where the ranges are cut.

Terms are counted in the tasks before the shuffle, by (language, source, term); a hot source or term is one row
of each task.  A row of a term has at most one item a source.  The result is all pairs of sources of a language, which bounds
the number of sources that a language can have; the sums of a task are written out when they reach ``SUMS``.

Defined cases: null text, language and source are empty strings; texts without terms count as documents of their group;
a language without kept terms gives zero for each pair; repeated rows are documents of their own, ids are not read;
ties in value go to the smaller item by UTF-8 bytes; an empty table gives an empty table; very long texts are
counted match by match; only the three named columns are read, so extra columns may have any name.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, cut

#: Terms are runs of ASCII letters and of all that is not ASCII; in UTF-8 the other bytes become blanks, and A-Z small.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
BLANKED = bytes(c | 32 if chr(c).isascii() and chr(c).isalpha() else c if c > 127 else 32 for c in range(256))
#: Counted terms, and corrections of pairs, that a task holds before it writes them out.
TERMS, SUMS = 1 << 19, 1 << 20
#: Bytes up to which the groups of all languages are broadcast.
BROADCAST_BYTES = 8 << 20


def term_counts(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    """lang, source, term, n (occurrences) and docs (rows that hold it) of every group, dealt by (lang, term)."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held_terms = 0

        def written() -> pa.RecordBatch:
            names, n, held = [], [], []
            for group, (every, docs) in counts.items():
                names += [group] * len(every)
                n += every.values()
                held += map(docs.__getitem__, every)
            terms = pa.array([t for every, _ in counts.values() for t in every], pa.binary()).cast(pa.string())
            counts.clear()
            return pa.RecordBatch.from_arrays([*[pa.array([g[k] for g in names], pa.string()) for k in (0, 1)], terms, pa.array(n, pa.int64()), pa.array(held, pa.int64())],
                                              names=["lang", "source", "term", "n", "docs"])

        for b in batches:
            texts = b.column(2).cast(pa.binary())
            for la, so, te in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), texts):
                terms = te.as_py().translate(BLANKED).split()
                every, docs = counts.setdefault((la, so), (Counter(), Counter()))
                held_terms -= len(every)
                every.update(terms)
                docs.update(set(terms))
                held_terms += len(every)
                if held_terms >= TERMS:
                    yield written()
                    held_terms = 0
        yield written()

    rows = docs.select(*[F.coalesce(col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])
    counted = rows.mapInArrow(task, "lang string, source string, term string, n long, docs long")
    return counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column, terms: Column, smooth: int, scale: int) -> Column:
    """1 + floor(scale * (n + smooth) / (total + smooth * terms)), in whole numbers of up to 38 digits."""
    above = F.lit(scale).cast("decimal(10,0)") * (n + smooth).cast("decimal(19,0)")
    below = (total.cast("decimal(19,0)") + (terms * smooth).cast("decimal(19,0)"))
    return F.lit(1).cast("long") + F.call_function("div", above, below)


class _Path:
    """The open path of the tree of one language, and the corrections of the nodes closed so far."""

    def __init__(self) -> None:
        self.lang: str | None = None
        self.start()

    def start(self) -> None:
        self.number: dict[str, int] = {}
        self.s, self.n, self.p, self.z, self.m = (np.zeros(0, dtype=np.int64) for _ in range(5))
        self.keys, self.values, self.held = [], [], 0

    def numbers(self, codes: np.ndarray, names: list[str]) -> np.ndarray:
        """The numbers of the sources of a row."""
        return np.fromiter((self.number.setdefault(names[c], len(self.number)) for c in codes.tolist()), np.int64, len(codes))

    def insert(self, s: np.ndarray, n: np.ndarray, p: np.ndarray, z: np.ndarray, count: int) -> None:
        """Add ``count`` terms whose sources ``s`` hold them ``n`` times; rows come in order of (source, n)."""
        both = min(len(s), len(self.s))
        same = (s[:both] == self.s[:both]) & (n[:both] == self.n[:both])
        shared = both if same.all() else int(same.argmin())
        self.close(shared)
        self.s, self.n, self.p, self.z = s, n, p, z
        self.m = np.concatenate((self.m[:shared], np.zeros(len(s) - shared, dtype=np.int64)))
        self.m[-1] += count

    def close(self, depth: int) -> None:
        """Close the nodes below ``depth``: each has all terms of those under it, and is corrected with each ancestor once."""
        if depth >= len(self.m):
            return
        terms = np.cumsum(self.m[depth:][::-1])[::-1]
        step = max(1, SUMS // len(self.m))
        for at in range(depth, len(self.m), step):
            d = np.arange(at, min(at + step, len(self.m)))
            node, above = np.nonzero(d[:, None] > np.arange(d[-1] + 1)[None, :])
            node += at
            p, z, pa_, za = self.p[node], self.z[node], self.p[above], self.z[above]
            fix = np.abs(p - pa_) - np.abs(p - za) - np.abs(z - pa_) + np.abs(z - za)
            self.keys.append(self.s[node] << 32 | self.s[above])
            self.values.append(fix * terms[node - depth])
            self.held += len(node)
            if self.held >= SUMS:
                self.add_up()
        if depth:
            self.m[depth - 1] += terms[0]

    def add_up(self) -> None:
        """One sum for each pair."""
        if not self.keys:
            return
        keys, values = np.concatenate(self.keys), np.concatenate(self.values)
        order = np.argsort(keys, kind="stable")
        keys, values = keys[order], values[order]
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), dtype=bool), keys[1:] != keys[:-1])))
        sums = np.add.reduceat(values, first) if len(first) else values
        self.keys, self.values, self.held = [keys[first]], [sums], len(first)

    def written(self) -> pa.RecordBatch:
        """The sums of the pairs so far, which start anew."""
        self.add_up()
        names = pa.array(list(self.number), pa.string())
        keys = self.keys[0] if self.keys else np.zeros(0, dtype=np.int64)
        values = self.values[0] if self.values else keys
        out = pa.RecordBatch.from_arrays([pa.array([self.lang] * len(keys), pa.string()), names.take(pa.array(keys >> 32)),
                                          names.take(pa.array(keys & 0xFFFFFFFF)), pa.array(values)], names=["lang", "a", "b", "value"])
        self.keys, self.values, self.held = [], [], 0
        return out

    def finish(self, lang: str | None) -> pa.RecordBatch:
        """Close the whole tree; the next rows are of ``lang``."""
        self.close(0)
        out = self.written()
        self.start()
        self.lang = lang
        return out


def tree_corrections(rows: DataFrame) -> DataFrame:
    """lang, a, b (a after b in source order), value: the corrections of the terms that both hold.

    ``rows`` has lang, items (source, n, p, z; by source) and m (terms with these items).
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = _Path()
        for batch in batches:
            langs, counts = batch.column(0).to_pylist(), batch.column(2).to_numpy()
            ends = batch.column(1).offsets.to_numpy()
            items = batch.column(1).values
            coded = items.field("source").dictionary_encode()
            codes, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            n, p, z = (items.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("n", "p", "z"))
            for k, lang in enumerate(langs):
                if lang != tree.lang:
                    yield tree.finish(lang)
                at, to = ends[k], ends[k + 1]
                tree.insert(tree.numbers(codes[at:to], names), n[at:to], p[at:to], z[at:to], int(counts[k]))
                if tree.held >= SUMS:
                    yield tree.written()
        yield tree.finish(None)

    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.select("lang", "items", "m").repartitionByRange(n, "lang", "items").sortWithinPartitions("lang", "items")
    return dealt.mapInArrow(task, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def audit(docs: DataFrame, min_docs: int = 30, smooth: int = 5, scale: int = 1_000_000_000, top: int = 50,
          lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """lang, source, part, item, value and rank: how far each source is from each other one of its language
    (part ``pair``), and the ``top`` terms that it uses more than the language does (part ``term``)."""
    whole = Window.partitionBy("lang", "term")
    held = cut(term_counts(docs, lang_col, source_col, text_col)
               .withColumn("in_docs", F.sum("docs").over(whole)).withColumn("in_lang", F.sum("n").over(whole))
               .where(F.col("in_docs") >= min_docs).select("lang", "source", "term", "n", "in_lang"))
    groups = docs.select(*[F.coalesce(col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"))]).distinct()
    per_term = held.groupBy("lang", "term").agg(F.max("in_lang").alias("in_lang"))
    langs = per_term.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("in_lang").alias("lang_total"))
    totals = held.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    shares = (groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
              .select("lang", "source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total", "terms", "lang_total")])
              .withColumn("z", F.when(F.col("terms") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("terms"), smooth, scale)).otherwise(0)))
    shares = cut(shares)
    if (shares.agg(F.sum(F.octet_length("lang") + F.octet_length("source") + 64)).first()[0] or 0) <= BROADCAST_BYTES:
        shares = F.broadcast(shares)

    cells = cut(held.join(shares, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms"), smooth, scale)))
    items = F.sort_array(F.collect_list(F.struct("source", "n", "p", "z")))
    rows = (cells.groupBy("lang", "term").agg(items.alias("items")).where(F.size("items") > 1)
            .groupBy("lang", "items").agg(F.count("*").alias("m")))
    joint = tree_corrections(rows)

    left = shares.select("lang", F.col("source").alias("a"), F.col("z").alias("za"), "terms")
    right = shares.select("lang", F.col("source").alias("b"), F.col("z").alias("zb"))
    far = F.abs(F.col("za") - F.col("zb"))
    base = left.join(right, "lang").where("a != b").select("lang", "a", "b", (F.col("terms") * far).alias("value"))
    levels = cells.groupBy("lang", F.col("source").alias("a"), "p", F.col("z").alias("za")).agg(F.count("*").alias("m"))
    own = (levels.join(right, "lang").where("a != b")
           .select("lang", "a", "b", (F.col("m") * (F.abs(F.col("p") - F.col("zb")) - far)).alias("value"))
           .groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))
    turned = [d.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value") for d in (own, joint)]
    pairs = (base.union(own).union(joint).union(turned[0]).union(turned[1]).groupBy("lang", F.col("a").alias("source"), F.col("b").alias("item"))
             .agg(F.sum("value").alias("value")))

    q = share(F.col("in_lang"), F.col("lang_total"), F.col("terms"), smooth, scale)
    terms = cells.withColumn("value", F.col("p") - q).where("value > 0").select("lang", "source", F.col("term").alias("item"), "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))

    def ranked(part: DataFrame, name: str) -> DataFrame:
        return part.withColumn("rank", rank).select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")

    return ranked(pairs, "pair").union(ranked(terms, "term").where(F.col("rank") <= top))
