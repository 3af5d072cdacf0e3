"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Test items are cut into word n-grams.  An n-gram is rare if chance would rarely make it: with corpus
word frequencies p(w) over T words, T * prod p(w) < ``chance``.  Rarity is thus a matter of the words,
not of how often a passage was copied, so a passage that leaked into a third of the corpus keeps its
seeds; an item all of whose n-grams are common keeps them all.  Passages join items on seeds; every
(document, item) pair with a seed is then aligned word by word (match +2, mismatch -1, gap -1)
around its seeds, and the score is the best local alignment's share of a perfect one.

Texts are read twice (word counts; seeds), each time against a filter of fixed size built from the
items, followed by an exact join: a word or n-gram of the corpus that is not in the benchmark is
never shuffled, and nothing is broadcast that grows with either table.  Texts of documents with a
seed travel once, beside their hits, and are aligned in the task that holds them.  Hot passages meet
only as (document, seed) rows whose join AQE may split.

Defined cases: null or empty texts and items match nothing; items shorter than n words are seeded by
their whole word sequence if it is rare; of items with one id the greatest text counts; equal rows are reported once per (id, text, item); ties in score go to the
first span; empty tables give no rows.  Texts of any length are read whole, and each is aligned only around its seeds;
a score exactly at ``min_score`` counts.  ``keep_clean`` packs the row, so other columns of any names pass unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, cut, hash_filter, in_filter, signed, text_key

BREAKS = r"[^\p{L}\p{N} ]+"
MATCH, MISMATCH, GAP = 2, -1, -1


def tokenise(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct words (runs of letters and digits, lower case) of a column, each text's words as numbers of
    them, and where each text's words start (one more start than texts).  Null texts have no words."""
    flat = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.replace_substring_regex(flat, pattern=BREAKS, replacement=" ")))
    words = pc.list_flatten(lists).dictionary_encode()
    ids, names = words.indices.to_numpy(zero_copy_only=False), words.dictionary.to_pylist()
    starts = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    if "" in names:  # a text without words comes as one empty word
        real = ids != names.index("")
        starts = np.concatenate([[0], np.cumsum(real)])[starts]
        ids = ids[real]
    return names, ids, starts


def words_of(text: str | None) -> list[str]:
    names, ids, _ = tokenise(pa.array([text], pa.string()))
    return [names[i] for i in ids]


def hashes(words: list[str]) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words (of the whole sequence, if shorter), in order."""
    n = min(n, len(h))
    if not n:
        return h
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = (out ^ h[k:len(h) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


def item_grams(items: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """item_id, item (its words), g, at and w (the words' hashes) for each n-gram of each item."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, (names, ids, starts) = [], tokenise(b.column(1))
            of = hashes(names)
            for i in range(b.num_rows):
                h = of[ids[starts[i]:starts[i + 1]]]
                g, s = signed(ngrams(h, n)), signed(h)
                rows += [(b.column(0)[i].as_py(), len(h), int(x), k, s[k:k + n].tolist()) for k, x in enumerate(g)]
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (
                pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64())))], names=["item_id", "n_words", "g", "at", "w"])

    return items.select(col(id_col).cast("long").alias("item_id"), col(text_col).cast("string").alias("text")).mapInArrow(
        task, "item_id long, n_words int, g long, at int, w array<long>")


def word_counts(docs: DataFrame, wanted: np.ndarray, text_col: str) -> DataFrame:
    """h, n: partial counts of the wanted words; the count of all words under a null h."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, ids, _ = tokenise(b.column(0))
            h, n = hashes(names), np.bincount(ids, minlength=len(names))
            keep = in_filter(wanted, h)
            yield pa.RecordBatch.from_arrays([pa.array(signed(h[keep]).tolist() + [None], pa.int64()),
                                              pa.array(n[keep].tolist() + [len(ids)], pa.int64())], names=["h", "n"])

    return docs.select(col(text_col).cast("string").alias("text")).mapInArrow(task, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def seeds(items: DataFrame, docs: DataFrame, n: int, chance: float, id_col: str, item_text: str, text_col: str) -> DataFrame:
    """item_id, size, g, at: the rare n-grams of each item (all of them, where none is rare)."""
    grams = cut(item_grams(items, n, id_col, item_text).where("item_id is not null"))
    vocab = grams.select(F.explode("w").alias("h")).distinct()
    counts = cut(word_counts(docs, hash_filter(vocab, "h"), text_col))
    total = float((counts.where("h is null").first() or {"n": 0})["n"] or 0) + 1.0
    words = grams.select("item_id", "n_words", "g", "at", F.explode("w").alias("h")).join(counts.where("h is not null"), "h", "left")
    logp = F.log((F.coalesce("n", F.lit(0)) + 1) / F.lit(total))
    rated = (words.groupBy("item_id", "n_words", "g", "at").agg(F.sum(logp).alias("logp"))
             .withColumn("rare", (F.col("logp") + F.log(F.lit(total)) < F.log(F.lit(chance))).cast("int")))
    some = rated.groupBy(F.col("item_id").alias("i")).agg(F.max("rare").alias("some"))
    kept = (F.col("rare") == F.col("some")) & ((F.col("rare") == 1) | (F.col("n_words") >= n))
    return cut(rated.join(some, F.col("item_id") == F.col("i")).where(kept)
               .select("item_id", F.least("n_words", F.lit(n)).alias("size"), "g", "at"))


def hits(docs: DataFrame, wanted: np.ndarray, sizes: list[int], id_col: str, text_col: str) -> DataFrame:
    """doc_id, key, text and places (g, at) of the documents with an n-gram that may be in the filter."""
    place = pa.list_(pa.struct([("g", pa.int64()), ("at", pa.int32())]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, places, (names, ids, starts) = [], [], tokenise(b.column(2))
            of = hashes(names)
            for i in range(b.num_rows):
                h = of[ids[starts[i]:starts[i + 1]]]
                found = []
                for n in sizes:
                    if len(h) >= n:
                        g = ngrams(h, n)
                        at = np.flatnonzero(in_filter(wanted, g))
                        found += [{"g": x, "at": k} for x, k in zip(signed(g[at]).tolist(), at.tolist())]
                if found:
                    take.append(i)
                    places.append(found)
            t = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(t), b.column(1).take(t), b.column(2).take(t), pa.array(places, place)],
                                             names=["doc_id", "key", "text", "places"])

    rows = docs.select(col(id_col).cast("long").alias("doc_id"), text_key(col(text_col)).alias("key"), col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(task, "doc_id long, key string, text string, places array<struct<g:long,at:int>>")


def smith_waterman(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment score of two word-id sequences and its span in ``window`` (end exclusive)."""
    best, row = (0, 0, 0), np.zeros(len(window) + 1, dtype=np.int64)
    begin = np.arange(len(window) + 1)  # where the alignment that ends here began
    steps = np.arange(len(window) + 1) * -GAP
    for w in item:
        score = np.where(window == w, MATCH, MISMATCH)
        diag, up = row[:-1] + score, row[1:] + GAP
        new = np.zeros_like(row)
        new[1:] = np.maximum(np.maximum(diag, up), 0)
        start = np.arange(len(window) + 1)
        start[1:] = np.where(new[1:] == 0, start[1:], np.where(diag >= up, begin[:-1], begin[1:]))
        # gaps along the window: the best earlier cell less one gap per step
        lead = new + steps
        held = np.maximum.accumulate(lead)
        # the first cell that reaches the running maximum
        origin = np.maximum.accumulate(np.concatenate([[0], np.where(lead[1:] > held[:-1], np.arange(1, len(row)), 0)]))
        row = held - steps
        begin = np.where(row > new, start[origin], start)
        k = int(row.argmax())
        if row[k] > best[0]:
            best = (int(row[k]), int(begin[k]), k)
    return best


def align(pairs: DataFrame, min_score: float) -> DataFrame:
    """Aligned pairs: doc_id, key, item_id, score, start, end (words) and the aligned words.

    ``pairs`` has doc_id, key, text, item and ats (seed places as document word - item word)."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                words = words_of(b.column(2)[i].as_py())
                for m in b.column(3)[i].as_py():
                    item = words_of(m["item"])
                    ids = {w: k for k, w in enumerate(dict.fromkeys(item))}
                    iv = np.array([ids[w] for w in item], dtype=np.int64)
                    best, reach = (0, 0, 0), -1
                    spans: list[list[int]] = []
                    for d in sorted(set(m["ats"])):  # windows around the seeds' diagonals, joined where they overlap
                        a, z = max(0, d - len(item)), min(len(words), d + 2 * len(item))
                        if spans and a <= reach:
                            spans[-1][1] = z
                        else:
                            spans.append([a, z])
                        reach = z
                    for a, z in spans:
                        wv = np.array([ids.get(w, -1) for w in words[a:z]], dtype=np.int64)
                        s, x, y = smith_waterman(iv, wv)
                        if s > best[0]:
                            best = (s, a + x, a + y)
                    score = best[0] / (MATCH * len(item))
                    if score >= min_score:
                        rows.append((i, m["item_id"], score, best[1], best[2], " ".join(words[best[1]:best[2]])))
            t = pa.array([r[0] for r in rows], pa.int64())
            cols = [pa.array([r[k] for r in rows], kind) for k, kind in ((1, pa.int64()), (2, pa.float64()), (3, pa.int32()), (4, pa.int32()), (5, pa.string()))]
            yield pa.RecordBatch.from_arrays([b.column(0).take(t), b.column(1).take(t), *cols],
                                             names=["doc_id", "key", "item_id", "score", "start", "end", "passage"])

    return pairs.select("doc_id", "key", "text", "matches").mapInArrow(
        task, "doc_id long, key string, item_id long, score double, start int, end int, passage string")


def contaminated(docs: DataFrame, items: DataFrame, n: int = 4, chance: float = 0.01, min_score: float = 0.5,
                 id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per (document, item) whose alignment reaches ``min_score``: doc_id, key, item_id, score,
    start, end (in words) and the passage."""
    found = seeds(items, docs, n, chance, item_id_col, item_text_col, text_col)
    wanted = hash_filter(found.select("g").distinct(), "g")
    sizes = sorted(r["size"] for r in found.select("size").distinct().collect())  # n, and less for shorter items
    with_hits = cut(hits(docs, wanted, sizes, id_col, text_col).dropDuplicates(["doc_id", "key"]))
    places = with_hits.select("doc_id", "key", F.explode("places").alias("p")).select("doc_id", "key", "p.g", F.col("p.at").alias("d"))
    texts = (items.select(col(item_id_col).cast("long").alias("i"), col(item_text_col).alias("item"))
             .groupBy("i").agg(F.max("item").alias("item")))
    pairs = (places.join(found, "g").groupBy("doc_id", "key", "item_id")
             .agg(F.collect_set(F.col("d") - F.col("at")).alias("ats")))
    matches = (pairs.join(texts, F.col("item_id") == F.col("i"))
               .groupBy(F.col("doc_id").alias("d0"), F.col("key").alias("k0"))
               .agg(F.collect_list(F.struct("item_id", "item", "ats")).alias("matches")))
    joined = with_hits.join(matches, F.col("doc_id").eqNullSafe(F.col("d0")) & (F.col("key") == F.col("k0")))
    return align(joined, min_score)


def keep_clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """``docs`` without the contaminated rows."""
    bad = contaminated(docs, items, id_col=id_col, text_col=text_col, **kw).select("doc_id", "key").distinct()
    rows = docs.select(F.struct("*").alias("row"), col(id_col).cast("long").alias("id"), text_key(col(text_col)).alias("k"))
    return rows.join(bad, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("key")), "left_anti").select("row.*")
