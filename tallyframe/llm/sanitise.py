"""Information-theoretic sanitisation of personal data.

Base spans (e-mail, IP, card, phone) are found by pattern in whole texts; their values are the
protected entities.  Corpus co-occurrence then estimates how strongly other terms reveal them: with
documents as the unit, n(t) documents holding term t, n(e) holding entity e and n(t, e) holding t
within ``WINDOW`` words of e,

    PMI(t; e) = log(N n(t,e) / (n(t) n(e))),   IC(e) = log(N / n(e)),

and t discloses e if PMI >= ``threshold`` * IC, i.e. t alone conveys that share of what there is to
know about e.  The pair must also be significant over the entity's independent contexts: every mention gives
the words around it that no earlier mention of the entity in the document has taken, and contexts of an entity that
share ``RUN`` words in a row, directly or through others, are one group, so a text is one piece of evidence however
often it is copied or edited.  If k of the entity's w groups hold t, and a group holds it by chance with
p = n(t) / N, the Chernoff bound exp(-w KL(k/w || p)) on the chance of k or more must stay below ``alpha`` over
the number of pairs.  (A group's chance is that of a document; a group that grows by edits holds more words, which
only terms of the edits profit from, once a group.)  So a strong pair passes in one or two
documents, and a word seen once beside an entity does not.  A disclosing term is
generalised to its class ([WORD] or [NUMBER]) where the class itself stays below the threshold, else
removed; it is so wherever it occurs, for it reveals the entity there as well.

Three passes of ``mapInArrow`` read texts (mentions; document counts of candidate terms; places of the
disclosing ones; terms are pre-selected by a filter of fixed size), all counts are Spark aggregates over all documents, and hot terms or entities
only meet as partial counts.  Defined cases: null text is empty (``sanitise`` leaves it null); equal rows get equal spans;
an empty table gives no rows; texts of any length are read whole, one at a time; a pair exactly at the threshold
discloses; spans that start alike are ordered by kind, and what spans cover together is replaced once.  ``sanitise``
packs the row, so other columns of any names stay as they are.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import col, cut, hash_filter, in_filter, signed, text_key, word_hash

KINDS = ["email", "ip", "card", "phone", "term"]
WINDOW, RUN = 8, 4
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
WORD = re.compile(r"[^\W_]{2,}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Spans of the e-mail pattern, leftmost and non-overlapping: from each @ to the left and right."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        m = DOMAIN.match(text, at)
        if m:
            start = at
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            if start < at:
                out.append((start, m.end()))
                done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base spans, by start, then kind; offsets are code points."""
    out = [(a, 0, b) for a, b in emails(text)]
    if DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text)
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        for m in PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def entity(text: str, span: tuple[int, int, int]) -> str:
    a, kind, b = span
    value = text[a:b].lower() if kind < 2 else re.sub("[^0-9]", "", text[a:b])
    return f"{kind}:{value}"


def term_class(word: str) -> str:
    return "NUMBER" if DIGIT.search(word) else "WORD"


def class_hash(name: str) -> int:
    return word_hash(f"\x00{name}")


def words_outside(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """(start, end, lower-cased word) of the words that touch no span."""
    out, k, reach = [], 0, -1
    for m in WORD.finditer(text):
        while k < len(spans) and spans[k][0] < m.end():
            reach = max(reach, spans[k][2])
            k += 1
        if m.start() >= reach:
            out.append((m.start(), m.end(), m[0].lower()))
    return out


def runs(words: list[str]) -> list[int]:
    """Hashes of the runs of ``RUN`` words in a row."""
    return [word_hash(" ".join(words[k:k + RUN])) for k in range(len(words) - RUN + 1)]


def mentions(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int, list[int], list[int]]]:
    """(entity, context, number of new terms, terms, runs of words) of the different contexts of a text's
    entities; hashes.  Every word counts for one mention of an entity; the terms that no earlier one has come first."""
    near: dict[int, set[int]] = {}
    taken: dict[int, int] = {}
    out: dict[tuple[int, int], tuple[int, list[int], list[int]]] = {}
    words = words_outside(text, spans)
    starts = np.array([w[0] for w in words], dtype=np.int64)
    for s in spans:
        left = int(np.searchsorted(starts, s[0]))
        right = int(np.searchsorted(starts, s[2]))
        e = word_hash(entity(text, s))
        free = taken.get(e, 0)
        sides = [[w[2] for w in words[max(free, left - WINDOW):left]], [w[2] for w in words[max(free, right):right + WINDOW]]]
        around = sides[0] + sides[1]
        taken[e] = max(free, min(right + WINDOW, len(words)))
        terms = {word_hash(w) for w in around} | {class_hash(term_class(w)) for w in around}
        seen = near.setdefault(e, set())
        new = sorted(terms - seen)
        if around and (c := word_hash(" ".join(around))) and (e, c) not in out:
            out[e, c] = (len(new), new + sorted(terms & seen), sorted({g for side in sides for g in runs(side)}))
        seen |= terms
    for e in near.keys() - {e for e, _ in out}:  # an entity without words around it still counts
        out[e, word_hash("")] = (0, [], [])
    return [(e, c, *said) for (e, c), said in out.items()]


SCAN = ("doc_id long, key string, base array<struct<start:int,kind:int,end:int>>, "
        "mentions array<struct<e:long,c:long,k:int,t:array<long>,g:array<long>>>")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(col(id_col).cast("long").alias("doc_id"), text_key(col(text_col)).alias("key"),
                       F.coalesce(col(text_col), F.lit("")).alias("text"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base spans and entity mentions of every row."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    mention = pa.list_(pa.struct([("e", pa.int64()), ("c", pa.int64()), ("k", pa.int32()), ("t", pa.list_(pa.int64())), ("g", pa.list_(pa.int64()))]))
    wrap = lambda h: h - (1 << 64) if h >> 63 else h

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, said = [], []
            for t in b.column(2):
                text = t.as_py()
                spans = base_spans(text)
                base.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
                said.append([{"e": wrap(e), "c": wrap(c), "k": k, "t": [wrap(x) for x in ts], "g": [wrap(x) for x in gs]} for e, c, k, ts, gs in mentions(text, spans)] if spans else [])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(base, span), pa.array(said, mention)],
                                             names=["doc_id", "key", "base", "mentions"])

    return _keyed(docs, id_col, text_col).mapInArrow(task, SCAN)


def _lower_words(text: str) -> list[str]:
    return list(set(map(str.lower, set(WORD.findall(text)))))


def term_counts(docs: DataFrame, terms: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """t, n: partial counts (per batch of rows) of the documents that hold a term of the filter, or a class."""
    classes = {name: class_hash(name) for name in ("WORD", "NUMBER")}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: Counter = Counter()
            for t in b.column(2):
                seen = _lower_words(t.as_py())
                h = np.fromiter(map(word_hash, seen), np.uint64, len(seen))
                counts.update(h[in_filter(terms, h)].tolist())
                if seen:
                    counts[classes["WORD"]] += 1
                if any(map(DIGIT.search, seen)):
                    counts[classes["NUMBER"]] += 1
            yield pa.RecordBatch.from_arrays([pa.array(signed(np.array(list(counts), dtype=np.uint64))),
                                              pa.array(list(counts.values()), pa.int64())], names=["t", "n"])

    return _keyed(docs, id_col, text_col).mapInArrow(task, "t long, n long")


HITS = "doc_id long, key string, t long, cls string, spans array<struct<start:int,kind:int,end:int>>"


def occurrences(docs: DataFrame, terms: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Where terms that may be in the filter occur: a row per document and term."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for i in range(b.num_rows):
                text = b.column(2)[i].as_py()
                seen = _lower_words(text)
                h = np.fromiter(map(word_hash, seen), np.uint64, len(seen))
                hot = in_filter(terms, h)
                if hot.any():
                    named = {seen[j]: int(signed(h[j:j + 1])[0]) for j in np.flatnonzero(hot)}
                    at: dict[str, list[dict]] = {}
                    for s, e, w in words_outside(text, base_spans(text)):
                        if w in named:
                            at.setdefault(w, []).append({"start": s, "kind": 4, "end": e})
                    rows += [(i, named[w], term_class(w), x) for w, x in at.items()]
            take = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([r[2] for r in rows], pa.string()), pa.array([r[3] for r in rows], span)],
                names=["doc_id", "key", "t", "cls", "spans"])

    return _keyed(docs, id_col, text_col).mapInArrow(task, HITS)


def context_groups(scanned: DataFrame) -> DataFrame:
    """e, c, context: the group of each context of an entity; contexts that share a run of words are of one group.

    A run links its contexts to the least of them, so the links are as many as the runs of the contexts."""
    node = F.xxhash64("e", "c").alias("node")
    contexts = scanned.select(F.explode("mentions").alias("m")).select("m.e", "m.c", "m.g").dropDuplicates(["e", "c"])
    runs_of = cut(contexts.select(node, "e", F.explode("g").alias("g")))
    least = runs_of.groupBy(F.col("e").alias("e0"), F.col("g").alias("g0")).agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1")
    links = (runs_of.join(least, (F.col("e") == F.col("e0")) & (F.col("g") == F.col("g0"))).where("node != b")
             .select(F.col("node").alias("a"), "b"))
    roots = simhash.components(links).select(F.col("node").alias("linked"), "root")
    return (contexts.select("e", "c", node).join(roots, F.col("node") == F.col("linked"), "left")
            .select("e", "c", F.coalesce("root", "node").alias("context")))


def significant(k: Column, w: Column, p: Column, limit: Column) -> Column:
    """Whether the Chernoff bound on k or more of w contexts, each with chance p, is below exp(-``limit``)."""
    q = k / w
    rest = F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - p))).otherwise(0.0)
    return F.when((p < 1) & (q > p), w * (q * F.log(q / p) + rest) > limit).otherwise(False)


def disclosing(scanned: DataFrame, groups: DataFrame, counts: DataFrame, pairs: DataFrame, threshold: float, limit: float) -> DataFrame:
    """t, disclosure: the terms whose PMI reaches ``threshold`` of some entity's information content, over
    groups of contexts that are significant."""
    n = scanned.count()
    n_e = scanned.select(F.explode(F.array_distinct("mentions.e")).alias("e")).groupBy("e").agg(F.count("*").alias("n_e"))
    w_e = groups.select("e", "context").distinct().groupBy("e").agg(F.count("*").alias("w"))
    n_t = counts.groupBy("t").agg(F.sum("n").alias("n_t"))
    ic = F.log(F.lit(float(n)) / F.col("n_e"))
    pmi = F.log(F.lit(float(n)) * F.col("n_te") / (F.col("n_t") * F.col("n_e")))
    sure = significant(F.col("contexts"), F.col("w"), F.col("n_t") / F.lit(float(n)), F.lit(limit))
    return (pairs.join(n_e, "e").join(w_e, "e").join(n_t, "t").where(sure)
            .withColumn("disclosure", F.when(ic > 0, pmi / ic).otherwise(0.0))
            .where(F.col("disclosure") >= threshold).groupBy("t").agg(F.max("disclosure").alias("disclosure")))


def disclosures(docs: DataFrame, threshold: float = 0.7, alpha: float = 0.01, id_col: str = "doc_id",
                text_col: str = "text") -> DataFrame:
    """Per row: doc_id, key, base and terms (spans: start, kind, end, in order; kinds index ``KINDS``)
    and removed (starts of the term spans whose class discloses as well)."""
    scanned = cut(scan(docs, id_col, text_col))
    groups = cut(context_groups(scanned))
    said = (scanned.select(F.explode("mentions").alias("m")).select("m.*").groupBy("e", "c", "k", "t").agg(F.count("*").alias("rows"))
            .join(groups, ["e", "c"]).select("e", "context", "k", "rows", F.posexplode("t").alias("pos", "t"))
            .withColumn("new", F.when(F.col("pos") < F.col("k"), F.col("rows")).otherwise(0)))
    pairs = cut(said.groupBy("t", "e", "context").agg(F.sum("new").alias("n")).groupBy("t", "e")
                .agg(F.count("*").alias("contexts"), F.sum("n").alias("n_te")))
    limit = math.log(max(pairs.count(), 1) / alpha)
    # n(t) >= n(t, e), so the bound is p ** k at least: what fails with that cannot pass, and its term need not be counted
    pairs = pairs.where(F.col("contexts") * F.log(F.lit(float(max(scanned.count(), 1))) / F.col("n_te")) > limit)
    counts = term_counts(docs, hash_filter(pairs.select("t").distinct(), "t"), id_col, text_col)
    telling = cut(disclosing(scanned, groups, counts, pairs, threshold, limit))
    hits = (occurrences(docs, hash_filter(telling.select("t"), "t"), id_col, text_col)
            .join(telling.select("t"), "t", "left_semi"))
    classes = {c: int(signed([class_hash(c)])[0]) for c in ("WORD", "NUMBER")}
    telling_classes = telling.where(F.col("t").isin(list(classes.values()))).select("t")
    bad = {r["t"] for r in telling_classes.collect()}  # two rows at most
    gone = F.col("cls").isin([c for c, h in classes.items() if h in bad]) if bad else F.lit(False)
    per_doc = (hits.groupBy("doc_id", "key").agg(
                   F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("terms"),
                   F.array_distinct(F.flatten(F.collect_list(F.when(gone, F.col("spans.start")).otherwise(F.array().cast("array<int>"))))).alias("removed"))
               .select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "terms", "removed"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return (scanned.select("doc_id", "key", "base")
            .join(per_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")
            .select("doc_id", "key", "base", F.coalesce("terms", none).alias("terms"),
                    F.coalesce("removed", F.array().cast("array<int>")).alias("removed")))


def count_kind(spans: Column, kind: int) -> Column:
    """How many of the spans are of a kind (the lambda has one parameter: Spark gives a second one the place in the array)."""
    return F.size(F.filter(spans, lambda s: s["kind"] == kind))


def spelt(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: str, spans: list[tuple[int, int, int]], removed: set[int]) -> str:
    """``text`` with base spans replaced by their kind and term spans by their class or nothing."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out.append(text[at:start])
            if kind < 4:
                out.append(f"[{KINDS[kind].upper()}]")
            elif start not in removed:
                out.append(f"[{term_class(text[start:end])}]")
        at = max(at, end)
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, threshold: float = 0.7, alpha: float = 0.01, id_col: str = "doc_id",
             text_col: str = "text") -> DataFrame:
    """``docs`` with the text sanitised; other columns and the number of rows stay."""
    found = (disclosures(docs, threshold, alpha, id_col, text_col).where((F.size("base") > 0) | (F.size("terms") > 0))
             .select(F.col("doc_id").alias("d"), F.col("key").alias("k"), F.array_sort(F.concat("base", "terms")).alias("spans"), "removed")
             .dropDuplicates(["d", "k"]))
    rows = docs.select(F.struct("*").alias("row"), col(id_col).cast("long").alias("id"), text_key(col(text_col)).alias("key"))
    joined = rows.join(found, F.col("id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")), "left")

    @F.pandas_udf("string")
    def clean(text, spans, removed):
        import pandas as pd
        return pd.Series([t if s is None or t is None else redact(
            t, [(x["start"], x["kind"], x["end"]) for x in s], set(r)) for t, s, r in zip(text, spans, removed)])

    names = docs.columns
    fields = [clean(F.col("row").getField(text_col), "spans", "removed").alias(c) if c == text_col
              else F.col("row").getField(c).alias(c) for c in names]
    return joined.select(*fields)
