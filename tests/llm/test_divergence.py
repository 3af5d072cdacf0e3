"""Source audit against the plain definition over all terms."""

import random
import re
from collections import Counter, defaultdict

import pytest

from tallyframe.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, value string"


def brute(rows, min_docs=30, top=50):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        terms = re.findall(divergence.TERM, (text or "").translate(lower))
        groups[lang].add(source)
        count[lang, source].update(terms)
        count[lang].update(terms)
        docs[lang].update(set(terms))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, d in docs[lang].items() if d >= min_docs]

        def shares(c):
            total = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // total for t in kept}

        p, q = {s: shares(count[lang, s]) for s in sources}, shares(count[lang])
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[r][t]) for t in kept), r) for r in sources if r != s]
            terms = [(p[s][t] - q[t], t) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, i, v, k + 1) for k, (v, i) in enumerate(found) if part == "pair" or k < top]
    return sorted(out)


def table(seed, n, sources=9):
    rnd = random.Random(seed)
    words = ["W%d" % k for k in range(60)] + ["ÉCLAT", "naïve", "中文", "😀", "Xx"]
    words = [re.sub(r"\d", lambda d: "abcdefghij"[int(d[0])], w) for w in words]
    rows = []
    for k in range(n):
        s = f"s{min(rnd.randrange(sources * 2), sources)}"
        text = rnd.choice([" ", ", ", "\n"]).join(rnd.choice(words[:10 + 7 * int(s[1:])]) for _ in range(rnd.randint(0, 40)))
        rows.append((rnd.choice([k, None]), rnd.choice([text] * 9 + [None]), rnd.choice(["en", "en", "de", None, ""]), rnd.choice([s] * 8 + [None]), "x"))
    return rows + rows[:20]


@pytest.mark.parametrize("min_docs,top", [(1, 50), (30, 50), (10, 3), (10_000, 50)])
def test_matches_the_definition(spark, min_docs, top):
    rows = table(min_docs, 500)
    got = divergence.audit(spark.createDataFrame(rows, SCHEMA), min_docs=min_docs, top=top).collect()
    assert sorted(map(tuple, got)) == brute(rows, min_docs, top)


def test_small_memory_gives_the_same(spark, monkeypatch):
    rows = table(77, 300)
    want = brute(rows, 5)
    for name in ("TERMS", "SUMS"):
        monkeypatch.setattr(divergence, name, 1)
    assert sorted(map(tuple, divergence.audit(spark.createDataFrame(rows, SCHEMA), min_docs=5).collect())) == want


def test_many_sources_grow_the_path(spark):
    rows = [(k, "alpha beta " * (k % 7) + "gamma", "en", f"source {k:03}", "") for k in range(150)]
    assert sorted(map(tuple, divergence.audit(spark.createDataFrame(rows, SCHEMA)).collect())) == brute(rows)


def test_odd_tables(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, None, None, None, None), (2, "", "", "b", None), (3, "12 34", "en", "a", None)]
    assert sorted(map(tuple, divergence.audit(spark.createDataFrame(rows, SCHEMA)).collect())) == brute(rows)
    long = [(k, "lang " * 20_000, "en", "a" if k % 2 else "b", None) for k in range(40)]
    assert sorted(map(tuple, divergence.audit(spark.createDataFrame(long, SCHEMA)).collect())) == brute(long)


def test_large_counts_stay_exact(spark):
    from pyspark.sql import functions as F
    n, total = 3_000_000_000_000, 7_000_000_000_001
    got = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(12_345), 5, 10 ** 9).alias("p")).first().p
    assert got == 1 + 10 ** 9 * (n + 5) // (total + 5 * 12_345)
