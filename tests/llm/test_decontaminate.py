import random

import numpy as np

from tallyframe.llm import decontaminate

DOC = "doc_id long, text string, item_id long, score string"
ITEM = "item_id long, text string, extra string"


def brute_score(a, b):
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            h[i + 1][j + 1] = max(0, h[i][j] + (2 if x == y else -1), h[i][j + 1] - 1, h[i + 1][j] - 1)
    return max(map(max, h))


def test_alignment_matches_brute_force():
    rnd = random.Random(1)
    for _ in range(500):
        a = [rnd.randint(0, 4) for _ in range(rnd.randint(1, 12))]
        b = [rnd.randint(0, 5) for _ in range(rnd.randint(1, 25))]
        s, x, y = decontaminate.smith_waterman(np.array(a), np.array(b))
        assert s == brute_score(a, b) and (not s or brute_score(a, b[x:y]) == s)


def corpus():
    rnd = random.Random(5)
    vocab = [f"t{i}q" for i in range(800)]
    items = [(i, " ".join(rnd.choice(vocab) for _ in range(40)), "e") for i in range(6)] + [(7, None, "e"), (8, "of the", "e"), (9, "", "e")]
    docs = []
    for d in range(120):
        words = [rnd.choice(vocab + ["of", "the"] * 200) for _ in range(150)]
        if d % 10 == 0:
            leak = items[d // 10 % 6][1].split()
            if d % 20 == 0:  # an edited copy: a tenth of the words replaced, some dropped
                leak = [rnd.choice(vocab) if k % 11 == 5 else w for k, w in enumerate(leak) if k % 17 != 16]
            words[50:50] = leak
        docs.append((d, ", ".join(words).title(), 1, "s"))
    docs += [(500 + i, docs[0][1], 1, "s") for i in range(100)]  # a hot leak
    return docs, items


def test_pairs_match_brute_force(spark):
    docs, items = corpus()
    got = decontaminate.contaminated(spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)).collect()
    found = {(r["doc_id"], r["item_id"]): r["score"] for r in got}
    want = {}
    for i, text, _ in items[:6]:
        item = decontaminate.words_of(text)
        for d, t, *_ in docs[:120]:
            s = brute_score(item, decontaminate.words_of(t)) / (2 * len(item))
            if s >= 0.5:
                want[d, i] = s
    want |= {(500 + k, i): s for (d, i), s in want.items() if d == 0 for k in range(100)}
    assert found == want and len({d for d, _ in want}) == 112


def test_keep_clean(spark):
    docs, items = corpus()
    docs += [(None, None, 1, "s"), (900, "", 1, "s"), (901, "of the", 1, "s"), (901, "of the", 1, "s")]
    df = spark.createDataFrame(docs, DOC)
    kept = decontaminate.keep_clean(df, spark.createDataFrame(items, ITEM))
    assert kept.columns == df.columns
    assert kept.count() == len(docs) - 112
    assert decontaminate.keep_clean(spark.createDataFrame([], DOC), spark.createDataFrame(items, ITEM)).count() == 0
    assert decontaminate.keep_clean(df, spark.createDataFrame([], ITEM)).count() == len(docs)
