import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from tallyframe.llm import langid

SYLLABLES = {"aa": ["ka", "lo", "mi", "pu"], "bb": ["ster", "ung", "lich", "zeit"], "cc": ["eau", "oix", "ment", "que"]}


def text(lang, rnd, n):
    return " ".join("".join(rnd.choice(SYLLABLES[lang]) for _ in range(rnd.randint(1, 3))) for _ in range(n))


def rows(n=90):
    rnd = random.Random(2)
    return [(i, text(lang, rnd, rnd.randint(3, 60)) + ("\n" + text(lang, rnd, 5) if i % 3 else ""), lang)
            for i, lang in zip(range(n), itertools.cycle(SYLLABLES))]


def test_marginals_match_enumeration():
    rng = np.random.default_rng(1)
    scores, moves, lens = rng.normal(size=(7, 3)), rng.normal(size=(3, 3)), np.array([4, 3])
    got, expected = langid.forward_backward(scores, lens, moves)
    assert np.allclose(got, langid.marginals(scores, lens, moves))
    at, total = 0, np.zeros((3, 3))
    for n in lens:
        weight, mass = np.zeros((n, 3)), 0.0
        pairs = np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            p = np.exp(sum(scores[at + t, k] for t, k in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
            mass += p
            for t, k in enumerate(path):
                weight[t, k] += p
            for a, b in zip(path, path[1:]):
                pairs[a, b] += p
        assert np.allclose(got[at:at + n], weight / mass)
        total += pairs / mass
        at += n
    assert np.allclose(expected, total)


def test_code_switching_is_labelled_by_span():
    model = langid.fit([(t, lang) for _, t, lang in rows()], sequences=600, rounds=15)
    rnd = random.Random(9)
    mixed = text("aa", rnd, 12) + " " + text("bb", rnd, 12)
    got = [lang for _, lang, _ in langid.label_words(model, mixed)]
    assert got[:11] == ["aa"] * 11 and got[13:] == ["bb"] * 11
    assert model.moves.diagonal().min() > (model.moves - 9 * np.eye(3)).max()


def test_held_out_accuracy_and_defined_cases(spark):
    data = rows() + [(1000, None, "aa"), (1001, "", None), (1002, "123 !?", "bb"), (1003, "kalo mipu lo", None), (1003, "kalo mipu lo", None),
                     (1004, "ster ung " * 30_000, None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = langid.identify(df, train_on=F.col("doc_id") % 3 != 4, docs_per_lang=20).collect()
    by_id = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}
    assert len(got) == len(data)
    assert all(by_id[i][0] == lang and 0 <= by_id[i][1] <= 1 for i, _, lang in rows())
    assert [by_id[i] for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert by_id[1003][0] == "aa" and by_id[1004][0] == "bb"


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert [r["lang_pred"] for r in langid.identify(df).collect()] == ["und"]
    assert langid.identify(df.limit(0)).count() == 0


def test_query_accuracy(spark):
    from tallyframe.llm.queries import QUERIES
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op7_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.where("held_out").collect()
    assert len(held) > 150 and sum(r["lang"] == r["lang_pred"] for r in held) / len(held) >= 0.98
