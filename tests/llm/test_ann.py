import numpy as np

from tallyframe.llm import ann


def vectors(spark, data):
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, score double, v string")


def brute(rows, q, k):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float32).astype(float)
    score = np.cumsum(x * x[list(ids).index(q)], axis=1)[:, -1]
    order = [j for j in np.lexsort((ids, -score)) if ids[j] != q][:k]
    return [(int(ids[j]), float(score[j])) for j in order]


def test_recall_on_clusters_norms_and_copies(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 16)) * rng.uniform(0.5, 2.0, size=(900, 1))
    x[300:500] = x[7]  # one very common vector
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    df = vectors(spark, [(i, v, 0.0, "c") for i, v in rows])
    got = ann.Index(df, k=10).search(df.where("vec_id % 20 = 0")).collect()
    hit = total = 0
    for q in range(0, 900, 20):
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        want = brute(rows, q, 10)
        assert [m[0] for m in mine] == list(range(1, 11))
        assert all(s == dict(brute(rows, q, 900))[v] for _, v, s in mine)
        hit += len({w[0] for w in want} & {m[1] for m in mine})
        total += 10
        if q in (300, 400):
            assert [m[1] for m in mine] == [w[0] for w in want]
    assert hit / total >= 0.95


def test_blocks_and_chunks_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(5)
    df = vectors(spark, [(i, [float(c) for c in rng.normal(size=8)], 0.0, "c") for i in range(400)])
    whole = sorted(map(tuple, ann.Index(df, k=5).search(df, p=0.9999).collect()))
    monkeypatch.setattr(ann, "BLOCK", 50)
    monkeypatch.setattr(ann, "CHUNK", 30)
    parts = sorted(map(tuple, ann.Index(df, k=5).search(df, p=0.9999).collect()))
    assert len(set(whole) & set(parts)) >= 0.99 * len(whole) and len(whole) == len(parts) == 2000


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    data = [(0, [1.0, 0.0], 0.0, "x"), (20, [0.0, 0.0], 0.0, "x"), (40, None, 0.0, "x"), (60, [nan, 1.0], 0.0, "x"), (80, [inf, 1.0], 0.0, "x"),
            (1, [1.0, 2.0], 0.0, "x"), (1, [1.0, 2.0], 0.0, "x"), (2, [1.0], 0.0, "x"), (3, [None, 1.0], 0.0, "x"), (None, [1.0, 1.0], 0.0, "x"),
            (100, [-1.0, 0.0], 0.0, "x")]
    df = vectors(spark, data)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.Index(df).search(df.where("vec_id % 20 = 0")).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 100, -1.0), (100, 1, 0, -1.0), (100, 2, 1, -1.0)]
    none = df.where("vec_id = -5")
    assert ann.Index(none).search(none).count() == 0
    assert ann.Index(df).search(none).count() == 0


def test_quantile():
    assert abs(ann.chi2_quantile(0.95, 2) - 5.991465) < 1e-5 and abs(ann.chi2_quantile(0.95, 8) - 15.507313) < 1e-5
