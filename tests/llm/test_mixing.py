import re

import pytest

from tallyframe.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string"


def rows(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def water(sizes, weights, share=1.5, cap=2.0):
    """Brute force: hold the sources above their cap, share the rest by weight, until none is above."""
    total, held = share * sum(sizes), set()
    while True:
        free = [i for i in range(len(sizes)) if i not in held]
        rest = total - sum(cap * sizes[i] for i in held)
        level = rest / sum(weights[i] for i in free) if free else 0
        over = {i for i in free if weights[i] * level > cap * sizes[i]}
        if not over:
            return [cap * sizes[i] if i in held else weights[i] * level for i in range(len(sizes))]
        held |= over


def test_targets_match_brute_force(spark):
    data = [(i, "w " * (1 + i % 7), f"s{i % 5}" if i % 5 else None, "x") for i in range(300)]
    got = mixing.mix(rows(spark, data)).collect()
    names = sorted({d[2] for d in data if d[2]}) + [None]
    sizes = [sum(len(re.findall(r"[^\x20\x09-\x0D]+", d[1])) for d in data if d[2] == n) for n in names]
    want = dict(zip(names, water(sizes, [(3, 1, 2)[k % 3] for k in range(len(names))])))
    assert len(got) == len(data)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
    taken = {n: sum(r["taken"] for r in got if r["source"] == n) for n in names}
    for n, t in want.items():
        assert abs(taken[n] - t) < 0.35 * t


def test_nulls_repeats_and_clashing_names(spark):
    data = [(None, None, None, "a"), (1, "", "s", "b"), (1, "", "s", "b"), (2, "one two", "s", "c"), (None, "x y", "t", None)]
    got = mixing.mix(rows(spark, data))
    assert got.columns.count("size") == 1 and got.count() == 5
    assert [r["size"] for r in got.where("doc_id = 2").collect()] == [2]
    twice = [mixing.mix(rows(spark, data)).orderBy("doc_id", "text").collect() for _ in range(2)]
    assert twice[0] == twice[1]


def test_emit_repeats_rows(spark):
    data = [(i, "a b c", "s", "x") for i in range(50)]
    mixed = mixing.mix(rows(spark, data))
    assert mixing.emit(mixed).count() == sum(r["copies"] for r in mixed.collect())


def test_empty(spark):
    assert mixing.mix(rows(spark, [])).count() == 0
