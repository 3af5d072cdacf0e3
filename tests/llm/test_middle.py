"""Cuts by the wavelet matrix against a plain reading of the definition."""

import hashlib
import random
import re

import numpy as np
import pytest

from tallyframe.llm import middle

TEXTS = [None, "", "a", "é", "ab cd", "naïve café 中文 😀 x", "  \n\t ", "a<P>b", "<S>", "x<M", "Zz09az{`@[", "word " * 3000, "x" * 100_000, "é" * 70,
         "a" * 63, "a" * 64, "a b" * 64, "\x00a\x00", "<P", "P>"]


def plain(doc_id, text):
    text = text or ""
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * k:8 * k + 8], 16) for k in range(4)]
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
    if not text or any(s in text for s in middle.SENTINELS) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text, text
    form = "spm" if h[3] % 100 < 20 else "psm"
    return doc_id, n, form, len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}" if form == "psm" else f"<S>{suf}<P>{pre}<M>{mid}", text


def test_ranks():
    rnd = np.random.default_rng(3)
    for n in (0, 1, 63, 64, 65, 1000):
        symbols = rnd.integers(0, 4, n).astype(np.uint8)
        matrix = middle.WaveletMatrix(symbols, 2)
        for s in range(4):
            want = np.concatenate(([0], np.cumsum(symbols == s)))
            assert (matrix.rank(s, np.arange(n + 1)) == want).all()


@pytest.mark.parametrize("size", [1, 50, 1 << 24])
def test_every_row(spark, monkeypatch, size):
    monkeypatch.setattr(middle, "BYTES", size)
    rnd = random.Random(2)
    data = [(k, t) for k, t in enumerate(TEXTS * 3)] + [(None, "null id text"), (7, "same id other text"), (7, "same id other text")]
    data += [(k, "".join(rnd.choice("ab <>PSM é中\n1") for _ in range(rnd.randint(0, 60)))) for k in range(1000, 1300)]
    docs = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in data], "doc_id long, text string, output string, form string, n int")
    made = middle.transform(docs)
    got = made.withColumn("restored", middle.restore(made["form"], made["output"]))
    want = [plain(i, t) for i, t in data]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_empty_table(spark):
    assert middle.transform(spark.createDataFrame([], "doc_id long, text string")).count() == 0
