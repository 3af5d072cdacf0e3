"""The pipeline and its stages against brute force over a small table, and the driver contract."""

import hashlib
import math
import os
import re
import subprocess
import sys

import numpy as np
import pytest

import corpus_pipeline
from tallyframe.llm import decontaminate, sanitise
from tests.llm.test_mixing import water
from tests.llm.test_sanitise import brute as brute_spans
from tests.llm.test_simhash import brute_components, brute_fingerprint

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="module")
def result(spark):
    return corpus_pipeline.run(spark, SF).collect()


def test_run_matches_brute_force(spark, result):
    docs = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]
    items = [decontaminate.words_of(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    # 1: every text in some language stays
    docs = [d for d in docs if re.search(r"[^\W\d_]", d["text"] or "")]
    # 2: the least id of each component
    fps = {d["doc_id"]: brute_fingerprint(d["text"]) for d in docs}
    root = brute_components(sorted(set(fps.values())))
    first = {}
    for d in docs:
        r = root[fps[d["doc_id"]]]
        first[r] = min(first.get(r, d["doc_id"]), d["doc_id"])
    docs = [d for d in docs if first[root[fps[d["doc_id"]]]] == d["doc_id"]]

    # 3: no benchmark item aligns with half its score
    def leaked(d):
        words = decontaminate.words_of(d["text"])
        for item in items:
            ids = {w: k for k, w in enumerate(dict.fromkeys(item))}
            there = np.array([ids.get(w, -1) for w in words])
            if (there >= 0).sum() * 2 >= len(item):
                s, _, _ = decontaminate.smith_waterman(np.array([ids[w] for w in item]), there)
                if s / (2 * len(item)) >= 0.5:
                    return True
        return False

    docs = [d for d in docs if not leaked(d)]
    # 4: base spans are replaced (no term of this table reaches the support)
    for d in docs:
        d["text"] = sanitise.redact(d["text"], [(a, k, b) for a, k, b in brute_spans(d["text"])], set())
        d["n_chars"] = len(d["text"])
    # 5: copies by source
    size = {d["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", d["text"])) for d in docs}
    names = sorted({d["source"] for d in docs})
    sums = [sum(size[d["doc_id"]] for d in docs if d["source"] == n) for n in names]
    rate = {n: t / s for n, t, s in zip(names, water(sums, [(3, 1, 2)[k % 3] for k in range(len(names))]), sums)}
    want = []
    for d in docs:
        u = int(hashlib.md5(f"42:{d['doc_id']}".encode()).hexdigest()[:13], 16) / 2 ** 52
        r = rate[d["source"]]
        want += [(d["doc_id"], d["text"], d["lang"], d["source"], d["n_chars"], c + 1) for c in range(math.floor(r) + (u < r - math.floor(r)))]
    got = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], r["copy"]) for r in result]
    assert sorted(got) == sorted(want)


def test_stages_keep_columns_and_meet_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "the quick brown fox " * 9, "en", "a", 180), (1, "the quick brown fox " * 9, "en", "a", 180), (2, None, None, None, None),
            (None, "ein kleiner text in einer sprache " * 4, "de", None, 1), (3, "", "en", "b", 0), (4, "123", "en", "b", 3),
            (5, "word " * 50_000, "en", "b", 250_000)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, SF).columns == docs.columns, name
        kept = {name: stage(spark, docs, SF).count() for name, stage in corpus_pipeline.STAGES}
        if data:
            assert (kept["language"], kept["duplicates"], kept["benchmark"], kept["private"]) == (4, 5, 7, 7)
        else:
            assert set(kept.values()) == {0}


def test_the_rest_works_without_the_subpackage(tmp_path):
    code = ("import sys; sys.modules['tallyframe.llm'] = None\n"
            "class Gone:\n"
            "    def find_spec(self, name, path=None, target=None):\n"
            "        if name.startswith(('tallyframe.llm', 'corpus_pipeline')): raise ModuleNotFoundError(name, name=name)\n"
            "sys.meta_path.insert(0, Gone())\n"
            "import __spark_entry__ as e\n"
            "q, s = e.queries(), e.oracle_sql()\n"
            "assert 'pipeline' not in q and len(q) > 200 and not any(x.startswith('op') for x in q)\n")
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_contract():
    import __spark_entry__ as entry
    names = set(entry.queries())
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1


def test_columns_of_any_name_pass(spark, tmp_path):
    extra = ["copy", "Score", "SIZE", "taken", "a.b", "lang_pred", "row", "key", "id", "k", "rate", "u", "src", "target", "_found", "d", "spans"]
    text = "the quick brown fox jumps over the lazy dog and this is plain english text of some length "
    data = [(k, f"{text * 2} number {k} " + " ".join(f"w{k}x{j}" for j in range(30)) + (" mail a@b.co" if k % 2 else ""), "en", f"s{k % 3}", 1,
             *(f"{c}-{k}" for c in extra)) for k in range(12)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra)
    spark.createDataFrame(data, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", *extra, "copy_1"]
    rows = out.collect()
    assert rows and all(r[c] == f"{c}-{r['doc_id']}" for r in rows for c in extra)
    assert {r["doc_id"] for r in rows} <= set(range(12)) and any("[EMAIL]" in r["text"] for r in rows)


def test_executors_need_not_have_the_library(tmp_path):
    code = (f"import sys; sys.path.insert(0, {ROOT!r})\n"
            "import __spark_entry__ as e\n"
            "from tallyframe.session import get_spark\n"
            "spark = get_spark('local[4]', 4, extra={'spark.checkpoint.dir': sys.argv[1]})\n"
            "def gone(batches):\n"
            "    import importlib.util\n"
            "    assert importlib.util.find_spec('tallyframe') is None\n"
            "    yield from batches\n"
            "assert spark.range(1).mapInArrow(gone, 'id long').count() == 1\n"
            "for n, q in sorted(e.queries().items()):\n"
            "    if n == 'pipeline' or n.startswith('op'):\n"
            f"        q(spark, {SF!r}).write.format('noop').mode('overwrite').save()\n"
            "        print('ran', n, flush=True)\n")
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "SPARK_HOME")}
    done = subprocess.run([sys.executable, "-c", code, str(tmp_path / "shared")], cwd=tmp_path, env=env, timeout=900,
                          capture_output=True, text=True)
    assert done.stdout.count("ran ") == 14, done.stdout[-500:] + done.stderr[-3000:]
