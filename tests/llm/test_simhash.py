import random
import re

import numpy as np
import pytest
import xxhash

from tallyframe.llm import simhash

DOC = "doc_id long, text string, fp string, key string"


def brute_fingerprint(text, words=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    shingles = [" ".join(w[i:i + words]) for i in range(max(1, len(w) - words + 1))]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps, radius=2):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if bin(a ^ b).count("1") <= radius:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {f: find(f) for f in fps}


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one two", "A b C d", "É é x y z", "a " * 40_000, "x\x0by\x0cz w"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_masks_cover_every_pair():
    ms = [m & ((1 << 64) - 1) for m in simhash.masks(2)]
    for i in range(64):
        for j in range(i, 64):
            diff = (1 << i) | (1 << j)
            assert any(m & diff == 0 for m in ms)


@pytest.mark.parametrize("bucket_rows", [1, 256])
def test_components_match_brute_force(spark, bucket_rows):
    rnd = random.Random(7)
    base = [rnd.getrandbits(64) for _ in range(12)]
    fps = set(base) | {0}
    for b in base:  # chains of near fingerprints
        x = b
        for _ in range(6):
            x ^= (1 << rnd.randrange(64)) | (1 << rnd.randrange(64))
            fps.add(x)
    signed = [int(np.uint64(f).view(np.int64)) for f in sorted(fps)]
    nodes = spark.createDataFrame([(s,) for s in signed], "fp long")
    found = {r["node"]: r["root"] for r in simhash.components(simhash.links(nodes, 2, bucket_rows)).collect()}
    want = brute_components(sorted(fps))
    groups, mine = {}, {}
    for f in fps:
        s = int(np.uint64(f).view(np.int64))
        groups.setdefault(want[f], set()).add(s)
        mine.setdefault(found.get(s, s), set()).add(s)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_documents(spark):
    same = "the quick brown fox jumps over the lazy dog again and again"
    data = [(5, same, "a", "b"), (3, same.upper(), "a", "b"), (9, None, "c", "d"), (8, " ", "c", "d"), (None, same, "e", "f"),
            (7, "something else entirely is written in this text here", "g", "h"), (7, "something else entirely is written in this text here", "g", "h")]
    docs = spark.createDataFrame(data, DOC)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(data)
    by_id = {r["doc_id"]: r["component_id"] for r in got}
    assert by_id == {5: 3, 3: 3, None: 3, 9: 8, 8: 8, 7: 7}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 7, 8]
    assert simhash.near_duplicates(spark.createDataFrame([], DOC)).count() == 0


def test_other_radius_needs_small_buckets(spark):
    nodes = spark.createDataFrame([(i,) for i in (0, 1, 3)], "fp long")
    assert simhash.links(nodes, 1).count() == 2
    with pytest.raises(ValueError):
        simhash.links(nodes, 1, bucket_rows=1)
