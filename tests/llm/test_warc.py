import hashlib

import pyarrow.fs
import zstandard

from tallyframe.llm import warc

PAGE = "page_id long, url string, html string, digest string, payload string"


def pages(spark):
    long = "é" * 700
    data = [(1, "http://a/ x\n", long), (9, "http://b", long), (4, None, long), (2, "u", "short"), (3, "u", "short"), (5, "u", None),
            (None, "u", long), (6, "u", "x" * 3_000_000), (7, "u", "x\r\n\r\nWARC/1.1\r\n"), (8, "u", "y" * 999), (10, "u", "y" * 999),
            (11, "u", "z" * 1000), (12, "u", "z" * 1000), (12, "u", "z" * 1000)]
    return data, spark.createDataFrame([(*r, "c", "d") for r in data], PAGE)


def test_round_trip(spark):
    data, df = pages(spark)
    got = sorted(map(tuple, warc.round_trip(df).collect()), key=str)
    want = []
    for i, _, text in data:
        raw = (text or "").encode()
        same = [j for j, _, t in data if t == text and j is not None]
        first = max(same) if len(raw) >= 1000 else None
        revisit = first is not None and first != i
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    assert got == sorted(want, key=str)
    assert warc.round_trip(df.limit(0)).count() == 0


def test_index_and_independent_frames(spark):
    data, df = pages(spark)
    index = warc.write(warc.decide(df.coalesce(1)), frame_bytes=2000, bundle_bytes=500)
    rows = index.collect()
    assert len(rows) == len(data) and len({r["bundle"] for r in rows}) > 1
    want = next(r for r in rows if r["record_id"] == warc.record_id(7, hashlib.sha1(data[8][2].encode()).hexdigest()))
    got = warc.lookup(index, index.where(index.record_id == want["record_id"])).collect()
    assert [bytes(r["payload"]) for r in got] == [data[8][2].encode()]
    fs, path = pyarrow.fs.FileSystem.from_uri(want["bundle"])
    table = warc.seek_table(fs, path)
    with fs.open_input_file(path) as f:
        whole = f.read()
    plain = zstandard.ZstdDecompressor().decompressobj
    for start, packed, full in table:  # each frame stands alone
        assert len(plain().decompress(whole[start:start + packed])) == full
    start = want["frame_start"]
    record = zstandard.ZstdDecompressor().decompress(whole[start:start + want["frame_bytes"]])[want["offset"]:want["offset"] + want["length"]]
    assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n")
    assert warc.read(index).count() == len(data)
