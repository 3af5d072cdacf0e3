"""WARC archives in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each holding whole WARC records, and a footer:
a skippable frame with the compressed and decompressed size of every frame (the public seekable
format).  An index row maps a record identifier to (bundle, frame, offset inside the frame, length),
so one record is read by one seek and one frame.  Payloads of at least ``min_revisit`` bytes that
occur again are written as ``revisit`` records which refer to the response with the largest id.

Writing is one ``mapInArrow`` pass: every task attempt writes bundles under names of its own and the
index, cut to the shared folder, names only those of the attempts that counted.  A lost executor
leaves orphans that no index row names.  Files are reached through ``pyarrow.fs`` by URI.

Memory holds one frame (or one record, if longer) per task.  Defined cases: a null payload is empty;
a null id sorts below all others; of equal payloads every row with the largest id is a response;
equal rows get equal record identifiers; a null address becomes ``urn:page:<id>``; control characters
and blanks in an address are percent-encoded; an empty table gives an empty index.  A payload of any length is one
record, written whole.  Only the three named columns of pages are read, so others may have any names.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.session import scratch_path

from .common import col, cut

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
INDEX = ("record_id string, record_type string, bundle string, frame int, frame_start long, frame_bytes long, "
         "offset long, length long")
RECORD = "record_id string, record_type string, page_id long, url string, digest string, refers_to_id string, payload binary"


def decide(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
           min_revisit: int = 1000) -> DataFrame:
    """page_id, url, payload (binary), digest and, for revisits, the id and address of the response."""
    p = pages.select(col(id_col).cast("long").alias("page_id"), col(url_col).cast("string").alias("url"),
                     F.coalesce(col(payload_col), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("digest", F.sha1("payload"))
    first = (p.where(F.octet_length("payload") >= min_revisit).groupBy("digest")
             .agg(F.max(F.struct("page_id", "url")).alias("first"), F.count("*").alias("n"))
             .where("n > 1").select(F.col("digest").alias("d"), "first"))
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    return (p.join(first, F.col("digest") == F.col("d"), "left")
            .select("page_id", "url", "payload", "digest", revisit.alias("revisit"),
                    F.col("first.page_id").alias("first_id"), F.col("first.url").alias("first_url")))


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}|{digest}')}>"


def uri_of(url: str | None, page_id: int | None) -> str:
    if not url:
        return f"urn:page:{page_id}"
    return "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in url)


def build_record(row: dict, date: str) -> tuple[str, str, bytes]:
    """Record id, type and the bytes of one WARC/1.1 record."""
    rid, payload = record_id(row["page_id"], row["digest"]), row["payload"]
    head = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}", "", ""]
    http = "\r\n".join(head).encode()
    kind, block = ("revisit", http) if row["revisit"] else ("response", http + payload)
    fields = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", date),
              ("WARC-Target-URI", uri_of(row["url"], row["page_id"])),
              ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(row["digest"])).decode()),
              ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    if row["page_id"] is not None:
        fields.append(("X-Page-Id", str(row["page_id"])))
    if row["revisit"]:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                   ("WARC-Refers-To", record_id(row["first_id"], row["digest"])),
                   ("WARC-Refers-To-Target-URI", uri_of(row["first_url"], row["first_id"]))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return rid, kind, text.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int) -> tuple[dict, int]:
    """The record at offset ``at`` of a frame and the offset behind it."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record at {at}")
    head = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    start = end + 4
    stop = start + int(head["content-length"])
    body = data[data.index(b"\r\n\r\n", start) + 4: stop]
    digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
    if head["warc-type"] == "response" and hashlib.sha1(body).hexdigest() != digest:
        raise ValueError(f"payload of {head['warc-record-id']} does not match its digest")
    page = head.get("x-page-id")
    return {"record_id": head["warc-record-id"], "record_type": head["warc-type"],
            "page_id": int(page) if page is not None else None, "url": head["warc-target-uri"], "digest": digest,
            "refers_to_id": head.get("warc-refers-to"), "payload": body}, stop + 4


class Bundle:
    """Writes one bundle; ``rows`` are the index rows of its records."""

    def __init__(self, root: str, frame_bytes: int):
        import zstandard
        self.fs, base = pyarrow.fs.FileSystem.from_uri(root)
        self.fs.create_dir(base, recursive=True)
        name = f"{uuid.uuid4()}.warc.zst"
        self.path, self.out = f"{root}/{name}", self.fs.open_output_stream(f"{base}/{name}", compression=None)
        self.zip, self.limit = zstandard.ZstdCompressor(level=3), frame_bytes
        self.frames, self.buffer, self.held, self.rows, self.pos = [], [], 0, [], 0

    def add(self, rid: str, kind: str, data: bytes) -> None:
        if self.held and self.held + len(data) > self.limit:
            self.flush()
        self.rows.append([rid, kind, self.path, len(self.frames), self.pos, 0, self.held, len(data)])
        self.buffer.append(data)
        self.held += len(data)

    def flush(self) -> None:
        if not self.held:
            return
        raw = b"".join(self.buffer)
        packed = self.zip.compress(raw)
        for r in reversed(self.rows):
            if r[3] != len(self.frames):
                break
            r[5] = len(packed)
        self.out.write(packed)
        self.frames.append((len(packed), len(raw)))
        self.pos += len(packed)
        self.buffer, self.held = [], 0

    def close(self) -> list[list]:
        self.flush()
        table = b"".join(struct.pack("<II", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()
        return self.rows


def _index_batch(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in INDEX.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)


def write(decided: DataFrame, root: str | None = None, date: str = "1970-01-01T00:00:00Z", frame_bytes: int = 1 << 20,
          bundle_bytes: int = 256 << 20) -> DataFrame:
    """Write the records of :func:`decide` and return their index (already cut to the shared folder)."""
    root = root or scratch_path(decided.sparkSession, f"warc-{uuid.uuid4()}")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}
                bundle = bundle or Bundle(root, frame_bytes)
                bundle.add(*build_record(row, date))
                if bundle.pos >= bundle_bytes:
                    yield _index_batch(bundle.close())
                    bundle = None
        if bundle:
            yield _index_batch(bundle.close())

    return cut(decided.mapInArrow(task, INDEX))


def seek_table(fs, path: str) -> list[tuple[int, int, int]]:
    """(start, compressed, decompressed) of each frame, from the footer alone."""
    with fs.open_input_file(path) as f:
        size = f.size()
        f.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", f.read(9))
        if magic != SEEKABLE:
            raise ValueError(f"{path} has no seek table")
        entry = 12 if flags & 0x80 else 8
        f.seek(size - 9 - n * entry)
        raw = f.read(n * entry)
    out, at = [], 0
    for k in range(n):
        packed, full = struct.unpack_from("<II", raw, k * entry)
        out.append((at, packed, full))
        at += packed
    return out


def frames(bundles: DataFrame) -> DataFrame:
    """Frames of the bundles in column ``bundle``, read from the footers: bundle, frame, start, packed."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, p = pyarrow.fs.FileSystem.from_uri(path)
                t = seek_table(fs, p)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(t), pa.string()), pa.array(range(len(t)), pa.int32()),
                     pa.array([x[0] for x in t], pa.int64()), pa.array([x[1] for x in t], pa.int64())],
                    names=["bundle", "frame", "start", "packed"])

    return bundles.select("bundle").distinct().mapInArrow(task, "bundle string, frame int, start long, packed long")


def _record_batch(recs: list[dict], names: list[str]) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "payload": pa.binary(), "payload_bytes": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in recs], kinds.get(n, pa.string())) for n in names], names=names)


def _load(path: str, start: int, packed: int) -> bytes:
    import zstandard
    fs, p = pyarrow.fs.FileSystem.from_uri(path)
    with fs.open_input_file(p) as f:
        f.seek(start)
        return zstandard.ZstdDecompressor().decompress(f.read(packed))


def read(bundles: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the bundles, a frame at a time; frames are dealt evenly whatever bundle they are in.

    Without ``payloads`` a record has its payload's length instead (null for a revisit).
    """
    spec = RECORD if payloads else RECORD.replace("payload binary", "payload_bytes long")
    names = [x.split()[0] for x in spec.split(", ")]
    n = int(bundles.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                data, at, recs = _load(b["bundle"], b["start"], b["packed"]), 0, []
                while at < len(data):
                    rec, at = parse_record(data, at)
                    rec["payload_bytes"] = len(rec["payload"]) if rec["record_type"] == "response" else None
                    recs.append(rec)
                yield _record_batch(recs, names)

    return frames(bundles).repartition(n, "bundle", "frame").mapInArrow(task, spec)


def lookup(index: DataFrame, record_ids: DataFrame) -> DataFrame:
    """The records with the given identifiers (column ``record_id``): one seek and one frame each."""
    names = [x.split()[0] for x in RECORD.split(", ")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                data = _load(b["bundle"], b["frame_start"], b["frame_bytes"])
                yield _record_batch([parse_record(data, b["offset"])[0]], names)

    return index.join(record_ids.select("record_id").distinct(), "record_id", "left_semi").mapInArrow(task, RECORD)


def catalogue(records: DataFrame) -> DataFrame:
    """Per record: page_id, payload_bytes, payload_digest, record_type, refers_to (a page id).

    A revisit takes its payload's length and page from the response record that it refers to.
    """
    known = (records.where("record_type = 'response'").groupBy(F.col("record_id").alias("r"))
             .agg(F.max("page_id").alias("to_page"), F.max("payload_bytes").alias("to_bytes")))
    return (records.join(known, F.col("refers_to_id") == F.col("r"), "left")
            .select("page_id", F.coalesce("payload_bytes", "to_bytes").alias("payload_bytes"),
                    F.col("digest").alias("payload_digest"), "record_type", F.col("to_page").alias("refers_to")))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` and read the archives back, as :func:`catalogue`."""
    index = write(decide(pages))
    return catalogue(read(index, payloads=False))


