"""WARC archives as seekable Zstandard bundles (operator 6).

A bundle holds WARC records in groups, each an independent Zstandard frame. Two
skippable frames end it: an index that maps record identifiers to (frame,
offset in the frame, length), and the seek table of the public seekable format.
So a record is read by decompressing one frame, and any Zstandard tool reads
the whole.

Bundles are first binary rows, each with its index as a nested column; so
record_index() maps every record to its bundle and place without touching the
archives. save_bundles() makes files of them, and load_bundles() reads files.

Of pages with equal payloads of min_bytes at least, the one with the largest
page_id is written as response and the others as revisit records without
payload. Only digests are compared across tasks; a payload moves once, to the
task that writes it. Revisits are written after the responses, so that each
names the record it refers to.

Record identifiers are unique: a UUID of the page, the digest and the place of
the record in its bundle. Defined cases: null html is an empty payload, which
is always a response; a null page_id sorts before every other one; rows that
repeat the response's page_id and payload are responses too, and revisits refer
to the one of smallest record identifier; a null url gives no target URI; an
empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keepsight.llm.tables import Table, own_columns, scope, shared_dir

MIN_BYTES = 1000
#: Uncompressed bytes after which a frame ends, and compressed ones after which a bundle does.
FRAME_BYTES, BUNDLE_BYTES, LEVEL = 256 << 10, 16 << 20, 3
# Fixed values of the Zstandard and seekable formats, and of WARC.
SKIPPABLE, INDEX_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = "1970-01-01T00:00:00Z"
ID_BYTES = 16
INDEX = np.dtype([("record_id", f"V{ID_BYTES}"), ("frame", "<u4"), ("offset", "<u8"), ("length", "<u8")])
REFERS = "<urn:uuid:%s>"


def record(record_id: uuid.UUID, page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None = None, refers_id: str | None = None) -> bytes:
    """One WARC record; without payload it is a revisit. The page's id and the full payload's length are extension fields."""
    kind = "revisit" if payload is None else "response"
    block = b"" if payload is None else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    fields = [("WARC-Type", kind), ("WARC-Record-ID", REFERS % record_id), ("WARC-Date", EPOCH)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%~")))
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", size), ("X-Page-ID", "" if page_id is None else page_id)]
    if payload is None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", REFERS % refers_id), ("X-Refers-To-Page", refers_to)]
    fields += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", len(block))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


class BundleWriter:
    def __init__(self, name: str, frame_bytes: int = FRAME_BYTES):
        import zstandard

        self.name, self.compress, self.frame_bytes = name, zstandard.ZstdCompressor(level=LEVEL).compress, frame_bytes
        self.data, self.sizes, self.index, self.entries, self.open, self.held = bytearray(), [], [], [], [], 0

    def add(self, page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None = None, refers_id: str | None = None) -> None:
        name = uuid.uuid5(uuid.NAMESPACE_URL, f"{self.name}/{len(self.index)} {page_id} {digest}")
        rec = record(name, page_id, url, payload, size, digest, refers_to, refers_id)
        self.index.append((name.bytes, len(self.sizes), self.held, len(rec)))
        self.entries.append({"record_id": str(name), "page_id": page_id, "payload_digest": digest, "frame": len(self.sizes), "offset": self.held, "length": len(rec)})
        self.open.append(rec)
        self.held += len(rec)
        if self.held >= self.frame_bytes:
            self.end_frame()

    def end_frame(self) -> None:
        if self.open:
            frame = self.compress(b"".join(self.open))
            self.data += frame
            self.sizes.append((len(frame), self.held))
            self.open, self.held = [], 0

    def finish(self) -> bytes:
        self.end_frame()
        index = np.array(self.index, INDEX).tobytes()
        self.data += struct.pack("<II", INDEX_MAGIC, len(index)) + index
        self.sizes.append((8 + len(index), 0))  # a frame like any other to the seek table
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        self.data += struct.pack("<II", SKIPPABLE, len(table)) + table
        return bytes(self.data)


class Bundle:
    """Reads a bundle by its seek table."""

    def __init__(self, data: bytes):
        import zstandard

        self.data, self.decompress = memoryview(data), zstandard.ZstdDecompressor().decompress
        n, flags, magic = struct.unpack("<IBI", self.data[-9:])
        if magic != SEEKABLE_MAGIC or flags:
            raise ValueError("no seek table at the end")
        sizes = np.frombuffer(self.data[-9 - 8 * n : -9], "<u4").reshape(n, 2).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes[:, 0])])
        at, size = int(self.starts[n - 1]), int(sizes[n - 1, 0])
        if struct.unpack("<II", self.data[at : at + 8]) != (INDEX_MAGIC, size - 8):
            raise ValueError("no record index before the seek table")
        self.index, self.frames = np.frombuffer(self.data[at + 8 : at + size], INDEX), n - 1

    def frame(self, k: int) -> bytes:
        return self.decompress(self.data[self.starts[k] : self.starts[k + 1]])

    def fetch(self, record_id: str) -> bytes | None:
        """A record, from its frame alone."""
        at = np.flatnonzero(self.index["record_id"] == np.void(uuid.UUID(record_id).bytes))
        return self.at(*self.index[at[0]].tolist()[1:]) if len(at) else None

    def at(self, frame: int, offset: int, length: int) -> bytes:
        return self.frame(frame)[offset : offset + length]

    def records(self) -> Iterator[bytes]:
        for k in range(self.frames):
            frame = self.frame(k)
            for e in self.index[self.index["frame"] == k]:
                yield frame[int(e["offset"]) : int(e["offset"] + e["length"])]


def parsed(rec: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and payload of a record; the payload of a response is checked against its digest."""
    head, _, rest = rec.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(": "), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    if fields["WARC-Type"] == "response" and "sha1:" + hashlib.sha1(payload).hexdigest() != fields["WARC-Payload-Digest"]:
        raise ValueError(f"the payload of page {fields['X-Page-ID']} does not match its digest")
    return fields, payload


ENTRY = pa.struct([("record_id", pa.string()), ("page_id", pa.int64()), ("payload_digest", pa.string()), ("frame", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])
BUNDLE = pa.schema([("bundle", pa.string()), ("index", pa.list_(ENTRY)), ("data", pa.binary())])
BUNDLE_SQL = "bundle string, index array<struct<record_id string, page_id long, payload_digest string, frame long, offset long, length long>>, data binary"


def write_batches(kind: str, frame_bytes: int, bundle_bytes: int):
    """For mapInArrow over (page_id, url, digest and html, or payload_bytes, refers_to, refers_id): bundles of this kind of record."""

    def run(batches):
        pid, number, writer = TaskContext.get().partitionId(), 0, None

        def ended():
            data = writer.finish()
            return pa.RecordBatch.from_pydict({"bundle": [writer.name], "index": [writer.entries], "data": [data]}, schema=BUNDLE)

        for batch in batches:
            columns = [batch.column(c) for c in batch.schema.names]
            for row in zip(*columns, strict=True):
                r = {name: x.as_py() for name, x in zip(batch.schema.names, row, strict=True)}
                if writer is None:
                    writer = BundleWriter(f"{kind}-{pid:06d}-{number:06d}", frame_bytes)
                payload = (r["html"] or "").encode() if kind == "response" else None
                writer.add(r["page_id"], r["url"], payload, len(payload) if payload is not None else r["payload_bytes"], r["digest"], r.get("refers_to"), r.get("refers_id"))
                if len(writer.data) >= bundle_bytes:
                    yield ended()
                    writer, number = None, number + 1
        if writer:
            yield ended()

    return run


RECORD_SQL = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
#: Stores that archive files can be written to.
STORES = ("file", "hdfs", "s3", "gs")


def read_batches(batches):
    """For mapInArrow over (data): a row for each record."""
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    number = lambda x: int(x) if x else None
    for batch in batches:
        for data in batch.column("data"):
            rows = {n: [] for n in schema.names}
            for rec in Bundle(data.as_py()).records():
                f, _ = parsed(rec)
                for name, value in zip(rows, (number(f["X-Page-ID"]), int(f["X-Payload-Length"]), f["WARC-Payload-Digest"][5:], f["WARC-Type"], number(f.get("X-Refers-To-Page"))), strict=True):
                    rows[name].append(value)
            yield pa.RecordBatch.from_pydict(rows, schema=schema)


def write_bundles(pages: DataFrame, min_bytes: int = MIN_BYTES, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES) -> DataFrame:
    """A written table of bundles: bundle, index (of its records), data."""
    pages = own_columns(pages, ["page_id", "url", "html"])
    payload = F.coalesce("html", F.lit(""))
    narrow = Table(pages.filter(F.octet_length(payload) >= min_bytes).select("page_id", "url", F.octet_length(payload).cast("long").alias("payload_bytes"), F.sha1(payload).alias("digest"), F.sha2(payload, 256).alias("sha256"), F.spark_partition_id().alias("pid")), "payloads").read()
    shared = Table(narrow.groupBy("sha256").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).filter("n > 1 and refers_to is not null").drop("n"), "shared-payloads").read()
    # A payload that many pages share meets its answer once for each task, then only inside the task.
    local = Table(narrow.select("pid", "sha256").distinct().join(shared, "sha256"), "local-payloads").read()
    revisits = Table(narrow.join(local, ["pid", "sha256"]).filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "url", "payload_bytes", "digest", "sha256", "refers_to", "pid"), "revisits").read()
    absent = Table(revisits.select("page_id", "sha256").distinct(), "not-responses").read()
    hashed = pages.withColumn("sha256", F.sha2(payload, 256)).alias("p")
    responses = hashed.join(absent.alias("r"), F.col("p.page_id").eqNullSafe(F.col("r.page_id")) & (F.col("p.sha256") == F.col("r.sha256")), "left_anti").select("page_id", "url", "html", F.sha1(payload).alias("digest"))
    first = Table(responses.mapInArrow(write_batches("response", frame_bytes, bundle_bytes), BUNDLE_SQL), "response-bundles", "none").read()
    named = Table(record_index(first).groupBy("page_id", "payload_digest").agg(F.min("record_id").alias("refers_id")), "response-ids").read()
    targets = shared.join(narrow.select("sha256", "digest").distinct(), "sha256").join(named.withColumnRenamed("page_id", "refers_to").withColumnRenamed("payload_digest", "digest"), ["refers_to", "digest"]).select("sha256", "refers_id")
    per_task = Table(revisits.select("pid", "sha256").distinct().join(targets, "sha256"), "revisit-targets").read()
    later = revisits.join(per_task, ["pid", "sha256"]).select("page_id", "url", "payload_bytes", "digest", "refers_to", "refers_id")
    second = Table(later.mapInArrow(write_batches("revisit", frame_bytes, bundle_bytes), BUNDLE_SQL), "revisit-bundles", "none").read()
    return first.union(second)


def record_index(bundles: DataFrame) -> DataFrame:
    """Where each record is: record_id, page_id, payload_digest, bundle, frame, offset, length. Reads no archive data."""
    return bundles.select("bundle", F.explode("index").alias("e")).select("e.record_id", "e.page_id", "e.payload_digest", "bundle", "e.frame", "e.offset", "e.length")


def fetch_records(bundles: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records (record_id, record) of wanted (rows of record_index): each needed frame is decompressed once."""
    frames = wanted.groupBy("bundle", "frame").agg(F.collect_list(F.struct("record_id", "offset", "length")).alias("records"))

    def read(batches):
        for batch in batches:
            out = {"record_id": [], "record": []}
            for data, frame, records in zip(*(batch.column(c) for c in ("data", "frame", "records")), strict=True):
                text = Bundle(data.as_py()).frame(frame.as_py())
                for r in records.as_py():
                    out["record_id"].append(r["record_id"])
                    out["record"].append(text[r["offset"] : r["offset"] + r["length"]])
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("record_id", pa.string()), ("record", pa.binary())]))

    return bundles.select("bundle", "data").join(frames, "bundle").select("data", "frame", "records").mapInArrow(read, "record_id string, record binary")


def read_bundles(bundles: DataFrame) -> DataFrame:
    """A row for each record: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return bundles.select("data").mapInArrow(read_batches, RECORD_SQL)


def save_bundles(bundles: DataFrame, folder: str) -> None:
    """Each bundle as <folder>/<bundle>.warc.zst. The folder is a URI that pyarrow knows (file, hdfs, s3, gs) and every executor reaches; a file appears whole or not at all, and a retried task writes the same file again."""

    def save(rows):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        for r in rows:
            part = f"{path}/.{r['bundle']}-{uuid.uuid4().hex}"
            with store.open_output_stream(part) as f:
                f.write(r["data"])
            store.move(part, f"{path}/{r['bundle']}.warc.zst")

    bundles.select("bundle", "data").foreachPartition(save)


def load_bundles(spark: SparkSession, folder: str) -> DataFrame:
    """The bundles (bundle, data) of a folder of archive files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    return files.select(F.regexp_extract("path", r"([^/]+)\.warc\.zst$", 1).alias("bundle"), F.col("content").alias("data"))


def archive_round_trip(pages: DataFrame, **options) -> DataFrame:
    """Writes archive files of all pages below the shared folder, then reads every record back from them. Where pyarrow doesn't know that folder's store, the bundles stay rows of a table there."""
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    scheme, found, _ = folder.partition("://")
    if found and scheme not in STORES:
        return read_bundles(write_bundles(pages, **options))
    with scope():
        bundles = write_bundles(pages, **options)
        if bundles.isEmpty():
            return pages.sparkSession.createDataFrame([], RECORD_SQL)
        save_bundles(bundles, folder)
    return read_bundles(load_bundles(spark, folder))
