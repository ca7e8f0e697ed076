"""WARC archives: writing, normalising to one gzip member for each record, and reading back.

``write_archives`` gives each task one archive, compressed as a single gzip stream, as simple
crawlers leave them. The normaliser inflates such a stream once from front to back, writes every
record as its own gzip member, and writes a sidecar index with each member's offset and length, so
that any record can be read alone. ``read_archives`` reads through that index.

Records with equal payloads (by SHA-1, of at least ``min_bytes``) are deduplicated: the one with the
largest page_id is a response, the others are revisits that refer to it and carry no payload. Null
html is an empty payload. Repeated rows with the largest page_id are all responses; a null page_id
is below every other, and of rows that all have none each is a response. Null urls become
urn:page:<id>. An empty table writes no archive and reads as an empty result. Extra columns are
ignored.

Archives go to the shared folder, named after the attempt that wrote them; only those that a
finished task reports are read. Memory holds one record at a time.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

LEVEL = 4
#: Payloads shared by more than LARGE pages may be looked up in a broadcast table of at most HOT_DIGESTS.
LARGE = 256
HOT_DIGESTS = 100_000
CRLF = b"\r\n"


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if ":" in uri else f"file://{uri}")


def record(page_id, url, payload: bytes | None, n_bytes: int, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record; payload None makes a revisit."""
    uri = "".join(c if 32 < ord(c) < 127 else "%%%02X" % ord(c) if ord(c) < 128 else c for c in (url or f"urn:page:{page_id}"))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if payload is None else 'response'}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Target-URI: {uri}",
        "WARC-Date: 2020-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if payload is None:
        head[2:2] = [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode("utf-8", "replace") + CRLF * 2 + block + CRLF * 2


def parse(raw: bytes) -> dict:
    """Headers (lower case), payload and payload_bytes of one record."""
    head, _, rest = raw.partition(CRLF * 2)
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    out = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    block = rest[: int(out["content-length"])]
    http, _, payload = block.partition(CRLF * 2)
    sizes = [x.split(b":")[1] for x in http.split(CRLF) if x.lower().startswith(b"content-length:")]
    return out | {"payload": payload, "payload_bytes": int(sizes[0]) if sizes else len(payload)}


def records(stream):
    """Each record's bytes from an inflated stream, read once from front to back."""
    while True:
        head = b""
        while not head.endswith(CRLF * 2):
            line = stream.readline()
            if not line:
                if head.strip():
                    raise ValueError("the stream ends inside a record")
                return
            head += line
            if head == CRLF:
                head = b""
        size = next(int(x.split(b":")[1]) for x in head.split(CRLF) if x.lower().startswith(b"content-length:"))
        block = stream.read(size + 4)
        if len(block) != size + 4:
            raise ValueError("the stream ends inside a record")
        yield head + block


def normalise(source: str, target: str, level: int = LEVEL) -> tuple[int, int]:
    """Rewrite a single-stream gzip archive with a member for each record, and ``target``.idx beside it.

    Each line of the index is a JSON list: record id, type, offset, length. Returns (records, bytes).
    """
    fs, src = _fs(source)
    _, dst = _fs(target)
    n = at = 0
    with fs.open_input_stream(src, compression=None) as raw, fs.open_output_stream(dst, compression=None) as out, fs.open_output_stream(dst + ".idx", compression=None) as idx:
        for rec in records(gzip.GzipFile(fileobj=raw)):
            packer = zlib.compressobj(level, zlib.DEFLATED, 31)
            member = packer.compress(rec) + packer.flush()
            head = dict(x.split(b": ", 1) for x in rec.partition(CRLF * 2)[0].split(CRLF)[1:] if b": " in x)
            out.write(member)
            idx.write((json.dumps([head[b"WARC-Record-ID"].decode(), head[b"WARC-Type"].decode(), at, len(member)]) + "\n").encode())
            n, at = n + 1, at + len(member)
    return n, at


def plan_records(spark: SparkSession, pages: DataFrame, scratch: Scratch, min_bytes: int = 0) -> DataFrame:
    """Pages with their payload (null for revisits), its SHA-1 and size, and the response each revisit refers to.

    Who answers for a payload is decided on ids and digests alone, before payloads move. The digests
    of large groups, at most HOT_DIGESTS, are looked up in a broadcast table, so a payload that a third
    of all pages share is not dealt out by its digest; the others are joined.
    """
    keyed = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload")
    ).withColumns({"sha": F.sha1("payload"), "n_bytes": F.length("payload").cast("long")})
    # rows without an id count as the least, so the largest id of a group is null only if all are
    groups = keyed.where(F.col("n_bytes") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("answer"), F.count("*").alias("n")).where("n > 1")
    groups = scratch.save(groups.withColumnRenamed("sha", "digest"), "groups")
    rows = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    large = F.col("n") > max(LARGE, rows // HOT_DIGESTS)
    hot = groups.where(large).select(F.col("digest").alias("hot_digest"), F.col("answer").alias("hot_answer"))
    got = keyed.join(F.broadcast(hot), F.col("sha") == F.col("hot_digest"), "left")
    # rows that the broadcast table answered are dealt out by themselves
    key = F.when(F.col("hot_digest").isNull(), F.col("sha")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string")))
    got = got.withColumn("key", key).join(groups.where(~large).select("digest", "answer"), F.col("key") == F.col("digest"), "left")
    answer = F.coalesce("hot_answer", "answer")
    got = got.select("page_id", "url", "payload", "sha", "n_bytes", answer.alias("answer"))
    got = got.withColumn("revisit", F.col("answer").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("answer")))
    return got.withColumn("payload", F.when(~F.col("revisit"), F.col("payload")))


def write_archives(plan: DataFrame, folder: str, keep_single_stream: bool = False) -> DataFrame:
    """Write ``plan_records`` rows as archives, a normalised one for each task: (path, records, bytes).

    An archive and its index are named after the attempt that wrote both, and count only by the row
    returned, so the files of a lost attempt are never read.
    """

    def write(batches):
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        fs, root = _fs(folder)
        fs.create_dir(root, recursive=True)
        whole, final = f"single-{part:06d}-{attempt}.warc.gz", f"part-{part:06d}-{attempt}.warc.gz"
        n = 0
        with fs.open_output_stream(f"{root}/{whole}", compression=None) as sink, gzip.GzipFile(fileobj=sink, mode="wb", compresslevel=1, mtime=0) as out:
            for b in batches:
                for page, url, payload, sha, size, answer, revisit in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "sha", "n_bytes", "answer", "revisit"))):
                    digest = base64.b32encode(bytes.fromhex(sha)).decode()
                    out.write(record(page, url, None if revisit else payload, size, digest, answer))
                    n += 1
        if n:
            n, size = normalise(f"{folder}/{whole}", f"{folder}/{final}")
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{final}"]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["path", "records", "bytes"])
        if not (n and keep_single_stream):
            fs.delete_file(f"{root}/{whole}")

    return plan.mapInArrow(write, "path string, records long, bytes long")


def read_archives(paths: DataFrame, with_payload: bool = True) -> DataFrame:
    """A row for each record of the archives in ``paths.path``, each read through its index.

    A response whose payload doesn't match its digest is an error.
    """
    extra = ", payload binary" if with_payload else ""

    def number(urn: str | None):
        text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
        return int(text) if text not in ("", "None") else None

    def rows(path: str):
        fs, p = _fs(path)
        with fs.open_input_stream(p + ".idx", compression=None) as f:
            index = [json.loads(x) for x in f.read().decode().splitlines()]
        with fs.open_input_file(p) as f:
            for _, kind, at, length in index:
                got = parse(gzip.decompress(f.read_at(length, at)))
                digest = got["warc-payload-digest"].removeprefix("sha1:")
                if kind == "response" and base64.b32encode(hashlib.sha1(got["payload"]).digest()).decode() != digest:
                    raise ValueError(f"{path}: the payload at {at} doesn't match its digest")
                out = (number(got["warc-record-id"]), got["payload_bytes"], digest, kind, number(got.get("warc-refers-to")))
                yield out + ((got["payload"] if kind == "response" else None),) if with_payload else out

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: 6 if with_payload else 5]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: len(kinds)]

    def read(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                held = []
                for r in rows(path):
                    held.append(r)
                    if len(held) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)

    return paths.select("path").mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + extra)


def archive_round_trip(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write all pages, normalise, read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    scratch = Scratch(spark, "warc")
    folder = f"{scratch.root}/archives"
    written = scratch.save(write_archives(plan_records(spark, pages, scratch, min_bytes), folder), "written")
    return read_archives(written.repartition(max(1, min(written.count(), 100_000)), "path"), with_payload=False)
