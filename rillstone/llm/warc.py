"""Operator 7, WARC: archives of gzip members, an index first, and coalesced byte-range reads."""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, shared_dir, sized_join, text_or_empty

#: An archive is closed once it holds this many bytes.
ARCHIVE_BYTES = 64 << 20
#: Ranges of one archive that are at most this far apart are read at once, up to READ_BYTES.
GAP_BYTES = 64 << 10
READ_BYTES = 8 << 20
#: Payloads of fewer bytes are never revisits.
MIN_REVISIT_BYTES = 0
#: A task reads at most so many bytes of archives; with fewer bytes in all, as many tasks share them as run at a time.
TASK_BYTES = 64 << 20
LEAST_TASK_BYTES = 1 << 20

_RECORD = "urn:rillstone:page:"
#: A URL of these characters stands in its header line as it is.
_PLAIN_URL = re.compile(r"[!-~\xa1-\U0010ffff]+")
INDEX = "page_id long, url string, archive string, offset long, length long, payload_digest string, record_type string"


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id, payload_digest: str) -> str:
    """Names a page's record. A payload's responses all have its least page_id, so revisits can name one before it is written."""
    return f"<{_RECORD}{page_id}:{payload_digest}>"


def format_record(page_id, url, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    """One gzip member with a response record, or a revisit record that carries no payload.

    A URL that can't stand in a header line is percent-encoded there, and a line of its own keeps it exactly.
    """
    digest = _digest(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None and _PLAIN_URL.fullmatch(url):
        lines.append(f"WARC-Target-URI: {url}")
    elif url is not None:
        lines += [f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(33, 127))))}", f"X-Exact-URL: {json.dumps(url)}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    head = "\r\n".join(lines).encode() + b"\r\n\r\n"
    return gzip.compress(head + block + b"\r\n\r\n", 6, mtime=0)


def _page_of(name: str | None) -> int | None:
    page = (name or f"<{_RECORD}None:>").strip("<>").removeprefix(_RECORD).split(":")[0]
    return None if page == "None" else int(page)


def parse_record(member: bytes) -> dict:
    """Of one gzip member: record_id, refers_to_id, page_id, url, record_type, refers_to, payload (None in a revisit), payload_bytes, payload_digest."""
    head, rest = zlib.decompress(member, 31).split(b"\r\n\r\n", 1)
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines)
    block = rest[: int(fields["Content-Length"])]
    http, payload = block.split(b"\r\n\r\n", 1)
    size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or _digest(payload) != digest):
        raise ValueError(f"damaged payload of {fields['WARC-Record-ID']}")
    name, refers = fields["WARC-Record-ID"], fields.get("WARC-Refers-To")
    url = json.loads(fields["X-Exact-URL"]) if "X-Exact-URL" in fields else fields.get("WARC-Target-URI")
    return {"record_id": name, "refers_to_id": refers, "page_id": _page_of(name), "url": url, "record_type": kind, "refers_to": _page_of(refers), "payload": payload if kind == "response" else None, "payload_bytes": size, "payload_digest": digest}


def with_record_types(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload (string), revisit, refers_to.

    Of the rows whose payloads are equal and of at least ``min_bytes`` bytes, those with the
    smallest page_id are responses and the others revisit it; a row without an id revisits if
    any row of its payload has one. Payloads are equal when their SHA-256 are. Counts and least
    ids by digest are aggregated before the shuffle; the digests that occur twice are a written
    table, and payloads move only if it is too large to be broadcast.
    """
    rows = pages.select("page_id", "url", text_or_empty("html").alias("payload"))
    rows = rows.withColumn("_sha", F.unhex(F.sha2("payload", 256)))
    shared = (
        rows.where(F.octet_length("payload") >= min_bytes).groupBy("_sha").agg(F.count(F.lit(1)).alias("_n"), F.min("page_id").alias("_least")).where("_n > 1").select("_sha", "_least")
    )
    joined = sized_join(rows, durable(shared), "_sha", "left")
    revisit = F.col("_least").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_least"))
    return joined.select("page_id", "url", "payload", revisit.alias("revisit"), F.when(revisit, F.col("_least")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Writes every row as a record to archives in ``folder`` (a URI that all executors reach); returns the index.

    A task names its archives at random and a retried one writes new ones, so the index, which
    is written once after the archives, never points to half an archive.
    """

    def run(batches):
        files, root = pafs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        out = path = name = None
        for batch in batches:
            index = []
            for row in batch.to_pylist():
                if out is None:
                    name, at = uuid.uuid4().hex, 0
                    path = f"{root}/{name}.warc.gz"
                    out = files.open_output_stream(path, compression=None)
                payload = row["payload"].encode()
                member = format_record(row["page_id"], row["url"], payload, row["refers_to"], row["revisit"])
                out.write(member)
                index.append((row["page_id"], row["url"], f"{name}.warc.gz", at, len(member), _digest(payload), "revisit" if row["revisit"] else "response"))
                at += len(member)
                if at >= ARCHIVE_BYTES:
                    out.close()
                    out = None
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in index], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()))], ["page_id", "url", "archive", "offset", "length", "payload_digest", "record_type"])
        if out is not None:
            out.close()

    return durable(with_record_types(pages, min_bytes).mapInArrow(run, INDEX))


def read_records(index: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of the index's rows, read back from the archives.

    Rows are sorted by archive and offset over all partitions, whose number comes from the bytes
    to read and not from those of the index; neighbouring ranges are read at once. Returns
    page_id, url, record_type, refers_to, payload_bytes, payload_digest, record_id, refers_to_id
    and the payload (null in a revisit).
    """
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-total // TASK_BYTES), min(index.sparkSession.sparkContext.defaultParallelism, total // LEAST_TASK_BYTES))

    def members(batches):
        files, root = pafs.FileSystem.from_uri(folder)
        run = []

        def flush():
            start = run[0][1]
            with files.open_input_file(f"{root}/{run[0][0]}") as f:
                data = f.read_at(run[-1][1] + run[-1][2] - start, start)
            for _, offset, length in run:
                yield data[offset - start : offset - start + length]

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in ("archive", "offset", "length")), strict=True):
                if run and (row[0] != run[0][0] or row[1] - run[-1][1] - run[-1][2] > GAP_BYTES or row[1] + row[2] - run[0][1] > READ_BYTES):
                    yield from flush()
                    run = []
                if not run or row[1] >= run[-1][1]:
                    run.append(row)
        if run:
            yield from flush()

    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "record_id", "refers_to_id", *["payload"] * with_payload]
    types = {"page_id": pa.int64(), "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}

    def run(batches):
        held, size = [], 0
        for member in members(batches):
            held.append(parse_record(member))
            size += len(held[-1]["payload"] or b"") if with_payload else 64
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in held], types.get(k, pa.string())) for k in names], names)
                held, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in held], types.get(k, pa.string())) for k in names], names)

    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, record_id string, refers_to_id string" + ", payload binary" * with_payload
    ranged = index.select("archive", "offset", "length").repartitionByRange(tasks, F.col("archive"), F.col("offset")).sortWithinPartitions("archive", "offset")
    return ranged.mapInArrow(run, schema)


def round_trip(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Per input row page_id, payload_bytes, payload_digest, record_type, refers_to, as read back.

    A null html is an empty payload; a null url has no target line; empty payloads are equal to
    one another. Of repeated rows with the smallest id all are responses, the same record under
    one id. Any URL comes back as it was. An empty table gives an empty result. Columns other than page_id, url and html are ignored.
    """
    folder = shared_dir(pages.sparkSession)
    index = write_archives(pages, folder, min_bytes)
    return read_records(index, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP7_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages
), d AS (
  SELECT page_id, payload, sha1(payload) AS h, min(page_id) OVER (PARTITION BY payload) AS least FROM p
), b AS (
  SELECT page_id, payload, least,
         array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(instr('0123456789abcdef', substr(h, i, 1)) - 1), 4, '0')), '') AS bits
  FROM d
)
SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT) + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT)
         + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = least THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> least THEN least END AS refers_to
FROM b
"""
