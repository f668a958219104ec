"""WARC archives with the index first.

``write_archives`` writes every row as a gzip member of a WARC file and returns the index: file, offset, length, URL
and digest of each record. ``read_records`` sorts the index rows that are asked for, joins neighbouring byte ranges to
few reads of bounded size, and parses the records. Payloads that occur again are revisits of the record with the
smallest id.

A file is named after the task attempt that wrote it, and the index only knows files of attempts that ended; so a
task that is run again leaves at most a file that nobody reads.

Defined results: null html is an empty payload; of equal payloads of at least 100 bytes only the smallest page_id is a
response; rows that repeat this page_id or have none are responses too; a null URL is an empty one; long payloads are stored
whole; an empty table gives an empty index; other columns aren't stored.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvia.llm.common import scratch, small_batches, table, written

MIN_REVISIT_BYTES = 100
#: Groups of equal payloads whose table is broadcast, at most (about 80 bytes each).
BROADCAST_GROUPS = 100_000
FILE_BYTES = 64 << 20
READ_BYTES = 8 << 20
#: Bytes that a read may skip between two records.
GAP_BYTES = 64 << 10
TASK_BYTES = 32 << 20
DATE = "2024-01-01T00:00:00Z"
INDEX = "page_id long, url string, digest string, file string, offset long, length long"


def marked(pages: DataFrame, html: str = "html", broadcast_groups: int | None = None) -> DataFrame:
    """page_id, url, html, digest, and first: the smallest page_id with this payload, null where it is one of a kind.
    Beyond ``broadcast_groups`` (BROADCAST_GROUPS) groups of equal payloads, the largest ones are still broadcast and the
    others joined."""
    broadcast_groups = BROADCAST_GROUPS if broadcast_groups is None else broadcast_groups
    payload = F.coalesce(F.col(html), F.lit(""))
    pages = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("html"), F.sha2(payload, 256).alias("digest"))
    groups = pages.filter(F.octet_length("html") >= MIN_REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    groups = written(groups.filter("n > 1"), "payload-groups")
    n_groups, copies = groups.agg(F.count(F.lit(1)), F.sum("n")).first()
    # groups above this size are fewer than the bound, whatever the table; so no key that is shuffled is larger than it
    least = 0 if n_groups <= broadcast_groups else copies // max(1, broadcast_groups)
    large, small = (groups.filter(f"n {op} {least}").select("digest", "first") for op in (">", "<="))
    out = pages.join(F.broadcast(large), "digest", "left")
    if n_groups > broadcast_groups:  # short payloads and those of large groups stay where they are
        done = out.filter(F.col("first").isNotNull() | (F.octet_length("html") < MIN_REVISIT_BYTES))
        rest = out.filter(F.col("first").isNull() & (F.octet_length("html") >= MIN_REVISIT_BYTES)).drop("first")
        out = done.unionByName(rest.join(small, "digest", "left"))
    return out.select("page_id", "url", "html", "digest", "first")


def _uri(path: str) -> str:
    if "://" in path:
        return path
    return "file://" + path.removeprefix("file:")


def record(page_id: int | None, url: str, payload: bytes, digest: str, first: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit that has only the HTTP head."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = None not in (first, page_id) and first != page_id
    block = head if revisit else head + payload
    safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {safe}", f"WARC-Payload-Digest: sha256:{digest}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{first}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    store, root = fs.FileSystem.from_uri(folder)
    out, at, name = None, 0, ""
    try:
        for batch in batches:
            rows = []
            for page_id, url, html, digest, first in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                data = gzip.compress(record(page_id, url, html.encode(), digest, first), 5, mtime=0)
                out.write(data)
                rows.append((page_id, url, digest, name, at, len(data)))
                at += len(data)
            columns = [*zip(*rows)] or [()] * 6
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in INDEX.split(", ")])
    finally:
        if out is not None:
            out.close()


def write_archives(pages: DataFrame) -> tuple[DataFrame, str]:
    """The index table of the archives, and their folder."""
    spark = pages.sparkSession
    small_batches(spark)
    folder = _uri(scratch(spark, "warc"))
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    return written(pages.mapInArrow(partial(_write, folder=folder), INDEX), "warc-index"), folder


def ranges(rows: list[tuple[str, int, int]]) -> list[tuple[str, int, int, int, int]]:
    """Sorted (file, offset, length) as reads: file, begin, end, first row, row behind the last."""
    out: list[list] = []
    for i, (file, offset, length) in enumerate(rows):
        if out and out[-1][0] == file and 0 <= offset - out[-1][2] <= GAP_BYTES and offset + length - out[-1][1] <= READ_BYTES:
            out[-1][2], out[-1][4] = offset + length, i + 1
        else:
            out.append([file, offset, offset + length, i, i + 1])
    return [tuple(x) for x in out]


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long, length long"


def _read(batches: Iterator[pa.RecordBatch], folder: str, with_payload: bool) -> Iterator[pa.RecordBatch]:
    store, root = fs.FileSystem.from_uri(folder)
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), *[pa.binary()] * with_payload]
    names = [x.split()[0] for x in RECORDS.split(", ")] + ["payload"] * with_payload
    for batch in batches:
        asked = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))))
        for file, begin, end, first, last in ranges(asked):
            with store.open_input_file(f"{root}/{file}") as f:
                data = f.read_at(end - begin, begin)
            rows = []
            for _, offset, length in asked[first:last]:
                headers, http, payload = parse(zlib.decompress(data[offset - begin : offset - begin + length], 31))
                kind = headers["WARC-Type"]
                digest = hashlib.sha256(payload).hexdigest() if kind == "response" else headers["WARC-Payload-Digest"].removeprefix("sha256:")
                if f"sha256:{digest}" != headers["WARC-Payload-Digest"]:
                    raise ValueError(f"damaged payload in {file} at {offset}")
                number = lambda x: int(x) if (x := x.removeprefix("<urn:page:").removesuffix(">")) else None
                refers = number(headers["WARC-Refers-To"]) if kind == "revisit" else None
                size = len(payload) if kind == "response" else int(http["Content-Length"])
                rows.append((number(headers["WARC-Record-ID"]), headers["WARC-Target-URI"], size, digest, kind, refers, file, offset, length, *[payload] * with_payload))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def read_records(index: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The records of the index rows. Tasks take neighbouring rows; their number follows the bytes to read."""
    small_batches(index.sparkSession)
    total = index.agg(F.sum("length")).first()[0] or 0
    spread = index.select("file", "offset", "length").repartitionByRange(1 + total // TASK_BYTES, "file", "offset").sortWithinPartitions("file", "offset")
    return spread.mapInArrow(partial(_read, folder=folder, with_payload=with_payload), RECORDS + ", payload binary" * with_payload)


def op4_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, folder = write_archives(marked(table(spark, sf_dir, "pages")))
    # where a record lies depends on how the rows are dealt to files, and stays in the index
    return read_records(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n,
    min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
  FROM pages
)
SELECT page_id, n::BIGINT AS payload_bytes, sha256(html) AS payload_digest,
  CASE WHEN n >= {MIN_REVISIT_BYTES} AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= {MIN_REVISIT_BYTES} AND first <> page_id THEN first END AS refers_to
FROM p
"""
