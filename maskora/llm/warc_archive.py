"""WARC archives with a two-level capture index.

Pages are written where they are: each task writes one archive, in which every record is a gzip member of its
own. What is sorted is the index alone: lines of reversed-host URL key, archive, place and size are
range-partitioned by key and written in compressed blocks. The second level, the directory, is a table with a
row for each block: its first and last key and its place. A lookup finds the block in the directory, searches
the block's lines in two halves again and again, and reads the record's byte range.

Of records with equal payloads one is the response and the others are revisits without a payload. Groups are
summed by digest before anything moves; only the join that deals out the response's id touches the rows of a
large group, and it may be split.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import create, open_file, range_read
from .shared import scratch, written

BLOCK_LINES = 512
#: Payloads of fewer bytes are never revisits.
LEAST_REVISIT = 0
#: pages has no capture time; an archive of it says this one.
CAPTURED = "1970-01-01T00:00:00Z"
#: Index lines in a partition of the sort.
PART_LINES = 250_000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE = re.compile(r"[^\x21-\x7E]")


def surt(url):
    """Column: labels of the host from the last to the first, then what follows it; a url without ``://`` is taken from its start."""
    rest = F.when(F.locate("://", url) > 0, F.expr("substr(url, locate('://', url) + 3)")).otherwise(url)
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    return F.concat(F.array_join(F.reverse(F.split(F.lower(host), "[.]")), ","), F.lit(")"), tail)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(data: bytes) -> bytes:
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def _urn(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def record(page_id, url: str | None, payload: bytes | None, refers_to, size: int, digest: str) -> bytes:
    """One record: a response with its payload, or (payload None) a revisit of ``refers_to``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if payload is not None else 'revisit'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {CAPTURED}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + _UNSAFE.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url))
    if payload is None:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {_urn(refers_to)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Fields of one record; payload digest and size of a response are computed anew, and must be as stated."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload), sha1_base32(payload)) != (size, digest):
        raise ValueError("a damaged record")
    number = lambda name: int(x) if (x := fields.get(name, "<urn:page:>")[10:-1]) else None
    return {"page_id": number("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest, "record_type": fields["WARC-Type"], "refers_to": number("WARC-Refers-To"), "payload": payload if fields["WARC-Type"] == "response" else None}


LINES = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("warc", pa.string()), ("at", pa.int64()), ("size", pa.int64())])
DIRECTORY = pa.schema([("index", pa.string()), ("at", pa.int64()), ("size", pa.int64()), ("lines", pa.int64()), ("first_key", pa.string()), ("last_key", pa.string())])


def _write_records(batches, folder: str):
    """Write the task's records; yields an index line for each."""
    path, warc, place = f"{folder}/{uuid.uuid4().hex}.warc.gz", None, 0
    for b in batches:
        lines = []
        for row in b.to_pylist():
            warc = warc or create(path)
            digest = base64.b32encode(bytes.fromhex(row["sha1"])).decode()
            data = _member(record(row["page_id"], row["url"], row["payload"], row["refers_to"], row["n"], digest))
            warc.write(data)
            lines.append({"key": row["key"], "page_id": row["page_id"], "warc": path, "at": place, "size": len(data)})
            place += len(data)
        yield pa.RecordBatch.from_pylist(lines, LINES)
    if warc is not None:
        warc.close()


def _write_index(batches, folder: str):
    """Write the partition's sorted lines in compressed blocks; yields a directory row for each."""
    path, index, place, lines = f"{folder}/{uuid.uuid4().hex}.cdx", None, 0, []

    def block() -> pa.RecordBatch:
        nonlocal index, place
        index = index or create(path)
        data = zlib.compress("\n".join(json.dumps(x) for x in lines).encode())
        index.write(data)
        row = {"index": path, "at": place, "size": len(data), "lines": len(lines), "first_key": lines[0][0], "last_key": lines[-1][0]}
        place += len(data)
        lines.clear()
        return pa.RecordBatch.from_pylist([row], DIRECTORY)

    for b in batches:
        for row in b.to_pylist():
            lines.append([row["key"], row["page_id"], row["warc"], row["at"], row["size"]])
            if len(lines) == BLOCK_LINES:
                yield block()
    if lines:
        yield block()
    if index is not None:
        index.close()


def write_archive(pages: DataFrame, folder: str, least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """Write ``pages(page_id, url, html)`` into ``folder``; returns the directory of the index."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    base = base.withColumns({"sha1": F.sha1("payload"), "n": F.octet_length("payload").cast("long"), "check": F.xxhash64("payload"), "key": F.coalesce(surt(F.col("url")), F.lit(""))})
    groups = base.filter(F.col("n") >= least_revisit).groupBy("sha1", "n", "check").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("copies"))
    groups = groups.filter("copies > 1 and response is not null").drop("copies")
    revisit = F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    roles = base.join(groups, ["sha1", "n", "check"], "left").select("page_id", "url", "key", "sha1", "n", F.when(~revisit, F.col("payload")).alias("payload"), F.when(revisit, F.col("response")).alias("refers_to"))
    # the lines are written before they are sorted, so the archives that they name are written once
    lines = written(roles.mapInArrow(lambda it: _write_records(it, folder), "key string, page_id long, warc string, at long, size long"), "warc-lines")
    parts = lines.count() // PART_LINES + 1
    ordered = lines.repartitionByRange(parts, "key", "page_id").sortWithinPartitions("key", "page_id")
    return written(ordered.mapInArrow(lambda it: _write_index(it, folder), "index string, at long, size long, lines long, first_key string, last_key string"), "warc-directory")


def _lines(block: dict, index) -> list[list]:
    return [json.loads(x) for x in zlib.decompress(range_read(index, block["at"], block["size"])).decode().split("\n")]


def _record_at(warc, at: int, n: int) -> dict:
    return parse(zlib.decompress(range_read(warc, at, n), 31))


def read_archive(directory: DataFrame) -> DataFrame:
    """All records, by way of the index: ``(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload)``."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def lines(batches):
        for b in batches:
            for block in b.to_pylist():
                with open_file(block["index"]) as index:
                    found = [dict(zip(LINES.names, x, strict=True)) for x in _lines(block, index)]
                yield pa.RecordBatch.from_pylist(found, LINES)

    def records(batches):
        path, warc = None, None
        for b in batches:
            for i in range(0, b.num_rows, 256):
                out = []
                for row in b.slice(i, 256).to_pylist():
                    if row["warc"] != path:
                        if warc is not None:
                            warc.close()
                        path, warc = row["warc"], open_file(row["warc"])
                    out.append(_record_at(warc, row["at"], row["size"]))
                yield pa.RecordBatch.from_pylist(out, schema)
        if warc is not None:
            warc.close()

    listed = directory.mapInArrow(lines, "key string, page_id long, warc string, at long, size long")
    dealt = listed.repartitionByRange("warc", "at").sortWithinPartitions("warc", "at")
    return dealt.mapInArrow(records, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def lookup(directory: DataFrame, url: str) -> list[dict]:
    """The captures of a url. The directory is filtered to the blocks that may hold its key, each is searched by halves."""
    spark = directory.sparkSession
    key = spark.createDataFrame([(url,)], "url string").select(surt(F.col("url"))).first()[0]
    found = []
    for block in directory.filter((F.col("first_key") <= key) & (F.col("last_key") >= key)).collect():
        with open_file(block["index"]) as index:
            lines = _lines(block.asDict(), index)
        i = bisect_left(lines, key, key=lambda x: x[0])
        while i < len(lines) and lines[i][0] == key:
            with open_file(lines[i][2]) as warc:
                found.append(_record_at(warc, *lines[i][3:]))
            i += 1
    return found


def archived(pages: DataFrame, least_revisit: int = LEAST_REVISIT) -> DataFrame:
    """Write the pages and read them back: ``(page_id, payload_bytes, payload_digest, record_type, refers_to)``.

    A null html is an empty payload; a very long one is a record like others, held whole while it is written or read. Of equal payloads the largest page_id is the response; where a whole group
    has no page_id, each of its rows is one. Rows repeated with one page_id are records of their own, all of them
    responses if the first is. A null url has the empty key. An empty table writes nothing. Other columns are not read.
    """
    directory = write_archive(pages, scratch(pages.sparkSession, "warc"), least_revisit)
    return read_archive(directory).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def query(spark, sf_dir: str) -> DataFrame:
    return archived(spark.read.parquet(f"{sf_dir}/pages.parquet"))


#: The digest in base32: 5 hexadecimal digits are 4 of its letters.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
r AS (SELECT page_id, payload, hex, max(page_id) OVER (PARTITION BY payload) AS response FROM p)
SELECT page_id, strlen(payload) AS payload_bytes,
 array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, CAST(i // 4 * 5 + 1 AS bigint), 5) AS bigint) >> (15 - i % 4 * 5)) & 31 AS bigint) + 1, 1)), '') AS payload_digest,
 CASE WHEN response IS NULL OR page_id IS NOT DISTINCT FROM response THEN 'response' ELSE 'revisit' END AS record_type,
 CASE WHEN response IS NOT NULL AND page_id IS DISTINCT FROM response THEN response END AS refers_to
FROM r
"""
