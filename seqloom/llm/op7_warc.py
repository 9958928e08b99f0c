"""WARC records in ZIP-packaged archives (operator 7).

``write_archives`` turns pages into archives: each is a ZIP file of stored members, with the
records (each its own gzip member) in ``archive/data.warc.gz`` and their places in
``indexes/index.cdxj``. Archives are rows of a table in the shared folder, so Spark's own
committer writes them to any store, and a lost task is written anew. ``read_archives`` parses the
central directory, locates the members, and reads each record by its range, without extraction.

Of pages with equal payloads of at least 1000 bytes, that with the largest ``page_id`` is a
response and the others are revisits of it; rows that repeat the largest id are responses too. A
null html is an empty payload, a null url an empty one; rows with a null id are revisits of the
largest id, or responses if their group has none. Empty tables give no archives and no rows. Only
page_id, url and html are read.
"""

from __future__ import annotations

import hashlib
import json
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.llm import common, ziparchive

#: Payloads shorter than this are always responses.
LEAST_BYTES = 1000
#: Compressed records in an archive; it bounds what a task holds.
ARCHIVE_BYTES = 4 << 20
#: Rows (of digest and id) up to which the originals are broadcast; beyond it they are joined by a shuffle, hot digests apart.
BROADCAST_ROWS = 200_000
#: Records that a task returns at once.
RECORDS = 256
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"


def record_id(page_id: int | None) -> str:
    """A UUID (version 8) that holds the page's id."""
    n = (page_id or 0) & (1 << 64) - 1
    h = f"{n >> 16:012x}8{int(page_id is None):03x}8{n & 0xFFFF:015x}"
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def page_of(record: str) -> int | None:
    h = record.strip("<>").removeprefix("urn:uuid:").replace("-", "")
    n = int(h[:12] + h[-4:], 16)
    return None if h[13:16] != "000" else n - (1 << 64) if n >> 63 else n


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    url = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        "WARC-Date: 2026-01-01T00:00:00Z",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(raw: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in raw.decode("utf-8", "replace").split("\r\n")[1:])}


def parse(raw: bytes) -> dict:
    """A record: type, page_id, url, payload (None for a revisit), payload_bytes, digest, refers_to."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    warc = _headers(head)
    block = rest[: int(warc["content-length"])]
    http_head, _, body = block.partition(b"\r\n\r\n")
    http, kind = _headers(http_head), warc["warc-type"]
    said = warc["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and hashlib.sha1(body).hexdigest() != said:
        raise ValueError(f"the payload of {warc['warc-record-id']} is not that of its digest")
    return {
        "record_type": kind,
        "page_id": page_of(warc["warc-record-id"]),
        "url": warc.get("warc-target-uri", ""),
        "payload": body if kind == "response" else None,
        "payload_bytes": len(body) if kind == "response" else int(http["content-length"]),
        "payload_digest": said,
        "refers_to": page_of(warc["warc-refers-to"]) if "warc-refers-to" in warc else None,
    }


def pack(records: list[bytes], names: list[str], zip64: bool = False) -> bytes:
    """An archive of records and the index of their places."""
    data, index, at = [], [], 0
    for raw, name in zip(records, names, strict=True):
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = z.compress(raw) + z.flush()
        data.append(member)
        index.append(f"{name} {json.dumps({'offset': at, 'length': len(member)})}\n")
        at += len(member)
    return ziparchive.write([(DATA, b"".join(data)), (INDEX, "".join(index).encode()), ("datapackage.json", b'{"profile": "data-package"}')], zip64)


def records_of(archive: ziparchive.Archive):
    """Each record, read by its range of the archive."""
    start, _ = archive.place(DATA)
    for line in archive.read(INDEX).decode().splitlines():
        place = json.loads(line.split(" ", 1)[1])
        yield parse(zlib.decompress(archive.read_at(start + place["offset"], place["length"]), 31))


def _planned(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest and refers_to; payloads are not shuffled unless the originals are too many to broadcast."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    groups = rows.filter(F.octet_length("payload") >= LEAST_BYTES).groupBy("digest").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n"))
    originals = common.scratch(groups.filter("n > 1 and original is not null").select("digest", "original", "n"), "originals")
    if originals.count() <= BROADCAST_ROWS:
        joined = rows.join(F.broadcast(originals), "digest", "left")
    else:
        joined = common.split_join(rows, originals, "digest", pages.count(), "left", counted="n")
    return joined.select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("original")), F.col("original")).alias("refers_to"))


def write_archives(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES, zip64: bool = False) -> DataFrame:
    """A table of archives: the column ``archive``."""
    import pyarrow as pa

    def run(batches):
        records, names, held = [], [], 0
        for batch in batches:
            for row in batch.to_pylist():
                raw = record(row["page_id"], row["url"], row["payload"], row["digest"], row["refers_to"])
                records.append(raw)
                names.append(str(row["page_id"]))
                held += len(raw)
                if held >= 3 * archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([pack(records, names, zip64)], pa.binary())], names=["archive"])
                    records, names, held = [], [], 0
        if records:
            yield pa.RecordBatch.from_arrays([pa.array([pack(records, names, zip64)], pa.binary())], names=["archive"])

    schema = T.StructType([T.StructField("archive", T.BinaryType())])
    return common.scratch(_planned(pages).mapInArrow(run, schema), "warc")


def read_archives(archives: DataFrame, payload: bool = False, column: str = "archive") -> DataFrame:
    """One row a record of each archive in the binary ``column``."""
    return _read(archives, column, ziparchive.of_bytes, payload)


def read_files(files: DataFrame, payload: bool = False, column: str = "path") -> DataFrame:
    """One row a record of each archive at a URI in ``column``: directories, indexes and records are read by ranges."""
    return _read(files, column, ziparchive.of_uri, payload)


def _read(archives: DataFrame, column: str, opened, payload: bool) -> DataFrame:
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = [("page_id", T.LongType()), ("url", T.StringType()), ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()), ("record_type", T.StringType()), ("refers_to", T.LongType()), *([("payload", T.BinaryType())] if payload else [])]
    schema = T.StructType([T.StructField(n, t) for n, t in kinds])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            for value in batch.column(0):
                rows = []
                for r in records_of(opened(value.as_py())):
                    rows.append({n: r[n] for n, _ in kinds})
                    if len(rows) == RECORDS:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return archives.filter(F.col(column).isNotNull()).select(column).mapInArrow(run, schema)


ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
o AS (SELECT payload, max(page_id) AS original FROM p WHERE strlen(payload) >= {LEAST_BYTES} GROUP BY payload)
SELECT page_id, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest,
  CASE WHEN original IS NULL OR original IS NOT DISTINCT FROM page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN original IS DISTINCT FROM page_id THEN original END AS refers_to
FROM p LEFT JOIN o USING (payload)
"""


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(common.table(spark, sf_dir, "pages"))
    return read_archives(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
