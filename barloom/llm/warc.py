"""WARC archives: writing pages with revisits of repeated payloads, and a salvage reader (operator 1).

write_pages() writes one record a page, each a gzip member of its own, to archives of bounded size in
the shared folder. Of pages with equal payloads of REVISIT_FROM bytes or more, that with the smallest
page_id is a response and the others are revisits that refer to it. read_archives() and read_warc()
read archives back; after a failed check they go on at the next valid member or version line and
return the bytes passed over as rows of kind `gap`.

Which pages repeat is found from digests alone; only then does a page travel, once, to its writer, by
page_id and digest, so that a payload that a third of all pages share loads no single task.

Defined results: a null html is an empty payload, a null url leaves the header out; a null page_id is
always a response and never referred to; rows that repeat the smallest page_id of equal payloads are
all responses; an empty table gives no archive and no row; other columns are ignored. An archive grows
past its bound only where one page does.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import common
from barloom.llm.warc_format import REVISIT, record, salvage

REVISIT_FROM, ARCHIVE_BYTES, DATE = 100, 16_000_000, "2024-01-01T00:00:00Z"
MANIFEST = "path string, n_records long, n_bytes long"
ROWS = "kind string, archive string, offset long, length long, reason string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def _urn(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}:{digest[:32]}>"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    headers = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": _urn(page_id, digest), "WARC-Date": DATE}
    if url is not None:
        headers["WARC-Target-URI"] = url
    if refers_to is not None:
        headers |= {"WARC-Profile": REVISIT, "WARC-Refers-To": _urn(refers_to, digest)}
    headers |= {"WARC-Payload-Digest": f"sha256:{digest}", "Payload-Length": str(len(payload)), "Content-Type": "application/http; msgtype=response"}
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    return record(headers, http if refers_to is not None else http + payload)


def _writer(folder: str, most: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = common.open_fs(folder)
        store.create_dir(base, recursive=True)
        part, out, name, n, size = TaskContext.get().partitionId(), None, "", 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "n_records": [n], "n_bytes": [size]})

        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    # a name of its own for each attempt: files of failed attempts are in no manifest
                    name, n, size = f"pages-{part:06d}-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                data = page_record(page_id, url, payload, digest, refers_to)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= most:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return write


def write_pages(pages: DataFrame, revisit_from: int = REVISIT_FROM, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write pages (page_id, url, html); the manifest, one row an archive."""
    spark = pages.sparkSession
    common.ship(spark)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    slim = rows.where(F.length("payload") >= revisit_from).select("page_id", "digest")
    firsts = slim.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    revisits = slim.join(firsts, "digest").where("page_id > first").select(F.col("page_id").alias("p"), F.col("digest").alias("d"), F.col("first").alias("refers_to")).distinct()
    told = rows.join(revisits, (F.col("page_id") == F.col("p")) & (F.col("digest") == F.col("d")), "left")
    written = told.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(_writer(common.scratch(spark, "warc"), archive_bytes), MANIFEST)
    return common.keep(written, "warc-manifest")


def _rows(archive: str, data: bytes, payloads: bool) -> Iterator[dict]:
    for f in salvage(data):
        row = dict.fromkeys(("kind", "archive", "offset", "length", "reason", "page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload"))
        row |= {"kind": "gap" if f.reason else "record", "archive": archive, "offset": f.offset, "length": f.length, "reason": f.reason}
        if not f.reason:
            h = f.headers
            kind = h.get("warc-type", "")
            http = f.block.startswith(b"HTTP/") and kind in ("response", "revisit")
            payload = f.block.partition(b"\r\n\r\n")[2] if http else f.block
            page, other = (re.match(r"<urn:page:(-?\d+):", h.get(k, "")) for k in ("warc-record-id", "warc-refers-to"))
            digest = h.get("warc-payload-digest", "")
            digest = digest[7:].lower() if digest.startswith("sha256:") else hashlib.sha256(payload).hexdigest()
            if kind != "revisit" and digest != hashlib.sha256(payload).hexdigest():
                row |= {"kind": "gap", "reason": "payload digest differs"}
            length = h.get("payload-length", "")
            row |= {"page_id": int(page[1]) if page else None, "url": h.get("warc-target-uri"), "record_type": kind, "payload_digest": digest, "refers_to": int(other[1]) if other else None}
            row["payload_bytes"] = int(length) if kind == "revisit" and length.isdigit() else len(payload)
            if payloads and kind != "revisit":
                row["payload"] = payload
        yield row


def _batches(rows: Iterator[dict], schema: pa.Schema, n: int = 500) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == n:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _schema() -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in ROWS.split(", "))])


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """Records and gaps of the archives of a manifest (path)."""
    common.ship(manifest.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = common.open_fs(path)
                with store.open_input_file(name) as f:
                    yield from _batches(_rows(path, f.read(), payloads), _schema())

    return manifest.select("path").repartition(common.tasks_for(manifest), F.col("path")).mapInArrow(read, ROWS)


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of the archives below any path that Spark reads (up to 2 GB an archive)."""
    common.ship(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                yield from _batches(_rows(name, data.as_py(), payloads), _schema())

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, ROWS)


def op1_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read_archives(write_pages(common.table(spark, sf_dir, "pages")), payloads=False)
    return found.where("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = f"""
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes FROM pages)
, f AS (SELECT *, CASE WHEN payload_bytes >= {REVISIT_FROM} THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to FROM f"""
