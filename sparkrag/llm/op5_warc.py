"""WARC archives, index first.

Each task writes one archive of gzip members, one per record, in the shared folder, and returns one index row per
record (file, offset, length, url, digest). The index is a Parquet table; a retried task writes a file of another
name, which no index row names. Reading starts from the index: rows are put in order of file and offset, near byte
ranges are coalesced into one read, and records are parsed out of it.
Of equal payloads of at least LEAST bytes the one with the largest page_id is the response (repeated rows with that
page_id all are), the others are revisits without payload. Null html is an empty payload, a null page_id never
is what a revisit refers to, null urls are written empty, an empty table gives no rows, further columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, stored, table

LEAST = 1000
#: Ranges closer than GAP are read as one, up to CHUNK bytes.
GAP, CHUNK = 1 << 16, 1 << 22
#: Archive bytes that a task reads at most, and at least where there are fewer tasks than shuffle partitions.
TASK, LEAST_TASK = 1 << 27, 1 << 20
INDEX = "page_id bigint, url string, digest string, file string, offset bigint, length bigint"


def plan_records(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, payload binary, digest, refers_to); refers_to is null for responses."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload")).withColumn("large", F.length("payload") >= LEAST)
    firsts = stored(rows.where("large").groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1"), "copies")
    # Payloads that more than a thousandth of the copies have, less than a thousand, are broadcast; small ones are not looked up.
    total = firsts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = [r[0] for r in firsts.where(F.col("n") > max(total // 1000, 100)).select("digest").collect()]
    hot = F.col("digest").isin(frequent) if frequent else F.lit(False)
    refers = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("last")), F.col("last"))
    columns = ["page_id", "url", "payload", "digest"]
    parts = [rows.where("not large").select(*columns, F.lit(None).cast("bigint").alias("refers_to")), rows.where("large").where(~hot).join(firsts, "digest", "left").select(*columns, refers.alias("refers_to"))]
    if frequent:
        parts.append(rows.where("large").where(hot).join(F.broadcast(firsts.where(hot)), "digest").select(*columns, refers.alias("refers_to")))
    return reduce(DataFrame.union, parts)


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    revisit = refers_to is not None
    body = b"" if revisit else payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>"]
    head += [f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: text/html", f"Content-Length: {len(body)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 4, mtime=0)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, rest = gzip.decompress(raw).split(b"\r\n\r\n", 1)
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Index rows of the archives that are written when they are evaluated; store them before use."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base)
        file, out, at = f"{base}/{uuid.uuid4().hex}.warc.gz", None, 0
        try:
            for b in batches:
                done = []
                for r in b.to_pylist():
                    out = out or fs.open_output_stream(file, compression=None)
                    raw = record(r["page_id"], r["url"], r["payload"], r["digest"], r["refers_to"])
                    out.write(raw)
                    done.append({"page_id": r["page_id"], "url": r["url"], "digest": r["digest"], "file": file, "offset": at, "length": len(raw)})
                    at += len(raw)
                yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("digest", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))
        finally:
            if out:
                out.close()

    return rows.mapInArrow(write, INDEX)


READ = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, payload binary"


def read_records(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records that the rows of an index name."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        number = lambda x: int(x[10:-1]) if x and x[10:-1] else None

        def load(run: list[dict]) -> pa.RecordBatch:
            first, end = run[0]["offset"], max(x["offset"] + x["length"] for x in run)
            with fs.open_input_file(run[0]["file"]) as f:
                raw = f.read_at(end - first, first)
            done = []
            for x in run:
                at = x["offset"] - first
                head, body = parse(raw[at : at + x["length"]])
                revisit = head["WARC-Type"] == "revisit"
                digest = head["WARC-Payload-Digest"][5:] if revisit else hashlib.sha1(body).hexdigest()
                size = int(head["X-Payload-Length"]) if revisit else len(body)
                done.append({"page_id": number(head["WARC-Record-ID"]), "url": head["WARC-Target-URI"], "payload_bytes": size, "payload_digest": digest, "record_type": head["WARC-Type"], "refers_to": number(head.get("WARC-Refers-To")), "payload": body if payloads else None})
            return pa.RecordBatch.from_pylist(done, schema=schema)

        run: list[dict] = []
        for b in batches:
            for x in b.to_pylist():
                if run and (x["file"] != run[-1]["file"] or x["offset"] > run[-1]["offset"] + run[-1]["length"] + GAP or x["offset"] + x["length"] - run[0]["offset"] > CHUNK):
                    yield load(run)
                    run = []
                run.append(x)
        if run:
            yield load(run)

    # As many tasks as the bytes to read ask for; the rows of an index are few and would all be put in one.
    size = index.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(1, -(-size // TASK), min(tasks, -(-size // LEAST_TASK)))
    dealt = index.select("file", "offset", "length").withColumn("_c", F.floor(F.col("offset") / CHUNK)).repartition(n, "file", "_c")
    return dealt.sortWithinPartitions("file", "offset").drop("_c").mapInArrow(read, READ)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "warc")
    index = stored(write_archives(plan_records(table(spark, sf_dir, "pages")), folder), "warc-index")
    return read_records(index, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to FROM m
"""
