"""WARC archives as a table of record chunks.

Payloads travel as rows (record, chunk number, bytes) of a fixed size: Spark cuts them, a writing task appends chunk
after chunk to one gzip member for each record, and a reading task streams the archive back into chunk rows, each with
the SHA-256 of the payload up to its end. Neither holds a whole record. Every task writes a file of its own into the
folder that driver and executors share, under a name that no other attempt uses; the manifest, written once from the
tasks that succeeded, says which files count. Payloads that occur again are revisit records without payload.

Which payloads occur again is decided on ids and digests alone. Their digests are met by broadcast while they are few,
which is counted first, so that payloads stay where they were read; beyond that by a join in which a digest with many
rows is met in many places.

Defined results: a null payload is empty; equal payloads under `least` bytes are all responses; of others the smallest
id is the response, and rows that repeat this id are responses too; rows with a null id never are the one referred to;
a null url is left out of the record's header, and line ends in urls become spaces; each record has an id of its own,
rows that repeat too, so that a revisit names its response by its url, its page and the payload's digest; an empty table
gives no files and no rows. Other columns aren't read.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import scratch_path, spread_join, stored, table

CHUNK, LEAST = 65_536, 100
#: Digests that are broadcast at most (about 100 bytes each), and rows with one digest that one task meets beyond that.
FEW, SPREAD = 250_000, 2_000
#: Bytes of chunks that a reading task hands over at once.
HANDED = 8_000_000
CHUNKS = "record_id string, page_id long, record_type string, refers_to long, url string, chunk_no int, last boolean, bytes_so_far long, digest_so_far string, payload_bytes long, payload_digest string, chunk binary"

ARROW = pa.schema(
    [(n, {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}[t]) for n, t in (f.split() for f in CHUNKS.split(", "))]
)


def decided(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST) -> DataFrame:
    """(id, url, payload, bytes, digest, record_type, refers_to, refers_url) for every row: which record is a response, and
    which a revisit."""
    body = F.encode(F.coalesce(F.col(payload), F.lit("")), "utf-8")
    rows = pages.select(F.col(key).alias("id"), F.col(url).alias("url"), body.alias("payload"))
    rows = rows.withColumns({"bytes": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    known = F.when(F.col("id").isNotNull(), F.struct("id", "url"))
    firsts = rows.where(F.col("bytes") >= least).groupBy("digest").agg(F.min(known).alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = stored(firsts, "warc-firsts")
    met = rows.join(F.broadcast(firsts.drop("n")), "digest", "left") if firsts.count() <= FEW else spread_join(rows, firsts, ["digest"], SPREAD)
    again = F.col("first").isNotNull() & ~F.coalesce(F.col("id") == F.col("first.id"), F.lit(False)) & (F.col("bytes") >= least)
    return met.select(
        "id", "url", "payload", "bytes", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("first.id")).alias("refers_to"), F.when(again, F.col("first.url")).alias("refers_url"),
    )


def chunked(payload: Column, size: int) -> Column:
    """The chunks of a binary column in order; one empty chunk for an empty payload."""
    count = F.greatest(F.lit(1), F.ceil(F.octet_length(payload) / size)).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substring(payload, i * size + 1, F.lit(size)))


DATE = "1970-01-01T00:00:00Z"


def _header(row: dict) -> bytes:
    revisit = row["record_type"] == "revisit"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {row['record_type']}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
        f"WARC-Date: {DATE}",
        "Content-Type: text/html; charset=utf-8",
        f"WARC-Payload-Digest: sha256:{row['digest']}",
        f"X-Payload-Length: {row['bytes']}",
        f"Content-Length: {0 if revisit else row['bytes']}",
    ]
    if row["id"] is not None:
        lines.append(f"X-Page-ID: {row['id']}")
    if row["url"] is not None:
        lines.append("WARC-Target-URI: " + " ".join(row["url"].splitlines()))
    if revisit:
        lines += [f"WARC-Refers-To-Date: {DATE}", f"X-Refers-To-Page: {row['refers_to']}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        if row["refers_url"] is not None:
            lines.append("WARC-Refers-To-Target-URI: " + " ".join(row["refers_url"].splitlines()))
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n"


def write_archives(records: DataFrame, folder: str, chunk: int = CHUNK) -> DataFrame:
    """Writes rows of decided() into .warc.gz files below folder; the manifest: (path, records) of the files that count."""
    kept = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    rows = records.withColumn("chunks", chunked(kept, chunk)).select(
        "id", "url", "bytes", "digest", "record_type", "refers_to", "refers_url", (F.size("chunks") - 1).alias("last"), F.posexplode("chunks").alias("chunk_no", "chunk")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out, packer, records = TaskContext.get(), None, None, 0
        path = f"{folder}/part-{task.partitionId():05d}-{task.taskAttemptId()}-{uuid.uuid4().hex}.warc.gz"
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    store, at = fs.FileSystem.from_uri(path)
                    store.create_dir(at.rpartition("/")[0], recursive=True)
                    out = store.open_output_stream(at, compression=None)
                if row["chunk_no"] == 0:
                    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                    out.write(packer.compress(_header(row)))
                    records += 1
                out.write(packer.compress(row["chunk"] or b""))
                if row["chunk_no"] == row["last"]:
                    out.write(packer.compress(b"\r\n\r\n") + packer.flush())
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": pa.array([path]), "records": pa.array([records], pa.int64())})

    return stored(rows.mapInArrow(write, "path string, records long"), "warc-manifest")


def read_records(stream, chunk: int = CHUNK) -> Iterator[dict]:
    """Chunk rows of an uncompressed WARC stream with the digest so far; a wrong payload digest is an error."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8").partition(":")
            head[name.lower()] = value.strip()
        size, digest = int(head["content-length"]), hashlib.sha256()
        page, first = head.get("x-page-id"), head.get("x-refers-to-page")
        told = head.get("warc-payload-digest", "").removeprefix("sha256:")
        base = {
            "record_id": head["warc-record-id"],
            "page_id": None if page is None else int(page),
            "record_type": head["warc-type"],
            "refers_to": None if first in (None, "None") else int(first),
            "url": head.get("warc-target-uri"),
            "payload_bytes": int(head.get("x-payload-length", size)),
        }
        done = number = 0
        while True:
            part = stream.read(min(chunk, size - done))
            if len(part) < min(chunk, size - done):
                raise ValueError(f"record {base['record_id']} ends early")
            digest.update(part)
            done += len(part)
            last = done == size
            if last and base["record_type"] == "response" and told and told != digest.hexdigest():
                raise ValueError(f"record {base['record_id']} has another payload digest than its header says")
            yield base | {"chunk_no": number, "last": last, "bytes_so_far": done, "digest_so_far": digest.hexdigest(), "payload_digest": told or None, "chunk": part}
            number += 1
            if last:
                break


def read_archives(manifest: DataFrame, chunk: int = CHUNK, with_bytes: bool = True) -> DataFrame:
    """The chunk table of the archives in a manifest, one row for each chunk; without the bytes if they aren't wanted."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, at = fs.FileSystem.from_uri(path)
                rows, size = [], 0
                with store.open_input_stream(at, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for row in read_records(stream, chunk):
                        size += len(row["chunk"])
                        if not with_bytes:
                            row["chunk"] = None
                        rows.append(row)
                        if size > HANDED or len(rows) >= 10_000:
                            yield pa.RecordBatch.from_pylist(rows, ARROW)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, ARROW)

    files = max(1, manifest.count())
    return manifest.select("path").repartition(files).mapInArrow(read, CHUNKS)


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_archives(decided(table(spark, sf_dir, "pages")), scratch_path(spark, "warc"))
    ends = read_archives(manifest, with_bytes=False).where("last")
    digest = F.when(F.col("record_type") == "response", F.col("digest_so_far")).otherwise(F.col("payload_digest"))
    return ends.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")


OP9_SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first_id FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN coalesce(first_id <> page_id, false) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id <> page_id THEN first_id END AS refers_to
FROM f
"""
