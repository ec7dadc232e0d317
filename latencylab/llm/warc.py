"""Dictionary-compressed WARC archives (``.warc.zst``).

An archive is a skippable frame that holds a Zstandard dictionary, built from a spread sample of the
archive's own records, followed by one Zstandard frame per record, compressed on its own with that
dictionary: any record can be read alone, and small pages still compress well. Pages whose payload
was already archived become ``revisit`` records that refer to the first one.

Archives are written by tasks as rows (archive, content) of a Parquet table, which any store can
hold and which a lost task writes again whole; :func:`save_files` puts them into a folder as files.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
import uuid

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latencylab.llm.blocks import scratch

ARCHIVE_BYTES = 16 << 20  # of records before compression
DICT_BYTES = 32 << 10
SAMPLE_BYTES = 1 << 20
LEVEL = 6
# fixed values of the formats
DICT_FRAME = 0x184D2A5D
TRAINED_MAGIC = 0xEC30A437
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
ARCHIVE = "archive string, n_records long, content binary"
RECORD = "page_id long, url string, record_type string, record_id string, refers_to_id string, payload_digest string, payload binary"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{digest}')}>"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url, payload: bytes, refers_to=None, is_revisit: bool = False) -> bytes:
    """One WARC record; a revisit has the HTTP header only."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if is_revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Fields of a response or revisit record; the payload digest of a response is verified."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    digest = fields.get("WARC-Payload-Digest", "sha1:")[5:]
    payload = None
    if fields["WARC-Type"] == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if base32_sha1(payload) != digest:
            raise ValueError(f"record {fields['WARC-Record-ID']}: the payload does not have its digest")
    url = fields.get("WARC-Target-URI")
    return {
        "page_id": int(fields["X-Page-ID"]) if "X-Page-ID" in fields else None,
        "url": url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%") if url is not None else None,
        "record_type": fields["WARC-Type"],
        "record_id": fields["WARC-Record-ID"],
        "refers_to_id": fields.get("WARC-Refers-To"),
        "payload_digest": digest,
        "payload": payload,
    }


def build_dictionary(records: list[bytes]) -> bytes:
    """Dictionary of evenly spaced records (at most ``SAMPLE_BYTES``); where there are too few to
    train one, the first of them serve as raw content."""
    total = sum(map(len, records))
    step = max(1, -(-total // SAMPLE_BYTES))
    sample = [r[:SAMPLE_BYTES] for r in records[::step]]
    if len(sample) >= 16:
        try:
            return zstd.train_dictionary(min(DICT_BYTES, max(1024, sum(map(len, sample)) // 4)), sample, k=256, d=8).as_bytes()
        except zstd.ZstdError:
            pass
    return b"".join(sample)[:DICT_BYTES]


def archive(records: list[bytes]) -> bytes:
    """Bytes of one archive: the dictionary frame, then a frame per record."""
    blob = build_dictionary(records)
    packer = zstd.ZstdCompressor(level=LEVEL, dict_data=_dictionary(blob) if blob else None)
    return struct.pack("<II", DICT_FRAME, len(blob)) + blob + b"".join(packer.compress(r) for r in records)


def _dictionary(blob: bytes) -> zstd.ZstdCompressionDict:
    trained = len(blob) >= 4 and struct.unpack("<I", blob[:4])[0] == TRAINED_MAGIC
    return zstd.ZstdCompressionDict(blob, dict_type=zstd.DICT_TYPE_FULLDICT if trained else zstd.DICT_TYPE_RAWCONTENT)


def read_archive(content: bytes):
    """Records of one archive, one at a time."""
    magic, size = struct.unpack("<II", content[:8])
    if magic != DICT_FRAME:
        raise ValueError("the archive has no dictionary frame")
    blob, at = content[8 : 8 + size], 8 + size
    reader = zstd.ZstdDecompressor(dict_data=_dictionary(blob) if blob else None)
    view = memoryview(content)
    while at < len(content):
        frame = reader.decompressobj()
        parts, left = [], b""
        while not frame.eof and at < len(content):
            parts.append(frame.decompress(view[at : at + (1 << 16)]))
            at += min(1 << 16, len(content) - at)
            left = frame.unused_data
        at -= len(left)
        yield b"".join(parts)


def write_archives(pages: DataFrame, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(archive, n_records, content): one record per row of ``pages`` (page_id, url, html).

    Of rows with equal payloads (UTF-8 of html, null: empty) of at least ``min_bytes`` bytes those with the
    smallest page_id are responses, the others revisits; smaller payloads are all responses.
    Rows without a page_id count as the largest id. Other columns are not read. An empty table has no archives.
    """
    null = F.lit(2**63 - 1)
    base = pages.select(
        F.coalesce(F.col("page_id").cast("long"), null).alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload")
    ).withColumn("digest", F.sha1("payload"))
    keys = base.select("page_id", "digest").groupBy("page_id", "digest").agg(F.lit(1).alias("one")).select("page_id", "digest")
    first = keys.groupBy("digest").agg(F.min("page_id").alias("refers_to"))
    refer = keys.join(first, "digest")
    rows = base.join(refer, ["page_id", "digest"]).select("page_id", "url", "payload", "refers_to")

    def write(batches):
        records, held, n, first_id = [], 0, 0, None

        def flush():
            name = f"pages-{first_id}-{n:05d}.warc.zst"
            return pa.RecordBatch.from_arrays(
                [pa.array([name]), pa.array([len(records)], pa.int64()), pa.array([archive(records)], pa.binary())], ["archive", "n_records", "content"]
            )

        for batch in batches:
            for page_id, url, payload, refers in zip(*(c.to_pylist() for c in batch.columns)):
                again = len(payload) >= min_bytes and refers != page_id
                page_id, refers = (None if x == 2**63 - 1 else x for x in (page_id, refers))
                first_id = page_id if first_id is None else first_id
                records.append(record(page_id, url, payload, refers, again))
                held += len(records[-1])
                if held >= archive_bytes:
                    yield flush()
                    records, held, n = [], 0, n + 1
        if records:
            yield flush()

    return rows.mapInArrow(write, ARCHIVE)


def read_archives(archives: DataFrame) -> DataFrame:
    """Records of all archives: page_id, url, record_type, record_id, refers_to_id, payload_digest,
    payload (null for a revisit)."""

    def read(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows, held = [], 0
                for raw in read_archive(content.as_py()):
                    rows.append(parse_record(raw))
                    held += len(raw)
                    if held > 4 << 20:
                        yield _records(rows)
                        rows, held = [], 0
                if rows:
                    yield _records(rows)

    return archives.select("content").mapInArrow(read, RECORD)


def _records(rows: list[dict]) -> pa.RecordBatch:
    kinds = [("page_id", pa.int64())] + [(c, pa.string()) for c in ("url", "record_type", "record_id", "refers_to_id", "payload_digest")] + [("payload", pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in kinds], [c for c, _ in kinds])


def save_files(archives: DataFrame, folder: str) -> None:
    """Write each archive as a file into a folder that all executors mount; a file appears whole or not."""

    def save(rows):
        for row in rows:
            part = os.path.join(folder, f".{row['archive']}.{uuid.uuid4().hex}")
            with open(part, "wb") as f:
                f.write(row["content"])
            os.replace(part, os.path.join(folder, row["archive"]))

    os.makedirs(folder, exist_ok=True)
    archives.select("archive", "content").foreachPartition(save)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes the archives of ``pages``, reads them back, and returns per record page_id, payload_bytes,
    payload_digest, record_type, refers_to. A revisit's size is that of the response it refers to."""
    spark = pages.sparkSession
    archives = scratch(spark, write_archives(pages), "warc")
    records = scratch(spark, read_archives(archives).withColumn("bytes", F.octet_length("payload").cast("long")).drop("payload", "url"), "warc-records")
    responses = records.filter("record_type = 'response'").groupBy("record_id").agg(F.max("bytes").alias("full"), F.min("page_id").alias("first"))
    out = records.join(responses.withColumnRenamed("record_id", "refers_to_id"), "refers_to_id", "left")
    revisit = F.col("record_type") == "revisit"
    return out.select(
        "page_id", F.when(revisit, F.col("full")).otherwise(F.col("bytes")).alias("payload_bytes"), "payload_digest", "record_type",
        F.when(revisit, F.col("first")).alias("refers_to"),
    )


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT *, strlen(html)::BIGINT AS payload_bytes, min(page_id) OVER (PARTITION BY h) AS first,
    array_to_string([
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::INT >> (15 - 5 * (i % 4))) & 31)::INT, 1)
      for i in range(0, 32)], '') AS payload_digest
  FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d
"""
