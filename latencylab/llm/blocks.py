"""Blocks of documents, packed exchanges between blocks and buckets, scratch tables.

A *block* is the group of all documents whose id hashes to one number; it holds about
``BLOCK_BYTES`` of text, and its rows are sorted inside the task, so a block has the same
content in the same order whenever it is computed again. A *bucket* owns a share of a key
space (hashes of words, shingles, byte strings). Blocks combine their own keys first and send
each bucket one packed message; a bucket answers each block with one packed reply. A key that
every document has costs one entry per block, so no bucket grows with a hot key's rows.
"""

from __future__ import annotations

import atexit
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latencylab.session import scratch_path

BLOCK_BYTES = 4 << 20
_WRITTEN: list[tuple[SparkSession, str]] = []


def scratch(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and read it back: cuts the lineage,
    and a lost executor costs no recomputation. Deleted when the driver ends."""
    path = scratch_path(spark, f"llm-{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    if not _WRITTEN:
        atexit.register(drop_scratch)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch() -> None:
    """Delete all scratch tables of this driver (results that still read them become invalid)."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            jvm = spark.sparkContext._jvm
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended: the folder stays to the cluster's own clean-up
            return


def with_blocks(df: DataFrame, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """(block, key, text) and the number of blocks, from the total text size."""
    df = df.select(F.col(key), F.col(text))
    size = df.agg(F.sum(F.octet_length(text)), F.count(F.lit(1))).first()
    n = max(1, math.ceil(max((size[0] or 0) / block_bytes, (size[1] or 0) / 100_000)))
    return df.withColumn("block", F.pmod(F.xxhash64(key), F.lit(n))), n


def block_rows(table: pa.Table, key: str = "doc_id", text: str = "text") -> tuple[np.ndarray, pa.Array]:
    """Ids (null: the largest) and texts of a block, sorted by id, then text (null: empty)."""
    text_col = table.column(text).fill_null("")
    ids = table.column(key).fill_null(np.iinfo(np.int64).max)
    order = pa.compute.sort_indices(pa.table({"i": ids, "t": text_col}), sort_keys=[("i", "ascending"), ("t", "ascending")])
    return ids.take(order).to_numpy().astype(np.int64), text_col.take(order)


def buckets_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Bucket of each 64-bit key, from its high bits."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def split(order_bucket: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """(bucket, start, end) of the non-empty runs of a sorted bucket array."""
    edges = np.searchsorted(order_bucket, np.arange(n + 1))
    return [(b, int(edges[b]), int(edges[b + 1])) for b in range(n) if edges[b] < edges[b + 1]]
