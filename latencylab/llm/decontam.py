"""Benchmark decontamination: size-partitioned MinHash containment search.

Test items are partitioned by the size of their shingle set (powers of two). Each item is
represented by its bottom-k MinHash sketch: its ``k = |Q| - ceil(t |Q|) + 1`` smallest shingle
hashes. A document that contains at least ``t`` of the item lacks fewer than ``k`` of its
shingles, so it holds one sketch value at least: candidates are found with recall 1 however
long the document is. A partition is probed only by documents with enough shingles for
its smallest item. Candidates are verified by exact shingle containment.

Items are broadcast in slices of at most ``max_shingles`` shingles (16 MB); a larger benchmark takes
one pass over the documents per slice, so nothing that is broadcast grows with the data.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latencylab.llm import text as tx

THRESHOLD = 0.75
SHINGLE = 5
MAX_SHINGLES = 2_000_000
PAIRS = "doc_id long, item_id long, n_item long, n_shared long, containment double"


def needed(n: int, threshold: float) -> int:
    """Smallest shared count that reaches the threshold (compared in whole thousandths)."""
    return -(-round(threshold * 1000) * n // 1000)


class ItemIndex:
    """Sketches and full sets of the items of one slice."""

    def __init__(self, ids: list, sets: list[np.ndarray], threshold: float):
        self.ids = ids
        self.sets = sets
        self.need = [needed(len(s), threshold) for s in sets]
        parts: dict[int, list[int]] = {}
        for i, s in enumerate(sets):
            parts.setdefault(int(len(s)).bit_length(), []).append(i)
        self.parts = []
        for members in parts.values():
            sketch = [sets[i][: len(sets[i]) - self.need[i] + 1] for i in members]  # sets are sorted by hash
            keys = np.concatenate(sketch)
            owner = np.repeat(members, [len(s) for s in sketch])
            order = np.argsort(keys, kind="stable")
            self.parts.append((min(self.need[i] for i in members), keys[order], owner[order]))

    def search(self, doc: np.ndarray) -> list[tuple[int, int]]:
        """(item position, shared shingles) of the items that the document's set contains."""
        out = []
        for least, keys, owner in self.parts:
            if len(doc) < least:
                continue
            if len(doc) < len(keys):
                lo, hi = np.searchsorted(keys, doc, "left"), np.searchsorted(keys, doc, "right")
                hit = np.flatnonzero(hi > lo)
                found = {int(o) for i in hit for o in owner[lo[i] : hi[i]]}
            else:
                at = np.minimum(np.searchsorted(doc, keys), len(doc) - 1)
                found = set(owner[doc[at] == keys].tolist())
            for i in sorted(found):
                s = self.sets[i]
                at = np.minimum(np.searchsorted(doc, s), len(doc) - 1)
                shared = int((doc[at] == s).sum())
                if shared >= self.need[i]:
                    out.append((i, shared))
        return out


def _slices(items: DataFrame, max_shingles: int, k: int):
    """Lists of (item_id, set) of at most ``max_shingles`` shingles together (one larger item alone)."""
    ids, sets, held = [], [], 0
    for row in items.select("item_id", "text").filter(F.col("text").isNotNull()).toLocalIterator():
        s = next(tx.text_shingle_sets(pa.array([row["text"]]), k))
        if not len(s):
            continue
        if held and held + len(s) > max_shingles:
            yield ids, sets
            ids, sets, held = [], [], 0
        ids.append(row["item_id"])
        sets.append(s)
        held += len(s)
    if ids:
        yield ids, sets


def contained_items(
    docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE, max_shingles: int = MAX_SHINGLES
) -> DataFrame:
    """Pairs (doc_id, item_id, n_item, n_shared, containment) with containment >= threshold.

    ``containment`` is the share of the item's distinct k-word shingles that the document
    holds; an item of fewer words is one shingle (its whole sequence), matched by a
    document of exactly those words. Null or empty texts hold and match nothing. Repeated rows give
    repeated pairs; a null id stays null in its pairs. Other columns are not read.
    """
    spark = docs.sparkSession
    out = None
    for ids, sets in _slices(items, max_shingles, k):
        index = spark.sparkContext.broadcast(ItemIndex(ids, sets, threshold))

        def probe(batches, index=index):
            ix = index.value
            for batch in batches:
                doc_ids = batch.column("doc_id").to_pylist()
                rows = []
                for doc, s in zip(doc_ids, tx.text_shingle_sets(batch.column("text"), k)):
                    for i, shared in ix.search(s) if len(s) else ():
                        rows.append((doc, ix.ids[i], len(ix.sets[i]), shared, shared / len(ix.sets[i])))
                cols = list(zip(*rows)) if rows else [[]] * 5
                kinds = [pa.int64()] * 4 + [pa.float64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "item_id", "n_item", "n_shared", "containment"]
                )

        part = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(probe, PAIRS)
        out = part if out is None else out.unionAll(part)
    return out if out is not None else spark.createDataFrame([], PAIRS)


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, k: int = SHINGLE, max_shingles: int = MAX_SHINGLES) -> DataFrame:
    """The documents that contain no item (all columns, whatever their names). Every row is judged by its own text in the task that
    reads it: no shuffle, and a row without an id or with another row's id stays if it is clean."""
    spark, names, kept = docs.sparkSession, docs.columns, docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    text = f"c{names.index('text')}"
    for ids, sets in _slices(items, max_shingles, k):
        index = spark.sparkContext.broadcast(ItemIndex(ids, sets, threshold))

        def clean(batches, index=index):
            ix = index.value
            for batch in batches:
                keep = [not len(s) or not ix.search(s) for s in tx.text_shingle_sets(batch.column(text), k)]
                yield batch.filter(pa.array(keep, pa.bool_()))

        kept = kept.mapInArrow(clean, kept.schema)
    return kept.toDF(*names)


ORACLE = """
WITH toks AS (
  SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\\x20\\x09-\\x0D]+') AS w FROM documents
  UNION ALL
  SELECT 'i', item_id, regexp_extract_all(
           translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[^\\x20\\x09-\\x0D]+') FROM benchmark),
sh AS (
  SELECT DISTINCT kind, id, unnest(CASE WHEN len(w) >= 5
      THEN [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]
      ELSE [array_to_string(w, ' ')] END) AS s
  FROM toks WHERE len(w) > 0),
n AS (SELECT id, count(*) AS n_item FROM sh WHERE kind = 'i' GROUP BY id),
c AS (
  SELECT d.id AS doc_id, i.id AS item_id, count(*) AS n_shared
  FROM sh i JOIN sh d ON i.s = d.s AND i.kind = 'i' AND d.kind = 'd' GROUP BY 1, 2)
SELECT doc_id, item_id, n_item, n_shared, n_shared::DOUBLE / n_item AS containment
FROM c JOIN n ON c.item_id = n.id WHERE 1000 * n_shared >= 750 * n_item
"""
