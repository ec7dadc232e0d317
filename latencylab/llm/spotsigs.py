"""SpotSigs document fingerprints.

Every occurrence of a common word (an antecedent) anchors a signature: the antecedent and the chain of the
next ``CHAIN`` content words after it, at spot distance ``DISTANCE``. Chains follow running prose and survive edits
elsewhere in the text. So that texts without common words have signatures too, one word in 16, picked by its
hash, is an antecedent as well. A fingerprint is the set of a text's signatures, and likeness is
Jaccard similarity: sets fall into partitions by length, so that only neighbouring partitions can
reach a threshold, and a pair beyond them is settled without comparing.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latencylab.llm import jaccard_join
from latencylab.llm import text as tx

CHAIN = 2
DISTANCE = 1
GROUP_BYTES = 8 << 20
NULL_ID = np.iinfo(np.int64).min
U64 = np.uint64

# Common words of English, French, German and Spanish.
COMMON = (
    "a an and are as at be but by for from had has have he her his i in is it its not of on or she that the their they this to was were which will with you "
    "au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous ou par pas pour qu que qui sa se son sur un une vous "
    "aber als am auch auf aus bei das dass dem den der des die dir ein eine einem einen einer er es für hat ich im in ist mit nach nicht noch nur oder sich sie sind so über um und uns von war wie wir zu zum zur "
    "al como con de del donde el ella ellos en era es esta este fue ha hay la las lo los más muy no nos o para pero por porque que se ser si sin sobre su sus también un una y ya"
).split()

SEPARATORS = tx.SPACE.copy()
SEPARATORS[[i for i in range(33, 128) if not chr(i).isalnum()]] = True
_STOP = np.unique([tx.word_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]), SEPARATORS)[0][0] for w in COMMON]).astype(U64)


def signatures(buf: np.ndarray, offs: np.ndarray, chain: int = CHAIN, distance: int = DISTANCE) -> np.ndarray:
    """Sorted distinct (row << 32 | signature) of the texts. A text of words without a signature has one, of
    its whole word sequence; a text without words, of its bytes; an empty text has none."""
    h, first = tx.word_hashes(buf, offs, SEPARATORS)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    stop = np.isin(h, _STOP)
    content = np.flatnonzero(~stop)
    following = np.cumsum(~stop)  # number of the first content word after each word
    anchor = np.flatnonzero(stop | (h % U64(16) == U64(3)))
    last = following[anchor] + (chain - 1) * distance
    anchor = anchor[last < len(content)]
    links = [content[following[anchor] + j * distance] for j in range(chain)]
    anchor_ok = row[links[-1]] == row[anchor] if len(anchor) else np.zeros(0, bool)
    anchor, links = anchor[anchor_ok], [x[anchor_ok] for x in links]
    acc = h[anchor] * U64(0x9E3779B97F4A7C15)
    for x in links:
        acc = tx.mix(acc + h[x])
    found = row[anchor].astype(U64) << U64(32) | acc >> U64(32)
    has = np.zeros(len(offs) - 1, bool)
    has[row[anchor]] = True
    alone = []
    for r in np.flatnonzero(~has & (np.diff(offs) > 0)):
        words = h[first[r] : first[r + 1]]
        if len(words):
            one = int(tx.mix((words * tx.mix(np.arange(1, len(words) + 1, dtype=U64))).sum(dtype=U64, keepdims=True))[0])
        else:
            one = int.from_bytes(hashlib.blake2b(buf[offs[r] : offs[r + 1]].tobytes(), digest_size=8).digest(), "big")
        alone.append(int(r) << 32 | one >> 32)
    return np.unique(np.concatenate([found, np.array(alone, U64)]))


def fingerprints(texts: list[str], limit: int = tx.CHUNK) -> tuple[list[str], np.ndarray]:
    """Fingerprint string of each text (hex of its ascending signatures) and all (row << 32 | signature)."""
    keys, base = [], 0
    for lo, hi, buf, offs in tx.chunks(pa.array(texts, pa.large_string()), limit):
        keys.append(signatures(buf, offs) + (U64(lo) << U64(32)))
        base = hi
    all_keys = np.concatenate(keys) if keys else np.zeros(0, U64)
    edge = np.searchsorted(all_keys >> U64(32), np.arange(len(texts) + 1))
    raw = (all_keys & U64(0xFFFFFFFF)).astype(">u4")
    assert base == len(texts)
    return [raw[a:b].tobytes().hex() for a, b in zip(edge[:-1], edge[1:])], all_keys


def spot_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Signature set of each text of an Arrow column."""
    for lo, hi, buf, offs in tx.chunks(column):
        keys = signatures(buf, offs)
        edge = np.searchsorted(keys >> U64(32), np.arange(hi - lo + 1))
        yield from (keys[a:b] & U64(0xFFFFFFFF) for a, b in zip(edge[:-1], edge[1:]))


def near_duplicates(docs: DataFrame, percent: int = 75, max_region: int = jaccard_join.MAX_REGION) -> DataFrame:
    """doc_id, n_signatures, component_id: documents linked by fingerprints of at least ``percent`` Jaccard similarity.

    Fingerprints are partitioned by length and joined exactly within and between neighbouring partitions, with the
    pruning of :mod:`latencylab.llm.jaccard_join`; nulls, repeats and empty tables as there."""
    found = jaccard_join.near_duplicates(docs, percent, spot_sets, max_region, by_length=True)
    return found.withColumnRenamed("n_shingles", "n_signatures")


def partition_of(length: int, threshold: float) -> int:
    """Partition of a set by its length: sets two or more partitions apart are below the threshold."""
    return 0 if length == 0 else 1 + int(math.log(length) / -math.log(threshold))


def likeness(a: np.ndarray, b: np.ndarray, threshold: float = 0.0) -> float:
    """Jaccard similarity of two ascending signature sets; 0 at once if their lengths rule the
    threshold out. Two empty sets are alike (1)."""
    if not len(a) and not len(b):
        return 1.0
    if threshold > 0 and abs(partition_of(len(a), threshold) - partition_of(len(b), threshold)) > 1:
        return 0.0
    if min(len(a), len(b)) < threshold * max(len(a), len(b)):
        return 0.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (len(a) + len(b) - shared)


def _likeness_rows(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Likeness of row i of ``a`` and row i of ``b`` for all rows at once."""
    count = lambda keys: np.bincount((keys >> U64(32)).astype(np.int64), minlength=n)[:n]
    na, nb = count(a), count(b)
    shared = count(np.intersect1d(a, b, assume_unique=True))
    union = na + nb - shared
    return np.where(union > 0, shared / np.maximum(union, 1), 1.0)


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edit(text: str, following: str) -> str:
    """The last third of the text's code points replaced by as many of the following text's first."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _group(table: pa.Table) -> pa.Table:
    """Documents of one id range in descending order; the last row is the start of the next range."""
    order = pa.compute.sort_indices(table, sort_keys=[("doc_id", "descending"), ("guest", "ascending"), ("text", "ascending")])
    table = table.take(order)
    guest = table.column("guest").to_numpy(zero_copy_only=False)
    # the row after this range: the first guest (for the last range it is the largest id of all)
    table = table.take(pa.array(np.concatenate([np.flatnonzero(~guest), np.flatnonzero(guest)[:1]])))
    ids, texts = table.column("doc_id").to_pylist(), table.column("text").fill_null("").to_pylist()
    n = int((~guest).sum())
    prints, keys = fingerprints(texts)
    edited = [_edit(texts[i], texts[i + 1]) for i in range(n)]
    edited_prints, edited_keys = fingerprints(edited)
    following = keys[keys >> U64(32) >= U64(1)] - (U64(1) << U64(32))
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    cols = (
        [None if i == NULL_ID else i for i in ids[:n]],
        [len(s) for s in texts[:n]],
        [hashlib.sha256(s.encode()).hexdigest() for s in edited],
        prints[:n],
        edited_prints,
        _likeness_rows(keys, edited_keys, n),
        _likeness_rows(keys, following, n),
    )
    names = [c.split()[0] for c in OUT.split(", ")]
    return pa.table({name: pa.array(c, t) for name, c, t in zip(names, cols, kinds)})


def compare_with_edits(docs: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next.

    The next document is that with the next smaller doc_id, after the smallest the largest. Null text is
    empty, with an empty fingerprint; two empty fingerprints have likeness 1. A null doc_id comes after all
    others. Rows with equal ids follow each other in text order. A single document is its own
    next one. Extra columns are not read; an empty table gives an empty result.

    Documents are dealt to id ranges; the first row of each range is also sent, as a guest, to the
    range before it, so each text is shuffled once and no task holds more than a range.
    """
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NULL_ID))).alias("doc_id"), "text")
    size = base.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    if not size[1]:
        return docs.sparkSession.createDataFrame([], OUT)
    n = max(1, math.ceil(max((size[0] or 0) / group_bytes, size[1] / 100_000)))
    bounds = sorted({int(x) for x in base.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.2 / n)}) if n > 1 else []
    edges = np.array(bounds, np.int64)

    def range_of(ids: np.ndarray) -> np.ndarray:
        return len(edges) - np.searchsorted(edges, ids, "left")

    def ranges(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(range_of(ids), pa.int64()), batch.column("doc_id")], ["r", "doc_id"])

    tops = sorted((r["r"], r["top"]) for r in base.select("doc_id").mapInArrow(ranges, "r long, doc_id long").groupBy("r").agg(F.max("doc_id").alias("top")).collect())
    host = {top: tops[i - 1][0] for i, (_, top) in enumerate(tops)}  # the range before each range's first row
    guests = np.array(sorted(host), np.int64)
    targets = np.array([host[t] for t in guests.tolist()], np.int64)

    def deal(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            own = range_of(ids)
            at = np.minimum(np.searchsorted(guests, ids), len(guests) - 1)
            again = np.flatnonzero(guests[at] == ids)
            rows = np.concatenate([np.arange(len(ids)), again])
            picked = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([own, targets[at[again]]]), pa.int64()), picked.column("doc_id"), picked.column("text"),
                    pa.array(np.concatenate([np.zeros(len(ids), bool), np.ones(len(again), bool)])),
                ],
                ["r", "doc_id", "text", "guest"],
            )

    return base.mapInArrow(deal, "r long, doc_id long, text string, guest boolean").groupBy("r").applyInArrow(_group, OUT)
