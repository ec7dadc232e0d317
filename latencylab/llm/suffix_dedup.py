"""Removal of repeated byte strings by longest-previous-factor arrays.

A byte goes if a string of ``LENGTH`` bytes over it also starts in a document with a smaller id.
In the suffix array of the corpus (in id order) that is a question to the longest-previous-factor
array: the longest earlier match of a suffix is with the previous or the next suffix, in suffix order,
that has a smaller position; if either shares ``LENGTH`` bytes, the string is a later copy.

The corpus is far too large for one array, and only suffixes with a common prefix of
``LENGTH`` bytes ever meet, so the array is built in pieces that keep such suffixes together:

1. *Anchors.* Each window of LENGTH bytes has one anchor, the gram of ``GRAM`` bytes in it with the
   least hash (leftmost on ties). Equal windows have equal anchors at equal places. Runs of windows
   with one anchor are a *unit*, about LENGTH - GRAM windows.
2. Blocks send the hashes of their anchors to buckets, which answer which occur in two documents.
3. Blocks send the bytes of units with such anchors, each distinct one once with its smallest document,
   to the bucket of the anchor. There the suffixes of all units are sorted to depth LENGTH by prefix doubling, with
   documents in id order, and previous and next smaller values decide each suffix.
4. The answers, one bit per window, return to the blocks, which cut the bytes out.

A passage in very many documents is one unit per block in steps 3 and 4, whatever its copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latencylab.llm import text as tx
from latencylab.llm.blocks import block_rows, buckets_of, scratch, split, with_blocks

LENGTH = 50
GRAM = 16
KEY_BYTES = 5
POSITION_BITS = np.uint64(21)  # a slice and its overlap fit
NULL_ID = np.iinfo(np.int64).max
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


# ---- anchors and units -------------------------------------------------------------------------


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    n, span = len(x) - width + 1, 1
    while 2 * span <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    return np.minimum(x[:n], x[width - span : width - span + n]) if span < width else x[:n]


class Units:
    """Units of a run of documents: anchor hash, first and last window start, content hash, document row."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, length: int, gram: int):
        parts = [self._slice(buf, offs, a, length, gram) for a in range(0, max(0, len(buf) - length + 1), tx.SLICE)]
        self.key, self.anchor, self.lo, self.hi, self.content = (
            (np.concatenate(x) if parts else np.zeros(0, t)) for x, t in zip(zip(*parts) if parts else [()] * 5, (np.uint64, np.int64, np.int64, np.int64, np.uint64))
        )
        self.row = np.searchsorted(offs, self.lo, "right") - 1
        self.length = length

    @staticmethod
    def _slice(buf, offs, a, length, gram):
        """Units of the windows that start in one slice."""
        b = min(a + tx.SLICE, len(buf) - length + 1)
        seg = buf[a : b - 1 + length]
        ph = tx.PrefixHash(seg)
        n = len(seg) - gram + 1
        h = tx.mix((ph.sum[gram:] - ph.sum[:-gram]) * ph.inverse[:n])
        low = (np.uint64(1) << POSITION_BITS) - np.uint64(1)
        at = (sliding_min((h & ~low) | np.arange(n, dtype=np.uint64), length - gram + 1) & low).astype(np.int64)
        # windows that reach over the end of their document are none
        edge = np.zeros(b - a + 1, np.int32)
        ends = offs[1:]
        ends = ends[(ends > a) & (ends < b + length)]
        np.add.at(edge, np.clip(ends - length + 1 - a, 0, b - a), 1)
        np.add.at(edge, np.clip(ends - a, 0, b - a), -1)
        start = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
        if not len(start):
            return np.zeros(0, np.uint64), start, start, start, np.zeros(0, np.uint64)
        p = at[start]
        new = np.ones(len(start), bool)
        new[1:] = (p[1:] != p[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(start)) - 1
        lo, hi, p = start[first], start[last], p[first]
        content = tx.mix(ph(lo, hi + length) + tx.mix((p - lo).astype(np.uint64)))
        return tx.mix(h[p]), p + a, lo + a, hi + a, content  # least hashes are small: mixed again to spread over buckets

    def keep(self, mask: np.ndarray) -> None:
        for name in ("key", "anchor", "lo", "hi", "content", "row"):
            setattr(self, name, getattr(self, name)[mask])


def _first(sorted_keys: np.ndarray) -> np.ndarray:
    """Index of the first of each run of equal values."""
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)


class _Block:
    def __init__(self, table: pa.Table, length: int, gram: int):
        self.ids, texts = block_rows(table)
        self.buf, self.offs = tx.flat(texts)
        self.units = Units(self.buf, self.offs, length, gram)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchor hashes, ascending, and whether two documents of the block have it."""
        u = self.units
        order = np.argsort(u.key, kind="stable")
        key, doc = u.key[order], self.ids[u.row[order]]
        first = _first(key)
        if not len(first):
            return key, np.zeros(0, bool)
        return key[first], np.minimum.reduceat(doc, first) != np.maximum.reduceat(doc, first)

    def only_shared(self, shared: np.ndarray) -> None:
        keys, _ = self.anchors()
        self.units.keep(shared[np.searchsorted(keys, self.units.key)])

    def distinct_units(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per distinct unit, ordered by (anchor hash, content): index of one, its smallest document;
        and per unit its distinct unit."""
        u = self.units
        order = np.lexsort((u.content, u.key))
        pair = np.stack([u.key[order], u.content[order]])
        new = np.ones(len(order), bool)
        new[1:] = (pair[:, 1:] != pair[:, :-1]).any(0)
        first = np.flatnonzero(new)
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        least = np.minimum.reduceat(self.ids[u.row[order]], first) if len(first) else np.zeros(0, np.int64)
        return order[first], least, of


def _send(n_buckets: int, length: int, gram: int):
    def run(table: pa.Table) -> pa.Table:
        keys, many = _Block(table, length, gram).anchors()
        raw = np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES])
        parts = split(buckets_of(keys, n_buckets), n_buckets)
        return pa.table({
            "bucket": pa.array([b for b, _, _ in parts], pa.int64()),
            "block": pa.array([table.column("block")[0].as_py()] * len(parts), pa.int64()),
            "keys": pa.array([raw[i:j].tobytes() for _, i, j in parts], pa.binary()),
            "many": pa.array([np.packbits(many[i:j]).tobytes() for _, i, j in parts], pa.binary()),
        })

    return run


def _shared(table: pa.Table) -> pa.Table:
    """Which anchors occur in two documents, in the order they were sent."""
    blobs = table.column("keys").to_pylist()
    n = [len(b) // KEY_BYTES for b in blobs]
    raw = np.zeros((sum(n), 8), np.uint8)
    raw[:, :KEY_BYTES] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, KEY_BYTES)
    many = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=m) for b, m in zip(table.column("many").to_pylist(), n)])
    _, inverse = np.unique(raw.view("<u8").ravel(), return_inverse=True)
    shared = (np.bincount(inverse, 1 + many) > 1)[inverse]
    at = np.concatenate([[0], np.cumsum(n)])
    return pa.table({
        "block": table.column("block").cast(pa.int64()),
        "bucket": table.column("bucket").cast(pa.int64()),
        "n": pa.array(n, pa.int64()),
        "bits": pa.array([np.packbits(shared[i:j]).tobytes() for i, j in zip(at[:-1], at[1:])], pa.binary()),
    })


def _bits(replies: pa.Table) -> np.ndarray:
    order = np.argsort(replies.column("bucket").to_numpy())
    blobs, n = replies.column("bits").to_pylist(), replies.column("n").to_pylist()
    parts = [np.unpackbits(np.frombuffer(blobs[i], np.uint8), count=n[i]) for i in order]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)


def _send_units(n_buckets: int, length: int, gram: int):
    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        block = _Block(table, length, gram)
        block.only_shared(_bits(replies))
        u = block.units
        one, least, _ = block.distinct_units()
        size = u.hi[one] - u.lo[one] + length
        data = block.buf[np.repeat(u.lo[one] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        at = np.concatenate([[0], np.cumsum(size)])
        parts = split(buckets_of(u.key[one], n_buckets), n_buckets)
        cols = {
            "keys": u.key[one].astype("<u8"),
            "windows": (u.hi[one] - u.lo[one] + 1).astype(np.uint8),
            "docs": least.astype("<i8"),
        }
        out = {
            "bucket": pa.array([b for b, _, _ in parts], pa.int64()),
            "block": pa.array([table.column("block")[0].as_py() if table.num_rows else 0] * len(parts), pa.int64()),
        }
        out |= {name: pa.array([c[i:j].tobytes() for _, i, j in parts], pa.binary()) for name, c in cols.items()}
        out["data"] = pa.array([data[at[i] : at[j]].tobytes() for _, i, j in parts], pa.binary())
        return pa.table(out)

    return run


# ---- suffix order and earlier matches ----------------------------------------------------------


def suffix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Rank of the ``length`` bytes from each position in lexicographic order (equal strings, equal ranks),
    by prefix doubling from 8 bytes. The last length - 1 positions have none."""
    width = min(8, length)
    n = len(data) - width + 1
    word = np.zeros(n, np.uint64)
    for j in range(width):
        word = (word << np.uint64(8)) | data[j : n + j]
    rank = np.unique(word, return_inverse=True)[1]
    while width < length:
        step = min(width, length - width)
        n -= step
        pair = rank[:n].astype(np.uint64) << np.uint64(32) | rank[step : n + step].astype(np.uint64)
        rank = np.unique(pair, return_inverse=True)[1]
        width += step
    return rank


def previous_smaller(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Index of the nearest earlier element with a smaller value, not before ``first``; -1 if none.
    Pointers jump over elements that are not smaller, all at once."""
    at = np.arange(len(value)) - 1
    at[at < first] = -1
    todo = np.flatnonzero(at >= 0)
    while len(todo):
        todo = todo[value[at[todo]] >= value[todo]]
        nxt = at[at[todo]]
        at[todo] = nxt
        todo = todo[nxt >= 0]
    return at


def has_earlier_match(rank: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether each suffix has a longest previous factor of full length: in suffix order (ties by
    position) the previous or next suffix of a smaller document has the same rank."""
    order = np.argsort(rank, kind="stable")
    r, d = rank[order], doc[order]
    start = _first(r)
    run = np.repeat(start, np.diff(np.append(start, len(r))))
    found = previous_smaller(d, run) >= 0
    back = len(r) - 1 - np.repeat(np.append(start[1:], len(r)) - 1, np.diff(np.append(start, len(r))))
    found |= previous_smaller(d[::-1], back[::-1])[::-1] >= 0
    out = np.empty(len(r), bool)
    out[order] = found
    return out


def earlier_windows(data: np.ndarray, windows: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """Per unit (its bytes one after another in ``data``) a bit for each window that starts in a
    smaller document's unit too."""
    size = windows + length - 1
    at = np.cumsum(size) - size
    rank = suffix_ranks(data, length)
    unit = np.repeat(np.arange(len(windows)), windows)
    j = np.arange(len(unit)) - np.repeat(np.cumsum(windows) - windows, windows)
    by_doc = np.argsort(doc, kind="stable")  # the text of the suffix array: units in id order
    position = np.empty(len(doc), np.int64)
    position[by_doc] = np.arange(len(doc))
    order = np.argsort(position[unit], kind="stable")
    unit, j = unit[order], j[order]
    found = has_earlier_match(rank[at[unit] + j], doc[unit])
    bits = np.zeros(len(windows), np.uint64)
    np.bitwise_or.at(bits, unit[found], np.uint64(1) << j[found].astype(np.uint64))
    return bits


def _match(length: int):
    def run(table: pa.Table) -> pa.Table:
        col = {name: table.column(name).to_pylist() for name in ("keys", "windows", "docs", "data")}
        n = [len(b) // 8 for b in col["keys"]]
        key, doc = np.frombuffer(b"".join(col["keys"]), "<u8"), np.frombuffer(b"".join(col["docs"]), "<i8")
        windows = np.frombuffer(b"".join(col["windows"]), np.uint8).astype(np.int64)
        data = np.frombuffer(b"".join(col["data"]), np.uint8)
        size = windows + length - 1
        end = np.cumsum(size)
        content = np.empty(len(size), np.uint64)
        lo = 0
        while lo < len(size):
            a = int(end[lo] - size[lo])
            hi = max(lo + 1, int(np.searchsorted(end, a + tx.SLICE, "right")))
            content[lo:hi] = tx.PrefixHash(data[a : end[hi - 1]])(end[lo:hi] - size[lo:hi] - a, end[lo:hi] - a)
            lo = hi
        order = np.lexsort((doc, content, key))  # the first of each distinct unit has its smallest document
        k, c = key[order], content[order]
        new = np.ones(len(order), bool)
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        first = np.flatnonzero(new)
        of = np.empty(len(order), np.int64)
        of[order] = np.cumsum(new) - 1
        one = order[first]
        bits = np.zeros(len(one), np.uint64)
        group = _first(key[one])
        alone = np.repeat(np.diff(np.append(group, len(one))) == 1, np.diff(np.append(group, len(one))))
        several = np.flatnonzero(~alone)  # an anchor with one unit has no other suffix to meet
        lo = 0
        while lo < len(several):  # whole anchors, about a slice of text at a time
            total = np.cumsum(size[one[several[lo:]]])
            hi = lo + max(1, int(np.searchsorted(total, tx.SLICE, "right")))
            while hi < len(several) and key[one[several[hi]]] == key[one[several[hi - 1]]]:
                hi += 1
            part = several[lo:hi]
            s = size[one[part]]
            flat = data[np.repeat(end[one[part]] - s - (np.cumsum(s) - s), s) + np.arange(s.sum())]
            bits[part] = earlier_windows(flat, windows[one[part]], doc[one[part]], length)
            lo = hi
        answer = np.where(doc > doc[one][of], ALL, bits[of])
        at = np.concatenate([[0], np.cumsum(n)])
        return pa.table({
            "block": table.column("block").cast(pa.int64()),
            "bucket": table.column("bucket").cast(pa.int64()),
            "n": pa.array([-1] * len(n), pa.int64()),  # marks answers of step 3
            "bits": pa.array([answer[i:j].astype("<u8").tobytes() for i, j in zip(at[:-1], at[1:])], pa.binary()),
        })

    return run


def _cut(length: int, gram: int):
    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        block = _Block(table, length, gram)
        last = np.array([x < 0 for x in replies.column("n").to_pylist()], bool)
        block.only_shared(_bits(replies.filter(pa.array(~last))))
        u = block.units
        _, least, of = block.distinct_units()
        answers = replies.filter(pa.array(last))
        order = np.argsort(answers.column("bucket").to_numpy())
        blobs = answers.column("bits").to_pylist()
        bits = np.frombuffer(b"".join(blobs[i] for i in order), "<u8")
        mask = np.where(block.ids[u.row] > least[of], ALL, bits[of]) if len(of) else np.zeros(0, np.uint64)
        some = np.flatnonzero(mask)
        n = (u.hi - u.lo + 1)[some]
        j = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        gone = (np.repeat(mask[some], n) >> j.astype(np.uint64)) & np.uint64(1) > 0
        start = (np.repeat(u.lo[some], n) + j)[gone]
        row = np.repeat(u.row[some], n)[gone]
        new = np.ones(len(start), bool)
        new[1:] = (start[1:] > start[:-1] + length) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        begin, row = start[first], row[first]
        stop = start[np.append(first[1:], len(start)) - 1] + length if len(first) else begin
        edge = np.searchsorted(row, np.arange(len(block.ids) + 1))
        spans, kept = [], []
        for r in range(len(block.ids)):
            a, b = int(block.offs[r]), int(block.offs[r + 1])
            lo, hi = begin[edge[r] : edge[r + 1]].tolist(), stop[edge[r] : edge[r + 1]].tolist()
            spans.append([{"start": x - a, "end": y - a} for x, y in zip(lo, hi)])
            kept.append(b"".join(block.buf[x:y].tobytes() for x, y in zip([a, *hi], [*lo, b])))
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return pa.table({
            "doc_id": pa.array([None if i == NULL_ID else int(i) for i in block.ids], pa.int64()),
            "n_bytes": pa.array(np.diff(block.offs), pa.int64()),
            "spans": pa.array(spans, span),
            "kept": pa.array(kept, pa.binary()),
        })

    return run


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, spans (removed, byte offsets), kept (remaining bytes) of every row.

    A byte is removed if a string of ``length`` bytes over it starts in a document with a smaller doc_id;
    matches are judged on the input and never cross documents. Null text is empty. Rows that repeat a
    doc_id are no earlier documents of each other. A null doc_id comes after all others. Extra
    columns are not read; an empty table gives an empty result. ``length - gram`` is below 64.
    """
    if not gram < length < gram + 64:
        raise ValueError("gram < length < gram + 64 is needed")
    spark = docs.sparkSession
    blocks, n = with_blocks(docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NULL_ID))).alias("doc_id"), "text"))
    few = max(8, n // 4)
    sent = blocks.groupBy("block").applyInArrow(_send(few, length, gram), "bucket long, block long, keys binary, many binary")
    shared = scratch(spark, sent.groupBy("bucket").applyInArrow(_shared, "block long, bucket long, n long, bits binary"), "lpf-anchors")
    units = blocks.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(
        _send_units(max(8, 2 * n), length, gram), "bucket long, block long, keys binary, windows binary, docs binary, data binary"
    )
    answers = units.groupBy("bucket").applyInArrow(_match(length), "block long, bucket long, n long, bits binary")
    both = shared.unionAll(answers)
    return blocks.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(
        _cut(length, gram), "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    )


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """Digest of :func:`remove_repeats`: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return remove_repeats(docs).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
