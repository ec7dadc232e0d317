"""Language-model scoring with a log-frequency Bloom filter.

Counts of words and word pairs come from all training documents. All pairs go into
a Bloom filter with their quantised log count: a pair of level q is entered as (pair, 1) ... (pair, q), so its
level is found by probing level after level until one is missing. The filter is broadcast, and
a text's probability is a mixture of the pair's dequantised count and the smoothed word probability.

Blocks of documents send buckets their distinct words (with counts) and pairs; a bucket owns a word, all
pairs that start with it and a slice of the filter, and answers each block with its words' counts and pair
totals. Pairs that start with a very common word (at least ``HEAVY`` of a bounded sample) are
spread over all buckets; only their totals, at most ``1 / HEAVY`` rows, pass through the driver. The filter grows with the corpus;
it is broadcast in parts of at most ``FILTER_BYTES``, with one pass over the documents for each part.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latencylab.llm import text as tx
from latencylab.llm.blocks import block_rows, buckets_of, scratch, split, with_blocks

MODULUS = 5
BLOCK_BYTES = 4 << 20
BITS_PER_ENTRY = 10
PROBES = 5
BASE = 1.5
FILTER_BYTES = 48 << 20
HEAVY = 1 / 1000
STEP = 1 << 17  # pairs or tokens worked on at a time, so that temporary arrays stay small
SAMPLE_DOCS = 2000
NULL_ID = np.iinfo(np.int64).max
U64 = np.uint64
LOW = U64((1 << 40) - 1)
END = tx.mix(np.array([0xE0D], U64))[0]
START = tx.mix(np.array([0x57A], U64))[0]
# interval of counts of each level, and the count a level stands for
_EDGES = np.unique(np.ceil(BASE ** np.arange(0, 92)).astype(np.float64))
LEVEL_COUNT = np.concatenate([[0.0], (_EDGES[:-1] + _EDGES[1:] - 1) / 2])


def levels(count: np.ndarray) -> np.ndarray:
    """Quantised log count: 0 for a count of 0, else its interval's number from 1 (a pair seen once)."""
    return np.searchsorted(_EDGES, count, "right")


def is_held_out(doc_id: int, modulus: int = MODULUS) -> bool:
    return doc_id != NULL_ID and zlib.crc32(str(doc_id).encode()) % modulus == 1


def pair_keys(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    return tx.mix(context + (word & LOW) * U64(0x9E3779B97F4A7C15))


def _bits(keys: np.ndarray, level: np.ndarray, size: np.ndarray):
    """Bit numbers of (pair, level) in a slice of ``size`` bits, one probe after another."""
    a = tx.mix(keys + level.astype(U64) * U64(0xD1342543DE82EF95))
    b = tx.mix(a) | U64(1)
    for i in range(PROBES):
        yield ((a + U64(i) * b) % size).astype(np.int64)


def build_slice(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Filter slice that holds the pairs with their levels; its size follows the number of entries."""
    q = levels(counts)
    size = max(64, -(-int(q.sum()) * BITS_PER_ENTRY // 8) * 8)
    mask = np.zeros(size, bool)
    for i in range(0, len(keys), STEP):
        part = q[i : i + STEP]
        level = np.arange(1, part.sum() + 1) - np.repeat(np.cumsum(part) - part, part)
        for at in _bits(np.repeat(keys[i : i + STEP], part), level, U64(size)):
            mask[at] = True
    return np.packbits(mask).tobytes()


class Filter:
    """Slices of some buckets, one after another."""

    def __init__(self, n_buckets: int, slices: dict[int, bytes]):
        self.size = np.zeros(n_buckets, U64)
        self.at = np.zeros(n_buckets, np.int64)
        parts = []
        held = 0
        for b, blob in sorted(slices.items()):
            self.size[b], self.at[b] = len(blob) * 8, held
            held += len(blob)
            parts.append(blob)
        self.data = np.frombuffer(b"".join(parts), np.uint8)

    def level(self, keys: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Highest level up to which every probe hits."""
        out = np.zeros(len(keys), np.int64)
        for i in range(0, len(keys), STEP):
            out[i : i + STEP] = self._level(keys[i : i + STEP], bucket[i : i + STEP])
        return out

    def _level(self, keys: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        todo = np.flatnonzero(self.size[bucket] > 0)
        level = 0
        while len(todo):
            level += 1
            hit = np.ones(len(todo), bool)
            b = bucket[todo]
            for at in _bits(keys[todo], np.full(len(todo), level), self.size[b]):
                hit &= (self.data[self.at[b] + (at >> 3)] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0
            todo = todo[hit]
            out[todo] = level
            if level >= len(LEVEL_COUNT) - 1:
                break
        return out


class _Tokens:
    """Tokens of a block: words and one end per document; the context of a document's first token is START."""

    def __init__(self, table: pa.Table):
        self.ids, texts = block_rows(table)
        tokens, size = [], []
        for _, _, buf, offs in tx.chunks(texts):
            h, first = tx.word_hashes(buf, offs)
            tokens.append(np.insert(h, first[1:], END))
            size.append(np.diff(first) + 1)
        self.token = np.concatenate(tokens) if tokens else np.zeros(0, U64)
        self.size = np.concatenate(size) if size else np.zeros(0, np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.context = np.roll(self.token, 1)
        if len(self.first):
            self.context[self.first] = START
        self.row = np.repeat(np.arange(len(self.ids)), self.size)
        self.held_out = np.fromiter((is_held_out(int(i)) for i in self.ids), bool, len(self.ids))
        self.words, self.word = np.unique(self.token, return_inverse=True)


def _pair_bucket(context: np.ndarray, keys: np.ndarray, heavy: np.ndarray, n: int) -> np.ndarray:
    """Bucket of a pair: that of its first word, or of the pair itself after a very common word."""
    return np.where(_is_heavy(context, heavy), buckets_of(tx.mix(keys), n), buckets_of(context, n))


def _is_heavy(word: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    return heavy[np.minimum(np.searchsorted(heavy, word), len(heavy) - 1)] == word


def _short(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])


def _long(blob: np.ndarray) -> np.ndarray:
    raw = np.zeros((len(blob) // 5, 8), np.uint8)
    raw[:, :5] = blob.reshape(-1, 5)
    return raw.view("<u8").ravel()


SENT = "bucket long, block long, words binary, counts binary, n_pairs binary, pairs binary, pair_counts binary, heavy binary, heavy_pairs binary, heavy_counts binary"


def _send(n_buckets: int, heavy: np.ndarray):
    def run(table: pa.Table) -> pa.Table:
        t = _Tokens(table)
        learn = ~t.held_out[t.row]
        counts = np.bincount(t.word[learn], minlength=len(t.words))
        common = _is_heavy(t.context, heavy)
        # pairs after other words, by their first word's number in the block
        use = learn & ~common
        number = np.searchsorted(t.words, t.context[use])
        pair, pair_count = np.unique(number.astype(U64) << U64(40) | (t.token[use] & LOW), return_counts=True)
        n_pairs = np.bincount((pair >> U64(40)).astype(np.int64), minlength=len(t.words))
        # pairs after very common words
        use = learn & common
        which = np.searchsorted(heavy, t.context[use])
        hpair, hcount = np.unique(which.astype(U64) << U64(40) | (t.token[use] & LOW), return_counts=True)
        hnum = (hpair >> U64(40)).astype(np.int64)
        hbucket = buckets_of(tx.mix(pair_keys(heavy[hnum], hpair & LOW)), n_buckets)
        order = np.argsort(hbucket, kind="stable")
        hnum, hword, hcount = hnum[order], _short(hpair & LOW)[order], hcount[order]
        hedge = np.searchsorted(hbucket[order], np.arange(n_buckets + 1))
        word_bucket = buckets_of(t.words, n_buckets)
        parts = {b: (i, j) for b, i, j in split(word_bucket, n_buckets)}
        at = np.concatenate([[0], np.cumsum(n_pairs)])
        short = _short(pair & LOW)
        rows = []
        for b in sorted(set(parts) | set(np.flatnonzero(np.diff(hedge)).tolist())):
            i, j = parts.get(b, (0, 0))
            p, q = int(at[i]), int(at[j])
            x, y = int(hedge[b]), int(hedge[b + 1])
            rows.append((
                t.words[i:j].astype("<u8").tobytes(), counts[i:j].astype("<u4").tobytes(), n_pairs[i:j].astype("<u4").tobytes(),
                short[p:q].tobytes(), pair_count[p:q].astype("<u4").tobytes(),
                hnum[x:y].astype("<u2").tobytes(), hword[x:y].tobytes(), hcount[x:y].astype("<u4").tobytes(), b,
            ))
        cols = list(zip(*rows)) if rows else [[]] * 9
        block = table.column("block")[0].as_py()
        names = ["words", "counts", "n_pairs", "pairs", "pair_counts", "heavy", "heavy_pairs", "heavy_counts"]
        out = {"bucket": pa.array(cols[8], pa.int64()), "block": pa.array([block] * len(rows), pa.int64())}
        return pa.table(out | {n: pa.array(c, pa.binary()) for n, c in zip(names, cols)})

    return run


OWNED = "kind string, block long, bucket long, blob binary, a double, b double"


def _own(heavy: np.ndarray):
    """Counts, pair totals and filter slice of one bucket."""

    def run(table: pa.Table) -> pa.Table:
        # one column at a time, so that no more than one is held as Python bytes
        join = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
        words, number = np.unique(join("words", "<u8"), return_inverse=True)
        count = np.bincount(number, join("counts", "<u4"), minlength=len(words)).astype(np.int64)
        pair = np.repeat(number, join("n_pairs", "<u4").astype(np.int64)).astype(U64) << U64(40)
        pair |= _long(join("pairs", "u1"))
        pair, at = np.unique(pair, return_inverse=True)
        pair_count = np.bincount(at, join("pair_counts", "<u4"), minlength=len(pair))
        del at
        context = (pair >> U64(40)).astype(np.int64)
        kinds = np.bincount(context, minlength=len(words))
        mass = np.bincount(context, LEVEL_COUNT[levels(pair_count)], minlength=len(words))
        hpair, at = np.unique(join("heavy", "<u2").astype(U64) << U64(40) | _long(join("heavy_pairs", "u1")), return_inverse=True)
        hcount = np.bincount(at, join("heavy_counts", "<u4"), minlength=len(hpair))
        del at
        hnum = (hpair >> U64(40)).astype(np.int64)
        keys = np.concatenate([pair_keys(words[context], pair & LOW), pair_keys(heavy[hnum], hpair & LOW)])
        blob = build_slice(keys, np.concatenate([pair_count, hcount]))
        del keys
        bucket = table.column("bucket")[0].as_py()
        answer = np.empty(len(number), [("c", "<i8"), ("t", "<f4"), ("m", "<f4")])
        answer["c"], answer["t"], answer["m"] = count[number], kinds[number], mass[number]
        rows = [("slice", None, bucket, blob, float(len(blob)), 0.0), ("total", None, bucket, None, float(count.sum()), float((count > 0).sum()))]
        n = 0
        for block, m in zip(table.column("block").to_pylist(), pc.binary_length(table.column("words")).to_pylist()):
            m //= 8
            rows.append(("answer", block, bucket, answer[n : n + m].tobytes(), 0.0, 0.0))
            n += m
        t = np.bincount(hnum, minlength=len(heavy))
        m = np.bincount(hnum, LEVEL_COUNT[levels(hcount)], minlength=len(heavy))
        rows += [("heavy", None, int(i), None, float(t[i]), float(m[i])) for i in np.flatnonzero(t)]
        kinds_of = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.float64(), pa.float64())
        return pa.table({name: pa.array(c, k) for name, c, k in zip(("kind", "block", "bucket", "blob", "a", "b"), zip(*rows), kinds_of)})

    return run


SCORED = "block long, row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _score(model, first_pass: bool):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        m = model.value
        t = _Tokens(table)
        order = np.argsort(answers.column("bucket").to_numpy())
        blobs = answers.column("blob").to_pylist()
        got = np.frombuffer(b"".join(blobs[i] for i in order), [("c", "<i8"), ("t", "<f4"), ("m", "<f4")])
        count, kinds, mass = got["c"].astype(float), got["t"].astype(float), got["m"].astype(float)
        common = np.flatnonzero(_is_heavy(t.words, m["heavy"]))
        number = np.searchsorted(m["heavy"], t.words[common])
        kinds[common], mass[common] = m["heavy_kinds"][number], m["heavy_mass"][number]
        word_p = (count + 0.5) / (m["n"] + 0.5 * (m["v"] + 1))
        n_docs = len(t.ids)
        # probe each distinct pair once
        keys, one, of = np.unique(pair_keys(t.context, t.token), return_index=True, return_inverse=True)
        bucket = _pair_bucket(t.context[one], keys, m["heavy"], m["n_buckets"])
        mine = (bucket >= m["lo"]) & (bucket < m["hi"])
        level = np.zeros(len(keys), np.int8)
        level[mine] = m["filter"].level(keys[mine], bucket[mine])
        del keys, one, bucket
        # the context of each token; START has the training documents as its count
        start = np.zeros(len(t.token), bool)
        start[t.first] = True
        before = np.roll(t.word, 1)
        begin = int(np.searchsorted(m["heavy"], START))
        score = np.zeros(len(t.token))
        for i in range(0, len(score), STEP):
            s = slice(i, i + STEP)
            pick = lambda values, at_start: np.where(start[s], at_start, values[before[s]])
            c_count = pick(count, m["docs"])
            c_kinds, c_mass = pick(kinds, m["heavy_kinds"][begin]), pick(mass, m["heavy_mass"][begin])
            p = word_p[t.word[s]]
            seen = np.minimum(LEVEL_COUNT[level[of[s]]], c_mass)
            back = np.maximum(0.0, c_count - c_mass) + c_kinds
            whole = c_mass + back
            with np.errstate(divide="ignore", invalid="ignore"):
                mixed = np.where(whole > 0, (seen + back * p) / whole, p)
            score[s] = np.where(mine[of[s]], np.log10(np.where(mixed > 0, mixed, p)), 0.0)
        del start, before, of
        total = lambda v: np.bincount(t.row, v, minlength=n_docs)
        known = total(count[t.word] > 0).astype(np.int64) if first_pass else np.zeros(n_docs, np.int64)
        base = total(np.log10(word_p)[t.word]) if first_pass else np.zeros(n_docs)
        return pa.table({
            "block": pa.array([table.column("block")[0].as_py() if n_docs else None] * n_docs, pa.int64()),
            "row": pa.array(np.arange(n_docs), pa.int64()),
            "doc_id": pa.array([None if i == NULL_ID else int(i) for i in t.ids], pa.int64()),
            "held_out": pa.array(t.held_out, pa.bool_()),
            "n_tokens": pa.array(t.size, pa.int64()),
            "n_known": pa.array(known, pa.int64()),
            "base_score": pa.array(base, pa.float64()),
            "score": pa.array(total(score), pa.float64()),
        })

    return run


def common_words(docs: DataFrame, n_docs: int) -> np.ndarray:
    """Hashes, ascending, of the words that are at least ``HEAVY`` of all tokens of a sample of about
    ``SAMPLE_DOCS`` documents (drawn by a hash of the id), and START. They decide only where pairs are counted."""

    def count(batches):
        for batch in batches:
            for _, _, buf, offs in tx.chunks(batch.column("text")):
                h, _ = tx.word_hashes(buf, offs)
                words, n = np.unique(np.append(h, np.full(len(offs) - 1, END)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n)], ["word", "n"])

    share = min(1.0, SAMPLE_DOCS / max(1, n_docs))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = docs.filter(drawn).select("text")
    counts = sample.mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.filter(F.col("n") >= max(2, HEAVY * total)).collect()
    return np.unique(np.append(np.array([r["word"] for r in rows], np.int64).view(U64), START))


def score_documents(docs: DataFrame, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs`` (doc_id, text).

    Trained on rows whose crc32(doc_id as text) mod 5 is not 1 (a null id is not held out). Tokens are the
    words and one end. ``base_score`` is the additive-smoothed word model, ``score`` the pair model with
    the word model as its back-off: p(w | v) = (c(v,w) + b(v) p(w)) / (m(v) + b(v)), m(v) the
    pairs' mass after v in the filter and b(v) the rest of v's count plus its number of pairs. Null text is empty (one token, the end).
    Rows that repeat count as often as they occur. Without training rows both scores are 0 for all texts.
    Extra columns are not read; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    heavy = common_words(docs, docs.count())
    blocks, n = with_blocks(docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NULL_ID))).alias("doc_id"), "text"), block_bytes=BLOCK_BYTES)
    n_buckets = max(8, n)
    sent = blocks.groupBy("block").applyInArrow(_send(n_buckets, heavy), SENT)
    owned = scratch(spark, sent.groupBy("bucket").applyInArrow(_own(heavy), OWNED), "lm-counts")
    total = owned.filter("kind = 'total'").agg(F.sum("a"), F.sum("b")).first()
    kinds, mass = np.zeros(len(heavy)), np.zeros(len(heavy))
    for r in owned.filter("kind = 'heavy'").groupBy("bucket").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect():
        kinds[r["bucket"]], mass[r["bucket"]] = r["a"], r["b"]
    train = docs.filter(~F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % MODULUS == 1, F.lit(False)))
    model = {"heavy": heavy, "heavy_kinds": kinds, "heavy_mass": mass, "n": float(total[0] or 0), "v": float(total[1] or 0), "docs": float(train.count()), "n_buckets": n_buckets}
    sizes = sorted((r["bucket"], r["a"]) for r in owned.filter("kind = 'slice'").select("bucket", "a").collect())
    parts, lo, held = [], 0, 0.0
    for bucket, size in sizes:
        if held and held + size > filter_bytes:
            parts.append((lo, bucket))
            lo, held = bucket, 0.0
        held += size
    parts.append((lo, n_buckets))
    answers = owned.filter("kind = 'answer'").select("block", "bucket", "blob")
    out = None
    for i, (lo, hi) in enumerate(parts):
        slices = owned.filter((F.col("kind") == "slice") & (F.col("bucket") >= lo) & (F.col("bucket") < hi)).select("bucket", "blob").collect()
        part = model | {"lo": lo, "hi": hi, "filter": Filter(n_buckets, {r["bucket"]: bytes(r["blob"]) for r in slices})}
        scored = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(spark.sparkContext.broadcast(part), i == 0), SCORED)
        out = scored if out is None else out.unionAll(scored)
    if len(parts) > 1:
        out = out.groupBy("block", "row", "doc_id", "held_out", "n_tokens").agg(*[F.sum(c).alias(c) for c in ("n_known", "base_score", "score")])
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(int(model["n"])).cast("long").alias("train_tokens"), "base_score", "score")
