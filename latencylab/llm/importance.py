"""Importance resampling of documents towards a target distribution of hashed n-grams.

Every text's n-grams fall into ``BUCKETS`` buckets. The corpus' and the target's bucket counts give each
bucket a gain (its scaled log ratio); a document's weight is the mean gain of its n-grams, and weight plus Gumbel noise
drawn from its id is its score: the highest scores are a sample without replacement whose odds follow the weights.

In a task the n-grams of a slice of text are *interned*: an open-addressed NumPy table, keyed by xxhash64 and verified
byte for byte, maps every occurrence to the slot of its n-gram. CRC-32 runs once per distinct n-gram; the slot keeps its bucket and its
count, and an occurrence's slot id gathers its gain.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latencylab.llm import text as tx
from latencylab.llm.blocks import scratch
from latencylab.operators.scan import null_safe_join, sequence_number

BUCKETS = 10_000
MAX_N = 1
MIN_WORDS = 20
PERCENT = 10
SEED = "2024"
STEP = 1 << 19  # occurrences interned together
U64 = np.uint64

# The bytes between words after lower-casing (everything in ASCII but digits and letters).
BLANK = np.zeros(256, bool)
BLANK[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

# The five primes of xxHash64.
P1, P2, P3 = U64(0x9E3779B185EBCA87), U64(0xC2B2AE3D27D4EB4F), U64(0x165667B19E3779F9)
P4, P5 = U64(0x85EBCA77C2B2AE63), U64(0x27D4EB2F165667C5)


class Spans:
    """Byte spans of a buffer that can be hashed and compared many at a time."""

    def __init__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.buf, self.starts, self.size = buf, starts, ends - starts
        padded = np.concatenate([buf, np.zeros(8, np.uint8)])
        self.eights = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))

    def bytes(self, i: int) -> bytes:
        return self.buf[self.starts[i] : self.starts[i] + self.size[i]].tobytes()

    def lane(self, which: np.ndarray, offset: int) -> np.ndarray:
        """Up to eight bytes of each span from ``offset`` on, bytes after its end as zero."""
        left = np.clip(self.size[which] - offset, 0, 8).astype(U64)
        value = self.eights[np.minimum(self.starts[which] + offset, len(self.buf))]
        return value & np.where(left >= 8, ~U64(0), (U64(1) << (left * U64(8) & U64(63))) - U64(1))

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        same = self.size[a] == self.size[b]
        longest = int(self.size[a].max(initial=0))
        offset = 0
        todo = np.flatnonzero(same)
        while offset < longest and len(todo):
            same[todo] = self.lane(a[todo], offset) == self.lane(b[todo], offset)
            offset += 8
            todo = todo[same[todo] & (self.size[a[todo]] > offset)]
        return same

    def hashes(self) -> np.ndarray:
        """xxhash64 of every span: spans below 32 bytes together, longer ones by the library."""
        out = np.empty(len(self.starts), U64)
        short = np.flatnonzero(self.size < 32)
        out[short] = self._short(short)
        for i in np.flatnonzero(self.size >= 32).tolist():
            out[i] = xxhash.xxh64_intdigest(self.bytes(i))
        return out

    def _short(self, which: np.ndarray) -> np.ndarray:
        size = self.size[which]
        acc = P5 + size.astype(U64)
        for offset in (0, 8, 16):
            on = np.flatnonzero(size >= offset + 8)
            if len(on):
                lane = _rotate(self.lane(which[on], offset) * P2, 31) * P1
                acc[on] = _rotate(acc[on] ^ lane, 27) * P1 + P4
        done = size & ~7
        on = np.flatnonzero(size - done >= 4)
        if len(on):
            value = self.eights[self.starts[which[on]] + done[on]] & U64(0xFFFFFFFF)
            acc[on] = _rotate(acc[on] ^ value * P1, 23) * P2 + P3
            done[on] += 4
        for _ in range(3):
            on = np.flatnonzero(done < size)
            if not len(on):
                break
            acc[on] = _rotate(acc[on] ^ self.buf[self.starts[which[on]] + done[on]].astype(U64) * P5, 11) * P1
            done[on] += 1
        acc = (acc ^ (acc >> U64(33))) * P2
        acc = (acc ^ (acc >> U64(29))) * P3
        return acc ^ (acc >> U64(32))


def _rotate(x: np.ndarray, by: int) -> np.ndarray:
    return (x << U64(by)) | (x >> U64(64 - by))


class Interned:
    """Open-addressed table of the distinct spans: the bucket and the count of each slot, and the slot of each span."""

    def __init__(self, spans: Spans, buckets: int):
        keys = spans.hashes()
        n = len(keys)
        mask = (1 << max(4, (2 * n).bit_length())) - 1
        owner = np.full(mask + 1, -1, np.int64)  # the span that a slot was claimed by
        self.slot = np.zeros(n, np.int64)
        todo, at = np.arange(n), (keys & U64(mask)).astype(np.int64)
        while len(todo):
            free = owner[at] < 0
            owner[at[free]] = todo[free]
            holder = owner[at]
            same = keys[holder] == keys[todo]
            check = np.flatnonzero(same & (holder != todo))
            same[check] = spans.equal(holder[check], todo[check])
            self.slot[todo[same]] = at[same]
            todo, at = todo[~same], (at[~same] + 1) & mask
        self.count = np.bincount(self.slot, minlength=mask + 1)
        self.bucket = np.zeros(mask + 1, np.int64)
        for s in np.flatnonzero(owner >= 0).tolist():
            self.bucket[s] = zlib.crc32(spans.bytes(owner[s])) % buckets


def ngram_spans(column: pa.Array, max_n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, words per row, text, starts, ends, row of each n-gram) of runs of rows: the text holds each
    row's lower-cased words joined by one space, so that an n-gram is a span of it."""
    for lo, hi, buf, offs in tx.chunks(column):
        low = tx.LOWER[buf]
        starts, ends, first = tx.words(low, offs, BLANK)
        size = ends - starts
        joined = np.cumsum(size + 1) - (size + 1)
        keep = np.zeros(len(low) + 1, bool)
        keep[: len(low)] = ~BLANK[low]
        plain = np.full(int((size + 1).sum()), 0x20, np.uint8)
        plain[np.arange(len(plain)) != np.repeat(joined + size, size + 1)] = low[keep[:-1]]
        row = np.repeat(np.arange(hi - lo), np.diff(first))
        begins, stops, rows = [], [], []
        for n in range(1, max_n + 1):
            ok = np.flatnonzero(row[n - 1 :] == row[: len(row) - n + 1]) if len(row) >= n else np.zeros(0, np.int64)
            begins.append(joined[ok])
            stops.append((joined + size)[ok + n - 1])
            rows.append(row[ok])
        yield np.arange(lo, hi), np.diff(first), plain, np.concatenate(begins), np.concatenate(stops), np.concatenate(rows)


def bucket_counts(texts: DataFrame, max_n: int = MAX_N, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences of each bucket over all texts (column ``text``); the driver receives one row per bucket."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, plain, starts, ends, _ in ngram_spans(batch.column("text"), max_n):
                for i in range(0, len(starts), STEP):
                    table = Interned(Spans(plain, starts[i : i + STEP], ends[i : i + STEP]), buckets)
                    np.add.at(total, table.bucket, table.count)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) of each of the B buckets."""
    b = len(corpus)
    whole, aim = float(corpus.sum() + b), float(target.sum() + b)
    return np.array([math.floor(1000 * math.log((t + 1) * whole / ((s + 1) * aim))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, max_n: int = MAX_N) -> DataFrame:
    """doc_id, n_words, n_features, weight of every row: the floored mean gain of its n-grams (none: 0)."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for rows, n_words, plain, starts, ends, row in ngram_spans(batch.column("text"), max_n):
                total, n = np.zeros(len(rows), np.int64), np.bincount(row, minlength=len(rows))
                for i in range(0, len(starts), STEP):
                    table = Interned(Spans(plain, starts[i : i + STEP], ends[i : i + STEP]), len(shared.value))
                    np.add.at(total, row[i : i + STEP], shared.value[table.bucket[table.slot]])
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(int(rows[0]), len(rows)), pa.array(n_words, pa.int64()), pa.array(n, pa.int64()), pa.array(weight, pa.int64())],
                    ["doc_id", "n_words", "n_features", "weight"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: str = SEED,
             max_n: int = MAX_N, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs`` (doc_id, text), drawn towards ``target`` (text).

    Of the N documents with at least ``min_words`` words, the floor(percent N / 100) highest scores are drawn, ties to the smaller
    doc_id; their rank counts from 1, that of the others is null. The score adds Gumbel noise from sha256(seed:doc_id) to the weight.

    Null text has no words, weight 0. A null doc_id draws its noise from the empty string and is last among ties. Rows that
    repeat an id share its noise and are drawn one by one. Without target texts all gains follow the corpus alone; an empty
    table gives an empty result. Extra columns are not read.

    Scores are integers in a range that the logarithms bound, so the documents above each score are counted by one row per
    score; only drawn rows are numbered within their score, in blocks (a score that very many rows share is no hot task).
    """
    spark = docs.sparkSession
    gain = gains(bucket_counts(docs, max_n, buckets), bucket_counts(target, max_n, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = scratch(spark, weigh(docs, gain, max_n).withColumn("score", (F.col("weight") + noise).cast("long")), "importance")
    fit = scored.filter(F.col("n_words") >= min_words)
    per_score = fit.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    above = per_score.select("score", (F.sum("n").over(Window.orderBy(F.desc("score"))) - F.col("n")).alias("above"))
    wanted = fit.count() * percent // 100
    reach = scratch(spark, above.filter(F.col("above") < wanted), "importance-scores")
    near = null_safe_join(fit, reach, ["score"]).withColumn("order", F.coalesce(F.col("doc_id"), F.lit(2**63 - 1)))
    drawn = sequence_number(near, ["score"], ["order", "n_features", "weight"], "place").withColumn("rank", F.col("above") + F.col("place"))
    drawn = drawn.select("doc_id", "n_features", "weight", "score", F.when(F.col("rank") <= wanted, F.col("rank")).alias("rank"))
    least = reach.agg(F.min("score")).first()[0]
    rest = scored.filter((F.col("n_words") < min_words) | (F.col("score") < least if least is not None else F.lit(True)))
    return drawn.unionAll(rest.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))


ORACLE = """
WITH RECURSIVE bits AS (
  SELECT i::UBIGINT AS i, list_reduce(list_prepend(i::UBIGINT, [0::UBIGINT FOR k IN range(8)]),
    lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v FROM range(256) r(i)),
tab AS (SELECT list(v ORDER BY i) AS t FROM bits),
dw AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
bw AS (
  SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM benchmark),
occ AS (SELECT doc_id, unnest(w) AS w FROM dw),
vocab AS (SELECT DISTINCT w FROM (SELECT w FROM occ UNION ALL SELECT w FROM bw)),
crc AS (
  SELECT w, hex(encode(w)) AS h, 1 AS p, 4294967295::UBIGINT AS c FROM vocab
  UNION ALL
  SELECT w, h, p + 2, xor(c >> 8, t[(xor(c % 256, ('0x' || substr(h, p, 2))::UBIGINT) + 1)::INT]) FROM crc, tab WHERE p < length(h)),
bucket AS (SELECT w, (xor(c, 4294967295::UBIGINT) % 10000)::BIGINT AS b FROM crc WHERE p > length(h)),
s AS (SELECT b, count(*) AS s FROM occ JOIN bucket USING (w) GROUP BY 1),
t AS (SELECT b, count(*) AS t FROM bw JOIN bucket USING (w) GROUP BY 1),
gain AS (
  SELECT i AS b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM occ) + 10000)::DOUBLE
    / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bw) + 10000)::DOUBLE))) AS g
  FROM range(10000) r(i) LEFT JOIN s ON s.b = i LEFT JOIN t ON t.b = i),
doc AS (
  SELECT doc_id, count(*) AS n, floor(sum(g) / count(*)) AS weight FROM occ JOIN bucket USING (w) JOIN gain USING (b) GROUP BY 1),
scored AS (
  SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::UBIGINT::DOUBLE + 0.5) / 4294967296))))::BIGINT AS score
  FROM documents d LEFT JOIN doc USING (doc_id)),
ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END::BIGINT AS rank
FROM scored s LEFT JOIN ranked USING (doc_id)
"""
