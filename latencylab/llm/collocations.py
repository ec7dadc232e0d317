"""Collocations: phrases that occur much more often than their parts would by chance, per language.

Documents of one language are gathered into *shards* of about ``SHARD_BYTES`` of text, each a sequence of word ids (0 between
pieces) that is written once. A shard's FM-index works on word ids: the suffixes in the order of their first ``max_words``
symbols, their BWT, and the same of the reversed sequence. An interval of the one and its twin of the other stand for a phrase; the
symbols in the BWT interval are the words that extend it to the left (or, in the twin, to the right) with their counts, and each
gives the next interval pair. Sorting by so many symbols is enough: an extension to m + 1 words needs suffixes in order of m + 1 symbols.

Two rounds keep what shards send small. First each shard extends its words to the left and sends hashes of its words and pairs
with capped counts to buckets; a bucket answers one bit for each: frequent in all shards together, or not. Then each
shard extends frequent pairs to the right as long as every pair inside is frequent, and its counts are summed over shards. A hash
collision can only let a pair through to the exact second count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latencylab.llm import text as tx
from latencylab.llm.blocks import buckets_of, scratch, split

MIN_COUNT = 10
MIN_WORDS = 2
MAX_WORDS = 3
COVERED = 50  # percent of a phrase's count that a longer candidate around it needs to drop it
TOP = 2000
SHARD_BYTES = 8 << 20
HELD_BYTES = 24 << 20  # of texts held by a task over all languages
BUCKET_BYTES = 8 << 20
SENT_SHARE = 0.6  # bytes sent to buckets for a byte of text, about
U64 = np.uint64
# Bytes of a hash in a message. A bucket holds about as many keys at any size of the corpus, so the share of keys that collide
# (and are let through to the exact count) does not grow with it.
SHORT_BYTES = 4
SHORT = U64((1 << 8 * SHORT_BYTES) - 1)

# The bytes that end a piece, and those that stand between words of a piece.
PIECE_END = np.zeros(256, bool)
PIECE_END[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
BLANK = PIECE_END.copy()
BLANK[[0x20, 0x09]] = True


class FmIndex:
    """BWT of a sequence of symbols 0 .. size - 1 whose suffixes are in order of their first ``depth`` symbols."""

    def __init__(self, seq: np.ndarray, size: int, depth: int):
        n = len(seq)
        rank, length = seq.astype(np.int64), 1
        order = None
        while length < depth or order is None:
            key = rank * (int(rank.max(initial=0)) + 1)
            key[: max(0, n - length)] += rank[length:]
            order = np.argsort(key, kind="stable")
            length *= 2
            if length < depth:
                key = key[order]
                rank[order] = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        del rank, key
        self.size = size
        self.bwt = seq[order - 1].astype(np.int32)
        self.start = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=size))])
        self._by_symbol = None

    def rank(self, symbol: np.ndarray, before: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the BWT before a position."""
        n = len(self.bwt) + 1
        if self._by_symbol is None:
            self._by_symbol = self.bwt.astype(np.int64) * n + np.arange(len(self.bwt))
            self._by_symbol.sort()
        return np.searchsorted(self._by_symbol, symbol * n + before) - self.start[symbol]

    def extensions(self, lo: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of disjoint intervals (lo, count): (interval, symbol, count, count of smaller symbols) of every symbol in their
        BWT, separators excepted."""
        key = np.repeat(np.arange(len(lo)) * self.size, count)
        at = np.arange(len(key), dtype=np.int32)
        at += np.repeat((lo - (np.cumsum(count) - count)).astype(np.int32), count)
        key += self.bwt[at]
        del at
        key, n = np.unique(key, return_counts=True)
        whose, symbol = key // self.size, key % self.size
        smaller = np.cumsum(n) - n
        first = np.searchsorted(whose, np.arange(len(lo)))
        smaller -= smaller[np.minimum(first, max(0, len(key) - 1))][whose] if len(key) else 0
        word = symbol > 0
        return whose[word], symbol[word], n[word], smaller[word]


class Phrases:
    """Interval pairs of phrases of one length: words (one row each), count, start in the index and in its twin."""

    def __init__(self, words: np.ndarray, count: np.ndarray, lo: np.ndarray, twin: np.ndarray):
        self.words, self.count, self.lo, self.twin = words, count, lo, twin

    def __getitem__(self, pick: np.ndarray) -> Phrases:
        return Phrases(self.words[pick], self.count[pick], self.lo[pick], self.twin[pick])


class Shard:
    """Bidirectional index of one shard."""

    def __init__(self, seq: np.ndarray, size: int, depth: int):
        self.seq, self.size, self.depth = seq, size, depth
        self.index = FmIndex(seq, size, depth)
        self._reverse = None

    @property
    def reverse(self) -> FmIndex:
        if self._reverse is None:
            self._reverse = FmIndex(self.seq[::-1], self.size, self.depth)
        return self._reverse

    def single_words(self) -> Phrases:
        lo = self.index.start[1:-1]
        return Phrases(np.arange(1, self.size)[:, None], np.diff(self.index.start)[1:], lo, lo)

    def to_left(self, p: Phrases, wanted=None) -> Phrases:
        """Phrases one word longer at the left; ``wanted(words, count)`` tells which to go on with."""
        return self._extend(p, self.index, wanted, True)

    def to_right(self, p: Phrases, wanted=None) -> Phrases:
        return self._extend(p, self.reverse, wanted, False)

    def _extend(self, p: Phrases, index: FmIndex, wanted, left: bool) -> Phrases:
        own, other = (p.lo, p.twin) if left else (p.twin, p.lo)
        whose, symbol, count, smaller = index.extensions(own, p.count)
        parts = [symbol[:, None], p.words[whose]]
        words = np.concatenate(parts if left else parts[::-1], axis=1)
        if wanted is not None:
            keep = wanted(words, count)
            whose, symbol, count, smaller, words = whose[keep], symbol[keep], count[keep], smaller[keep], words[keep]
        own = index.start[symbol] + index.rank(symbol, own[whose])
        other = other[whose] + smaller
        return Phrases(words, count, *((own, other) if left else (other, own)))


def word_sequence(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str], int]:
    """(sequence of word ids from 1 with 0 before, between and after pieces, hash of each id, its word, number of words)."""
    buf, offs = tx.flat(texts)
    low = tx.LOWER[buf]
    starts, ends, first = tx.words(low, offs, BLANK)
    hashes, one, word = np.unique(tx.hash_spans(low, starts, ends), return_index=True, return_inverse=True)
    piece = np.searchsorted(np.flatnonzero(PIECE_END[low]), starts)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    breaks = np.flatnonzero((piece[1:] != piece[:-1]) | (row[1:] != row[:-1])) + 1
    seq = np.concatenate([[0], np.insert(word + 1, breaks, 0), [0]]).astype("<i4")
    names = [low[a:b].tobytes().decode() for a, b in zip(starts[one].tolist(), ends[one].tolist())]
    return seq, hashes, names, len(word)


def cut_text(data: bytes, limit: int, overlap: int) -> Iterator[tuple[bytes, int]]:
    """(part, weight) of a long text: parts of about ``limit`` bytes end with a piece. Where a piece is longer, parts
    overlap by ``overlap`` words, and the overlap comes again with weight -1, so that sums over the parts are right."""
    buf = np.frombuffer(data, np.uint8)
    at, size = 0, limit
    while len(buf) - at > size:
        window = buf[at : at + size]
        ends = np.flatnonzero(PIECE_END[window])
        if len(ends):
            yield data[at : at + int(ends[-1]) + 1], 1
            at, size = at + int(ends[-1]) + 1, limit
            continue
        starts, stops, _ = tx.words(window, np.array([0, len(window)]), BLANK)
        if len(starts) < overlap + 2:
            size *= 2
            continue
        stop, back = at + int(stops[-2]), at + int(starts[-1 - overlap]) if overlap else at + int(stops[-2])
        yield data[at:stop], 1
        if overlap:
            yield data[back:stop], -1
        at, size = back, limit
    yield data[at:], 1


class Sent:
    """What a shard asks buckets about: its pairs of words, then its words, in the order (bucket, hash) of ``order``."""

    def __init__(self, shard: Shard, lang: str, hashes: np.ndarray, n_buckets: int):
        self.words = shard.single_words()
        self.pairs = shard.to_left(self.words)
        raw = lang.encode()
        salt = tx.mix(np.frombuffer(raw.ljust(8 * (len(raw) // 8 + 1), b"\0"), "<u8").cumsum(dtype=U64)[-1:])
        first = tx.mix(hashes + salt)
        key = tx.mix(first[self.pairs.words[:, 0] - 1] + hashes[self.pairs.words[:, 1] - 1] * U64(0x9E3779B97F4A7C15))
        key = np.concatenate([key, tx.mix(first)])
        bucket = buckets_of(key, n_buckets)
        self.order = np.lexsort((key, bucket))
        self.key = key[self.order] & SHORT
        self.parts = split(bucket[self.order], n_buckets)

    def counts(self) -> np.ndarray:
        return np.concatenate([self.pairs.count, self.words.count])[self.order]

    def answered(self, bits: dict[int, bytes]) -> tuple[Phrases, Phrases]:
        """The pairs and the words that the buckets have found often enough."""
        often = np.zeros(len(self.order), bool)
        for b, x, y in self.parts:
            often[self.order[x:y]] = np.unpackbits(np.frombuffer(bits[b], np.uint8), count=y - x) > 0
        n = len(self.pairs.count)
        return self.pairs[often[:n]], self.words[often[n:]]


# Rows of kind "text" hold a shard in parts (small values are easier on the executors' memory than one large one), rows of kind "sent" its messages.
SHARDS = ("kind string, shard long, lang string, weight int, n_words long, part int, seq binary, hashes binary, names array<string>, "
          "bucket long, pairs binary, counts binary")
PART_TOKENS = 1 << 16
PART_WORDS = 1 << 14


def _batch(n: int, shard: int, lang: str, **columns) -> pa.RecordBatch:
    """``n`` rows of the table of shards; columns that are not given are null."""
    kinds = {"part": pa.int32(), "seq": pa.binary(), "hashes": pa.binary(), "names": pa.list_(pa.string()), "bucket": pa.int64(), "pairs": pa.binary(), "counts": pa.binary(),
             "weight": pa.int32(), "n_words": pa.int64(), "kind": pa.string(), "shard": pa.int64(), "lang": pa.string()}
    given = {"shard": [shard] * n, "lang": [lang] * n, **columns}
    names = [c.split()[0] for c in SHARDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(given[c], kinds[c]) if c in given else pa.nulls(n, kinds[c]) for c in names], names)


def write_shards(docs: DataFrame, max_words: int, shard_bytes: int, min_count: int, n_buckets: int) -> DataFrame:
    """Table of shards of (lang, text) with their messages; a shard holds texts of one language that one task read."""
    counted = "<u4" if min_count > 255 else "u1"

    def rows(number: int, lang: str, texts: list, weight: int):
        seq, hashes, names, n = word_sequence(pa.array(texts, pa.large_string()))
        pack = zstandard.ZstdCompressor(level=1)
        for part in range(max(-(-len(seq) // PART_TOKENS), -(-len(hashes) // PART_WORDS))):
            cut = lambda values, size: values[part * size : (part + 1) * size]  # noqa: E731, B023
            yield _batch(1, number, lang, kind=["text"], weight=[weight], n_words=[n if part == 0 else 0], part=[part], seq=[pack.compress(cut(seq, PART_TOKENS).tobytes())],
                         hashes=[cut(hashes, PART_WORDS).astype("<u8").tobytes()], names=[cut(names, PART_WORDS)])
        sent = Sent(Shard(seq, len(hashes) + 1, 2), lang, hashes, n_buckets)
        short = sent.key.astype("<u4")
        capped = (np.minimum(sent.counts(), min_count) if weight > 0 else np.zeros(len(sent.key))).astype(counted)
        for i in range(0, len(sent.parts), 32):
            some = sent.parts[i : i + 32]
            yield _batch(len(some), number, lang, kind=["sent"] * len(some), bucket=[b for b, *_ in some],
                         pairs=[short[x:y].tobytes() for _, x, y in some], counts=[capped[x:y].tobytes() for _, x, y in some])

    def run(batches):
        held: dict[str, list[str]] = {}
        size: dict[str, int] = {}
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                data = text.as_py() or ""
                n = len(data.encode())
                if n > shard_bytes:
                    for part, weight in cut_text(data.encode(), shard_bytes, max_words - 1):
                        number += 1
                        yield from rows(number, lang, [part.decode()], weight)
                    continue
                held.setdefault(lang, []).append(data)
                size[lang] = size.get(lang, 0) + n
                while size.get(lang, 0) >= shard_bytes or sum(size.values()) >= HELD_BYTES:
                    most = max(size, key=size.get)
                    del size[most]
                    number += 1
                    yield from rows(number, most, held.pop(most), 1)
        for lang in sorted(held):
            number += 1
            yield from rows(number, lang, held[lang], 1)

    return scratch(docs.sparkSession, docs.mapInArrow(run, SHARDS), "collocation-shards")


def _answer(min_count: int):
    """Of each message to a bucket one bit a pair: whether all messages together hold it often enough."""

    def run(table: pa.Table) -> pa.Table:
        blobs = table.column("pairs").to_pylist()
        counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), "<u4" if min_count > 255 else "u1")
        _, number = np.unique(np.frombuffer(b"".join(blobs), "<u4"), return_inverse=True)
        often = (np.bincount(number, counts) >= min_count)[number] if len(number) else np.zeros(0, bool)
        ends = np.cumsum([len(b) // SHORT_BYTES for b in blobs])
        bits = [np.packbits(often[e - len(b) // SHORT_BYTES : e]).tobytes() for b, e in zip(blobs, ends)]
        return pa.table({"shard": table.column("shard"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary())})

    return run


def _count(n_buckets: int, max_words: int):
    """Counts of the frequent words of a shard, its frequent pairs, and the longer phrases made of frequent pairs."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        join = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
        lang, weight, hashes = table.column("lang")[0].as_py(), table.column("weight")[0].as_py(), join("hashes", "<u8")
        seq = np.frombuffer(b"".join(zstandard.decompress(x) for x in table.column("seq").to_pylist()), "<i4")
        names = pa.concat_arrays([c.flatten() for c in table.column("names").chunks])
        shard = Shard(seq, len(hashes) + 1, max_words)
        bits = dict(zip(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist()))
        phrases, words = Sent(shard, lang, hashes, n_buckets).answered(bits)
        known = np.sort(phrases.words[:, 0] * shard.size + phrases.words[:, 1])

        def frequent(words, count):
            code = words[:, -2] * shard.size + words[:, -1]
            return known[np.minimum(np.searchsorted(known, code), len(known) - 1)] == code

        levels = [words, phrases]
        while levels[-1].words.shape[1] < max_words and len(phrases.count):
            phrases = shard.to_right(phrases, frequent)
            levels.append(phrases)
        joined = [pc.binary_join_element_wise(*[names.take(pa.array(x.words[:, j] - 1)) for j in range(x.words.shape[1])], " ") for x in levels]
        # one string for language and phrase (which has no line break) makes the rows to be summed small
        keys = pc.binary_join_element_wise(pa.concat_arrays(joined), pa.scalar(lang), "\n")
        return pa.table({"key": keys, "count": pa.array(np.concatenate([x.count for x in levels]) * weight, pa.int64())})

    return run


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, count) of all phrases of 1 to ``max_words`` words that occur ``min_count`` times, and
    (lang, n) with the number of words of each language."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(8, math.ceil(total * SENT_SHARE / BUCKET_BYTES))
    table = write_shards(docs, max_words, shard_bytes, min_count, n_buckets)
    sent = table.filter("kind = 'sent'").select("bucket", "shard", "pairs", "counts")
    answers = sent.groupBy("bucket").applyInArrow(_answer(min_count), "shard long, bucket long, bits binary")
    shards = table.filter("kind = 'text'").select("shard", "lang", "weight", "part", "seq", "hashes", "names")
    found = shards.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(_count(n_buckets, max_words), "key string, count long")
    counts = found.groupBy("key").agg(F.sum("count").alias("count")).filter(F.col("count") >= min_count)
    counts = counts.withColumn("phrase", F.substring_index("key", "\n", 1)).select(
        F.expr("substring(key, length(phrase) + 2)").alias("lang"), "phrase", F.size(F.split("phrase", " ")).alias("size"), "count")
    n = table.filter("kind = 'text'").groupBy("lang").agg(F.sum(F.col("n_words") * F.col("weight")).alias("n"))
    return scratch(spark, counts, "collocation-counts"), n


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, min_words: int = MIN_WORDS, max_words: int = MAX_WORDS,
                 covered: int = COVERED, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """lang, phrase, a, l, r, n, score of every candidate phrase that no longer candidate covers.

    Texts are lower-cased (A-Z), split at ``.,;:!?`` and line ends into pieces and those at blanks and tabs into words. A phrase of
    ``min_words`` to ``max_words`` words with a >= ``min_count`` occurrences is a candidate. A cut after its first words gives l and r,
    the counts of the two parts, and floor(1000000 a a / (l r)); the lowest-scoring cut counts, of equal ones the
    shortest first part. A candidate inside a longer one that has ``covered`` percent of its count is dropped.

    Null text is empty; a null lang is ``und``, together with that language itself. Rows that repeat count as often as they
    occur, ids are not read. Texts longer than a shard are cut between pieces; a single piece longer than that is cut with an overlap that is
    subtracted again. Empty tables give an empty result; extra columns are not read.
    """
    counts, n = phrase_counts(docs, min_count, max_words, shard_bytes)
    candidates = counts.filter(F.col("size") >= 2).select("lang", "phrase", "size", F.col("count").alias("a"), F.split("phrase", " ").alias("w"))
    part = lambda start, length: F.array_join(F.slice("w", start, length), " ")
    cuts = candidates.filter(F.col("size") >= min_words).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "size", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("size")).alias("right"))
    for side, name in (("left", "l"), ("right", "r")):
        cuts = cuts.join(counts.select("lang", F.col("phrase").alias(side), F.col("count").alias(name)), ["lang", side])
    big = lambda c: f"cast({c} as decimal(38,0))"
    score = F.expr(f"{big('1000000')} * {big('a')} * {big('a')} div ({big('l')} * {big('r')})")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "size", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    # a longer candidate around a phrase contains one that is a single word longer and at least as frequent
    inner = F.explode(F.array(part(F.lit(1), F.col("size") - 1), part(F.lit(2), F.col("size") - 1)))
    around = candidates.filter(F.col("size") > min_words).select("lang", inner.alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    best = best.join(around, ["lang", "phrase"], "left").filter(F.coalesce(100 * F.col("longer") < covered * F.col("a"), F.lit(True)))
    return best.join(n, "lang").select("lang", "phrase", "a", "b.l", "b.r", "n", "b.score")


def top_collocations(docs: DataFrame, top: int = TOP, **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the first ``top`` collocations of each language: by score, then a, both
    descending, then phrase in byte order; see :func:`collocations`."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = collocations(docs, **options).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


ORACLE = """
WITH piece AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
gram AS (
  SELECT lang, m, unnest([array_to_string(w[i:i + m - 1], ' ') for i in range(1, len(w) - m + 2)]) AS p
  FROM piece, (SELECT unnest([1, 2, 3]) AS m) WHERE len(w) >= m),
f AS (SELECT lang, m, p, count(*) AS c FROM gram GROUP BY ALL),
cand AS (SELECT * FROM f WHERE m >= 2 AND c >= 10),
cut AS (
  SELECT lang, p, m, c, k, array_to_string(string_split(p, ' ')[1:k], ' ') AS lp, array_to_string(string_split(p, ' ')[k + 1:m], ' ') AS rp
  FROM cand, (SELECT unnest([1, 2]) AS k) WHERE k < m),
scored AS (
  SELECT cut.*, x.c AS l, y.c AS r, (1000000::HUGEINT * cut.c * cut.c) // (x.c::HUGEINT * y.c) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.p = lp JOIN f y ON y.lang = cut.lang AND y.p = rp),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inner_ AS (
  SELECT lang, array_to_string(string_split(p, ' ')[i:i + 1], ' ') AS p, max(c) AS longer
  FROM cand, (SELECT unnest([1, 2]) AS i) WHERE m = 3 GROUP BY ALL),
n AS (SELECT lang, sum(c) AS n FROM f WHERE m = 1 GROUP BY 1)
SELECT best.lang, row_number() OVER (PARTITION BY best.lang ORDER BY score DESC, c DESC, best.p)::BIGINT AS rank, best.p AS phrase,
  c::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM best JOIN n USING (lang) LEFT JOIN inner_ ON inner_.lang = best.lang AND inner_.p = best.p
WHERE longer IS NULL OR 100 * longer < 50 * c
QUALIFY rank <= 2000
"""
