"""Mixing sources to target weights by blocks of tokens.

Every source is a stream of words: its documents in a pseudorandom order, packed into blocks
of ``BLOCK`` words. A source's quota of blocks follows from its target; a multinomial draw deals the quota
out to output shards. The j-th slot of a source takes block ``perm(j mod n)`` of a pseudorandom
permutation of the source's block numbers, a new one for each pass, so a block is used again only after
all others. Slots and blocks are joined by (source, block number).

Offsets in a stream come from sums over (source, chunk) and a running sum within a chunk, and slots are
made per (source, shard), so a source with a third of all rows is spread over all tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from latencylab.llm import text as tx
from latencylab.llm.blocks import scratch

BLOCK = 64
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_REPEAT = 2
SHARD_BLOCKS = 4096
CHUNK_DOCS = 2_000
SEED = 20_240_607
WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code point order (null last) weigh ``weights`` in turn; their targets divide ``share`` of
    all words by weight and stop at ``max_repeat`` times the source's size, the excess shared again
    by weight until none is above. The common level is found by aggregates; sources are numbered by a
    distributed sort, so their number is not bounded by the driver.
    """
    spark = sizes.sparkSession
    ordered = scratch(
        spark,
        sizes.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()),
        "mix-sources",
    ).withColumns({"part": F.shiftright("at", 33), "row": F.col("at").bitwiseAND(F.lit((1 << 33) - 1))})
    parts = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))
    before = parts.select("part", F.coalesce(F.sum("rows").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    number = F.pmod(F.col("row") + F.col("before"), F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (number + 1).cast("int"))
    ranked = scratch(
        spark,
        ordered.join(before, "part").select("source", "source_size", weight.alias("w"), (max_repeat * F.col("source_size")).cast("double").alias("cap")),
        "mix-weights",
    )
    total = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:  # target = min(cap, level * weight); the level rises as sources reach their cap
        full = F.col("cap") <= level * F.col("w")
        capped, open_ = ranked.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("w")))).first()
        if not open_:
            break
        new = (total - (capped or 0.0)) / open_
        if new <= level * (1 + 1e-15):
            break
        level = new
    return ranked.select("source", "source_size", F.least("cap", level * F.col("w")).alias("target"), "w")


def _permute(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Pseudorandom permutation of 0..n-1 per key: a Feistel network on the next even power of two,
    walked until the value is below n."""
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2))) + 1).astype(np.int64) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x = index.astype(np.uint64)
    todo = np.ones(len(x), bool)
    while todo.any():
        left, right, m, h, k = x[todo] >> half[todo], x[todo] & mask[todo], mask[todo], half[todo], key[todo]
        for r in range(4):
            f = tx.mix(right ^ tx.mix(k + np.uint64(r + 1))) & m
            left, right = right, left ^ f
        x[todo] = (left << h) | right
        todo = x >= n.astype(np.uint64)
    return x.astype(np.int64)


def _draw(seed: int, n_shards: int):
    """Multinomial counts of each source's quota over the shards, with the first slot number of each."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {k: batch.column(k)[i].as_py() for k in ("source_key", "n_blocks", "quota")}
                rng = np.random.default_rng([seed, row["source_key"] & (2**63 - 1)])
                count = rng.multinomial(row["quota"], np.full(n_shards, 1.0 / n_shards))
                shard = np.flatnonzero(count)
                first = (np.cumsum(count) - count)[shard]
                fill = lambda v: pa.array(np.full(len(shard), v), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [fill(row["source_key"]), fill(row["n_blocks"]), pa.array(shard, pa.int64()), pa.array(first, pa.int64()), pa.array(count[shard], pa.int64())],
                    ["source_key", "n_blocks", "shard", "first", "count"],
                )

    return run


def _slots(seed: int):
    """One row per slot with its block number."""

    def run(batches):
        for batch in batches:
            key, n, shard, first, count = (batch.column(i).to_numpy() for i in range(5))
            if not len(key):
                continue
            slot = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())
            key, n, shard = np.repeat(key, count), np.repeat(n, count), np.repeat(shard, count)
            turn = slot // n
            k = tx.mix(key.astype(np.int64).view(np.uint64) ^ tx.mix(turn.astype(np.uint64) + np.uint64(seed)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.int64()) for x in (key, _permute(slot % n, n, k), shard, slot)], ["source_key", "block", "shard", "slot"]
            )

    return run


class Mix:
    """Plan of a mix over ``docs`` (doc_id, text, source): targets, document spans, slots."""

    def __init__(self, docs: DataFrame, weights=WEIGHTS, share: float = SHARE, block: int = BLOCK, max_repeat: int = MAX_REPEAT, seed: int = SEED, text: bool = False):
        spark = docs.sparkSession
        self.block = block
        key = F.when(F.col("source").isNull(), F.lit(-1)).otherwise(F.xxhash64("source"))  # null is a source of its own
        base = docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
            word_count(F.col("text")).alias("size"), *(["text"] if text else []),
        ).withColumn("source_key", key)
        n_chunks = max(1, -(-docs.count() // CHUNK_DOCS))
        order = F.xxhash64("doc_id", F.lit(seed))
        base = base.withColumns({"order": order, "chunk": F.pmod(F.xxhash64("order", F.lit(1)), F.lit(n_chunks))})
        sums = scratch(spark, base.groupBy("source_key", "chunk").agg(F.first("source").alias("source"), F.sum("size").alias("words")), "mix-chunks")
        self.targets = scratch(
            spark,
            source_targets(sums.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("words").alias("source_size")).select("source", "source_size"), weights, share, max_repeat)
            .withColumn("source_key", key).select("source_key", "source_size", "target"),
            "mix-targets",
        )
        offsets = sums.select(
            "source_key", "chunk",
            F.coalesce(F.sum("words").over(W.partitionBy("source_key").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("offset"),
        )
        run = W.partitionBy("source_key", "chunk").orderBy("order", "doc_id", "size", *(["text"] if text else [])).rowsBetween(W.unboundedPreceding, -1)
        spans = base.withColumn("inside", F.coalesce(F.sum("size").over(run), F.lit(0)))
        self.spans = (
            spans.join(offsets, ["source_key", "chunk"]).withColumn("start", F.col("offset") + F.col("inside"))
            .drop("order", "chunk", "offset", "inside")
        )
        n_blocks = F.ceil(F.col("source_size") / block).cast("long")
        passes = F.floor(F.col("target") / F.col("source_size")).cast("long")
        rest = F.round((F.col("target") - passes * F.col("source_size")) * n_blocks / F.col("source_size")).cast("long")
        quota = self.targets.filter("source_size > 0").select(
            "source_key", n_blocks.alias("n_blocks"), F.least(passes * n_blocks + F.least(rest, n_blocks), max_repeat * n_blocks).alias("quota")
        )
        wanted = quota.agg(F.sum("quota")).first()[0] or 0
        self.n_shards = max(1, -(-wanted // SHARD_BLOCKS))
        drawn = quota.mapInArrow(_draw(seed, self.n_shards), "source_key long, n_blocks long, shard long, first long, count long")
        self.slots = drawn.repartition("source_key", "shard").mapInArrow(_slots(seed), "source_key long, block long, shard long, slot long")

    def document_taken(self) -> DataFrame:
        """doc_id, size, source_size, target, taken of every row."""
        used = self.slots.groupBy("source_key", "block").agg(F.count(F.lit(1)).alias("uses"))
        b, end = F.lit(self.block), F.col("start") + F.col("size")
        spans = self.spans.drop("text")
        pieces = spans.filter("size > 0").select(
            "source_key", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((end - 1) / b))).alias("block")
        )
        overlap = F.least(end, (F.col("block") + 1) * b) - F.greatest(F.col("start"), F.col("block") * b)
        # merge joins: Spark would take the slots for as few rows as the sources they are drawn from, and broadcast them
        taken = pieces.join(used.hint("merge"), ["source_key", "block"]).groupBy("source_key", "start").agg(F.sum(overlap * F.col("uses")).alias("taken"))
        out = spans.join(taken.withColumn("filled", F.lit(True)), ["source_key", "start"], "left").join(self.targets, "source_key")
        return out.select(
            "doc_id", "size", "source_size", "target",
            F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("taken"),
        )

    def blocks(self) -> DataFrame:
        """The mixed corpus: shard, slot, source, block, n_words, doc_ids, text of every slot.
        A block's text is its documents' words in stream order, joined by one line break."""
        size = self.block

        def cut(batches):
            for batch in batches:
                out: list[tuple] = []
                start = batch.column("start").to_numpy()
                ids, keys, names = (batch.column(c).to_pylist() for c in ("doc_id", "source_key", "source"))
                for lo, hi, buf, offs in tx.chunks(batch.column("text")):
                    a, e, first = tx.words(buf, offs)
                    for r in range(lo, hi):
                        w0, w1 = int(first[r - lo]), int(first[r - lo + 1])
                        at = int(start[r])
                        while w0 < w1:
                            block = at // size
                            n = min(w1 - w0, (block + 1) * size - at)
                            piece = buf[a[w0] : e[w0 + n - 1]].tobytes().decode("utf-8", "replace")
                            out.append((keys[r], block, at, ids[r], n, piece, names[r]))
                            w0, at = w0 + n, at + n
                cols = list(zip(*out)) if out else [[]] * 7
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, kinds)], ["source_key", "block", "at", "doc_id", "n", "piece", "source"]
                )

        pieces = self.spans.filter("size > 0").select("source_key", "source", "doc_id", "start", "text").mapInArrow(
            cut, "source_key long, block long, at long, doc_id long, n long, piece string, source string"
        )
        packed = pieces.groupBy("source_key", "block").agg(
            F.sort_array(F.collect_list(F.struct("at", "doc_id", "n", "piece"))).alias("p"), F.first("source").alias("source")
        )
        return self.slots.join(packed.hint("merge"), ["source_key", "block"]).select(
            "shard", "slot", "source", "block",
            F.aggregate("p.n", F.lit(0).cast("long"), lambda s, x: s + x).alias("n_words"),
            F.col("p.doc_id").alias("doc_ids"), F.array_join("p.piece", "\n").alias("text"),
        )


def mix_documents(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of a mix of all ``docs``.

    Null text has size 0 and takes 0; a null source is the last source. An empty source has target 0.
    Repeated rows are documents of their own; a null doc_id stays null. Other columns are not read.
    An empty table gives an empty result. The draw depends only on ids, sizes and the seed.
    """
    return Mix(docs).document_taken()


def mixed_blocks(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The mixed blocks with their text; nulls, repeats and empty tables as in :func:`mix_documents`."""
    return Mix(docs, block=block, text=True).blocks()
