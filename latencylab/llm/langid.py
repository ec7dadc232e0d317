"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the average of the embeddings of its character n-grams (1 to 3 letters, with word
boundaries), hashed to ``DIM`` buckets; a linear softmax maps the average to languages. Both
layers are trained together by stochastic gradient descent in numpy on a bounded sample:
``PER_LANG`` labelled documents of each language at most (expected), chosen by a hash of the
id, whose bucket counts the executors compute. Scores are calibrated by temperature on a held-back fifth
of the sample, and a text whose calibrated score is below ``MIN_SCORE`` (no language has much more than
a third of the evidence) is rejected; a text that merely mixes two languages is not.

Prediction is a map over all whole texts; embedding and output layer collapse to one
weight per bucket and language, which is all that is shipped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from latencylab.llm import text as tx

DIM = 4096
EMBED = 16
PER_LANG = 800
MIN_SCORE = 0.35
UNKNOWN = "und"
_LETTER = np.zeros(0, bool)


def letters() -> np.ndarray:
    """Whether each code point is a letter (built once per worker)."""
    global _LETTER
    if not len(_LETTER):
        _LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    return _LETTER


def bucket_stream(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per run of rows: the buckets of all n-grams, and offsets of each row's n-grams (n + 1).

    n-grams are of lower-cased letters; a run of other characters is one boundary.
    """
    table = letters()
    for lo, hi, _, _ in tx.chunks(column, 1 << 18):
        rows = [(" " + (s or "").lower() + " ") for s in column.slice(lo, hi - lo).to_pylist()]
        size = np.fromiter(map(len, rows), np.int64, len(rows))
        code = np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = table[code]
        code = np.where(is_letter, code, np.uint32(32))
        keep = is_letter.copy()
        keep[1:] |= is_letter[:-1]  # one boundary after each word
        starts = np.concatenate([[0], np.cumsum(size)])
        keep[starts[:-1]] = True  # and one at the start
        c = code[keep].astype(np.uint64)
        at = np.concatenate([[0], np.cumsum(keep)])[starts]
        row = np.repeat(np.arange(len(rows)), np.diff(at))
        grams, owner = [], []
        for n in (1, 2, 3):
            m = len(c) - n + 1
            if m <= 0:
                continue
            h = np.full(m, n, np.uint64)
            for j in range(n):
                h = (h * np.uint64(0x100000001B3)) ^ c[j : m + j]
            ok = row[:m] == row[n - 1 :]
            if n == 1:
                ok = c != 32
            grams.append((tx.mix(h[ok]) % np.uint64(DIM)).astype(np.int32))
            owner.append(row[:m][ok])
        g, o = np.concatenate(grams), np.concatenate(owner)
        order = np.argsort(o, kind="stable")
        yield g[order], np.searchsorted(o[order], np.arange(len(rows) + 1))


@dataclass
class Model:
    """Languages, weight per bucket and language (embedding times output layer), bias, temperature."""

    langs: list[str] = field(default_factory=list)
    weight: np.ndarray = field(default_factory=lambda: np.zeros((DIM, 0)))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    temperature: float = 1.0
    min_score: float = MIN_SCORE

    def predict(self, column: pa.Array) -> tuple[list, list, list]:
        """lang_pred, score and rejected of each text."""
        langs, scores, rejected = [], [], []
        for grams, at in bucket_stream(column):
            n = np.diff(at)
            none = n == 0
            if self.langs:
                z = np.empty((len(n), len(self.langs)))
                for j in range(len(self.langs)):
                    s = np.concatenate([[0.0], np.cumsum(self.weight[grams, j], dtype=np.float64)])
                    z[:, j] = (s[at[1:]] - s[at[:-1]]) / np.maximum(n, 1) + self.bias[j]
                p = softmax(z / self.temperature)
                best = p.argmax(1)
                top = p[np.arange(len(n)), best]
            else:
                best, top, none = np.zeros(len(n), int), np.zeros(len(n)), np.ones(len(n), bool)
            langs += [UNKNOWN if e else self.langs[b] for e, b in zip(none.tolist(), best.tolist())]
            scores += np.where(none, 0.0, top).tolist()
            rejected += (none | (top < self.min_score)).tolist()
        return langs, scores, rejected


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def sgd(x: np.ndarray, y: np.ndarray, n_lang: int, epochs: int = 30, rate: float = 0.5, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Embedding-times-output weights and bias, by mini-batch SGD on both layers. ``x`` has
    rows of n-gram shares (they sum to 1), so ``x @ embedding`` is the averaged embedding."""
    rng = np.random.default_rng(seed)
    scale = 1.0 / np.sqrt(np.einsum("ij,ij->j", x, x) / len(x) + 1e-9)
    scale = np.minimum(scale, 1e3)
    emb = rng.normal(0, 0.1, (x.shape[1], EMBED))
    out = rng.normal(0, 0.1, (EMBED, n_lang))
    bias = np.zeros(n_lang)
    one_hot = np.eye(n_lang)[y]
    xs = x * (scale / np.sqrt(x.shape[1])).astype(np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for batch in np.array_split(rng.permutation(len(y)), max(1, len(y) // 32)):
            h = xs[batch] @ emb
            g = (softmax(h @ out + bias) - one_hot[batch]) / len(batch)
            g_out, g_h = h.T @ g, g @ out.T
            out -= step * g_out
            bias -= step * g.sum(0)
            emb -= step * (xs[batch].T @ g_h)
    return (scale[:, None] / np.sqrt(x.shape[1])) * (emb @ out), bias


def calibrate(z: np.ndarray, y: np.ndarray) -> float:
    """Temperature with the least log loss on held-back rows."""
    if not len(y):
        return 1.0
    grid = np.geomspace(0.05, 20, 80)
    loss = [-np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
    return float(max(grid[int(np.argmin(loss))], 0.1))


def train(labelled: DataFrame, per_lang: int = PER_LANG, min_score: float = MIN_SCORE) -> Model:
    """Model from (doc_id, text, lang) rows; null text or lang teaches nothing. The languages are
    all distinct values of lang. Only ``per_lang`` rows of each (expected number) are read
    into the driver, as bucket counts; without rows the model knows no language.
    """
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return Model(min_score=min_score)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_003)) / 1_000_003.0
    share = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, min(1.0, per_lang / n))])
    sample = rows.filter(draw < share[F.col("lang")]).select("doc_id", "lang", "text")

    def count(batches):
        for batch in batches:
            blobs = []
            for grams, at in bucket_stream(batch.column("text")):
                for a, b in zip(at[:-1], at[1:]):
                    c = np.bincount(grams[a:b], minlength=DIM)
                    nz = np.flatnonzero(c)
                    blobs.append(nz.astype("<u2").tobytes() + (c[nz] / max(1, b - a)).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column("lang"), pa.array(blobs, pa.binary())], ["doc_id", "lang", "x"]
            )

    got = sample.mapInArrow(count, "doc_id long, lang string, x binary").collect()
    langs = sorted(counts)
    x = np.zeros((len(got), DIM), np.float32)
    got.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"], r["lang"], r["x"]))
    for i, r in enumerate(got):
        n = len(r["x"]) // 6
        x[i, np.frombuffer(r["x"][: 2 * n], "<u2")] = np.frombuffer(r["x"][2 * n :], "<f4")
    y = np.array([langs.index(r["lang"]) for r in got], int)
    used = x.sum(1) > 0
    x, y = x[used], y[used]
    if not len(y):
        return Model(min_score=min_score)
    held = np.arange(len(y)) % 5 == 4
    weight, bias = sgd(x[~held], y[~held], len(langs))
    return Model(langs, weight.astype(np.float32), bias, calibrate(x[held] @ weight + bias, y[held]), min_score)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` with lang_pred, score and rejected.

    Null text or text without a letter: ``und``, score 0, rejected. A model without languages gives
    the same for every row. Columns of ``docs`` with these names are replaced; only the text is read.
    """
    docs = docs.drop("lang_pred", "score", "rejected")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            found = shared.value.predict(batch.column("text"))
            kinds = (pa.string(), pa.float64(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                batch.columns + [pa.array(v, t) for v, t in zip(found, kinds)], batch.schema.names + ["lang_pred", "score", "rejected"]
            )

    schema = StructType(list(docs.schema.fields)).add("lang_pred", "string").add("score", "double").add("rejected", "boolean")
    return docs.mapInArrow(run, schema)


def recognised(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that are not rejected, with their own columns unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            rejected = shared.value.predict(batch.column("text"))[2]
            yield batch.filter(pa.array([not x for x in rejected], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column, modulus: int = 3) -> Column:
    """crc32 of the id as text, modulo ``modulus``, is 1 (a null id is not held out)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == 1, F.lit(False))


def lang_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected; learnt from the rows that are not held out."""
    model = train(docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    out = identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
