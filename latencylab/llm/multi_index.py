"""Approximate nearest neighbours by cosine with an inverted multi-index.

Unit vectors are cut into two halves; each half has its own codebook (k-means on a bounded sample), and a *cell* is a
pair of centroids. A query walks the cells in the order of the sum of its two half distances: a heap over the two sorted
distance lists gives the next pair. It stops after ``depth`` non-empty cells, and the entries of the visited cells are
reranked by their exact cosine on the original vectors.

``depth`` is measured, not chosen: a bounded sample of rows is searched by brute force, and the depth is the one at
which ``RECALL`` of their true neighbours lie in visited cells. Every row is indexed.

Cells are laid out in *regions* of about ``REGION_BYTES`` of vectors; a cell that is larger spans several regions. A query sends
one row to each region that holds a cell it visits, so regions join with queries by equality.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from latencylab.llm.blocks import scratch

K = 5
EVERY = 50
CENTROIDS = 64  # of each half, at most; fewer in small tables (about ROWS_PER_CELL rows a cell)
ROWS_PER_CELL = 16
SAMPLE = 20_000  # rows (expected) on which the codebooks are trained
CALIBRATION = 250  # rows (expected) searched by brute force to find the depth
RECALL = 0.97
ROUNDS = 12
REGION_BYTES = 64 << 20
REGIONS = 48  # at least, where a region keeps REGION_ROWS rows
REGION_ROWS = 1024
QUERY_BYTES = 32 << 20  # of queries in one group
SCORES = 1 << 21  # scores computed at once
NULL_ID = np.iinfo(np.int64).max


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of an array column, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(-1, dim)


def _unit(vectors: np.ndarray) -> np.ndarray:
    top = np.abs(vectors).max(axis=1, keepdims=True)  # scaled first, so that squares neither overflow nor vanish
    scaled = vectors / top
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def k_means(points: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Lloyd's rounds from a random start; a centroid without points stays where it is."""
    rng = np.random.default_rng(seed)
    start = np.unique(points, axis=0)
    centres = start[rng.choice(len(start), min(k, len(start)), replace=False)]
    for _ in range(ROUNDS):
        near = _distances(points, centres).argmin(axis=1)
        n = np.bincount(near, minlength=len(centres))
        sums = np.stack([np.bincount(near, points[:, j], len(centres)) for j in range(points.shape[1])], axis=1) if points.shape[1] else np.zeros((len(centres), 0))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def _distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, every point to every centre."""
    return (points**2).sum(axis=1)[:, None] - 2 * points @ centres.T + (centres**2).sum(axis=1)[None]


class Codebooks:
    """The two codebooks of unit vectors."""

    def __init__(self, sample: np.ndarray, centroids: int):
        self.dim = sample.shape[1]
        self.cut = self.dim // 2
        self.books = [k_means(sample[:, : self.cut], centroids, 1), k_means(sample[:, self.cut :], centroids, 2)]
        self.n_cells = len(self.books[0]) * len(self.books[1])

    def half_distances(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _distances(units[:, : self.cut], self.books[0]), _distances(units[:, self.cut :], self.books[1])

    def cells(self, units: np.ndarray) -> np.ndarray:
        a, b = self.half_distances(units)
        return a.argmin(axis=1) * len(self.books[1]) + b.argmin(axis=1)

    def walk(self, a: np.ndarray, b: np.ndarray) -> Iterator[int]:
        """All cells, nearest first by the sum of the half distances ``a`` and ``b`` of one query. A pair enters the heap
        through its left neighbour, a pair of the first column through the one above it, so each enters once."""
        rows, cols = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        x, y, width = a[rows].tolist(), b[cols].tolist(), len(b)
        rows, cols = rows.tolist(), cols.tolist()
        heap = [(x[0] + y[0], 0, 0)]
        while heap:
            _, i, j = heapq.heappop(heap)
            yield rows[i] * width + cols[j]
            if j + 1 < width:
                heapq.heappush(heap, (x[i] + y[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(x):
                heapq.heappush(heap, (x[i + 1] + y[0], i + 1, 0))


def _top(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each group: larger score, then smaller id."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    first = np.searchsorted(g, g, "left")
    return order[np.arange(len(g)) - first < k]


def _best(queries: np.ndarray, entries: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, entry, score) of the k best entries of each query (unit vectors), a block of scores at a time."""
    out = []
    step = max(1, SCORES // max(1, len(entries)))
    for lo in range(0, len(queries), step):
        score = queries[lo : lo + step] @ entries.T
        if len(entries) > k:
            # slack: rounding differs between products, the exact score decides later
            least = np.partition(score, len(entries) - k, axis=1)[:, len(entries) - k] - 1e-12
            q, e = np.nonzero(score >= least[:, None])
        else:
            q, e = (x.ravel() for x in np.indices(score.shape))
        s = np.einsum("ij,ij->i", queries[lo + q], entries[e])
        keep = _top(q, s, ids[e], k)
        out.append((lo + q[keep], e[keep], s[keep]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(id, vec) of the rows that take part, and their dimension: the most common length of a vector (ties: the smaller)."""
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"))
    rows = rows.filter(F.col("vec").isNotNull()).filter(finite & F.exists("vec", lambda x: x != 0))
    common = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    dim = common["dim"] if common else 1
    return rows.filter(F.size("vec") == dim), dim


class MultiIndex:
    """The index of a table of vectors; see :func:`nearest_neighbours` for odd rows."""

    def __init__(self, rows: DataFrame, dim: int, k: int = K, centroids: int = CENTROIDS, sample: int = SAMPLE,
                 calibration: int = CALIBRATION, recall: float = RECALL, region_bytes: int = REGION_BYTES):
        self.spark, self.dim, self.k = rows.sparkSession, dim, k + 1
        # of equal vectors a query needs the k + 1 smallest ids at most (one of them may be its own row)
        place = F.row_number().over(Window.partitionBy("vec").orderBy(F.col("id").asc_nulls_last()))
        self.entries = scratch(self.spark, rows.withColumn("place", place).filter(F.col("place") <= self.k).select("id", "vec"), "ann-entries")
        self.n = self.entries.count()
        centroids = max(1, min(centroids, int(math.sqrt(self.n / ROWS_PER_CELL))))
        drawn = self._draw(sample, 11)
        self.books = Codebooks(_unit(drawn), centroids) if len(drawn) else None
        if self.books is None:
            return
        self.index = scratch(self.spark, self._with_cells(), "ann-index")
        self.count = np.zeros(self.books.n_cells, np.int64)
        for r in self.index.groupBy("cell").count().collect():
            self.count[r["cell"]] = r["count"]
        self.depth = self._calibrate(self._draw(calibration, 12), recall)
        self._lay_out(max(1, min(region_bytes // (8 * dim), max(REGION_ROWS, self.n // REGIONS))))

    def _draw(self, wanted: int, salt: int) -> np.ndarray:
        """About ``wanted`` vectors, drawn by a hash of the row (all, where there are no more)."""
        share = int(min(1.0, wanted / max(1, self.n)) * (1 << 30))
        got = self.entries.filter(F.pmod(F.xxhash64("id", "vec", F.lit(salt)), F.lit(1 << 30)) < share).select("vec").toArrow()
        if not got.num_rows and self.n:
            got = self.entries.select("vec").limit(1).toArrow()
        return _vectors(got.column("vec"), self.dim)

    def _with_cells(self) -> DataFrame:
        books, dim = self.spark.sparkContext.broadcast(self.books), self.dim

        def run(batches):
            for batch in batches:
                cell = books.value.cells(_unit(_vectors(batch.column("vec"), dim)))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64())], [*batch.schema.names, "cell"])

        kind = self.entries.schema["vec"].dataType.simpleString()
        return self.entries.mapInArrow(run, f"id long, vec {kind}, cell long")

    def _calibrate(self, drawn: np.ndarray, recall: float) -> int:
        """The number of non-empty cells after which a query has met ``recall`` of its true neighbours, from an exact
        search of the drawn rows (a pass over the index that returns the best of each task)."""
        units = _unit(drawn)
        shared, dim, k = self.spark.sparkContext.broadcast(units), self.dim, self.k

        def search(batches):
            held = None
            for batch in batches:
                entries, ids = _unit(_vectors(batch.column("vec"), dim)), batch.column("id").fill_null(int(NULL_ID)).to_numpy()
                q, e, s = _best(shared.value, entries, ids, k)
                new = [q, ids[e], s, batch.column("cell").to_numpy()[e]]
                held = new if held is None else [np.concatenate(x) for x in zip(held, new)]
                keep = _top(held[0], held[2], held[1], k)
                held = [x[keep] for x in held]
            if held is not None:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], ["q", "id", "score", "cell"])

        found = self.index.mapInArrow(search, "q long, id long, score double, cell long")
        place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "id"))
        wanted: dict[int, list[int]] = {}
        for r in found.withColumn("place", place).filter((F.col("place") > 1) & (F.col("place") <= k)).select("q", "cell").collect():
            wanted.setdefault(r["q"], []).append(r["cell"])
        a, b = self.books.half_distances(units)
        depths = []
        for q, cells in wanted.items():
            at = {c: i for i, c in enumerate(c for c in self.books.walk(a[q], b[q]) if self.count[c])}
            depths += [at[c] + 1 for c in cells]
        return int(np.quantile(depths, recall, method="higher")) if depths else 1

    def _lay_out(self, region_rows: int) -> None:
        """First region of each cell and how many it spans: runs of cells of about ``region_rows`` rows."""
        self.region, self.spans = np.zeros(len(self.count), np.int64), np.ones(len(self.count), np.int64)
        now, held = 0, 0
        for c, n in enumerate(self.count.tolist()):
            if held and held + n > region_rows:
                now, held = now + 1, 0
            self.region[c] = now
            if n > region_rows:
                self.spans[c] = -(-n // region_rows)
                now, held = now + int(self.spans[c]), 0
            else:
                held += n
        self.n_regions = now + 1

    def _send(self, queries: DataFrame, blocks: int) -> DataFrame:
        """One row per query and region: (region, block, id, mark, vec, cells)."""
        books, dim, k, depth = self.books, self.dim, self.k, self.depth
        shared = self.spark.sparkContext.broadcast((books, self.count, self.region, self.spans))

        def run(batches):
            books, count, region, spans = shared.value
            for batch in batches:
                a, b = books.half_distances(_unit(_vectors(batch.column("vec"), dim)))
                row, to, cells = [], [], []
                for i in range(batch.num_rows):
                    visited, met = [], 0
                    for c in books.walk(a[i], b[i]):
                        if count[c]:
                            visited.append(c)
                            met += int(count[c])
                            if len(visited) >= depth and met >= k:
                                break
                    at: dict[int, list[int]] = {}
                    for c in visited:
                        for r in range(int(region[c]), int(region[c] + spans[c])):
                            at.setdefault(r, []).append(c)
                    for r, its in at.items():
                        row.append(i)
                        to.append(r)
                        cells.append(np.array(its, "<u2").tobytes())
                sent = batch.take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(cells, pa.binary()), *sent.columns], ["region", "cells", *sent.schema.names])

        schema = f"region long, cells binary, id long, mark long, vec {queries.schema['vec'].dataType.simpleString()}"
        return queries.mapInArrow(run, schema).withColumn("block", F.pmod(F.xxhash64("id", "mark"), F.lit(blocks)))

    def search(self, queries: DataFrame) -> DataFrame:
        """(id, mark, found): of each query (id, mark, vec; one row each) the k + 1 nearest rows, own row included, as an
        array of (place, vec_id, score, same), ``same`` where the vectors are equal."""
        dim, k = self.dim, self.k
        blocks = max(1, math.ceil(queries.count() * 8 * dim / QUERY_BYTES))
        layout = self.spark.sparkContext.broadcast((self.region, self.spans))
        kind = self.index.schema["vec"].dataType.simpleString()

        def place_in_region(batches):
            for batch in batches:
                region, spans = layout.value
                cell, spread = batch.column("cell").to_numpy(), batch.column("spread").to_numpy()
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(region[cell] + spread % spans[cell])], ["id", "vec", "cell", "region"])

        spread = F.pmod(F.xxhash64("id", "vec"), F.lit(1 << 30)).alias("spread")
        placed = self.index.select("id", "vec", "cell", spread).mapInArrow(place_in_region, f"id long, vec {kind}, cell long, region long")
        placed = placed.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))

        def rerank(entries: pa.Table, sent: pa.Table) -> pa.Table:
            order = np.argsort(entries.column("cell").to_numpy(), kind="stable")
            cell = entries.column("cell").to_numpy()[order]
            vectors = _vectors(entries.column("vec"), dim)[order]
            ids = entries.column("id").fill_null(int(NULL_ID)).to_numpy()[order]
            asked = _vectors(sent.column("vec"), dim)
            units, q_units = (_unit(x) if len(x) else x for x in (vectors, asked))
            lists = [np.frombuffer(x, "<u2") for x in sent.column("cells").to_pylist()]
            visits = np.concatenate(lists) if lists else np.zeros(0, np.uint16)
            visitor = np.repeat(np.arange(len(lists)), [len(x) for x in lists])[np.argsort(visits, kind="stable")]
            visits = np.sort(visits, kind="stable")
            got = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
            for c in np.unique(visits).tolist():
                who = visitor[np.searchsorted(visits, c, "left") : np.searchsorted(visits, c, "right")]
                lo, hi = np.searchsorted(cell, c, "left"), np.searchsorted(cell, c, "right")
                q, e, s = _best(q_units[who], units[lo:hi], ids[lo:hi], k)
                got.append((who[q], lo + e, s))
            q, e, s = (np.concatenate(x) for x in zip(*got))
            keep = _top(q, s, ids[e], k)
            q, e = q[keep], e[keep]
            whole = np.einsum("ij,ij->i", q_units[q], units[e])
            same = (asked[q] == vectors[e]).all(axis=1)
            return pa.table({
                "id": sent.column("id").combine_chunks().take(pa.array(q)), "mark": sent.column("mark").combine_chunks().take(pa.array(q)),
                "vec_id": pa.array(ids[e], pa.int64()), "score": pa.array(np.where(same, 1.0, np.clip(whole, -1, 1))), "same": pa.array(same),
            })

        found = placed.groupBy("region", "block").cogroup(self._send(queries, blocks).groupBy("region", "block")).applyInArrow(
            rerank, "id long, mark long, vec_id long, score double, same boolean")
        place = F.row_number().over(Window.partitionBy("id", "mark").orderBy(F.desc("score"), "vec_id"))
        best = found.withColumn("place", place).filter(F.col("place") <= k)
        return best.groupBy("id", "mark").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score", "same"))).alias("found"))


def nearest_neighbours(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = EVERY, k: int = K, **index) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found of every row whose id is divisible by ``every``, by cosine in
    double precision, ties to the smaller id.

    Candidates are all rows but the query's own row (another row with the same id is a candidate like any other). Vectors that are null, empty, zero or hold a
    null or non-finite component take no part, nor do those whose length is not the most common one. A row with a null id is
    never a query; as a neighbour its vec_id is null and it comes last among ties. Equal vectors score exactly 1. Where there are fewer than
    k candidates all are returned; an empty table gives an empty result. Extra columns are not read.

    Equal vectors are searched once and of their rows only the k + 1 smallest ids are indexed, which no answer can tell from all.
    """
    rows, dim = usable(vectors, id_col, vec_col)
    index_ = MultiIndex(rows, dim, k, **index)
    asked = rows.filter(F.pmod("id", F.lit(every)) == 0).withColumn("mark", F.xxhash64("vec"))
    if index_.books is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    one = asked.groupBy("vec", "mark").agg(F.min("id").alias("id"))
    found = index_.search(one.select("id", "mark", "vec")).withColumnRenamed("id", "first")
    of = asked.join(one.select("vec", "mark", F.col("id").alias("first")), ["mark", "vec"])
    joined = of.select("id", "mark", "first").join(found, ["first", "mark"])
    own = F.array_position(F.transform("found", lambda x: x["same"] & (x["vec_id"] == F.col("id"))), F.lit(True))
    others = F.slice(F.filter("found", lambda x, i: i + 1 != own), 1, k)
    out = joined.select(F.col("id").alias("query_id"), F.posexplode(others).alias("pos", "one"))
    vec_id = F.when(F.col("one.vec_id") != int(NULL_ID), F.col("one.vec_id"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), vec_id.alias("vec_id"), F.col("one.score").alias("score"))
