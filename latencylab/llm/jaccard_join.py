"""Exact Jaccard self-join of documents in the metric space of their shingle sets.

Jaccard distance is a metric, so a set within ``EPS`` of another lies, for every pivot, within
``EPS`` of the other's distance to that pivot.

1. Documents with equal sets are one class, represented by its smallest doc_id.
2. Pivots. Each shingle gets the size class of its document frequency (packed exchange between
   blocks and buckets); two linked sets share one of their ``n - ceil(0.75 n) + 1`` rarest shingles. Among
   the classes that hold a shingle in that position, the one with the least hash is the shingle's pivot;
   a class belongs to the regions of the pivots of its rarest shingles. Linked classes have a
   common region; a class without a shared rare shingle has no link and leaves.
3. Regions are first joined over each class's nearest pivot in hash order only; regions whose
   members are then all in one component have nothing left to learn. The others are joined with
   all their members.
4. A region is joined recursively: distances to a few pivots form Voronoi cells; a member also goes to
   the cell of each pivot no farther than its own plus 2 EPS (the window in which a
   partner can lie), and members whose windows hold only their own component are dropped. Small cells are compared pair by
   pair, exactly. A region of more than ``MAX_REGION`` members is first cut into cells by Spark, with
   its pivots' sets joined to the members; cells that do not shrink are joined chunk by chunk.

Links found are real links, enough of them to span each component (a group of n near copies
gives about n links, not n squared).
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latencylab.llm import text as tx
from latencylab.llm.blocks import block_rows, buckets_of, scratch, split, with_blocks
from latencylab.llm.components import components

PERCENT = 75
SHINGLE = 5
EPS = 1 - PERCENT / 100
SLACK = 1e-9
SMALL = 16  # members compared pair by pair
CELL_PIVOTS = 8
MAX_REGION = 4000
KEY_BYTES = 5
NULL_ID = np.iinfo(np.int64).max
Sets = Callable[[pa.Array], Iterator[np.ndarray]]  # ascending distinct 64-bit tokens of each text
MEMBER = "doc_id long, n long, h1 long, h2 long, rare array<long>, shingles binary"


# ---- sets, frequency classes, rare shingles ----------------------------------------------------


def _block_sets(table: pa.Table, make: Sets) -> tuple[np.ndarray, list[np.ndarray], list[int], np.ndarray, np.ndarray]:
    """Ids, sets, positions of the first of each distinct set, and the two set hashes."""
    ids, texts = block_rows(table)
    sets = list(make(texts))
    h = np.array([[s.sum(dtype=np.uint64), tx.mix(s ^ np.uint64(0x5BF03635)).sum(dtype=np.uint64)] if len(s) else [0, 0] for s in sets], np.uint64).reshape(-1, 2)
    seen: dict[tuple, int] = {}
    for i, s in enumerate(sets):
        if len(s):
            seen.setdefault((len(s), int(h[i, 0]), int(h[i, 1])), i)
    return ids, sets, list(seen.values()), h[:, 0].view(np.int64), h[:, 1].view(np.int64)


def _block_keys(sets: list[np.ndarray], first: list[int], n_buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of a block's distinct sets with their counts, in ascending order (so by bucket)."""
    every = np.concatenate([sets[i] for i in first]) if first else np.zeros(0, np.uint64)
    keys, counts = np.unique(every, return_counts=True)
    return keys, counts, buckets_of(keys, n_buckets)


def _short(keys: np.ndarray) -> bytes:
    """The low bytes of each key; with the bucket they stand for the key when only a filter needs it."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]).tobytes()


def _send(n_buckets: int, make: Sets):
    def run(table: pa.Table) -> pa.Table:
        _, sets, first, _, _ = _block_sets(table, make)
        keys, counts, bucket = _block_keys(sets, first, n_buckets)
        parts = split(bucket, n_buckets)
        many = np.minimum(counts, 255).astype(np.uint8)
        return pa.table({
            "bucket": pa.array([b for b, _, _ in parts], pa.int64()),
            "block": pa.array([table.column("block")[0].as_py()] * len(parts), pa.int64()),
            "keys": pa.array([_short(keys[i:j]) for _, i, j in parts], pa.binary()),
            "vals": pa.array([many[i:j].tobytes() if many[i:j].max() > 1 else b"" for _, i, j in parts], pa.binary()),
        })

    return run


def _count(table: pa.Table) -> pa.Table:
    """Size class of each key's document frequency: 0 for one document, else its bit length."""
    blobs = table.column("keys").to_pylist()
    n = [len(b) // KEY_BYTES for b in blobs]
    raw = np.zeros((sum(n), 8), np.uint8)
    raw[:, :KEY_BYTES] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, KEY_BYTES)
    counts = np.concatenate([np.frombuffer(v, np.uint8) if v else np.ones(m, np.uint8) for v, m in zip(table.column("vals").to_pylist(), n)])
    _, inverse = np.unique(raw.view("<u8").ravel(), return_inverse=True)
    df = np.bincount(inverse, counts).astype(np.int64)
    level = np.where(df > 1, np.ceil(np.log2(df + 1)), 0).astype(np.uint8)[inverse]
    at = np.concatenate([[0], np.cumsum(n)])
    return pa.table({
        "block": table.column("block").cast(pa.int64()),
        "bucket": table.column("bucket").cast(pa.int64()),
        "levels": pa.array([level[i:j].tobytes() for i, j in zip(at[:-1], at[1:])], pa.binary()),
    })


def _rare(n_buckets: int, make: Sets, percent: int):
    def run(table: pa.Table, replies: pa.Table) -> pa.Table:
        ids, sets, first, h1, h2 = _block_sets(table, make)
        keys, _, _ = _block_keys(sets, first, n_buckets)
        order = np.argsort(replies.column("bucket").to_numpy())
        blobs = replies.column("levels").to_pylist()
        level = np.frombuffer(b"".join(blobs[i] for i in order), np.uint8)
        rare: list = [None] * len(ids)
        kept: list = [None] * len(ids)
        for i in first:
            s = sets[i]
            of = level[np.searchsorted(keys, s)]
            take = len(s) - -(-percent * len(s) // 100) + 1
            chosen = np.lexsort((s, of))[:take]
            chosen = s[chosen[of[chosen] > 0]]
            if len(chosen):
                rare[i] = chosen.view(np.int64)
                kept[i] = s.astype("<u8").tobytes()
        return pa.table({
            "doc_id": pa.array(ids, pa.int64()),
            "n": pa.array([len(s) for s in sets], pa.int64()),
            "h1": pa.array(h1, pa.int64()),
            "h2": pa.array(h2, pa.int64()),
            "rare": pa.array(rare, pa.list_(pa.int64())),
            "shingles": pa.array(kept, pa.binary()),
        })

    return run


# ---- regions ----------------------------------------------------------------------------------


class _Groups:
    """Union-find that records the links it used."""

    def __init__(self, n: int):
        self.parent = list(range(n))
        self.links: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def link(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.links.append((i, j))

    def labels(self, members) -> np.ndarray:
        return np.array([self.find(i) for i in members], np.int64)


class _Region:
    """Sets of one region as dense token numbers; shingles of a single member are left out (they
    cannot be shared), as are members that hold too few shared ones to have a link."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent = percent
        self.eps = 1 - percent / 100
        self.n = np.array([len(s) for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), self.n)
        _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = count[token] > 1
        self.token, self.owner = token[shared], owner[shared]
        self.at = np.searchsorted(self.owner, np.arange(len(sets) + 1))
        self.flag = np.zeros(len(count), bool)
        self.alive = np.flatnonzero(100 * np.diff(self.at) >= percent * self.n)

    def tokens(self, i: int) -> np.ndarray:
        return self.token[self.at[i] : self.at[i + 1]]

    def shared(self, pivot: int, members: np.ndarray, flat: np.ndarray, edges: np.ndarray) -> np.ndarray:
        """Shingles each member shares with the pivot."""
        self.flag[self.tokens(pivot)] = True
        c = np.concatenate([[0], np.cumsum(self.flag[flat])])
        self.flag[self.tokens(pivot)] = False
        return c[edges[1:]] - c[edges[:-1]]

    def is_link(self, shared: np.ndarray, i: int, members: np.ndarray) -> np.ndarray:
        return 100 * shared >= self.percent * (self.n[i] + self.n[members] - shared)

    def join(self) -> list[tuple[int, int]]:
        groups = _Groups(len(self.n))
        stack = [self.alive]
        while stack:
            m = stack.pop()
            if len(m) < 2:
                continue
            label = groups.labels(m)
            if (label == label[0]).all():
                continue
            size = self.at[m + 1] - self.at[m]
            edges = np.concatenate([[0], np.cumsum(size)])
            flat = self.token[np.arange(edges[-1]) + np.repeat(self.at[m] - edges[:-1], size)]
            if len(m) <= SMALL:
                self._compare(m, flat, edges, groups, len(m))
                continue
            k = min(CELL_PIVOTS, len(m))
            dist = np.ones((len(m), k))
            pivot = 0
            done = np.zeros(len(m), bool)
            for j in range(k):  # each further pivot is the member farthest from those before
                done[pivot] = True  # all links of a pivot are found here
                s = self.shared(m[pivot], m, flat, edges)
                dist[:, j] = 1 - s / (self.n[m[pivot]] + self.n[m] - s)
                for x in np.flatnonzero(self.is_link(s, m[pivot], m)):
                    groups.link(int(m[pivot]), int(m[x]))
                pivot = int(dist[:, : j + 1].min(1).argmax())
            live = self._learnable(m, dist, groups) & ~done
            near = dist.min(1)
            cells = [live & (dist[:, j] <= near + 2 * self.eps + SLACK) for j in range(k)]
            if sum(c.sum() for c in cells) <= 1.25 * live.sum():
                stack += [m[c] for c in cells]
            else:  # these pivots do not separate the sets: other pivots of the rest, as one cell
                stack.append(m[live])
        return groups.links

    def _compare(self, m, flat, edges, groups, rows: int) -> None:
        """Each member against the later ones."""
        for x in range(rows - 1):
            lo = x + 1
            s = self.shared(m[x], m[lo:], flat[edges[lo] :], edges[lo:] - edges[lo])
            for y in np.flatnonzero(self.is_link(s, m[x], m[lo:])):
                groups.link(int(m[x]), int(m[lo + y]))

    def _learnable(self, m, dist, groups) -> np.ndarray:
        """Members that may have a partner outside their component: by the triangle inequality a
        partner is within eps for every pivot. Only the largest component's members are tested."""
        label = groups.labels(m)
        values, counts = np.unique(label, return_counts=True)
        main = label == values[counts.argmax()]
        if main.all():
            return np.zeros(len(m), bool)
        others = dist[~main]
        lo, hi = others.min(0) - self.eps - SLACK, others.max(0) + self.eps + SLACK
        maybe = main & (dist >= lo).all(1) & (dist <= hi).all(1)
        if len(others) <= 256:
            for x in np.flatnonzero(maybe):
                maybe[x] = bool((np.abs(others - dist[x]) <= self.eps + SLACK).all(1).any())
        return ~main | maybe


def region_links(sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links (positions) that span the components of the given sets."""
    sets = [np.asarray(s, np.uint64) for s in sets]
    return _Region(sets, percent).join() if len(sets) > 1 else []


def _join_regions(percent: int):
    def run(table: pa.Table) -> pa.Table:
        ids = table.column("cls").to_numpy()
        order = np.argsort(ids, kind="stable")
        blobs = table.column("shingles")
        links = region_links([np.frombuffer(blobs[int(i)].as_buffer(), "<u8") for i in order], percent)
        ids = ids[order]
        return pa.table({"a": pa.array([ids[i] for i, _ in links], pa.int64()), "b": pa.array([ids[j] for _, j in links], pa.int64())})

    return run


def _cells(percent: int):
    """Distances of members to their region's pivots: links to them, and the cells they go to."""
    eps = 1 - percent / 100

    def run(batches):
        for batch in batches:
            rows = batch.to_pydict()
            out: list[tuple] = []
            for region, cls, blob, pivots in zip(rows["region"], rows["cls"], rows["shingles"], rows["pivots"]):
                x = np.frombuffer(blob, "<u8")
                dist = []
                for p in pivots:
                    y = np.frombuffer(p["shingles"], "<u8")
                    s = len(np.intersect1d(x, y, assume_unique=True))
                    union = len(x) + len(y) - s
                    dist.append(1 - s / union)
                    if 100 * s >= percent * union and cls != p["cls"]:
                        out.append((None, None, cls, p["cls"]))
                near = min(dist)
                out += [(region, j, cls, None) for j, d in enumerate(dist) if d <= near + 2 * eps + SLACK]
            cols = list(zip(*out)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["region", "cell", "cls", "to"])

    return run


def _sized(members: DataFrame) -> DataFrame:
    return members.groupBy("region").agg(F.count(F.lit(1)).alias("size"))


def _join_members(members: DataFrame, reps: DataFrame, percent: int, max_region: int, name: str) -> DataFrame:
    """Links (a, b) of all regions; ``members`` has (region, cls), distinct."""
    spark = members.sparkSession
    found = None
    depth = 0
    while True:
        sized = members.join(_sized(members), "region")
        small = sized.filter((F.col("size") > 1) & (F.col("size") <= max_region)).select("region", "cls").join(reps, "cls")
        links = small.groupBy("region").applyInArrow(_join_regions(percent), "a long, b long")
        found = links if found is None else found.unionAll(links)
        large = sized.filter(F.col("size") > max_region)
        if large.isEmpty():
            return found
        depth += 1
        many = F.lit(2)  # expected pivots are twice that: a member goes to as many cells at most
        draw = F.pmod(F.xxhash64("cls", F.lit(depth)), F.lit(1 << 40)) / float(1 << 40)
        pivots = (
            large.filter(draw < 2 * many / F.col("size")).join(reps, "cls")
            .groupBy("region").agg(F.sort_array(F.collect_list(F.struct("cls", "shingles"))).alias("pivots"))
        )
        step = large.join(reps, "cls").join(pivots, "region", "left").select(
            "region", "cls", "shingles", F.coalesce("pivots", F.array(F.struct("cls", "shingles"))).alias("pivots")
        )
        cut = scratch(spark, step.mapInArrow(_cells(percent), "region long, cell long, cls long, to long"), name)
        near = cut.filter("to is not null").select(F.col("cls").alias("a"), F.col("to").alias("b"))
        found = found.unionAll(near)
        label = components(near, name=name).withColumnRenamed("id", "cls")
        cells = (
            cut.filter("to is null")
            .select(F.xxhash64("region", "cell", F.lit(depth)).alias("next"), "region", "cls")
            .join(label, "cls", "left").withColumn("label", F.coalesce("component", "cls"))
        )
        state = cells.groupBy("next").agg(F.count(F.lit(1)).alias("cell_size"), F.min("label").alias("lo"), F.max("label").alias("hi"), F.first("region").alias("region"))
        state = state.filter("lo <> hi").join(_sized(members), "region")
        shrunk = F.col("cell_size") <= 0.8 * F.col("size")
        state = state.select("next", (shrunk | (F.col("cell_size") <= max_region)).alias("cut"), "cell_size")
        cells = cells.select("next", "cls").join(state, "next")
        # cells that pivots do not separate: all pairs of chunks, each a region of its own
        n_chunks = F.ceil(2 * F.col("cell_size") / max_region)
        chunk = F.pmod(F.xxhash64("cls", F.lit("chunk")), n_chunks)
        paired = cells.filter(~F.col("cut")).select(
            "next", "cls", chunk.alias("c"), F.explode(F.sequence(F.lit(0).cast("long"), n_chunks - 1)).alias("o")
        ).select(F.xxhash64("next", F.least("c", "o"), F.greatest("c", "o"), F.lit("pair")).alias("region"), "cls")
        both = paired.join(reps, "cls").groupBy("region").applyInArrow(_join_regions(percent), "a long, b long")
        found = found.unionAll(both)
        members = scratch(spark, cells.filter("cut").select(F.col("next").alias("region"), "cls"), name)


def shingles_of(k: int) -> Sets:
    return functools.partial(tx.text_shingle_sets, k=k)


def similar_documents(docs: DataFrame, percent: int = PERCENT, make: Sets | None = None, max_region: int = MAX_REGION,
                      by_length: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members, classes and links of the join.

    members: (doc_id, n, h1, h2) of every document; classes: (n, h1, h2, cls) of every distinct non-empty
    set, cls its smallest doc_id; links: (a, b) between classes with
    100 * intersection >= percent * union, which span all components.

    ``make`` gives the set of each text (the five-word shingles). ``by_length`` also partitions the sets by length, each
    going to its own and the next partition: linked sets are in the same or in neighbouring ones, so
    regions hold sets of similar length only.

    Null or wordless text has an empty set and no links. A text of fewer than five words is
    one shingle. A null doc_id counts as the largest id. Repeated rows are members of
    one class. Extra columns are not read; an empty table gives empty results.
    """
    spark = docs.sparkSession
    blocks, n = with_blocks(docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NULL_ID))).alias("doc_id"), "text"))
    n_buckets = max(8, n // 4)
    make = make or shingles_of(SHINGLE)
    sent = blocks.groupBy("block").applyInArrow(_send(n_buckets, make), "bucket long, block long, keys binary, vals binary")
    replies = sent.groupBy("bucket").applyInArrow(_count, "block long, bucket long, levels binary")
    rows = blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(_rare(n_buckets, make, percent), MEMBER)
    rows = scratch(spark, rows, "jaccard-sets")

    members = rows.select("doc_id", "n", "h1", "h2")
    classes = members.filter("n > 0").groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("cls"))
    ids = classes.select("cls")
    reps = rows.filter("shingles is not null").select(F.col("doc_id").alias("cls"), "n", "rare", "shingles").join(ids, "cls", "left_semi")
    # repeated rows of one id in a block are one set or several; the class keeps one row
    rare = reps.select("cls", "n", F.explode("rare").alias("t"))
    if by_length:
        part = F.floor(F.log(F.col("n").cast("double")) / float(-np.log(percent / 100)) + SLACK)
        rare = rare.withColumn("part", F.explode(F.array(part, part + 1))).withColumn("t", F.xxhash64("t", "part"))
    rare = rare.select("cls", "t")
    pivots = rare.groupBy("t").agg(F.min(F.struct(F.xxhash64("cls").alias("h"), "cls")).alias("p"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("t", "p")
    region = scratch(
        spark,
        rare.join(pivots, "t").groupBy("p", "cls").agg(F.lit(1).alias("one")).select(F.col("p.cls").alias("region"), F.col("p.h").alias("h"), "cls"),
        "jaccard-regions",
    )
    sets = reps.select("cls", "shingles")
    first = region.groupBy("cls").agg(F.min(F.struct("h", "region")).alias("r")).select(F.col("r.region").alias("region"), "cls")
    links = scratch(spark, _join_members(first, sets, percent, max_region, "jaccard-first"), "jaccard-links")
    label = components(links, name="jaccard-cc").withColumnRenamed("id", "cls")
    open_ = region.join(label, "cls", "left").withColumn("label", F.coalesce("component", "cls"))
    todo = open_.groupBy("region").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("region")
    rest = scratch(spark, region.select("region", "cls").join(todo, "region", "left_semi"), "jaccard-open")
    more = scratch(spark, _join_members(rest, sets, percent, max_region, "jaccard-rest"), "jaccard-links")
    return members, classes, links.unionAll(more)


def near_duplicates(docs: DataFrame, percent: int = PERCENT, make: Sets | None = None, max_region: int = MAX_REGION, by_length: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links, itself included),
    one row per input row; see :func:`similar_documents` for nulls, empty texts and repeats. A component
    of documents without an id has component_id null."""
    members, classes, links = similar_documents(docs, percent, make, max_region, by_length)
    label = components(links, name="jaccard-cc").withColumnRenamed("id", "cls")
    of = classes.join(label, "cls", "left").select("n", "h1", "h2", F.coalesce("component", "cls").alias("component"))
    out = members.join(of, ["n", "h1", "h2"], "left")
    null = F.lit(int(NULL_ID))
    return out.select(
        F.nullif("doc_id", null).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.nullif(F.coalesce("component", "doc_id"), null).alias("component_id"),
    )


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One document of each component (its smallest doc_id) with all columns; documents without
    an id or without words stay."""
    copies = near_duplicates(docs, percent).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.alias("d").join(copies.alias("c"), F.col("d.doc_id") == F.col("c.doc_id"), "left_anti")


ORACLE = """
WITH RECURSIVE toks AS (
  SELECT doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5
    THEN [array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)] ELSE [array_to_string(w, ' ')] END) AS s
  FROM toks WHERE len(w) > 0),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (
  SELECT a, b FROM pair JOIN size x ON a = x.doc_id JOIN size y ON b = y.doc_id
  WHERE 100 * shared >= 75 * (x.n + y.n - shared)),
reach AS (SELECT a AS doc_id, b AS other FROM link UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON reach.other = link.a)
SELECT d.doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, least(d.doc_id, min(other))::BIGINT AS component_id
FROM documents d LEFT JOIN size USING (doc_id) LEFT JOIN reach USING (doc_id) GROUP BY d.doc_id
"""
