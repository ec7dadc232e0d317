"""Parquet store of the six tables, partitioned by ``run_id`` (SNK2-SNK9).

Writes are idempotent on replay: appends go to a ``batch_id=N`` folder that a
replayed batch overwrites; replace / upsert / purge rewrite only the touched
``run_id`` partitions with dynamic partition overwrite. A plan never reads and
overwrites the same path: the new partitions are first written to a staging
folder under the shared checkpoint dir, then copied over by a second job.

A micro-batch reads by folder: the paths follow from the runs and blocks it touches, and only those are listed. A
log's batch folders are merged as they pile up. The merged folder of the batches up to n is ``batch_id=-(n + 1)``; it
appears by one rename, and from then on the folders it replaces do not count, whether they are deleted yet or not.
"""

from __future__ import annotations

import itertools
import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from latencylab.operators.rollup import latest_wins
from latencylab.session import scratch_path

# The collect job's running state, deleted with a run.
STATE_TABLES = ["processed_events_log", "collect_run_starts", "collect_ids", "collect_latency", "collect_runs"]
TABLE_NAMES = [
    "resource_usage_buckets", "fault_events", "processed_event_buckets",
    "processed_run_summaries", "processed_events", "run_metadata",
]

MERGED_INTO_ONE = 64  # batch folders that merge into one file

# Schemas of the tables that a micro-batch reads (no footers are read to infer them).
_LOG = ("run_id string, framework string, scenario string, event_id long, sent_at_ms long, processed_at_ms long, "
        "collected_at_ms long, latency_ms double, ")
_LATENCY = "avg_latency_ms double, median_latency_ms double, p95_latency_ms double, max_latency_ms double"
_RANGE = "messages long, distinct_events long, min_event_id long, max_event_id long, "
DECLARED = {
    "processed_events_log": _LOG + "block long, batch_id int",
    "processed_event_buckets": ("run_id string, framework string, scenario string, bucket_offset_ms long, bucket_start_ms long, "
                                "bucket_end_ms long, " + _RANGE + _LATENCY + ", part long"),
    "processed_run_summaries": ("run_id string, framework string, scenario string, " + _RANGE + "first_sent_at_ms long, "
                                "first_collected_at_ms long, last_collected_at_ms long, " + _LATENCY),
    "collect_run_starts": ("run_id string, first_event_id long, first_record_sent_at_ms long, first_collected_at_ms long, "
                           "run_start_ms long"),
    "collect_ids": "run_id string, id_block long, bucket long, before binary, seen binary, upto int",
    "collect_latency": "run_id string, latency_ms double, n long, upto int",
    "collect_runs": ("run_id string, " + _RANGE + "first_collected_at_ms long, last_collected_at_ms long, framework string, "
                     "scenario string, upto int"),
}


class Store:
    """A folder of parquet tables, each partitioned by ``run_id``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def exists(self, table: str) -> bool:
        p, fs = self._fs(self.path(table))
        return fs.exists(p)

    def read(self, table: str, run_id: str | None = None) -> DataFrame | None:
        if not self.exists(table):
            return None
        reader = self.spark.read
        if table in DECLARED:
            reader = reader.schema(DECLARED[table])
        df = reader.parquet(self.path(table))
        return df if run_id is None else df.where(F.col("run_id") == run_id)

    # -- writes -----------------------------------------------------------------
    def append(self, table: str, df: DataFrame, batch_id: int | None = None, parts: Sequence[str] = ("run_id",)) -> None:
        """Append rows; with a ``batch_id`` the batch's partitions are replaced, so a
        replayed micro-batch does not duplicate rows."""
        if batch_id is None:
            df.write.mode("append").partitionBy(*parts).parquet(self.path(table))
        else:
            (df.withColumn("batch_id", F.lit(int(batch_id)))
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy(*parts, "batch_id").parquet(self.path(table)))

    # -- reads by folder -----------------------------------------------------------
    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def children(self, folder: str) -> list[str]:
        """Names of the partition folders right below one folder (nothing deeper is listed)."""
        p, fs = self._fs(folder)
        if not fs.exists(p):
            return []
        return sorted(st.getPath().getName() for st in fs.listStatus(p) if st.isDirectory() and "=" in st.getPath().getName())

    def folder(self, table: str, **values) -> str:
        """Path of a partition, its columns in the order of the folders."""
        escape = self.spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        return "/".join([self.path(table), *[f"{c}={escape(str(v))}" for c, v in values.items()]])

    def read_folders(self, table: str, folders: Sequence[str], schema: str | None = None) -> DataFrame:
        """Rows of these folders of a table (those that exist); no other folder is listed."""
        schema = schema or DECLARED[table]
        found = []
        for folder in folders:
            p, fs = self._fs(folder)
            if fs.exists(p):
                found.append(folder)
        if not found:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.path(table)).parquet(*found)

    def run_eps(self, run_ids: Sequence[str]) -> DataFrame:
        """(run_id, eps) of runs as their metadata is now."""
        return self.read_folders("run_metadata", [self.folder("run_metadata", run_id=r) for r in run_ids], "run_id string, eps double")

    def read_partitions(self, table: str, columns: Sequence[str], wanted: Sequence[tuple]) -> DataFrame:
        """Rows whose leading partition columns have one of the given combinations of values."""
        return self.read_folders(table, [self.folder(table, **dict(zip(columns, values))) for values in wanted])

    def read_parts(self, table: str, **values: list) -> DataFrame:
        """Rows whose leading partition columns have one of the given values each (other folders are not listed or read)."""
        df = self.read_partitions(table, list(values), list(itertools.product(*values.values())))
        for column, wanted in values.items():
            df = df.where(F.col(column).isin(*wanted) if wanted else F.lit(False))
        return df

    def live_batches(self, folder: str) -> list[int]:
        """The batch folders of a log's partition that count: the newest merged one and the batches after it."""
        ids = sorted(int(name.split("=")[1]) for name in self.children(folder))
        newest = min([i for i in ids if i < 0], default=None)
        return ids if newest is None else [newest, *[i for i in ids if i > -newest - 1]]

    def read_log(self, table: str, columns: Sequence[str], wanted: Sequence[tuple]) -> DataFrame:
        """Live rows of a log's partitions."""
        parts = [self.folder(table, **dict(zip(columns, values))) for values in wanted]
        return self.read_folders(table, [f"{p}/batch_id={i}" for p in parts for i in self.live_batches(p)])

    def merge_batches(self, table: str, folder: str, upto: int, least: int = 2) -> bool:
        """Merges a log partition's live batches up to ``upto`` (batches that cannot be replayed any more) into
        one folder, if there are at least ``least``."""
        live = self.live_batches(folder)
        old = [i for i in live if i <= upto]
        if len(old) < least:
            return False
        staging = f"{self.root}/_staging/{uuid.uuid4().hex}"
        levels = [part.split("=")[0] for part in folder[len(self.path(table)) + 1:].split("/")]
        rows = self.read_folders(table, [f"{folder}/batch_id={i}" for i in old]).drop(*levels, "batch_id")
        rows.coalesce(max(1, len(old) // MERGED_INTO_ONE)).write.parquet(staging)
        path, fs = self._fs(f"{folder}/batch_id={-(upto + 1)}")
        fs.delete(path, True)  # an earlier attempt that did not get to be the newest
        if not fs.rename(self._fs(staging)[0], path):
            raise OSError(f"cannot move merged batches to {folder}")
        keep = set(self.live_batches(folder))
        for name in self.children(folder):
            if int(name.split("=")[1]) not in keep:
                fs.delete(self._fs(f"{folder}/{name}")[0], True)
        return True

    def drop_run(self, table: str, run_id: str) -> None:
        """Delete one run's partitions of a table."""
        p, fs = self._fs(self.folder(table, run_id=run_id))
        fs.delete(p, True)

    def overwrite_parts(self, table: str, df: DataFrame, parts: Sequence[str]) -> None:
        """Replace the partitions that ``df`` has rows for. The rows are first written to a staging
        folder, since they may derive from the partitions they replace."""
        staging = scratch_path(self.spark, f"staging-{table}-{uuid.uuid4().hex}")
        df.write.mode("overwrite").partitionBy(*parts).parquet(staging)
        staged = self.spark.read.schema(df.schema).parquet(staging).select(*df.columns)
        (staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(*parts).parquet(self.path(table)))
        p = self.spark._jvm.org.apache.hadoop.fs.Path(staging)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def replace_runs(self, table: str, df: DataFrame) -> None:
        """Replace every row of the runs present in ``df`` (a fault-log import)."""
        self.overwrite_parts(table, df, ["run_id"])

    def upsert(self, table: str, df: DataFrame, keys: Sequence[str], version_col: str = "updated_at",
               keep_first: Sequence[str] = ("created_at",)) -> None:
        """Insert-or-update by ``keys``: the newest version wins; columns in
        ``keep_first`` are set on insert and keep their first value (as ``created_at`` does)."""
        new = df if version_col in df.columns else df.withColumn(version_col, F.current_timestamp())
        new = new.withColumns({c: F.col(version_col) for c in keep_first if c not in new.columns})
        old = self.read(table)
        if old is not None:
            touched = new.select("run_id").distinct()
            old = old.join(touched, "run_id", "left_semi")
            both = old.unionByName(new, allowMissingColumns=True)
        else:
            both = new
        merged = latest_wins(both, list(keys), [version_col])
        for c in keep_first:
            if c in both.columns:
                first = both.groupBy(*keys).agg(F.min(c).alias(f"_first_{c}"))
                merged = merged.join(first, list(keys), "left").withColumn(c, F.col(f"_first_{c}")).drop(f"_first_{c}")
        self.overwrite_parts(table, merged, ["run_id"])

    def purge(self, run_id: str) -> DataFrame:
        """Delete a run from every table; returns rows deleted per table.

        Tables are partitioned by ``run_id``, so a purge counts the run's rows
        (a partition-pruned read) and deletes its partition folders: a metadata
        operation, no rewrite of other runs."""
        jvm = self.spark._jvm
        conf = self.spark._jsc.hadoopConfiguration()
        rows = []
        escaped = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(run_id)
        for table in TABLE_NAMES:
            df = self.read(table, run_id)
            if df is None:
                continue
            n = df.count()
            base = jvm.org.apache.hadoop.fs.Path(self.path(table))
            fs = base.getFileSystem(conf)
            for pattern in (f"{self.path(table)}/run_id={escaped}", f"{self.path(table)}/*/run_id={escaped}"):
                for st in fs.globStatus(jvm.org.apache.hadoop.fs.Path(pattern)) or []:
                    fs.delete(st.getPath(), True)
            rows.append((run_id, table, int(n)))
        for table in STATE_TABLES:
            self.drop_run(table, run_id)
        return self.spark.createDataFrame(rows, "run_id string, table_name string, deleted_rows long")


def _table_frames(t) -> dict[str, DataFrame]:
    return {
        "resource_usage_buckets": t.resource_usage_buckets,
        "fault_events": t.fault_events,
        "processed_event_buckets": t.processed_event_buckets,
        "processed_run_summaries": t.processed_run_summaries,
        "processed_events": t.processed_events,
        "run_metadata": t.run_metadata,
    }


def purge_counts(t) -> DataFrame:
    """Rows a purge would delete, per existing run and table (0 when none).

    A run exists when any event table (summary, buckets, raw) has it. One
    ``groupBy`` count per table; the six table names are exploded per run.
    """
    frames = _table_frames(t)
    counts = None
    for name, df in frames.items():
        c = df.groupBy("run_id").agg(F.count(F.lit(1)).alias("deleted_rows")).withColumn("table_name", F.lit(name))
        counts = c if counts is None else counts.unionByName(c)
    existing = (
        frames["processed_run_summaries"].select("run_id")
        .unionByName(frames["processed_event_buckets"].select("run_id"))
        .unionByName(frames["processed_events"].select("run_id"))
        .distinct()
    )
    grid = existing.select("run_id", F.explode(F.array(*[F.lit(n) for n in TABLE_NAMES])).alias("table_name"))
    return grid.join(counts, ["run_id", "table_name"], "left").select(
        "run_id", "table_name", F.coalesce("deleted_rows", F.lit(0).cast("long")).alias("deleted_rows")
    )


def write_jsonl(df: DataFrame, path: str, batch_id: int) -> None:
    """One JSON line per record, a folder per batch and run (the collector's JSONL files); a replayed
    batch replaces its folder. Each line holds the whole record, its run id included."""
    (df.withColumns({"batch_id": F.lit(int(batch_id)), "run": F.col("run_id")})
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("batch_id", "run").json(path))


def new_store(spark: SparkSession, name: str | None = None) -> Store:
    return Store(spark, os.path.join(scratch_path(spark, "stores"), name or uuid.uuid4().hex))
