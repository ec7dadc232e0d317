"""latencylab: stream-benchmark analytics as plain Spark DataFrame operators.

Layers:
  sources/    readers (JSON events, JSONL logs, CSV) and the derived test tables
  functions/  Column-level helpers (bucketing, nearest-rank percentile, CI, run ids)
  operators/  DataFrame -> DataFrame operators (rules, running metrics, rollups,
              run model, summaries, series, recovery, resources)
  sinks/      parquet store: append, replace partition, upsert, purge
  streaming/  Structured Streaming pipeline and collect job
  plans/      the registered queries and their DuckDB oracle SQL
"""

__version__ = "0.1.0"
