"""Parquet store: idempotent append, partition replace, upsert, purge."""

from pyspark.sql import functions as F

from latencylab.sinks.store import Store


def test_append_replace_upsert_purge(spark, tmp_dir):
    st = Store(spark, f"{tmp_dir}/s")
    a = spark.createDataFrame([("r1", 1), ("r1", 2), ("r2", 3)], "run_id string, v long")
    st.append("t", a, batch_id=0)
    st.append("t", a, batch_id=0)  # replay
    assert st.read("t").count() == 3
    st.replace_runs("fault_events", a)
    st.replace_runs("fault_events", spark.createDataFrame([("r1", 9)], "run_id string, v long"))
    assert sorted((r.run_id, r.v) for r in st.read("fault_events").collect()) == [("r1", 9), ("r2", 3)]
    m1 = spark.createDataFrame([("r1", "x", 1)], "run_id string, eps string, ver long").withColumn(
        "created_at", F.lit(10)).withColumn("updated_at", F.lit(1))
    st.upsert("run_metadata", m1, ["run_id"], "updated_at")
    m2 = spark.createDataFrame([("r1", "y", 2)], "run_id string, eps string, ver long").withColumn(
        "created_at", F.lit(20)).withColumn("updated_at", F.lit(2))
    st.upsert("run_metadata", m2, ["run_id"], "updated_at")
    r = st.read("run_metadata").collect()
    assert len(r) == 1 and r[0].eps == "y" and r[0].created_at == 10
    counts = {x.table_name: x.deleted_rows for x in st.purge("r1").collect()}
    assert counts["run_metadata"] == 1
    assert st.read("fault_events").where("run_id = 'r1'").count() == 0


def test_read_jsonl_absent_and_blank_lines(spark, tmp_dir):
    from latencylab.schemas import FAULT_LOG
    from latencylab.sources.readers import read_jsonl

    assert read_jsonl(spark, f"{tmp_dir}/nope.jsonl", FAULT_LOG).count() == 0
    p = f"{tmp_dir}/f.jsonl"
    with open(p, "w") as f:
        f.write('{"run_id":"a","phase":"fault_start","timestamp_ms":5}\n\n   \n{"run_id":"a","phase":"fault_end","timestamp_ms":9}\n')
    assert read_jsonl(spark, p, FAULT_LOG).count() == 2


def test_csv_nan_becomes_null(spark, tmp_dir):
    from latencylab.sources.readers import read_scenarios, read_transactions_csv, scenario_volume

    p = f"{tmp_dir}/tx.csv"
    with open(p, "w") as f:
        f.write("TransactionID,AccountID,TransactionAmount\nT1,A1,NaN\nT2,A2,5.5\n")
    rows = {r.TransactionID: r.TransactionAmount for r in read_transactions_csv(spark, p).collect()}
    assert rows == {"T1": None, "T2": 5.5}
    s = f"{tmp_dir}/sc.csv"
    with open(s, "w") as f:
        f.write("scenario,eps,duration\nlow,50,250\nhigh,400,250\n")
    assert scenario_volume(read_scenarios(spark, s), "high").first().expected_events == 100000


def test_read_run_events_falls_back_to_table(spark, tmp_dir):
    from latencylab.sources.readers import read_run_events

    from latencylab.schemas import PROCESSED_EVENTS

    table = spark.createDataFrame(
        [("a", "f", "s", i, 1, 2, t, 3.5) for i, t in ((4, 9), (1, 7), (3, 7), (2, None))] + [("b", "f", "s", 2, 1, 2, 3, 4.0)], PROCESSED_EVENTS
    )
    stored = read_run_events(spark, f"{tmp_dir}/none.jsonl", table, "a")
    assert [r.event_id for r in stored.collect()] == [2, 1, 3, 4]  # arrival order, then id
    p = f"{tmp_dir}/a.jsonl"
    with open(p, "w") as f:
        f.write('{"run_id":"a","event_id":7,"collected_at_ms":1,"latency_ms":"12.5"}\n')
    log = read_run_events(spark, p, table, "a")
    assert log.schema == stored.schema and (log.first().event_id, log.first().latency_ms) == (7, 12.5)


def test_created_at_is_set_on_insert_and_kept(spark, tmp_dir):
    st = Store(spark, f"{tmp_dir}/m")
    for version, mode in ((1, "normal"), (2, "fault"), (2, "fault")):
        st.upsert("run_metadata", spark.createDataFrame([("r", mode, version)], "run_id string, mode string, updated_at long"), ["run_id"])
    r = st.read("run_metadata").collect()
    assert [(x.mode, x.updated_at, x.created_at) for x in r] == [("fault", 2, 1)]


def test_resource_upsert_replaces_points(spark, tmp_dir):
    st = Store(spark, f"{tmp_dir}/u")
    cols = "run_id string, bucket_offset_ms long, cpu_usage_cores double, updated_at long"
    st.upsert("resource_usage_buckets", spark.createDataFrame([("r", 0, 1.0, 1), ("r", 5000, 2.0, 1)], cols), ["run_id", "bucket_offset_ms"])
    st.upsert("resource_usage_buckets", spark.createDataFrame([("r", 5000, 9.0, 2)], cols), ["run_id", "bucket_offset_ms"])
    got = {(x.bucket_offset_ms): x.cpu_usage_cores for x in st.read("resource_usage_buckets").collect()}
    assert got == {0: 1.0, 5000: 9.0}


def test_staging_folders_are_removed(spark, tmp_dir):
    import os

    from latencylab.session import ensure_checkpoint_dir

    root = ensure_checkpoint_dir(spark).removeprefix("file:")
    before = {f for f in os.listdir(root) if f.startswith("staging-")}
    Store(spark, f"{tmp_dir}/st").replace_runs("fault_events", spark.createDataFrame([("r1", 9)], "run_id string, v long"))
    assert {f for f in os.listdir(root) if f.startswith("staging-")} <= before


def test_jsonl_result_files_hold_whole_records_and_survive_replay(spark, tmp_dir):
    from latencylab.schemas import PROCESSED_EVENTS
    from latencylab.sinks.store import write_jsonl

    df = spark.createDataFrame([("a", "f", "s", 1, 1, 2, 3, 3.5), ("b", "f", "s", 2, 1, 2, 3, 4.0)], PROCESSED_EVENTS)
    for _ in range(2):
        write_jsonl(df, f"{tmp_dir}/json", 0)
    back = spark.read.schema(PROCESSED_EVENTS).json(f"{tmp_dir}/json")
    assert sorted(map(tuple, back.select(*df.columns).collect())) == sorted(map(tuple, df.collect()))


def test_run_exists_one(spark):
    from latencylab.operators.runs import run_exists_one
    from latencylab.plans.catalog import tables
    from tests.conftest import SF_SMALL

    t = tables(spark, SF_SMALL)
    assert run_exists_one(t, "spark_low_01") is True
    assert run_exists_one(t, "spark_low_99") is False


def _log(spark, *rows):
    return spark.createDataFrame([(r, "f", "s", i, None, None, b * 60_000, 1.0, b) for r, b, i in rows],
                                 "run_id string, framework string, scenario string, event_id long, sent_at_ms long, processed_at_ms long, "
                                 "collected_at_ms long, latency_ms double, block long")


def test_merged_batches_replace_their_folders(spark, tmp_dir):
    st = Store(spark, f"{tmp_dir}/s")
    table, parts = "processed_events_log", ["run_id", "block"]
    for i in range(6):
        st.append(table, _log(spark, ("a:b", 1, i), ("a:b", 2, i), ("c", 1, i)), i, parts)
    folder = st.folder(table, run_id="a:b", block=1)
    ids = lambda: sorted(r.event_id for r in st.read_log(table, parts, [("a:b", 1)]).collect())
    assert st.merge_batches(table, folder, 3) and st.live_batches(folder) == [-4, 4, 5] and st.children(folder) == ["batch_id=-4", "batch_id=4", "batch_id=5"]
    assert ids() == list(range(6))
    assert not st.merge_batches(table, folder, 3)
    # a crash between the rename and the deletes leaves folders that no longer count
    st.append(table, _log(spark, ("a:b", 1, 2)), 2, parts)
    assert st.live_batches(folder) == [-4, 4, 5] and ids() == list(range(6))
    assert st.merge_batches(table, folder, 5) and st.children(folder) == ["batch_id=-6"] and ids() == list(range(6))
    # the other partitions are as they were
    assert st.live_batches(st.folder(table, run_id="a:b", block=2)) == list(range(6))
    assert st.read_partitions(table, parts, [("c", 1), ("none", 7)]).count() == 6


def test_folder_reads_list_only_their_folders(spark, tmp_dir):
    st = Store(spark, f"{tmp_dir}/s")
    table, parts = "processed_events_log", ["run_id", "block"]
    st.append(table, _log(spark, *[("r", b, b) for b in range(40)]), 0, parts)
    got = st.read_parts(table, run_id=["r"], block=[7])
    files = got.inputFiles()
    assert len(files) == 1 and "block=7" in files[0] and [r.event_id for r in got.collect()] == [7]
    assert st.read_parts(table, run_id=["r"], block=[]).count() == 0 and st.read_parts(table, run_id=["x"]).count() == 0
