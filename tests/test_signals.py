import json

from pyspark.sql import functions as F

from helpers import at, records, relation
from refreshgate import schemas
from refreshgate.operators import signals as sig
from refreshgate.sources import platform

OWNED = "table_name string, pipeline_id string, table_id string"


def test_write_operations():
    assert {"COPY INTO", "TRUNCATE", "DLT REFRESH", "STREAMING UPDATE", "MERGE"} <= set(sig.WRITE_OPERATIONS)
    assert not {"CLONE", "RESTORE", "OPTIMIZE", "DLT SETUP", "SET TBLPROPERTIES", "CREATE TABLE"} & set(sig.WRITE_OPERATIONS)


def test_last_write_ignores_maintenance_and_breaks_ties_by_version(spark):
    rows = [("t", 1, 100, "WRITE", {"numOutputRows": "1"}), ("t", 2, 100, "MERGE", {"numUpdatedRows": "00", "numOutputRows": "0",
             "numTargetRowsInserted": "7", "other": "9"}), ("t", 3, 200, "OPTIMIZE", {}), ("u", 1, 5, "VACUUM END", {})]
    got = sig.last_write(relation(spark, schemas.TABLE_HISTORY, rows)).withColumn("shown", sig.rows_text(F.col("impacted")))
    assert records(got, "table_name", "last_write_ms", "operation", "shown") == [
        ("t", 100, "MERGE", "numTargetRowsInserted=7, numUpdatedRows=00")]


def _success(spark, events, progress, updates):
    meta = relation(spark, schemas.TABLE_META, [("c.s.t", "tid", "STREAMING_TABLE", "p1", None)])
    events = events and relation(spark, schemas.PIPELINE_EVENTS, [("tid", "flow_progress", "COMPLETED", t) for t in events])
    updates = updates and relation(spark, schemas.PIPELINE_UPDATES, updates)
    defs = relation(spark, schemas.FLOW_DEFINITIONS, [("p1", "f", "s.t")])
    rows = relation(spark, schemas.FLOW_PROGRESS, progress)
    return tuple(sig.pipeline_success(meta, events, defs, rows, updates).select("success_ms", "signal").first())


def test_later_of_events_and_log_wins_and_updates_are_last(spark):
    log = [("p1", "f", "u7", "COMPLETED", 5, 0, 2, at("02:00")), ("p1", "f", "u7", "RUNNING", 1, 0, 0, at("01:30"))]
    update = [("p1", "u9", "COMPLETED", at("09:00"), [], None, None)]
    text = "pipeline event log, update u7: output_rows=6, deleted_rows=2"
    assert _success(spark, [at("01:00")], log, update) == (at("02:00"), text)
    assert _success(spark, [at("03:00")], log, update) == (at("03:00"), sig.EVENTS_SIGNAL)
    assert _success(spark, [at("02:00")], log, update) == (at("02:00"), sig.EVENTS_SIGNAL)
    assert _success(spark, None, log, None) == (at("02:00"), text)
    assert _success(spark, None, [], update) == (at("09:00"), "pipeline update u9 (start time)")
    assert _success(spark, None, [], None) == (None, sig.NO_PIPELINE_RUN)


def test_update_covers_by_selection(spark):
    owned = relation(spark, OWNED, [("c.s.t", "p", "1"), ("c.s.other", "p", "2"), ("c.s.x", "q", "3")])
    updates = relation(spark, schemas.PIPELINE_UPDATES, [
        ("p", "u1", "COMPLETED", 10, [], [], None), ("p", "u2", "COMPLETED", 20, ["t"], None, None),
        ("p", "u3", "COMPLETED", 30, None, ["c.s.t"], None), ("p", "u4", "FAILED", 40, [], None, None),
        ("q", "u5", "COMPLETED", 50, ["t"], None, None)])
    assert records(sig.update_covering(updates, owned), "table_name", "start_ms", "update_id") == [
        ("c.s.other", 10, "u1"), ("c.s.t", 30, "u3")]


def test_flow_defined_onto_two_datasets_and_null_update(spark):
    defs = relation(spark, schemas.FLOW_DEFINITIONS, [("p", "f", "a"), ("p", "f", "b"), ("p", "g", "a"), ("p", "f", "a")])
    rows = relation(spark, schemas.FLOW_PROGRESS, [
        ("p", "f", "u1", "COMPLETED", 1, 2, 3, 10), ("p", "g", "u1", "FAILED", 10, 0, 0, 5), ("p", "f", None, "RUNNING", 9, 9, 9, 8)])
    got = sig.dataset_completion(defs, rows)
    assert records(got, "dataset", "done_ms", "update_id", "output_rows", "upserted_rows") == [
        ("a", 10, "u1", 11, 2), ("b", 10, "u1", 1, 2)]
    late = rows.unionByName(relation(spark, schemas.FLOW_PROGRESS, [("p", "f", None, "COMPLETED", 4, 4, 4, 99)]))
    assert records(sig.dataset_completion(defs, late), "dataset", "done_ms", "update_id", "output_rows") == [
        ("a", 99, None, None), ("b", 99, None, None)]


def test_job_success_with_and_without_a_limit(spark):
    runs = [(1, i, i * 10, i * 10 + 5, "SUCCESS" if i == 1 else "FAILED", "TERMINATED") for i in range(1, 31)]
    runs += [(2, i, i * 10, i * 10 + 5, "SUCCESS" if i == 6 else "FAILED", "TERMINATED") for i in range(1, 31)]
    runs += [(2, 99, 990, None, None, "RUNNING"), (3, 1, 10, 15, "SUCCESS", "TERMINATED")]
    runs += [(4, i, i * 10, i * 10 + 5, "SUCCESS" if i == 1 else "FAILED", "TERMINATED") for i in range(1, 42)]
    rows = relation(spark, schemas.JOB_RUNS, runs)
    assert records(sig.job_success(rows)) == [(1, 15, 1), (2, 65, 6), (3, 15, 1), (4, 15, 1)]
    assert records(sig.job_success(rows, depth=25)) == [(2, 65, 6), (3, 15, 1)]


def test_running_producer(spark):
    meta = relation(spark, schemas.TABLE_META, [(f"t{i}", None, None, f"p{i}", None) for i in range(4)])
    pipes = relation(spark, schemas.PIPELINES, [("p0", "a", "RUNNING", True), ("p1", "b", "IDLE", False),
                                                ("p2", "c", "RUNNING", False), ("p3", "d", "STARTING", None)])
    updates = relation(spark, schemas.PIPELINE_UPDATES, [
        (f"p{i}", f"done{i}", "COMPLETED", 9, None, None, None) for i in range(3)] + [
        (f"p{i}", f"run{i}", "RUNNING", 5, None, None, "JOB_TASK") for i in range(3)])
    assert records(sig.running_producers(meta, pipes, updates)) == [("t2", "p2", "run2", "JOB_TASK")]


def test_event_log_projection_from_json_and_variant(spark):
    ts = "timestamp '2026-10-12 01:00:00'"
    flow = json.dumps({"flow_definition": {"output_dataset": "`s`.`t`"}})
    done = json.dumps({"flow_progress": {"status": "COMPLETED", "metrics": {"num_output_rows": 3}}})
    log = spark.sql(f"""select 'p' as pipeline_id, {ts} as timestamp, 'flow_definition' as event_type,
        named_struct('flow_name', 'f', 'update_id', null) as origin, '{flow}' as details union all
        select 'p', {ts}, 'flow_progress', named_struct('flow_name', 'f', 'update_id', 'u'), '{done}' union all
        select 'p', timestamp '2020-01-01', 'flow_progress', named_struct('flow_name', 'f', 'update_id', 'old'), '{done}'""")
    for source in (log, log.withColumn("details", F.parse_json("details"))):
        assert records(platform.flow_definitions(source)) == [("p", "f", "s.t")]
        assert records(platform.flow_progress(source, at("00:00"))) == [("p", "f", "u", "COMPLETED", 3, 0, 0, at("01:00"))]


def test_lookback_reaches_the_scan(spark, tmp_path):
    spark.sql("select timestamp '2026-10-12' event_time, 'flow_progress' event_type, named_struct('uc_table_id', 'x') origin, "
              "'{}' details").write.parquet(str(tmp_path / "e"))
    events = platform.pipeline_events(spark.read.parquet(str(tmp_path / "e")), at("00:00"))
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    plan = sig.events_completion(events)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(event_time" in plan and "EqualTo(event_type,flow_progress)" in plan
