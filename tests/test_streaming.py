from helpers import at, records, relation, signals, tracker
from refreshgate import schemas
from refreshgate.operators.freshness import Signals
from refreshgate.streaming import refresh_state as rs


def test_refresh_state_and_gate(spark, tmp_path):
    source, state, out = f"{tmp_path}/in", f"{tmp_path}/state", f"{tmp_path}/out"
    rows = tracker(spark, ("A", "JOB", "d", [], ["t"], None, None, 20), ("B", "JOB", "d", [], ["u"], None, None, 20))
    base = signals(spark)

    def with_state(last_write):
        return Signals(base.table_meta, last_write, base.pipeline_success, base.job_success)

    def feed(commits):
        relation(spark, schemas.TABLE_HISTORY, commits).coalesce(1).write.mode("append").parquet(source)
        history = spark.readStream.schema(schemas.TABLE_HISTORY).parquet(source)
        gate = rs.gate_on_change(rows, with_state, lambda: at("03:00"), state, out)
        rs.track_refreshes(history, state, f"{tmp_path}/cp", compact_every=1, on_change=gate, availableNow=True).awaitTermination()
        return records(rs.read_refresh_state(spark, state), "table_name", "version", "ts_ms", "operation")

    assert feed([("t", 1, at("02:00"), "WRITE", {}), ("u", 1, at("02:50"), "MERGE", {"numOutputRows": "2"}),
                 ("t", 2, at("02:10"), "OPTIMIZE", {})]) == [("t", 1, at("02:00"), "WRITE"), ("u", 1, at("02:50"), "MERGE")]
    # a late row changes nothing; only t changes
    late = [("u", 0, at("01:00"), "WRITE", {}), ("t", 3, at("02:55"), "WRITE", {})]
    assert feed(late) == [("t", 3, at("02:55"), "WRITE"), ("u", 1, at("02:50"), "MERGE")]
    assert feed([("u", 7, at("02:59"), "WRITE", {})]) == [("t", 3, at("02:55"), "WRITE"), ("u", 7, at("02:59"), "WRITE")]
    verdicts = records(spark.read.parquet(out), "batch", "entity_name", "verdict")
    assert (0, "A", "STALE") in verdicts and (0, "B", "FRESH") in verdicts and (1, "A", "FRESH") in verdicts
    assert [v for v in verdicts if v[0] == 2] == [(2, "B", "FRESH")]


def test_completions(spark, tmp_path):
    source = f"{tmp_path}/in"
    for batch in ([("x", "flow_progress", "COMPLETED", 5), ("x", "flow_progress", "FAILED", 9)],
                  [("x", "flow_progress", "COMPLETED", 3), ("y", "flow_progress", "COMPLETED", 7)]):
        relation(spark, schemas.PIPELINE_EVENTS, batch).write.mode("append").parquet(source)
        events = spark.readStream.schema(schemas.PIPELINE_EVENTS).parquet(source)
        rs.track_completions(events, f"{tmp_path}/state", f"{tmp_path}/cp", availableNow=True).awaitTermination()
    assert records(rs.read_completions(spark, f"{tmp_path}/state")) == [("x", 5), ("y", 7)]


def test_folders_stay_bounded(spark, tmp_path):
    for n in range(14):
        relation(spark, schemas.PIPELINE_EVENTS, [(f"t{n % 3}", "flow_progress", "COMPLETED", n)]).coalesce(1).write.parquet(f"{tmp_path}/in/n={n:02d}")
    events = spark.readStream.schema(schemas.PIPELINE_EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    state = tmp_path / "state"
    rs.track_completions(events, str(state), f"{tmp_path}/cp", compact_every=3, availableNow=True).awaitTermination()
    assert records(rs.read_completions(spark, str(state))) == [("t0", 12), ("t1", 13), ("t2", 11)]
    folders = {kind: sorted(p.name for p in (state / kind).iterdir() if p.is_dir()) for kind in ("changes", "snapshots", "heads")}
    assert folders == {"changes": ["batch=10", "batch=11", "batch=12", "batch=13"], "snapshots": ["upto=12", "upto=9"], "heads": ["upto=12", "upto=9"]}
