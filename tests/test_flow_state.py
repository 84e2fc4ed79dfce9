import random

from helpers import records, relation
from refreshgate import schemas
from refreshgate.operators import signals as sig
from refreshgate.streaming import flow_state as fs

HOUR = 3_600_000
FLOWS = [("p", "f1", "d"), ("p", "f2", "d"), ("p", "g", "e"), ("q", "f1", "d"), ("q", "x", None)]


def feed(spark, path, schema, batches):
    """One file, and so one micro-batch, for each list of rows."""
    for n, rows in enumerate(batches):
        relation(spark, schema, rows).coalesce(1).write.parquet(f"{path}/n={n:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def test_flows_in_any_order(spark, tmp_path):
    rng = random.Random(4)
    rows = [(*rng.choice(FLOWS)[:2], rng.choice(["u1", "u2", "u3", None]), rng.choice(["COMPLETED", "RUNNING", "FAILED"]), rng.randrange(9), rng.randrange(3),
             rng.randrange(2), HOUR + rng.randrange(40) * 60_000) for _ in range(60)]
    stream = feed(spark, f"{tmp_path}/in", schemas.FLOW_PROGRESS, [rows[k::4] for k in range(4)])
    definitions = relation(spark, schemas.FLOW_DEFINITIONS, FLOWS + FLOWS[:1])
    fs.track_flows(stream, definitions, f"{tmp_path}/state", f"{tmp_path}/cp", compact_every=2, availableNow=True).awaitTermination()
    batch = sig.dataset_completion(definitions, relation(spark, schemas.FLOW_PROGRESS, rows))
    columns = ("pipeline_id", "dataset", "done_ms", "update_id", *fs.COUNTS)
    assert records(fs.read_flows(spark, f"{tmp_path}/state"), *columns) == records(batch, *columns)


def test_state_stays_bounded_and_late_rows_are_dropped(spark, tmp_path):
    def at(hour):
        return [("p", "f1", f"u{hour}", status, 1, 0, 0, hour * HOUR + minute) for minute, status in enumerate(["RUNNING", "RUNNING", "COMPLETED"])]

    batches = [at(hour) for hour in range(1, 9)] + [[("p", "f1", "u8", "RUNNING", 5, 0, 0, 8 * HOUR + 9), ("p", "f1", "u1", "COMPLETED", 50, 0, 0, HOUR + 5)]]
    stream = feed(spark, f"{tmp_path}/in", schemas.FLOW_PROGRESS, batches)
    definitions = relation(spark, schemas.FLOW_DEFINITIONS, FLOWS)
    query = fs.track_flows(stream, definitions, f"{tmp_path}/state", f"{tmp_path}/cp", late_ms=HOUR // 2, keep_ms=HOUR // 2, availableNow=True)
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert len(held) >= 8 and max(held) <= 4
    # the late row of the open update counts, that of an update long forgotten does not
    assert records(fs.read_flows(spark, f"{tmp_path}/state"), "dataset", "update_id", "output_rows") == [("d", "u8", 8)]


def test_many_updates_share_slots(spark, tmp_path):
    """Python is called per slot, not per update; updates of a slot are summed, kept and forgotten each by itself."""
    def at(n, status, minute, rows=1):
        return ("p", "f1", f"u{n:03d}", status, rows, None, 0, None if minute is None else HOUR + minute * 60_000)

    batches = [[at(n, "RUNNING", n % 50) for n in range(200)] + [at(n, "COMPLETED", 40) for n in range(100)] + [at(7, "COMPLETED", None, 4)],
               [at(150, "RUNNING", 100)], [at(150, "RUNNING", 101)],  # those completed are forgotten
               [at(8, "COMPLETED", 90, 30), at(120, "COMPLETED", 90, 50), at(99, "RUNNING", 90)]]
    stream = feed(spark, f"{tmp_path}/in", schemas.FLOW_PROGRESS, batches)
    query = fs.track_flows(stream, relation(spark, schemas.FLOW_DEFINITIONS, FLOWS), f"{tmp_path}/state", f"{tmp_path}/cp", late_ms=HOUR // 2,
                           keep_ms=HOUR // 6, n_slots=3, availableNow=True)
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) == 3
    changes = spark.read.parquet(f"{tmp_path}/state/changes/batch=0")
    sums = [("u%03d" % n, HOUR + 40 * 60_000, 3 if n == 7 else 2, 6 if n == 7 else 2, 0) for n in range(100)]
    assert records(changes, "update_id", "done_ms", "n_rows", "output_rows", "upserted_rows") == sums
    last = {r["update_id"]: (r["n_rows"], r["output_rows"]) for r in spark.read.parquet(f"{tmp_path}/state/changes").where("done_ms > 6000000").collect()}
    assert last == {"u008": (1, 30), "u120": (2, 51)}
    assert records(fs.read_flows(spark, f"{tmp_path}/state"), "update_id", "output_rows") == [("u120", 51)]


def test_job_runs_and_updates(spark, tmp_path):
    runs = [(1, 5, 10, 90, "SUCCESS", "TERMINATED"), (1, 6, 20, 40, "SUCCESS", "TERMINATED"), (1, 7, 30, None, None, "RUNNING"), (2, 8, 5, 6, "FAILED", "TERMINATED"),
            (2, 9, 4, 7, "SUCCESS", "INTERNAL_ERROR")]
    stream = feed(spark, f"{tmp_path}/runs", schemas.JOB_RUNS, [runs[:2], runs[2:]])
    fs.track_job_runs(stream, f"{tmp_path}/jobs", f"{tmp_path}/cp1", availableNow=True).awaitTermination()
    assert records(fs.read_job_success(spark, f"{tmp_path}/jobs")) == records(sig.job_success(relation(spark, schemas.JOB_RUNS, runs)))
    updates = [("p", "u1", "COMPLETED", 5, ["t"], None, "x"), ("p", "u2", "COMPLETED", 9, [], None, "x"), ("p", "u3", "COMPLETED", 7, ["t"], ["v"], "x"),
               ("p", "u4", "FAILED", 11, [], None, "x")]
    stream = feed(spark, f"{tmp_path}/updates", schemas.PIPELINE_UPDATES, [updates[2:], updates[:2]])
    fs.track_updates(stream, f"{tmp_path}/scopes", f"{tmp_path}/cp2", availableNow=True).awaitTermination()
    columns = ("pipeline_id", "scope", "start_ms", "update_id")
    assert records(fs.read_update_scopes(spark, f"{tmp_path}/scopes"), *columns) == records(
        sig.update_scopes(relation(spark, schemas.PIPELINE_UPDATES, updates)), *columns)
