import random

import pytest

from helpers import at, records, relation, signals, tracker
from refreshgate import schemas
from refreshgate.operators import freshness, gates, signals as sig
from refreshgate.streaming import expiry_wheel as ew, refresh_state as rs

MINUTE = 60_000


def changes(spark, **refreshed):
    return relation(spark, ew.CHANGES, [(k.replace("_", ":"), v) for k, v in refreshed.items()])


def moved(df):
    return records(df, "entity_name", "verdict", "n_stale", "stale_at_ms")


def test_time_alone_moves_a_verdict(spark, tmp_path):
    rows = tracker(spark, ("A", "JOB", "d", [], ["t", "u"], None, None, 20), ("B", "JOB", "d", [], ["t"], None, None, 60), ("C", "JOB", "d", [], ["t"], None, None, None))
    wheel = ew.build(rows, signals(spark).table_meta, str(tmp_path / "wheel"), at("02:00"))
    first = wheel.tick(changes(spark, w_t=at("01:55"), w_u=at("01:50")), at("02:00"), 0)
    assert moved(first) == [("A", "FRESH", 0, at("02:10") + 1), ("B", "FRESH", 0, at("02:55") + 1), ("C", "UNCHECKED", 0, None)]
    nothing = changes(spark)
    assert moved(wheel.tick(nothing, at("02:10"), 1)) == []
    assert moved(wheel.tick(nothing, at("02:10") + 1, 2)) == [("A", "STALE", 1, at("02:15") + 1)]
    again = wheel.tick(nothing, at("02:30"), 3)
    assert moved(again) == [("A", "STALE", 2, None)]
    assert moved(wheel.tick(nothing, at("02:30"), 3)) == [("A", "STALE", 2, None)]  # a tick that is repeated says the same
    # an entry that a later refresh has overtaken moves nothing
    assert moved(wheel.tick(changes(spark, w_t=at("02:40"), w_u=at("02:41"), w_x=at("02:41")), at("02:45"), 4)) == [("A", "FRESH", 0, at("03:00") + 1)]
    assert moved(wheel.tick(nothing, at("02:56"), 5)) == []
    assert records(wheel.gate(spark), "entity_name", "verdict") == [("A", "FRESH"), ("B", "FRESH"), ("C", "UNCHECKED")]
    with pytest.raises(ValueError):
        wheel.tick(nothing, at("02:00"), 6)


def test_every_tick_is_the_batch_gate(spark, tmp_path):
    rng = random.Random(5)
    meta = [("t0", "i0", "MATERIALIZED_VIEW", "p", None), ("t1", "i1", "STREAMING_TABLE", "p", None), ("t2", "i2", "MANAGED", None, None)]
    job = {f"t{k}": ("JOB", "7") for k in range(5)}
    rows = tracker(spark, *[(f"E{k}", "JOB", "d", [], rng.sample([f"t{j}" for j in range(5)], rng.randint(0, 3)), ["t3"], job if k % 2 else None,
                             rng.choice([5, 15, 60, None])) for k in range(30)])
    start = at("01:00")
    history = [(f"t{rng.randrange(5)}", k, start + rng.randrange(120) * MINUTE, rng.choice(["WRITE", "OPTIMIZE"]), {}) for k in range(25)]
    events = [(f"i{rng.randrange(2)}", "flow_progress", rng.choice(["COMPLETED", "FAILED"]), start + rng.randrange(120) * MINUTE) for _ in range(15)]
    runs = [(7, k, start + 10 * k * MINUTE, start + (10 * k + rng.randrange(30)) * MINUTE, "SUCCESS", "TERMINATED") for k in range(9)]
    wheel = ew.build(rows, signals(spark, meta=meta).table_meta, str(tmp_path / "wheel"), start, slot_rows=8)
    assert wheel.n_slots > 1
    last = 0
    for number, now in enumerate(start + m * MINUTE for m in (0, 40, 41, 120)):
        upto = signals(spark, meta=meta, history=[h for h in history if h[2] <= now], runs=[r for r in runs if r[3] <= now],
                       events=[e for e in events if e[3] <= now])
        new = signals(spark, history=[h for h in history if last < h[2] <= now])
        done = relation(spark, schemas.PIPELINE_EVENTS, [e for e in events if last < e[3] <= now])
        jobs = upto.job_success if any(last < r[3] <= now for r in runs) else upto.job_success.limit(0)
        wheel.tick(ew.write_changes(new.last_write).unionByName(ew.completion_changes(sig.events_completion(done))).unionByName(ew.job_changes(jobs)), now, number)
        batch = gates.group_verdict(freshness.source_status(rows, upto, now))
        assert records(wheel.gate(spark), "entity_name", "verdict", "n_stale") == records(batch, "entity_name", "verdict", "n_stale")
        last = now


def opened(path, number):
    """Slots that a tick has rewritten, and buckets that are left."""
    return (len(list(path.glob(f"rows/slot=*/version={number}"))), len(list(path.glob(f"values/slot=*/version={number}"))))


def test_work_of_a_tick_does_not_follow_the_groups(spark, tmp_path):
    found = []
    for n in (40, 320):
        path = tmp_path / f"wheel-{n}"
        rows = tracker(spark, *[(f"E{k}", "JOB", "d", [], [f"t{k}"], None, None, 20) for k in range(n)])
        wheel = ew.build(rows, signals(spark).table_meta, str(path), at("02:00"), slot_rows=10)
        assert wheel.n_slots == n // 10
        wheel.tick(changes(spark, **{f"w_t{k}": at("01:50") + (k > 0) * 5 * MINUTE for k in range(n)}), at("02:00"), 0)
        assert moved(wheel.tick(changes(spark, w_t3=at("02:10")), at("02:12"), 1)) == [("E0", "STALE", 1, None)]
        found.append(opened(path, 1))
    assert found[0][1] == found[1][1] == 1 and max(f[0] for f in found) <= 2


def test_clock_stream(spark, tmp_path):
    rows = tracker(spark, ("A", "JOB", "d", [], ["t"], None, None, 20))
    wheel = ew.build(rows, signals(spark).table_meta, str(tmp_path / "wheel"), at("02:00"))
    state, source, clock = str(tmp_path / "state"), f"{tmp_path}/in", iter([at("02:00"), at("02:21"), at("02:22"), at("02:50")])
    run = ew.on_clock(spark, wheel, state, lambda: next(clock))

    def feed(commit):
        relation(spark, schemas.TABLE_HISTORY, [commit]).coalesce(1).write.mode("append").parquet(source)
        history = spark.readStream.schema(schemas.TABLE_HISTORY).parquet(source)
        rs.track_refreshes(history, state, f"{tmp_path}/cp", compact_every=1, availableNow=True).awaitTermination()

    feed(("t", 1, at("01:59"), "WRITE", {}))
    trigger = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).load()
    for _ in range(2):  # one batch of the clock each; nothing is written between them
        trigger.writeStream.foreachBatch(run).option("checkpointLocation", f"{tmp_path}/clock").trigger(once=True).start().awaitTermination()
    assert records(wheel.moved(spark), "now_ms", "verdict") == [(at("02:00"), "FRESH"), (at("02:21"), "STALE")]
    for minute in range(2, 7):  # so many that the first ones are only in a snapshot
        feed(("t", minute, at(f"02:2{minute}"), "WRITE", {}))
    run(None, 2)
    assert records(wheel.gate(spark), "verdict", "stale_at_ms") == [("FRESH", at("02:46") + 1)]
    run(None, 3)
    assert records(wheel.gate(spark), "verdict") == [("STALE",)]
