import random

import pytest

from helpers import at, records, relation, signals, tracker
from refreshgate.operators import gates
from refreshgate.operators.freshness import source_status, status_text
from refreshgate.operators.gates import entity_gate, gate_lines, group_verdict

NOW = at("03:00")
TABLE = "c.s.t"
META = [(TABLE, "tid", "STREAMING_TABLE", "p1", None)]
WRITE = [(TABLE, 1, at("01:00"), "MERGE", {"numOutputRows": "4"})]
FLOW = [("p1", "f", TABLE)]


def done(clock):
    return [("p1", "f", "u1", "COMPLETED", 5, 0, 0, at(clock))]


def one(spark, now=NOW, window=20, refreshed=None, producers=None, **kw):
    rows = tracker(spark, ("J", "JOB", "daily", ["c.s.out"], [TABLE], None, producers, window))
    now_tables = refreshed and relation(spark, "table_name string", [(t,) for t in refreshed])
    return source_status(rows, signals(spark, **kw), now, now_tables).first()


def test_refreshed_now_counts_as_now_but_keeps_the_completion(spark):
    s = one(spark, meta=META, history=WRITE, definitions=FLOW, progress=done("02:00"), refreshed=[TABLE])
    assert (s.refreshed_at_ms, s.is_fresh, s.data_refreshed_at_ms) == (NOW, True, at("02:00"))
    assert s.basis == "refreshed by calling upstream job, no rows changed in window" and s.met_without_row_changes


def test_refreshed_now_without_a_logged_completion(spark):
    s = one(spark, meta=META, history=WRITE, refreshed=[TABLE])
    assert s.data_refreshed_at_ms == NOW


def test_stale(spark):
    s = one(spark, meta=META, history=WRITE, definitions=FLOW, progress=done("02:00"))
    assert (s.refreshed_at_ms, s.data_refreshed_at_ms, s.is_fresh, s.basis) == (at("02:00"), at("02:00"), False, None)


def test_fresh_exactly_at_the_cutoff(spark):
    s = one(spark, meta=META, history=[(TABLE, 1, at("02:40"), "MERGE", {})])
    assert s.is_fresh and s.basis == "data write" and not s.met_without_row_changes
    assert not one(spark, meta=META, history=[(TABLE, 1, at("02:40") - 1, "MERGE", {})]).is_fresh


def test_epoch_cutoff(spark):
    s = one(spark, now=1791800000000, window=60)
    assert s.cutoff_ms == at("09:13:20") and s.refreshed_at_ms is None and not s.is_fresh


def test_producers(spark):
    runs = [(7, 70, at("02:30"), at("02:50"), "SUCCESS", "TERMINATED")]
    job = one(spark, runs=runs, producers={TABLE: ("JOB", "7")})
    assert (job.producer_type, job.signal, job.success_ms, job.basis) == (
        "JOB", "job run 70", at("02:50"), "producer run, no rows changed")
    assert one(spark, runs=runs, producers={TABLE: ("JOB", "8")}).signal == "no successful job run found"
    ignored = one(spark, runs=runs, producers={TABLE: ("PIPELINE", "p9")})
    assert (ignored.producer_type, ignored.producer_id, ignored.signal) == ("NONE", None, None)
    owned = one(spark, meta=META, runs=runs, producers={TABLE: ("JOB", "7")})
    assert (owned.producer_type, owned.producer_id) == ("PIPELINE", "p1")


def test_unreadable_history_keeps_the_producer_signal(spark):
    s = one(spark, meta=META, history=WRITE, definitions=FLOW, progress=done("02:50"), errors=[(TABLE, "history failed: no access")])
    assert (s.last_write_ms, s.error, s.is_fresh) == (None, "history failed: no access", True)


def _text(spark, status_rows):
    return status_text(status_rows).first().description


def described(spark, refreshed=None, window=20, now=NOW, **kw):
    rows = tracker(spark, ("J", "JOB", "daily", [], [TABLE], None, None, window))
    now_tables = refreshed and relation(spark, "table_name string", [(t,) for t in refreshed])
    return _text(spark, source_status(rows, signals(spark, **kw), now, now_tables)).split("\n          ")


def test_text_of_a_table_refreshed_by_the_caller(spark):
    assert described(spark, meta=META, history=WRITE, definitions=FLOW, progress=done("02:59:30.250"), refreshed=[TABLE]) == [
        "MET (refreshed by calling upstream job, no rows changed in window) c.s.t: refreshed 0.0 min ago — refreshed_at "
        "2026-10-12 03:00:00.000 UTC >= cutoff 2026-10-12 02:40:00.000 UTC (now 2026-10-12 03:00:00.000 UTC − window 20 min)",
        "last write: MERGE at 2026-10-12 01:00:00.000 UTC (numOutputRows=4)",
        "producer: PIPELINE p1 ran successfully at 2026-10-12 03:00:00.000 UTC [refreshed by calling upstream job] — no write "
        "within the window (run changed no rows)",
        "data refreshed at 2026-10-12 02:59:30.250 UTC (producer's actual completion; a downstream run started after it "
        "already includes the data)"]


def test_text_of_a_materialized_view(spark):
    meta = [(TABLE, "tid", "MATERIALIZED_VIEW", "p1", None)]
    assert described(spark, meta=meta, history=WRITE, definitions=FLOW, progress=done("02:57:36"), window=10080) == [
        "MET (producer refresh) c.s.t: refreshed 2.4 min ago — refreshed_at 2026-10-12 02:57:36.000 UTC >= cutoff "
        "2026-10-05 03:00:00.000 UTC (now 2026-10-12 03:00:00.000 UTC − window 10080 min)",
        "last write: materialized view — no Delta history; refresh and rows from its producer pipeline",
        "producer: PIPELINE p1 refreshed it at 2026-10-12 02:57:36.000 UTC [pipeline event log, update u1: output_rows=5]"]


def test_text_of_a_table_never_refreshed(spark):
    assert described(spark, meta=META, errors=[(TABLE, "broken")]) == [
        "NOT MET c.s.t: refreshed never — cutoff 2026-10-12 02:40:00.000 UTC (now 2026-10-12 03:00:00.000 UTC − window 20 min)",
        "last write: none found", "producer: PIPELINE p1 — no completed pipeline run found", "error: broken"]


def test_text_of_a_table_without_producer(spark):
    assert described(spark, history=[(TABLE, 1, at("02:50"), "WRITE", None)]) == [
        "MET (data write) c.s.t: refreshed 10.0 min ago — refreshed_at 2026-10-12 02:50:00.000 UTC >= cutoff "
        "2026-10-12 02:40:00.000 UTC (now 2026-10-12 03:00:00.000 UTC − window 20 min)",
        "last write: WRITE at 2026-10-12 02:50:00.000 UTC (0 rows)", "producer: NONE"]


@pytest.fixture(scope="module")
def gate_groups(spark):
    rows = tracker(
        spark, ("A", "JOB", "daily", [], ["b", "a", "skipped", "b"], ["skipped"], None, 20),
        ("A", "JOB", None, [], ["ok"], None, None, 20), ("B", "JOB", "", [], ["ok"], None, None, 20),
        ("C", "JOB", "x", [], ["ok"], None, None, None), ("D", "JOB", "x", [], ["ok"], ["ok"], None, 5),
        ("E", "JOB", "x", [], ["quiet"], None, {"quiet": ("JOB", "7")}, 20))
    history = [("ok", 1, at("02:55"), "WRITE", {}), ("a", 1, at("01:00"), "WRITE", {}), ("skipped", 1, 0, "WRITE", {})]
    runs = [(7, 70, at("02:30"), at("02:50"), "SUCCESS", "TERMINATED")]
    return group_verdict(source_status(rows, signals(spark, history=history, runs=runs), NOW)).cache()


def test_group_verdicts(gate_groups):
    assert records(gate_groups, "entity_name", "src_group", "n_sources", "n_stale", "stale", "verdict") == [
        ("A", "daily", 3, 3, ["b", "a", "b"], "STALE"), ("A", "default", 1, 0, [], "FRESH"),
        ("B", "default", 1, 0, [], "FRESH"), ("C", "x", 1, 0, [], "UNCHECKED"), ("D", "x", 0, 0, [], "UNCHECKED"),
        ("E", "x", 1, 0, [], "FRESH")]


def test_gate_and_its_lines(spark, gate_groups):
    requested = relation(spark, "entity_type string, entity_name string", [("JOB", n) for n in "ABCDEZ"])
    got = {r.entity_name: (r.verdict, r.headline) for r in entity_gate(gate_groups, requested).collect()}
    assert got["A"] == ("FAILED", "Freshness check FAILED for JOB 'A':")
    assert got["B"] == ("PASSED", "Freshness check PASSED for JOB 'B': all 1 source group(s) fresh.")
    assert got["Z"] == ("ERROR", "No tracker row for JOB 'Z'")
    assert records(gate_lines(gate_groups), "entity_name", "kind", "line") == [
        ("A", "failure", "src_group 'daily': 3 of 3 source(s) not refreshed since 2026-10-12 02:40:00.000 UTC: ['b', 'a', 'b']"),
        ("C", "failure", "src_group 'x': refresh window is NULL or no source tables to check"),
        ("D", "failure", "src_group 'x': refresh window is NULL or no source tables to check"),
        ("E", "met by producer run without row changes", "quiet [x]")]
    assert records(gates.stale_report(gate_groups), "table_name") == [("a",), ("b",), ("b",)]


def test_matches_a_loop_over_tables_on_random_input(spark):
    rng = random.Random(7)
    tables = [f"c.s.t{i}" for i in range(12)]
    kinds = ["MATERIALIZED_VIEW", "MANAGED", None]
    meta = [(t, f"id-{t}", rng.choice(kinds), rng.choice(["p1", "p2", None, ""]), None) for t in tables[:10]]
    history = [(rng.choice(tables), i, NOW - rng.randrange(0, 9_000_000), rng.choice(["WRITE", "OPTIMIZE"]), {}) for i in range(30)]
    events = [(f"id-{rng.choice(tables)}", "flow_progress", rng.choice(["COMPLETED", "FAILED"]), NOW - rng.randrange(0, 9_000_000))
              for _ in range(20)]
    names = {t: rng.choice([t, t.split(".", 1)[1], t.split(".")[-1]]) for t in tables}
    definitions = [(p, f"f-{t}", names[t]) for t in tables for p in ("p1", "p2") if rng.random() < 0.7]
    progress = [(p, f"f-{rng.choice(tables)}", f"u{i % 9}", rng.choice(["COMPLETED", "RUNNING"]), 1, 0, 0,
                 NOW - rng.randrange(0, 9_000_000)) for i in range(40) for p in ("p1", "p2")]
    runs = [(1, i, NOW - i * 1_000_000, NOW - i * 1_000_000 + 400_000, rng.choice(["SUCCESS", "FAILED"]), "TERMINATED") for i in range(1, 9)]
    rows = [(f"E{i}", "JOB", "g", [], rng.sample(tables, 5), rng.sample(tables, 2),
             {t: ("JOB", rng.choice(["1", "2"])) for t in rng.sample(tables, 4)}, rng.choice([30, 60, 120])) for i in range(8)]
    refreshed = set(rng.sample(tables, 2))
    got = {(r.entity_name, r.table_name): (r.refreshed_at_ms, r.data_refreshed_at_ms, r.is_fresh, r.producer_type) for r in source_status(
        tracker(spark, *rows), signals(spark, meta, history, definitions, progress, runs, events), NOW,
        relation(spark, "table_name string", [(t,) for t in refreshed])).collect()}

    def latest(times):
        return max((t for t in times if t is not None), default=None)

    want = {}
    about = {m[0]: m for m in meta}
    for name, _, _, _, sources, skip, producers, window in rows:
        for t in sources:
            if t in skip:
                continue
            m = about.get(t, (t, None, None, None))
            write = None if m[2] == "MATERIALIZED_VIEW" else latest(h[2] for h in history if h[0] == t and h[3] == "WRITE")
            log = latest(p[7] for p in progress for d in definitions if m[3] and p[0] == d[0] == m[3] and p[1] == d[1]
                         and p[3] == "COMPLETED" and (d[2] == t or t.endswith("." + d[2])))
            kind, success, actual = "NONE", None, NOW
            if m[3]:
                kind = "PIPELINE"
                success = latest([log] + [e[3] for e in events if e[0] == m[1] and e[2] == "COMPLETED"])
                actual = log if log is not None else NOW
            elif t in producers:
                kind = "JOB"
                good = [r for r in runs if str(r[0]) == producers[t][1] and r[4] == "SUCCESS"]
                success = max(good, key=lambda r: r[2])[3] if good else None
            if t in refreshed:
                success = NOW
            at_ms = latest([write, success])
            data = latest([write, actual]) if t in refreshed else at_ms
            want[(name, t)] = (at_ms, data, at_ms is not None and at_ms >= NOW - window * 60_000, kind)
    assert got == want


def test_equal_rows_and_rows_that_differ_in_producers_are_judged_each(spark):
    same = ("A", "JOB", "d", [], ["s"], None, None, 60)
    rows = tracker(spark, same, same, ("A", "JOB", "d", [], ["s"], None, {"s": ("JOB", "1")}, 60), (None, "A", "JOB", [], ["s"], None, None, 60),
                   ("A", None, "JOB", [], ["s"], None, None, 60))
    groups = group_verdict(source_status(rows, signals(spark), at("03:00")))
    assert records(groups, "n_sources", "stale") == [(1, ["s"])] * 5
