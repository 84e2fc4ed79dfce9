import random

from pyspark.sql import functions as F

from helpers import at, records, relation, signals, tracker
from refreshgate.operators import freshness, gates, intervals
from refreshgate.streaming import expiry_wheel as ew

MINUTE = 60_000
LINKS, REFRESHES = ew.LINKS, ew.CHANGES


def test_spans_of_literal_refreshes(spark):
    refreshes = relation(spark, REFRESHES, [("a", 0), ("a", 5), ("a", 5), ("a", 40), ("b", 3), ("b", 14), ("z", 1)])
    links = relation(spark, LINKS, [(1, 0, "a", 10), (2, 0, "a", 35), (3, 0, "a", 10), (3, 1, "b", 10), (4, 0, "a", 10), (4, 0, "b", 10), (5, 0, "none", 9)])
    for chunk in (1, 7, 1000):
        found = intervals.fresh_intervals(refreshes, links, chunk)
        # one source; a wider window; two sources; a source with two subjects; a source that nothing refreshes
        assert records(found, "row_id", "from_ms", "until_ms") == [(1, 0, 16), (1, 40, 51), (2, 0, 76), (3, 3, 16), (4, 0, 25), (4, 40, 51)]


def test_as_of_is_the_gate_at_each_instant(spark):
    rng = random.Random(6)
    rows = tracker(spark, *[(f"E{k}", "JOB", "d", [], rng.sample([f"t{j}" for j in range(4)], rng.randint(0, 3)), ["t3"], None, rng.choice([5, 15, 60, None]))
                            for k in range(25)])
    start = at("01:00")
    history = [(f"t{rng.randrange(4)}", k, start + rng.randrange(90) * MINUTE + rng.randrange(2), rng.choice(["WRITE", "OPTIMIZE"]), {}) for k in range(40)]
    written = relation(spark, REFRESHES, [(f"w:{h[0]}", h[2]) for h in history if h[3] == "WRITE"])
    meta = signals(spark).table_meta
    spans = intervals.fresh_intervals(written, ew.gate_links(rows, meta), 10 * MINUTE)
    checked = F.col("window_mins").isNotNull() & (F.size("tables") > 0)
    groups = freshness.tracker_rows(rows).select("row_id", "entity_name", checked.alias("checked"))
    times = [start + m * MINUTE + 1 for m in (-1, 3, 30, 31, 100)]
    found = intervals.gate_as_of(groups, spans, times)
    for now in times:
        batch = gates.group_verdict(freshness.source_status(rows, signals(spark, history=[h for h in history if h[2] <= now]), now))
        assert records(found.where(F.col("now_ms") == now), "entity_name", "verdict") == records(batch, "entity_name", "verdict")
