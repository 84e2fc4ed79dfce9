import random
from statistics import median_low

from helpers import records, relation, tracker
from refreshgate import schemas
from refreshgate.operators import monitor

HOUR = 3_600_000


def test_streaks_match_a_scan_per_entity(spark):
    rng = random.Random(5)
    ticks = [(rng.choice(["hot", "hot", "hot", "b", "c"]), i, rng.randrange(0, 40 * HOUR), rng.choice(["FAILED", "FAILED", "SUCCESS"]))
             for i in range(600)]
    want = []
    for name in {t[0] for t in ticks}:
        run = []
        for t in sorted((t for t in ticks if t[0] == name), key=lambda t: (t[2], t[1])) + [(name, -1, None, "SUCCESS")]:
            if t[3] == "FAILED":
                run.append(t[2])
            elif run:
                want.append((name, len(run), run[0], run[-1]))
                run = []
    df = relation(spark, schemas.CHECK_TICKS, ticks)
    for chunk in (HOUR, 7 * HOUR, 1_000):
        assert records(monitor.failure_streaks(df, chunk)) == sorted(want, key=repr)
    assert records(monitor.consecutive_failures(df, 4)) == sorted([w for w in want if w[1] >= 4], key=repr)


def test_no_success(spark):
    ticks = relation(spark, schemas.CHECK_TICKS, [("a", 1, 10 * HOUR, "SUCCESS"), ("b", 2, 4 * HOUR, "SUCCESS"), ("b", 3, 9 * HOUR, "FAILED"),
                                                  ("c", 4, 9 * HOUR, "FAILED")])
    assert records(monitor.no_success_for(ticks, 12 * HOUR, 5)) == [("b", 4 * HOUR, 2), ("c", None, 1)]


def test_gaps(spark):
    rng = random.Random(6)
    history = [(rng.choice("tu"), i, rng.randrange(0, 200 * HOUR), rng.choice(["WRITE", "OPTIMIZE"]), {}) for i in range(300)]
    rows = tracker(spark, ("A", "JOB", None, [], ["t", "t", "z"], None, None, 60), ("B", "JOB", None, [], ["u"], None, None, None))
    at = sorted(h[2] for h in history if h[0] == "t" and h[3] == "WRITE")
    gaps = [b - a for a, b in zip(at, at[1:])]
    got = monitor.refresh_gaps(rows, relation(spark, schemas.TABLE_HISTORY, history))
    assert records(got, "entity_name", "table_name", "n_gaps", "median_gap_ms", "max_gap_ms", "window_below_max") == [
        ("A", "t", len(gaps), median_low(gaps), max(gaps), 60 * 60_000 < max(gaps))]


def test_the_median_is_exact_for_any_number_of_gaps(spark):
    rng = random.Random(9)
    gaps = [("t", rng.randrange(0, 10 ** 7)) for _ in range(3000)] + [("u", 5)] * 4 + [("u", 7)] * 4 + [("w", 1)]
    got = records(monitor.gap_summary(relation(spark, "table_name string, gap_ms bigint, n bigint", [(*g, 1) for g in gaps])), "table_name", "n_gaps", "max_gap_ms", "median_gap_ms")
    assert got == [(t, len(own), max(own), median_low(own)) for t in "tuw" for own in [[g for k, g in gaps if k == t]]]
