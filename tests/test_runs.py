from helpers import at, records, relation
from refreshgate import schemas
from refreshgate.operators import runs

AFTER, BEFORE, REFRESH = at("03:00"), at("01:00"), at("02:00")


def job_runs(spark, *rows):
    return relation(spark, schemas.JOB_RUNS, [(j, r, start, None, result, life) for j, r, start, result, life in rows])


def no_updates(spark):
    return schemas.empty(spark, schemas.PIPELINE_UPDATES)


def test_previous_run(spark):
    rows = job_runs(
        spark, (1, 100, AFTER, None, "RUNNING"), (1, 99, AFTER, "CANCELED", "TERMINATED"), (1, 98, AFTER, "FAILED", "TERMINATED"),
        (1, 97, AFTER, "SUCCESS", "TERMINATED"),
        (2, 200, AFTER, None, "RUNNING"), (2, 199, AFTER, None, "RUNNING"),
        (3, 99, AFTER, None, "SKIPPED"), (3, 98, AFTER, None, "INTERNAL_ERROR"), (3, 97, BEFORE, "SUCCESS", "TERMINATED"),
        (4, 9, AFTER, "FAILED", "TERMINATED"), (5, 7, AFTER, None, "TERMINATING"))
    current = relation(spark, "job_id bigint, run_id bigint", [(1, 100), (2, 200)])
    got = runs.previous_runs(rows, no_updates(spark), current)
    assert records(got, "entity_id", "prev_id", "prev_state") == [
        ("1", "97", "SUCCESS"), ("2", "199", "RUNNING"), ("3", "97", "SUCCESS"), ("5", "7", "TERMINATING")]


def test_previous_run_with_and_without_a_limit(spark):
    rows = [(1, i, i, "SUCCESS" if i == 5 else "FAILED", "TERMINATED") for i in range(30)]
    rows += [(2, i, i, "SUCCESS" if i == 4 else "FAILED", "TERMINATED") for i in range(30)]
    found = job_runs(spark, *rows)
    assert records(runs.previous_runs(found, no_updates(spark)), "entity_id", "prev_id") == [("1", "5"), ("2", "4")]
    assert records(runs.previous_runs(found, no_updates(spark), depth=25), "entity_id", "prev_id") == [("1", "5")]


def test_previous_update(spark):
    updates = relation(spark, schemas.PIPELINE_UPDATES, [
        ("p", "u2", "FAILED", AFTER, None, None, None), ("p", "u1", "COMPLETED", REFRESH, None, None, None),
        ("q", "u3", None, BEFORE, None, None, None)])
    got = runs.previous_runs(schemas.empty(spark, schemas.JOB_RUNS), updates)
    assert records(got, "entity_id", "prev_id") == [("p", "u1"), ("q", "u3")]


def test_already_processed(spark):
    gate = relation(spark, "entity_type string, entity_name string, newest_refresh_ms bigint, passed boolean",
                    [("JOB", n, REFRESH, n != "F") for n in "ABCDEF"])
    resolved = relation(spark, "entity_type string, entity_name string, entity_id string, error string",
                        [("JOB", n, i, None) for n, i in zip("ABCDF", "12345")] + [("JOB", "E", None, "found 2")])
    rows = job_runs(spark, (1, 97, AFTER, "SUCCESS", "TERMINATED"), (2, 97, BEFORE, "SUCCESS", "TERMINATED"),
                    (3, 98, AFTER, "FAILED", "TERMINATED"), (3, 97, BEFORE, "SUCCESS", "TERMINATED"),
                    (4, 97, REFRESH, "SUCCESS", "TERMINATED"))
    got = runs.already_processed(gate, resolved, runs.previous_runs(rows, no_updates(spark)))
    assert records(got, "entity_name", "verdict") == [
        ("A", "ALREADY_PROCESSED"), ("B", "RUN"), ("C", "RUN"), ("D", "ALREADY_PROCESSED"), ("E", "ERROR")]
    texts = dict(got.select("entity_name", "detail").collect())
    assert texts["A"] == ("Already processed: previous successful run 97 (SUCCESS) of JOB 'A' started 2026-10-12 03:00:00.000 UTC, "
                          "after the newest source refresh 2026-10-12 02:00:00.000 UTC.")


def test_decide(spark):
    rows = job_runs(spark, (1, 7, AFTER, "FAILED", "TERMINATED"), (2, 7, BEFORE, None, "RUNNING"),
                    (3, 7, BEFORE, "SUCCESS", "TERMINATED"), (5, 7, REFRESH, None, "RUNNING"))
    pipes = relation(spark, schemas.PIPELINES, [("p", "P", "RUNNING", False), ("q", "Q", "IDLE", False)])
    updates = relation(spark, schemas.PIPELINE_UPDATES, [("p", "u1", "RUNNING", BEFORE, None, None, None)])
    groups = relation(spark, "entity_type string, entity_id string, newest_refresh_ms bigint",
                      [("JOB", i, REFRESH) for i in "12345"] + [("PIPELINE", i, REFRESH) for i in "pq"])
    got = runs.decide(groups, runs.run_state(rows, pipes, updates))
    assert records(got, "entity_id", "action") == [
        ("1", "SKIP"), ("2", "QUEUE"), ("3", "LAUNCH"), ("4", "LAUNCH"), ("5", "SKIP"), ("p", "QUEUE"), ("q", "LAUNCH")]
    reasons = dict(got.select("entity_id", "reason").collect())
    assert reasons["1"] == ("run 7 (finished) started 2026-10-12 03:00:00.000 UTC, after the newest source refresh "
                            "2026-10-12 02:00:00.000 UTC")
    assert reasons["p"] == ("run u1 in progress started 2026-10-12 01:00:00.000 UTC, before the newest source refresh "
                            "2026-10-12 02:00:00.000 UTC")
    assert reasons["3"] == ""


def test_names_must_be_unique(spark):
    jobs = relation(spark, schemas.JOBS, [(1, "A"), (2, "B"), (3, "B"), (4, "b")])
    pipes = relation(spark, schemas.PIPELINES, [("p", "A", "IDLE", False)])
    wanted = relation(spark, "entity_type string, entity_name string", [("JOB", "A"), ("JOB", "B"), ("PIPELINE", "A"), ("JOB", "X")])
    assert records(runs.resolve_names(wanted, jobs, pipes), "entity_type", "entity_name", "entity_id", "n_found", "error") == [
        ("JOB", "A", "1", 1, None), ("JOB", "B", None, 2, "expected exactly 1 JOB named 'B', found 2"),
        ("JOB", "X", None, 0, "expected exactly 1 JOB named 'X', found 0"), ("PIPELINE", "A", "p", 1, None)]
    assert records(runs.name_matches(wanted, jobs, pipes), "entity_id") == [("1",), ("2",), ("3",), ("p",)]
