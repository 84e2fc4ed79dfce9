import datetime

import pytest

from helpers import records, relation, tracker
from refreshgate import schemas
from refreshgate.operators import tracker as ops
from refreshgate.sources import tracker as store


def test_candidates(spark):
    rows = tracker(
        spark, ("A", "JOB", "d", [], ["x", "y"], None, None, 5), ("B", "JOB", "d", [], ["x"], ["x"], None, 5),
        ("C", "PIPELINE", None, [], ["x", "z"], ["x"], None, 5), ("D", "JOB", "", [], None, None, None, 5),
        ("E", "PIPELINE", "d", [], ["y", "x"], ["x"], None, 5))
    refreshed = relation(spark, "table_name string", [("x",), ("y",), ("x",)])
    assert records(ops.candidates(rows, refreshed), "entity_name") == [("A",), ("E",)]
    assert records(ops.candidates(rows, refreshed, "PIPELINE"), "entity_name") == [("E",)]
    assert ops.candidates(rows, refreshed).columns == rows.columns


def test_candidates_of_any_type_and_repeated(spark):
    rows = tracker(spark, ("A", None, "d", [], ["x"], None, None, 5), ("A", "JOB", "d", [], ["x"], None, None, 5), ("A", "JOB", "d", [], ["x"], None, None, 5),
                   ("A", "JOB", "d", ["x"], None, None, None, 5), (None, None, None, [], ["x"], None, {"x": ("JOB", "1")}, None))
    got = ops.candidates(rows, relation(spark, "table_name string", [("x",)]))
    assert records(got, "entity_name", "entity_type") == [("A", "JOB"), ("A", "JOB"), ("A", None), (None, None)]


def test_select_rows(spark):
    rows = tracker(spark, *[(n, k, g, [], [], None, None, 5) for n, k, g in [("A", "JOB", None), ("A", "JOB", "w"), ("B", "PIPELINE", "w")]])
    assert ops.select_rows(rows, "JOB", "A").count() == 2
    assert ops.select_rows(rows, "JOB", "A", "default").count() == 1
    assert ops.select_rows(rows).count() == 3


INCOMING = f"entity_name string, entity_type string, src_group string, target_tables array<string>, src_tables array<string>, src_table_producers {schemas.PRODUCERS_TYPE}"


def test_upsert_keeps_and_inserts_and_is_idempotent(spark):
    old = tracker(spark, ("A", "JOB", None, ["old"], ["old"], ["s"], None, 99), ("B", "JOB", "w", ["b"], ["b"], None, None, None))
    new = relation(spark, INCOMING, [("A", "JOB", "default", ["t"], ["s", "u"], {"s": ("JOB", "1")}), ("C", "PIPELINE", "default", ["c"], [], {})])
    once = ops.upsert(old, new, "2026-10-12", "me")
    got = {r.entity_name: r for r in once.collect()}
    a = got["A"]
    assert (a.src_group, a.target_tables, a.src_tables, a.src_tables_to_skip, a.refresh_window_btn_tables_in_mins) == (
        None, ["t"], ["s", "u"], ["s"], 99)
    assert (a.created_by, a.updated_by, a.updated_on) == (None, "me", datetime.date(2026, 10, 12))
    assert (got["B"].target_tables, got["B"].updated_by) == (["b"], None)
    c = got["C"]
    assert (c.src_tables_to_skip, c.refresh_window_btn_tables_in_mins, c.created_by) == ([], 5, "me")
    assert records(ops.upsert(once, new, "2026-10-12", "me")) == records(once)
    assert once.columns == list(schemas.TRACKER_COLUMNS)


def test_upsert_rejects_duplicate_incoming_rows(spark):
    new = relation(spark, INCOMING, [("A", "JOB", "default", ["t"], [], {}), ("A", "JOB", "default", ["t2"], [], {})])
    with pytest.raises(Exception, match="duplicate incoming row for JOB 'A'"):
        ops.upsert(schemas.empty(spark, schemas.TRACKER), new, "2026-10-12", "me").collect()


EDITS = ("entity_name string, entity_type string, src_group string, seq bigint, action string, table_name string, "
         "producer_type string, producer_id string, window_mins int, new_name string")


def test_edits(spark):
    rows = tracker(spark, ("A", "JOB", "daily", ["t"], ["s", "s"], None, {"s": ("PIPELINE", "p")}, 5), ("A", "JOB", None, ["t"], ["s"], ["k"], None, 5),
                   ("B", "JOB", "daily", ["t"], ["s"], None, None, 5))
    edits = relation(spark, EDITS, [
        ("A", "JOB", "daily", 1, ops.ADD_SOURCE, "feed", "JOB", "123", None, None), ("A", "JOB", "daily", 2, ops.SET_PRODUCER, "s", "JOB", "4", None, None),
        ("A", "JOB", "daily", 3, ops.SET_PRODUCER, "s", "JOB", "456", None, None), ("A", "JOB", None, 4, ops.ADD_TARGET, "sink", None, None, None, None),
        ("A", "JOB", None, 5, ops.ADD_SKIP, "cal", None, None, None, None), ("A", "JOB", "daily", 6, ops.SET_WINDOW, None, None, None, 60, None),
        ("A", "JOB", "daily", 7, ops.ADD_SOURCE, "feed", None, None, None, None), ("A", "JOB", None, 8, ops.RENAME, None, None, None, None, "A2")])
    got = {(r.entity_name, r.src_group): r for r in ops.apply_edits(rows, edits, "2026-10-12", "me").collect()}
    daily, other = got[("A2", "daily")], got[("A2", None)]
    assert daily.src_tables == ["s", "feed"] and daily.refresh_window_btn_tables_in_mins == 60
    assert {k: tuple(v) for k, v in daily.src_table_producers.items()} == {"s": ("JOB", "456"), "feed": ("JOB", "123")}
    assert (daily.target_tables, daily.src_tables_to_skip) == (["t", "sink"], ["cal"])
    assert (other.src_tables, other.src_tables_to_skip, other.refresh_window_btn_tables_in_mins, other.src_table_producers) == (
        ["s"], ["k", "cal"], 5, None)
    assert (got[("B", "daily")].updated_by, daily.updated_by) == (None, "me")


def test_validate(spark):
    rows = tracker(spark, ("A", "JOB", None, [], ["s"], ["k", "k", "s"], None, 5), ("A", "JOB", "default", [], ["s"], None, None, None),
                   ("B", "TABLE", "x", [], ["s"], None, None, 5))
    assert records(ops.validate(rows), "entity_name", "issue", "detail") == [
        ("A", "duplicate key", "2"), ("A", "no source tables to check", ""), ("A", "skipped table not in src_tables", "k"),
        ("A", "window is NULL", ""), ("B", "unknown entity_type", "TABLE")]


def test_tracker_table_and_snapshot(spark, tmp_path):
    spark.sql(f"create database if not exists trk location '{tmp_path}/db'")
    listed = store.create_tracker(spark, "trk.entity_tracker")
    assert [r.col_name for r in listed.collect()] == list(schemas.TRACKER_COLUMNS)
    store.create_tracker(spark, "trk.entity_tracker")
    assert store.read_tracker(spark, "trk.entity_tracker").count() == 0
    rows = tracker(spark, ("A", "JOB", None, [], ["s"], None, None, 5))
    store.write_snapshot(rows, f"{tmp_path}/s1")
    assert spark.read.parquet(f"{tmp_path}/s1").count() == 1
    with pytest.raises(Exception, match="already exists"):
        store.write_snapshot(rows, f"{tmp_path}/s1")
    spark.sql("drop table trk.entity_tracker")


def test_merge_statement_parses(spark):
    parsed = spark._jsparkSession.sessionState().sqlParser().parsePlan(ops.merge_statement())
    assert "MergeIntoTable" in parsed.toString()
