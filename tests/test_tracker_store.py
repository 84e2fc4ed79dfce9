import pytest

from helpers import records, relation, tracker
from refreshgate import schemas
from refreshgate.operators import tracker as tracker_ops
from refreshgate.sources import tracker_store as ts

INCOMING = "entity_name string, entity_type string, src_group string, target_tables array<string>, src_tables array<string>, " \
           f"src_table_producers {schemas.PRODUCERS_TYPE}"


def test_only_touched_slots_are_written(spark, tmp_path):
    rows = tracker(spark, *[(f"E{k}", "JOB", "default" if k % 2 else None, ["x"], [f"t{k}"], ["skip"], None, 30) for k in range(40)])
    store = ts.create_store(rows, str(tmp_path / "store"), 16)
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "store" / "rows").rglob("*.parquet")}
    before = files()
    incoming = relation(spark, INCOMING, [("E3", "JOB", "default", ["y"], ["a", "b"], {}), ("new", "JOB", "default", ["z"], [], {})])
    assert store.upsert(incoming, "2024-01-31", "me") == 1
    after = files()
    assert before.items() <= after.items()
    assert {p.parent.name for p in after.keys() - before.keys()} == {"version=1"} and len({p.parent for p in after.keys() - before.keys()}) <= 2
    want = tracker_ops.upsert(rows, incoming, "2024-01-31", "me")
    columns = [c for c in schemas.TRACKER_COLUMNS]
    assert records(store.read(spark), *columns) == records(want, *columns)
    assert records(store.read(spark, 0), *columns) == records(rows, *columns)
    more = relation(spark, INCOMING, [("E3", "JOB", "default", ["y2"], ["c"], {})])
    assert store.upsert(more, "2024-02-01", "you") == 2
    assert records(store.read(spark), *columns) == records(tracker_ops.upsert(want, more, "2024-02-01", "you"), *columns)


def test_a_concurrent_writer_is_refused(spark, tmp_path):
    rows = tracker(spark, *[(f"E{k}", "JOB", "default", ["x"], [f"t{k}"], None, None, 30) for k in range(6)])
    store = ts.create_store(rows, str(tmp_path / "store"), 4)
    incoming = relation(spark, INCOMING, [("E1", "JOB", "default", ["y"], ["a"], {})])
    base = store.version(spark)
    assert store.upsert(incoming, "2024-01-31", "first", base) == 1
    with pytest.raises(ts.ConcurrentUpdate):
        store.upsert(incoming, "2024-01-31", "second", base)
    # a writer that claims and dies blocks the next one until its claim is withdrawn; readers see nothing of it
    assert store._create(spark, "claims/version=2")
    store.slots.write(store.read(spark).limit(0).unionByName(rows.limit(1)), 2)
    with pytest.raises(ts.ConcurrentUpdate):
        store.upsert(incoming, "2024-01-31", "third")
    assert {r["updated_by"] for r in store.read(spark).where("entity_name = 'E1'").collect()} == {"first"}
    store.give_up(spark)
    assert store.upsert(incoming, "2024-01-31", "third") == 2
    assert records(store.read(spark).where("entity_name = 'E1'"), "updated_by") == [("third",)]
    assert store.read(spark).count() == 6
