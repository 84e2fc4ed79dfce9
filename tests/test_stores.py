import re
from datetime import date

from pyspark.sql import functions as F

from helpers import ms, records, relation
from refreshgate import schemas
from refreshgate.operators import signals as sig
from refreshgate.sources import platform, stores
from refreshgate.sources.fixtures import BASE_SCHEMAS, Fixtures

TODAY = ms("2024-03-01 00:00")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def lineage(spark, days):
    rows = [(w, "PIPELINE", "p", f"r{d}", f"s{k}", f"t{k}", ms(f"2024-02-{d:02d} 05:00"), date(2024, 2, d)) for d in days for k in range(3) for w in ("w1", "w2")]
    return relation(spark, schemas.TABLE_LINEAGE, rows)


def test_lineage_of_other_days_is_not_opened(spark, tmp_path):
    path = str(tmp_path / "lineage")
    raw = lineage(spark, range(1, 29))
    stores.store_lineage(raw, path)
    kept = stores.stored_lineage(spark, path, TODAY, 5, "w1")
    assert records(kept, *raw.columns) == records(platform.table_lineage(raw, TODAY, 5, "w1"), *raw.columns)
    assert re.search(r"PartitionFilters: \[[^\]]*event_date", plan_of(kept)) and "PushedFilters: []" in plan_of(kept)
    opened = set(re.findall(r"workspace_id=(\w+)/event_date=([\d-]+)", " ".join(r[0] for r in kept.select(F.input_file_name()).distinct().collect())))
    assert opened == {("w1", f"2024-02-{d}") for d in (25, 26, 27, 28)}
    stores.store_lineage(lineage(spark, [28]).where("source_table_full_name = 's1'"), path)  # a day given again
    assert stores.stored_lineage(spark, path, TODAY, 5, "w1").where("event_date = date'2024-02-28'").count() == 1
    assert stores.stored_lineage(spark, path, TODAY, 60, "w1").count() == 27 * 3 + 1
    days = relation(spark, "event_date date, why string", [(date(2024, 2, 3), "x"), (date(2024, 2, 3), "y")])
    some = stores.lineage_of_days(spark, path, days.where("why <> 'z'"))
    assert some.count() == 6 and "dynamicpruning" in plan_of(some).lower()


def test_a_small_day_is_one_file(spark, tmp_path):
    stores.store_lineage(lineage(spark, range(1, 29)), str(tmp_path / "lineage"))
    assert len(list(tmp_path.glob("lineage/*/*/*.parquet"))) == 28 * 2


def test_raw_lineage_is_one_scan(spark, tmp_path):
    items = [(o, p, s) for o in (1, 51, 7000) for p in (7, 8, 107, None) for s in (1, 4, 9)]
    relation(spark, BASE_SCHEMAS["lineitem"], items).write.parquet(str(tmp_path / "lineitem.parquet"))
    raw = Fixtures(spark, str(tmp_path)).raw_lineage
    assert plan_of(raw).count("Scan parquet") == 1
    # of the 18 rows whose source ends in 7, 6 are a pipeline's; each has two more copies, and those two beyond that
    assert raw.count() == 36 + 18 * 2 + 6 * 2 and raw.where("workspace_id = 'w-2'").count() == 18
    assert raw.where("source_table_full_name = target_table_full_name").count() == 6
    assert raw.where("source_table_full_name = 'main.demo.old' and event_date < date'2024-01-01'").count() == 18


def test_details_are_read_as_typed_leaves(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [("p", "2024-02-01 00:00:00", "flow_progress", ("f", "u"), '{"flow_progress": {"status": "COMPLETED", "metrics": {"num_output_rows": 7}}}'),
            ("p", "2024-01-01 00:00:00", "flow_progress", ("f", "u0"), '{"flow_progress": {"status": "RUNNING"}, "more": [1, 2]}'),
            ("p", "2024-01-01 00:00:00", "flow_definition", ("f", None), '{"flow_definition": {"output_dataset": "`a`.`b`"}}'),
            ("p", "2024-02-02 00:00:00", "flow_progress", ("f", "u1"), '{"flow_progress": {"status": "FAILED", "metrics": {"num_output_rows": "many"}}}'),
            ("p", "2024-02-02 00:00:00", "other", None, None)]
    log = relation(spark, "pipeline_id string, t string, event_type string, origin struct<flow_name: string, update_id: string>, details string", rows)
    log = log.withColumn("timestamp", F.to_timestamp("t")).drop("t")
    stores.store_event_log(log, path)
    since = ms("2024-01-15 00:00")
    found = stores.stored_flow_progress(spark, path, since)
    assert records(found, "update_id", "status", "output_rows", "upserted_rows", "ts_ms") == [
        ("u", "COMPLETED", 7, 0, ms("2024-02-01 00:00")), ("u1", "FAILED", 0, 0, ms("2024-02-02 00:00"))]
    plain = log.where("origin.update_id IS NULL OR origin.update_id <> 'u1'")  # without the count that is no number
    assert records(found.where("update_id = 'u'"), *found.columns) == records(platform.flow_progress(plain, since), *found.columns)
    assert records(stores.stored_flow_definitions(spark, path)) == records(platform.flow_definitions(plain)) == [("p", "f", "a.b")]
    spark.conf.set("spark.sql.maxMetadataStringLength", 5000)  # else the schema is cut off
    plan = plan_of(stores.stored_flow_progress(spark, path, since))
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    schema = re.search(r"ReadSchema: (.*)", plan)[1]
    assert "details" not in schema and "output_dataset" not in schema and "status" in schema
    assert "event_type" in re.search(r"PartitionFilters: \[(.*?)\]", plan)[1] and "GreaterThanOrEqual(timestamp" in plan
    stores.store_event_log(log.withColumn("details", F.parse_json("details")), str(tmp_path / "variant"))
    assert records(stores.stored_flow_progress(spark, str(tmp_path / "variant"), since), *found.columns) == records(found, *found.columns)


def test_signals_in_buckets_are_joined_without_a_shuffle(spark):
    history = relation(spark, schemas.TABLE_HISTORY, [(f"t{k}", 1, k, "WRITE", {}) for k in range(50)])
    meta = relation(spark, schemas.TABLE_META, [(f"t{k}", f"i{k}", "MANAGED", None, None) for k in range(40)])
    try:
        stores.store_signal(sig.last_write(history), "kept_last_write", 4)
        stores.store_signal(meta, "kept_meta", 4)
        both = spark.table("kept_meta").join(spark.table("kept_last_write").hint("merge"), "table_name")
        assert both.count() == 40
        assert "Exchange" not in plan_of(both) and "SortMergeJoin" in plan_of(both)
    finally:
        for name in ("kept_last_write", "kept_meta"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
