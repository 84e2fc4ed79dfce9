"""Schemas of the relations the library reads and writes, as DDL. Times are UTC epoch milliseconds (`*_ms BIGINT`)."""
from pyspark.sql import DataFrame, SparkSession

PRODUCERS_TYPE = "map<string, struct<producer_type: string, producer_id: string>>"

# column -> (type, comment); one row per entity and source group
TRACKER_COLUMNS = {
    "entity_name": ("string", "Exact name of the job or pipeline that writes the target tables"),
    "entity_type": ("string", "JOB or PIPELINE"),
    "src_group": ("string", "Source group with its own sources and window; NULL or empty reads as default"),
    "target_tables": ("array<string>", "Final tables written by the entity"),
    "src_tables": ("array<string>", "Base tables feeding the targets, views expanded"),
    "src_tables_to_skip": ("array<string>", "Sources left out of the freshness check"),
    "src_table_producers": (PRODUCERS_TYPE, "Per source: PIPELINE, JOB or NONE and the producer id"),
    "refresh_window_btn_tables_in_mins": ("int", "Minutes a refresh stays fresh; NULL means the row cannot be checked"),
    "created_on": ("date", "Date the row was inserted"),
    "updated_on": ("date", "Date the row was last updated"),
    "created_by": ("string", "User who inserted the row"),
    "updated_by": ("string", "User who last updated the row"),
}
TRACKER = ", ".join(f"{name} {kind}" for name, (kind, _) in TRACKER_COLUMNS.items())

TABLE_HISTORY = (
    "table_name string, version bigint, ts_ms bigint, operation string, operation_metrics map<string,string>")
PIPELINE_EVENTS = "uc_table_id string, event_type string, status string, ts_ms bigint"
FLOW_DEFINITIONS = "pipeline_id string, flow_name string, dataset string"
FLOW_PROGRESS = (
    "pipeline_id string, flow_name string, update_id string, status string, "
    "output_rows bigint, upserted_rows bigint, deleted_rows bigint, ts_ms bigint")
TABLE_META = "table_name string, table_id string, table_type string, pipeline_id string, access string"
VIEW_DEPS = "view_name string, dep string"
TABLE_LINEAGE = (
    "workspace_id string, entity_type string, entity_id string, entity_run_id string, "
    "source_table_full_name string, target_table_full_name string, ts_ms bigint, event_date date")
JOB_RUNS = (
    "job_id bigint, run_id bigint, start_ms bigint, end_ms bigint, result_state string, life_cycle_state string")
PIPELINE_UPDATES = (
    "pipeline_id string, update_id string, state string, creation_ms bigint, "
    "refresh_selection array<string>, full_refresh_selection array<string>, cause string")
PIPELINES = "pipeline_id string, name string, state string, continuous boolean"
JOBS = "job_id bigint, name string"
JOB_TASKS = "job_id bigint, task_key string, pipeline_id string, python_file string, parameters array<string>"
ACTIVE_TASKS = "job_id bigint, run_id bigint, start_ms bigint, pipeline_id string, life_cycle_state string"
SCAN_ERRORS = "table_name string, error string"
CHECK_TICKS = "entity_name string, tick_id bigint, ts_ms bigint, result string"
REFRESH_STATE = (
    "table_name string, version bigint, ts_ms bigint, operation string, operation_metrics map<string,string>")


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """An empty input, for a signal that is not available."""
    return spark.createDataFrame([], schema)
