"""Platform metadata as it arrives -> the canonical relations of `schemas`.

Time limits are put on the raw timestamp column, so that they reach the file scan.
"""
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from refreshgate.functions.times import MS_PER_DAY, iso_ms, timestamp_ms

PRODUCER_LOOKBACK_DAYS = 31


def producer_since_ms(now_ms: int) -> int:
    return now_ms - PRODUCER_LOOKBACK_DAYS * MS_PER_DAY


def details(df: DataFrame) -> Column:
    """`details` as VARIANT, whether it is stored as VARIANT or as JSON text."""
    if isinstance(df.schema["details"].dataType, T.StringType):
        return F.parse_json("details")
    return F.col("details")


def table_history(raw: DataFrame) -> DataFrame:
    """Commit history of all tables: table_name, version, timestamp, operation, operationMetrics."""
    return raw.select("table_name", F.col("version").cast("bigint").alias("version"),
                      timestamp_ms(F.col("timestamp")).alias("ts_ms"), "operation",
                      F.col("operationMetrics").alias("operation_metrics"))


def pipeline_events(raw: DataFrame, since_ms: int | None = None) -> DataFrame:
    """Events of all pipelines: event_time, event_type, origin.uc_table_id, details."""
    if since_ms is not None:
        raw = raw.where(F.col("event_time") >= F.timestamp_millis(F.lit(since_ms)))
    return raw.select(F.col("origin.uc_table_id").alias("uc_table_id"), "event_type",
                      F.variant_get(details(raw), "$.flow_progress.status", "string").alias("status"),
                      timestamp_ms(F.col("event_time")).alias("ts_ms"))


def flow_definitions(event_log: DataFrame) -> DataFrame:
    """Flow -> dataset it writes, from the event log of all pipelines; never limited in time."""
    dataset = F.variant_get(details(event_log), "$.flow_definition.output_dataset", "string")
    return (event_log.where(F.col("event_type") == "flow_definition")
            .select("pipeline_id", F.col("origin.flow_name").alias("flow_name"),
                    F.replace(dataset, F.lit("`"), F.lit("")).alias("dataset")))


def flow_progress(event_log: DataFrame, since_ms: int | None = None) -> DataFrame:
    """Progress rows of flows, with the row counts each reported."""
    rows = event_log.where(F.col("event_type") == "flow_progress")
    if since_ms is not None:
        rows = rows.where(F.col("timestamp") >= F.timestamp_millis(F.lit(since_ms)))
    parsed = details(event_log)

    def count(metric):
        return F.coalesce(F.variant_get(parsed, f"$.flow_progress.metrics.{metric}", "bigint"),
                          F.lit(0).cast("bigint"))

    return rows.select(
        "pipeline_id", F.col("origin.flow_name").alias("flow_name"), F.col("origin.update_id").alias("update_id"),
        F.variant_get(parsed, "$.flow_progress.status", "string").alias("status"),
        count("num_output_rows").alias("output_rows"), count("num_upserted_rows").alias("upserted_rows"),
        count("num_deleted_rows").alias("deleted_rows"), timestamp_ms(F.col("timestamp")).alias("ts_ms"))


def pipeline_updates(raw: DataFrame) -> DataFrame:
    """Updates with `creation_time` as ISO text -> `creation_ms`."""
    return raw.withColumn("creation_ms", iso_ms(F.col("creation_time"))).drop("creation_time")


def table_lineage(raw: DataFrame, today_ms: int | None = None, lookback_days: int | None = None,
                  workspace_id: str | None = None) -> DataFrame:
    """Lineage, of the `lookback_days` up to `today_ms` if they are given; `event_date` is the partition column, so old
    partitions are not read then."""
    rows = raw
    if lookback_days is not None:
        rows = raw.where(F.col("event_date") >= F.date_sub(F.lit("1970-01-01").cast("date"),
                                                           -(today_ms // MS_PER_DAY) + lookback_days))
    if workspace_id is not None:
        rows = rows.where(F.col("workspace_id") == workspace_id)
    if "ts_ms" not in raw.columns:
        rows = rows.withColumn("ts_ms", timestamp_ms(F.col("event_time"))).drop("event_time")
    return rows


def job_tasks(raw: DataFrame) -> DataFrame:
    """Job definitions with a nested `tasks` array -> one row per task."""
    return (raw.select("job_id", F.explode("tasks").alias("task"))
            .select("job_id", "task.task_key", "task.pipeline_id", "task.python_file", "task.parameters"))


def active_tasks(raw: DataFrame) -> DataFrame:
    """Active runs with a nested `tasks` array -> one row per running pipeline task."""
    return (raw.select("job_id", "run_id", "start_ms", F.explode("tasks").alias("task"))
            .select("job_id", "run_id", "start_ms", "task.pipeline_id", "task.life_cycle_state")
            .where(F.col("pipeline_id").isNotNull()))
