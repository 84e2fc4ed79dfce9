"""Platform metadata kept so that later reads open only what they need: lineage by day, event logs by type with their details
as typed columns, and signals in buckets by table.

The readers give the canonical relations of `schemas`, as those of `platform` do for the raw tables.
"""
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from refreshgate.functions.times import timestamp_ms
from refreshgate.sources import platform

METRICS = ("num_output_rows", "num_upserted_rows", "num_deleted_rows")


def _write(rows: DataFrame, path: str, *by: str) -> None:
    """Replace the partitions that `rows` fill, one file per partition and task that holds a part of it."""
    (rows.write.partitionBy(*by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path))


# ---- lineage

def store_lineage(raw: DataFrame, path: str) -> None:
    """Keep raw lineage by workspace and day; days given again replace those kept. A day is sorted by target, so that row
    groups of other targets are passed over. Rows without a day go to a partition of their own, which no lookback reads.

    A day's rows are brought together and written by as many tasks as its size asks for (adaptive execution parts large days
    and puts small ones together), so that the files follow the data and not the number of days times that of tasks.
    """
    dealt = raw.hint("rebalance", F.col("workspace_id"), F.col("event_date"))
    _write(dealt.sortWithinPartitions("workspace_id", "event_date", "target_table_full_name"), path, "workspace_id", "event_date")


def stored_lineage(spark: SparkSession, path: str, today_ms: int, lookback_days: int, workspace_id: str) -> DataFrame:
    """Lineage of the `lookback_days` up to `today_ms`: files of other days and workspaces are not opened."""
    return platform.table_lineage(spark.read.parquet(path), today_ms, lookback_days, workspace_id)


def lineage_of_days(spark: SparkSession, path: str, days: DataFrame) -> DataFrame:
    """Lineage of the days in `days` (event_date); which files that means is found out when the query runs."""
    return spark.read.parquet(path).join(days.select("event_date").distinct(), "event_date", "left_semi")


# ---- event logs

def _shredded(event_log: DataFrame) -> Column:
    """What the readers take from `details`, each as a typed leaf; NULL where an event does not have it."""
    details = platform.details(event_log)

    def leaf(path: str, kind: str) -> Column:
        return F.try_variant_get(details, path, kind)

    metrics = F.struct(*[leaf(f"$.flow_progress.metrics.{m}", "bigint").alias(m) for m in METRICS])
    return F.struct(leaf("$.flow_progress.status", "string").alias("status"), metrics.alias("metrics"),
                    leaf("$.flow_definition.output_dataset", "string").alias("output_dataset"))


def store_event_log(event_log: DataFrame, path: str) -> None:
    """Keep an event log by event type, with the leaves of `details` that readers take as typed columns beside it.

    `details` is parsed here and never again; it stays for whoever needs the rest of it.
    """
    typed = event_log.withColumn("shredded", _shredded(event_log))
    _write(typed, path, "event_type")


def stored_flow_progress(spark: SparkSession, path: str, since_ms: int | None = None) -> DataFrame:
    """Progress rows of flows from the typed leaves alone."""
    rows = spark.read.parquet(path).where(F.col("event_type") == "flow_progress")
    if since_ms is not None:
        rows = rows.where(F.col("timestamp") >= F.timestamp_millis(F.lit(since_ms)))
    counts = [F.coalesce(f"shredded.metrics.{m}", F.lit(0).cast("bigint")).alias(name)
              for m, name in zip(METRICS, ("output_rows", "upserted_rows", "deleted_rows"))]
    return rows.select("pipeline_id", F.col("origin.flow_name").alias("flow_name"), F.col("origin.update_id").alias("update_id"),
                       F.col("shredded.status").alias("status"), *counts, timestamp_ms(F.col("timestamp")).alias("ts_ms"))


def stored_flow_definitions(spark: SparkSession, path: str) -> DataFrame:
    """Flow -> dataset it writes, from the typed leaf alone; never limited in time."""
    return spark.read.parquet(path).where(F.col("event_type") == "flow_definition").select(
        "pipeline_id", F.col("origin.flow_name").alias("flow_name"),
        F.replace(F.col("shredded.output_dataset"), F.lit("`"), F.lit("")).alias("dataset"))


# ---- signals

def store_signal(signal: DataFrame, table: str, n_buckets: int) -> None:
    """Keep a signal with a row per table_name as a catalog table in buckets. Two signals with as many buckets are joined
    by table_name without a shuffle."""
    signal.write.bucketBy(n_buckets, "table_name").sortBy("table_name").mode("overwrite").format("parquet").saveAsTable(table)
