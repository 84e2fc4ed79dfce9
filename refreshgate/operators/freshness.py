"""The freshness rule: every source of every tracker row against its window, in one plan.

A source is refreshed at the later of its last data write and its producer's last success, and is fresh when that is
not before `now - window`.
"""
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from refreshgate.functions.names import group_name, without
from refreshgate.functions.times import age_text, minutes_before, utc_text
from refreshgate.operators import signals as sig
from refreshgate.session import cut_lineage

# fixed values: this text and those of `basis` and `status_text`
REFRESHED_NOW = "refreshed by calling upstream job"
ROW_KEY = ("entity_name", "entity_type", "src_group", "row_id")
_LINE_BREAK = "\n          "


@dataclass(frozen=True)
class Signals:
    """Refresh signals of all tables and jobs."""
    table_meta: DataFrame
    last_write: DataFrame
    pipeline_success: DataFrame
    job_success: DataFrame
    scan_errors: DataFrame | None = None  # tables whose history cannot be read: table_name, error


def gather_signals(table_meta: DataFrame, table_history: DataFrame, flow_definitions: DataFrame, flow_progress: DataFrame,
                   job_runs: DataFrame, pipeline_events: DataFrame | None = None,
                   pipeline_updates: DataFrame | None = None, scan_errors: DataFrame | None = None,
                   tracker: DataFrame | None = None) -> Signals:
    """All signals; with `tracker`, of the tables, pipelines and jobs that its rows name, and no other.

    Histories are then narrowed by semi joins before they are aggregated; the names, and what is known of the tables, are
    written once, so that each history meets a table of known size. A materialized view has no history to read.
    """
    if tracker is None:
        return Signals(
            table_meta, sig.last_write(table_history),
            sig.pipeline_success(table_meta, pipeline_events, flow_definitions, flow_progress, pipeline_updates),
            sig.job_success(job_runs), scan_errors)
    names = cut_lineage(row_sources(tracker_rows(tracker)).where(F.col("table_name").isNotNull())
                        .select("table_name", "tracker_job").distinct())
    tables = names.select("table_name").distinct()
    meta = cut_lineage(table_meta.join(tables, "table_name", "left_semi"))
    views = meta.where(F.col("table_type") == sig.MATERIALIZED_VIEW).select("table_name")
    owned = sig.owned_by_pipeline(meta)
    pipelines, ids = owned.select("pipeline_id").distinct(), owned.select(F.col("table_id").alias("uc_table_id")).distinct()
    jobs = names.where(F.col("tracker_job").isNotNull()).select(
        F.col("tracker_job").try_cast("bigint").alias("job_id")).distinct()

    def of(rows, names, key):
        return None if rows is None else rows.join(names, key, "left_semi")

    return Signals(
        meta, sig.last_write(of(table_history, tables.join(views, "table_name", "left_anti"), "table_name")),
        sig.pipeline_success(meta, of(pipeline_events, ids, "uc_table_id"), of(flow_definitions, pipelines, "pipeline_id"),
                             of(flow_progress, pipelines, "pipeline_id"), of(pipeline_updates, pipelines, "pipeline_id")),
        sig.job_success(of(job_runs, jobs, "job_id")), scan_errors)


IDENTITY = ("entity_name", "entity_type", "src_group", "target_tables", "src_tables", "src_tables_to_skip", "src_table_producers",
            "refresh_window_btn_tables_in_mins")


def with_row_id(tracker: DataFrame) -> DataFrame:
    """Tracker rows with `row_id`: a hash of what the row says, NULLs included, and of its number among equal rows, so
    that every row is judged by itself and the ids are the same whenever they are worked out."""
    content = F.to_json(F.struct(*IDENTITY), {"ignoreNullFields": "false"})
    rows = tracker.withColumn("_content", F.xxhash64(content))
    equal = Window.partitionBy("entity_name", "_content").orderBy("entity_type")
    return rows.withColumn("row_id", F.xxhash64("_content", F.row_number().over(equal))).drop("_content")


def tracker_rows(tracker: DataFrame) -> DataFrame:
    """Tracker rows with a row id, the group named and the skipped sources taken out."""
    rows = tracker if "row_id" in tracker.columns else with_row_id(tracker)
    return rows.select(
        "entity_name", "entity_type", group_name(F.col("src_group")).alias("src_group"), "row_id",
        F.col("refresh_window_btn_tables_in_mins").alias("window_mins"), "target_tables", "src_tables",
        without(F.coalesce("src_tables", F.array().cast("array<string>")), F.col("src_tables_to_skip")).alias("tables"),
        "src_table_producers")


def row_sources(rows: DataFrame) -> DataFrame:
    """One row per tracker row and source, in order; a row without sources keeps one line with a NULL table."""
    producer = lambda t: F.try_element_at("src_table_producers", t)
    job = lambda t: F.when((producer(t)["producer_type"] == "JOB") & (producer(t)["producer_id"] != ""),
                           producer(t)["producer_id"])
    sources = F.transform("tables", lambda t: F.struct(t.alias("table_name"), job(t).alias("job_id")))
    return (rows.select(*ROW_KEY, "window_mins", F.posexplode_outer(sources).alias("pos", "source"))
            .select(*ROW_KEY, "window_mins", "pos", "source.table_name", F.col("source.job_id").alias("tracker_job")))


def resolve_producer(pipeline_id: Column, tracker_job: Column) -> tuple[Column, Column]:
    """(type, id): the pipeline that owns the table now, else the tracker's job, else NONE. A tracker entry of type
    PIPELINE never decides."""
    owned = pipeline_id.isNotNull() & (pipeline_id != "")
    kind = F.when(owned, "PIPELINE").when(tracker_job.isNotNull(), "JOB").otherwise("NONE")
    return kind, F.when(owned, pipeline_id).otherwise(tracker_job)


def table_signals(tables: DataFrame, signals: Signals, refreshed_now: DataFrame | None = None) -> DataFrame:
    """Everything known per table. `tables` holds each name once, so a source shared by many rows is looked up once;
    every join is on table_name, so the distinct's partitioning serves them all."""
    meta = signals.table_meta.select("table_name", "table_type", "pipeline_id")
    pipelines = signals.pipeline_success.select(
        "table_name", F.col("success_ms").alias("pipeline_ms"), F.col("signal").alias("pipeline_signal"), "log_ms")
    found = (tables.join(meta, "table_name", "left").join(signals.last_write, "table_name", "left")
             .join(pipelines, "table_name", "left"))
    if signals.scan_errors is None:
        found = found.withColumn("error", F.lit(None).cast("string"))
    else:
        found = found.join(signals.scan_errors.select("table_name", "error"), "table_name", "left")
    if refreshed_now is None:
        found = found.withColumn("refreshed_now", F.lit(False))
    else:
        marked = refreshed_now.select("table_name").distinct().withColumn("refreshed_now", F.lit(True))
        found = found.join(marked, "table_name", "left").withColumn(
            "refreshed_now", F.coalesce("refreshed_now", F.lit(False)))
    is_view = F.coalesce(F.col("table_type") == sig.MATERIALIZED_VIEW, F.lit(False))
    readable = ~is_view & F.col("error").isNull()
    return found.select(
        "table_name", "table_type", "pipeline_id", "pipeline_ms", "pipeline_signal", "log_ms", "refreshed_now",
        F.when(readable, F.col("last_write_ms")).alias("last_write_ms"),
        F.when(is_view, sig.MATERIALIZED_VIEW).when(readable, F.col("operation")).alias("operation"),
        F.when(readable, F.col("impacted")).alias("impacted"),
        F.when(~is_view, F.col("error")).alias("error"))


def source_status(tracker: DataFrame, signals: Signals, now_ms: int, refreshed_now: DataFrame | None = None) -> DataFrame:
    """One row per tracker row and source with its signals and verdict.

    `checked` is false for a row without a window, and for the single NULL-table line of a row without sources.
    `refreshed_now` names the tables the caller has just processed: they count as refreshed at `now_ms`.
    """
    sources = row_sources(tracker_rows(tracker))
    tables = sources.where(F.col("table_name").isNotNull()).select("table_name").distinct()
    known = table_signals(tables, signals, refreshed_now)
    kind, producer_id = resolve_producer(F.col("pipeline_id"), F.col("tracker_job"))
    rows = (sources.join(known, "table_name", "left")
            .withColumn("producer_type", kind).withColumn("producer_id", producer_id))
    # rows without a job producer get a key of their own, so that they do not all meet in one NULL partition
    jobs = signals.job_success.select(F.concat(F.lit("job "), F.col("job_id").cast("string")).alias("job_key"),
                                      F.col("done_ms").alias("job_ms"), F.col("run_id").alias("job_run"))
    job_key = F.when(F.col("producer_type") == "JOB", F.concat(F.lit("job "), "producer_id")).otherwise(
        F.concat_ws(" ", F.lit("none"), "entity_name", "src_group", "table_name"))
    rows = rows.withColumn("job_key", job_key).join(jobs, "job_key", "left")
    return with_verdict(rows, now_ms)


def with_verdict(rows: DataFrame, now_ms: int) -> DataFrame:
    """Apply the rule to rows that carry their signals."""
    now = F.lit(now_ms).cast("bigint")
    kind, last_write_ms, log_ms = F.col("producer_type"), F.col("last_write_ms"), F.col("log_ms")
    refreshed_now = F.coalesce("refreshed_now", F.lit(False))
    success = (F.when(refreshed_now, now).when(kind == "PIPELINE", F.col("pipeline_ms"))
               .when(kind == "JOB", F.col("job_ms")))
    signal = (F.when(refreshed_now, REFRESHED_NOW).when(kind == "PIPELINE", F.col("pipeline_signal"))
              .when((kind == "JOB") & F.col("job_run").isNotNull(), F.concat(F.lit("job run "), F.col("job_run").cast("string")))
              .when(kind == "JOB", sig.NO_JOB_RUN))
    completed = F.when(kind == "PIPELINE", F.coalesce(log_ms, now)).otherwise(now)
    rows = rows.select(
        *ROW_KEY, "pos", "table_name", "window_mins",
        (F.col("table_name").isNotNull() & F.col("window_mins").isNotNull()).alias("checked"),
        now.alias("now_ms"), minutes_before(now_ms, F.col("window_mins")).alias("cutoff_ms"),
        "last_write_ms", "operation", "impacted", "producer_type", "producer_id",
        success.alias("success_ms"), signal.alias("signal"),
        F.greatest(last_write_ms, success).alias("refreshed_at_ms"),
        F.when(refreshed_now, F.greatest(last_write_ms, completed))
        .otherwise(F.greatest(last_write_ms, success)).alias("data_refreshed_at_ms"), "error")
    rows = rows.withColumn("is_fresh", F.coalesce(F.col("refreshed_at_ms") >= F.col("cutoff_ms"), F.lit(False)))
    return rows.withColumn("basis", basis()).withColumn(
        "met_without_row_changes", F.coalesce(F.col("basis").contains("no rows changed"), F.lit(False)))


def basis() -> Column:
    """What made a fresh source meet its window."""
    return (F.when(~F.col("is_fresh"), F.lit(None).cast("string"))
            .when(F.col("last_write_ms") >= F.col("cutoff_ms"), "data write")
            .when(F.col("operation") == sig.MATERIALIZED_VIEW, "producer refresh")
            .when(F.col("signal") == REFRESHED_NOW, "refreshed by calling upstream job, no rows changed in window")
            .otherwise("producer run, no rows changed"))


def status_text(status: DataFrame) -> DataFrame:
    """`status` with `description`: the verdict, the comparison behind it, the last write and the producer."""
    def lit(text):
        return F.lit(text)

    col = F.col
    at = {name: utc_text(col(f"{name}_ms")) for name in
          ("now", "cutoff", "last_write", "success", "refreshed_at", "data_refreshed_at")}
    verdict = F.when(col("is_fresh"), F.concat(lit("MET ("), col("basis"), lit(")"))).otherwise("NOT MET")
    age = F.when(col("refreshed_at_ms").isNull(), "never").otherwise(
        F.concat(age_text(col("now_ms") - col("refreshed_at_ms")), lit(" ago")))
    compare = F.when(col("refreshed_at_ms").isNull(), F.concat(lit("cutoff "), at["cutoff"])).otherwise(
        F.concat(lit("refreshed_at "), at["refreshed_at"], F.when(col("is_fresh"), " >= ").otherwise(" < "),
                 lit("cutoff "), at["cutoff"]))
    first = F.concat(verdict, lit(" "), col("table_name"), lit(": refreshed "), age, lit(" — "), compare,
                     lit(" (now "), at["now"], lit(" − window "), col("window_mins").cast("string"), lit(" min)"))
    is_view = F.coalesce(col("operation") == sig.MATERIALIZED_VIEW, F.lit(False))
    write = (F.when(col("last_write_ms").isNotNull(),
                    F.concat(lit("last write: "), col("operation"), lit(" at "), at["last_write"], lit(" ("),
                             sig.rows_text(col("impacted")), lit(")")))
             .when(is_view, "last write: materialized view — no Delta history; refresh and rows from its producer pipeline")
             .otherwise("last write: none found"))
    who = F.concat(lit("producer: "), F.concat_ws(" ", "producer_type", "producer_id"))
    signal = F.concat(lit(" ["), col("signal"), lit("]"))
    only_run = (col("success_ms") >= col("cutoff_ms")) & (
        col("last_write_ms").isNull() | (col("last_write_ms") < col("cutoff_ms")))
    producer = (F.when(col("success_ms").isNull(),
                       F.concat(who, F.coalesce(F.concat(lit(" — "), col("signal")), lit(""))))
                .when(is_view, F.concat(who, lit(" refreshed it at "), at["success"], signal))
                .when(only_run, F.concat(who, lit(" ran successfully at "), at["success"], signal,
                                         lit(" — no write within the window (run changed no rows)")))
                .otherwise(F.concat(who, lit(" last success "), at["success"], signal)))
    data = F.when(col("data_refreshed_at_ms") != col("refreshed_at_ms"),
                  F.concat(lit("data refreshed at "), at["data_refreshed_at"],
                           lit(" (producer's actual completion; a downstream run started after it already includes the data)")))
    error = F.when(col("error").isNotNull(), F.concat(lit("error: "), col("error")))
    return status.where("checked").withColumn(
        "description", F.concat_ws(_LINE_BREAK, first, write, producer, data, error))
