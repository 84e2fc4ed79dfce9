"""Refresh signals: for every table, pipeline and job at once, when it was last written or last succeeded.

Raw events are reduced on the map side before any shuffle, so a table or pipeline that owns most of the events costs
no more than the others. Ties on time go to the higher version, update id or run id.
"""
from pyspark.sql import Column, DataFrame, Window, functions as F

from refreshgate.functions.names import dotted_suffixes, short_name

# fixed values: commit operations that write data
WRITE_OPERATIONS = (
    "WRITE", "MERGE", "DELETE", "UPDATE", "STREAMING UPDATE", "CREATE TABLE AS SELECT", "REPLACE TABLE AS SELECT",
    "CREATE OR REPLACE TABLE AS SELECT", "COPY INTO", "TRUNCATE", "DLT REFRESH")
# fixed values: commit metrics that count rows, in the order they are shown
ROW_METRICS = (
    "numOutputRows", "numTargetRowsInserted", "numTargetRowsUpdated", "numTargetRowsDeleted", "numUpdatedRows",
    "numDeletedRows", "numCopiedRows")
# fixed values: pipeline and update states
ACTIVE_PIPELINE_STATES = ("RUNNING", "STARTING", "DEPLOYING", "RESETTING")
FINAL_UPDATE_STATES = ("COMPLETED", "FAILED", "CANCELED")
FINAL_RUN_STATES = ("TERMINATED", "SKIPPED", "INTERNAL_ERROR")

MATERIALIZED_VIEW = "MATERIALIZED_VIEW"
EVENTS_SIGNAL = "pipeline_events system table"
NO_PIPELINE_RUN = "no completed pipeline run found"
NO_JOB_RUN = "no successful job run found"


def latest_write_row(table_history: DataFrame) -> DataFrame:
    """The last data-writing commit of each table, as a history row.

    One scan: the sort-based partial aggregate keeps one row per table and task, so raw history is never shuffled.
    """
    commit = F.struct("version", "ts_ms", "operation", "operation_metrics")
    return (table_history.where(F.col("operation").isin(*WRITE_OPERATIONS))
            .groupBy("table_name").agg(F.max_by(commit, F.struct("ts_ms", "version")).alias("commit"))
            .select("table_name", "commit.*"))


def impacted_rows(metrics: Column) -> Column:
    """The row metrics present and not "0", in their fixed order, as an array of (metric, rows)."""
    named = F.array(*[F.struct(F.lit(name).alias("metric"), metrics[name].alias("rows")) for name in ROW_METRICS])
    return F.filter(named, lambda m: m["rows"].isNotNull() & (m["rows"] != "0"))


def rows_text(impacted: Column) -> Column:
    """`numOutputRows=5, numUpdatedRows=2`, or `0 rows`."""
    shown = F.array_join(F.transform(impacted, lambda m: F.concat(m["metric"], F.lit("="), m["rows"])), ", ")
    return F.when(F.size(impacted) > 0, shown).otherwise("0 rows")


def last_write(table_history: DataFrame) -> DataFrame:
    """table_name -> last_write_ms, operation, impacted."""
    return latest_write_row(table_history).select(
        "table_name", F.col("ts_ms").alias("last_write_ms"), "operation",
        impacted_rows(F.col("operation_metrics")).alias("impacted"))


def events_completion(pipeline_events: DataFrame) -> DataFrame:
    """uc_table_id -> done_ms of its latest completed flow."""
    done = pipeline_events.where((F.col("event_type") == "flow_progress") & (F.col("status") == "COMPLETED")
                                 & F.col("uc_table_id").isNotNull())
    return done.groupBy("uc_table_id").agg(F.max("ts_ms").alias("done_ms"))


def dataset_completion(flow_definitions: DataFrame, flow_progress: DataFrame) -> DataFrame:
    """(pipeline_id, dataset) -> its latest completed update and the rows all its progress reported there.

    Progress is summed per flow and update before it meets the flow definitions: one scan, hash aggregation on
    numbers, and no join of raw events with themselves.
    """
    counts = ("output_rows", "upserted_rows", "deleted_rows")
    per_flow = flow_progress.groupBy("pipeline_id", "flow_name", "update_id").agg(
        F.max(F.when(F.col("status") == "COMPLETED", F.col("ts_ms"))).alias("done_ms"),
        *[F.sum(c).alias(c) for c in counts])
    flows = flow_definitions.where(F.col("dataset").isNotNull() & (F.col("dataset") != "")).distinct()
    per_update = (per_flow.join(flows, ["pipeline_id", "flow_name"])
                  .groupBy("pipeline_id", "dataset", "update_id")
                  .agg(F.max("done_ms").alias("done_ms"), *[F.sum(c).alias(c) for c in counts])
                  .where(F.col("done_ms").isNotNull()))
    # rows of an update without an id cannot be told apart, so they are not counted
    known = [F.when(F.col("update_id").isNotNull(), F.col(c)).alias(c) for c in counts]
    best = F.max_by(F.struct("done_ms", "update_id", *known), F.struct("done_ms", "update_id")).alias("best")
    return per_update.groupBy("pipeline_id", "dataset").agg(best).select("pipeline_id", "dataset", "best.*")


def dataset_matches(owned: DataFrame, datasets: DataFrame) -> DataFrame:
    """Tables of `owned` (table_name, pipeline_id) with every dataset of their pipeline that names them, in full or by
    a dotted suffix. The suffixes are exploded so that this is an equi join."""
    names = owned.select("table_name", "pipeline_id", F.explode(dotted_suffixes(F.col("table_name"))).alias("dataset"))
    return names.join(datasets, ["pipeline_id", "dataset"])


def flow_signal(update_id: Column, output_rows: Column, upserted_rows: Column, deleted_rows: Column) -> Column:
    """`pipeline event log, update u: output_rows=5`, naming the non-zero counts."""
    counts = {"output_rows": output_rows, "upserted_rows": upserted_rows, "deleted_rows": deleted_rows}
    shown = F.concat_ws(", ", *[F.when(c != 0, F.concat(F.lit(f"{name}="), c.cast("string")))
                                for name, c in counts.items()])
    return F.concat(F.lit("pipeline event log, update "), F.coalesce(update_id, F.lit("None")), F.lit(": "),
                    F.when(shown == "", "0 rows").otherwise(shown))


def newest_runs(job_runs: DataFrame, depth: int | None = None) -> DataFrame:
    """Each job's newest `depth` runs, all of them without a limit. The rank limit is applied before the shuffle too,
    so a job with most of the runs sends at most `depth` of them per task."""
    if depth is None:
        return job_runs
    newest = Window.partitionBy("job_id").orderBy(F.desc("start_ms"), F.desc("run_id"))
    return job_runs.withColumn("recency", F.row_number().over(newest)).where(F.col("recency") <= depth)


ID_RANGE = 10 ** 19  # more than any bigint run id


def run_place() -> Column:
    """(start_ms, run_id) as one number that sorts like the pair, a NULL id before all others, so that the latest run is a
    hash aggregate. NULL for a run that has not started."""
    start = F.col("start_ms").cast("decimal(18,0)") * F.lit(str(ID_RANGE)).cast("decimal(20,0)")
    return (start + F.coalesce(F.col("run_id").cast("decimal(19,0)") + 1, F.lit(0).cast("decimal(19,0)"))).cast("decimal(38,0)")


def run_of(place: str) -> Column:
    """The run id of a place, NULL if it has none."""
    rest = F.col(place) % F.lit(str(ID_RANGE)).cast("decimal(20,0)")
    return F.when(rest > 0, rest - 1).cast("bigint")


def start_of(place: str) -> Column:
    rest = F.col(place) % F.lit(str(ID_RANGE)).cast("decimal(20,0)")
    return ((F.col(place) - rest) / F.lit(str(ID_RANGE)).cast("decimal(20,0)")).cast("bigint")


def job_success(job_runs: DataFrame, depth: int | None = None) -> DataFrame:
    """job_id -> end and id of its newest successful run, among its newest `depth` completed runs if that is given."""
    completed = job_runs.where(F.col("life_cycle_state").isin(*FINAL_RUN_STATES)).select(
        "job_id", "run_id", "start_ms", "end_ms", "result_state")
    return (newest_runs(completed, depth).where(F.col("result_state") == "SUCCESS")
            .groupBy("job_id").agg(F.max_by("end_ms", run_place()).alias("done_ms"), F.max(run_place()).alias("place"))
            .select("job_id", "done_ms", run_of("place").alias("run_id")))


def update_scopes(pipeline_updates: DataFrame) -> DataFrame:
    """(pipeline_id, scope) -> start and id of the latest completed update of the whole pipeline (scope NULL) or of
    one selected name."""
    selection = F.concat(F.coalesce("refresh_selection", F.array().cast("array<string>")),
                         F.coalesce("full_refresh_selection", F.array().cast("array<string>")))
    scopes = F.when(F.size(selection) == 0, F.array(F.lit(None).cast("string"))).otherwise(F.array_distinct(selection))
    update = F.struct(F.col("creation_ms").alias("start_ms"), "update_id")
    return (pipeline_updates.where(F.col("state") == "COMPLETED")
            .select("pipeline_id", F.explode(scopes).alias("scope"), update.alias("update"))
            .groupBy("pipeline_id", "scope").agg(F.max("update").alias("update"))
            .select("pipeline_id", "scope", "update.*"))


def owned_by_pipeline(table_meta: DataFrame) -> DataFrame:
    """Tables a pipeline manages: table_name, pipeline_id, table_id."""
    return (table_meta.where(F.col("pipeline_id").isNotNull() & (F.col("pipeline_id") != ""))
            .select("table_name", "pipeline_id", "table_id"))


def pipeline_facts(owned: DataFrame, datasets: DataFrame | None = None, updates: DataFrame | None = None,
                   events: DataFrame | None = None) -> DataFrame:
    """What is known about each owned table: its latest flow (`log`), covering update (`covering`) and event (`events_ms`).

    A table is named differently by each signal: by full name or a dotted suffix in the event log, by full or short
    name or not at all in an update, by id in the events table. All names are looked up together, as exact keys, so
    this is one equi join and one aggregation however many signals there are. Each signal may be missing.
    """
    table = F.col("table_name")
    key = lambda kind, name: F.concat_ws(" ", F.lit(kind), name)
    look = lambda owner, kind, name: F.struct(owner.alias("owner"), key(kind, name).alias("lookup"))
    lookups = F.concat(
        F.transform(dotted_suffixes(table), lambda name: look(F.col("pipeline_id"), "log", name)),
        F.transform(F.array_distinct(F.array(table, short_name(table), F.lit(None).cast("string"))),
                    lambda name: look(F.col("pipeline_id"), "update", name)),
        F.array(look(F.lit(""), "events", F.col("table_id"))))
    wanted = owned.select("table_name", "pipeline_id", F.explode(lookups).alias("look")).select(
        "table_name", "pipeline_id", "look.*")
    none = {name: F.lit(None).cast(kind).alias(name) for name, kind in (
        ("ref", "string"), ("output_rows", "bigint"), ("upserted_rows", "bigint"), ("deleted_rows", "bigint"))}
    counts = ("output_rows", "upserted_rows", "deleted_rows")
    parts = []
    if datasets is not None:
        parts.append(datasets.select(
            F.col("pipeline_id").alias("owner"), key("log", F.col("dataset")).alias("lookup"), F.lit("log").alias("kind"),
            F.col("done_ms").alias("at_ms"), F.col("update_id").alias("ref"), *counts))
    if updates is not None:
        parts.append(updates.select(
            F.col("pipeline_id").alias("owner"), key("update", F.col("scope")).alias("lookup"), F.lit("update").alias("kind"),
            F.col("start_ms").alias("at_ms"), F.col("update_id").alias("ref"), *[none[c] for c in counts]))
    if events is not None:
        parts.append(events.select(
            F.lit("").alias("owner"), key("events", F.col("uc_table_id")).alias("lookup"), F.lit("events").alias("kind"),
            F.col("done_ms").alias("at_ms"), none["ref"], *[none[c] for c in counts]))
    facts = parts[0]
    for part in parts[1:]:
        facts = facts.unionByName(part)

    def newest(kind, *fields):
        return F.max(F.when(F.col("kind") == kind, F.struct("at_ms", "ref", *fields)))

    return wanted.join(facts, ["owner", "lookup"], "left").groupBy("table_name", "pipeline_id").agg(
        newest("log", "lookup", *counts).alias("log"), newest("update").alias("covering"),
        F.max(F.when(F.col("kind") == "events", F.col("at_ms"))).alias("events_ms"))


def flow_completion(flow_definitions: DataFrame, flow_progress: DataFrame, owned: DataFrame) -> DataFrame:
    """table_name -> done_ms, update_id and row counts of the latest completed flow that writes it."""
    facts = pipeline_facts(owned, datasets=dataset_completion(flow_definitions, flow_progress))
    return facts.where(F.col("log").isNotNull()).select(
        "table_name", "pipeline_id", F.col("log.at_ms").alias("done_ms"), F.col("log.ref").alias("update_id"),
        "log.output_rows", "log.upserted_rows", "log.deleted_rows")


def update_covering(pipeline_updates: DataFrame, owned: DataFrame) -> DataFrame:
    """table_name -> start of the latest completed update that covered it: a whole-pipeline update, or one that
    selected the table by full or short name. Updates are reduced per scope first, so no table meets all of them."""
    facts = pipeline_facts(owned, updates=update_scopes(pipeline_updates))
    return facts.where(F.col("covering").isNotNull()).select(
        "table_name", "pipeline_id", F.col("covering.at_ms").alias("start_ms"), F.col("covering.ref").alias("update_id"))


def pipeline_success(table_meta: DataFrame, pipeline_events: DataFrame | None, flow_definitions: DataFrame,
                     flow_progress: DataFrame, pipeline_updates: DataFrame | None) -> DataFrame:
    """table_name -> when its pipeline last processed it, the signal that says so, and the event log's own time.

    The later of the events table and the event log, the events table on a tie; updates only if both are silent.
    A signal that is not available is passed as None.
    """
    facts = pipeline_facts(
        owned_by_pipeline(table_meta), dataset_completion(flow_definitions, flow_progress),
        None if pipeline_updates is None else update_scopes(pipeline_updates),
        None if pipeline_events is None else events_completion(pipeline_events))
    events_ms, log_ms, log = F.col("events_ms"), F.col("log.at_ms"), F.col("log")
    by_events = events_ms.isNotNull() & (log_ms.isNull() | (events_ms >= log_ms))
    return facts.select(
        "table_name", "pipeline_id", F.coalesce(F.greatest(events_ms, log_ms), F.col("covering.at_ms")).alias("success_ms"),
        F.when(by_events, EVENTS_SIGNAL)
        .when(log_ms.isNotNull(), flow_signal(log["ref"], log["output_rows"], log["upserted_rows"], log["deleted_rows"]))
        .when(F.col("covering").isNotNull(),
              F.concat(F.lit("pipeline update "), F.col("covering.ref"), F.lit(" (start time)")))
        .otherwise(NO_PIPELINE_RUN).alias("signal"), log_ms.alias("log_ms"))


def running_producers(table_meta: DataFrame, pipelines: DataFrame, pipeline_updates: DataFrame) -> DataFrame:
    """table_name -> the update now in progress of the triggered pipeline that owns it, and its cause.

    Continuous pipelines always run, so they never count.
    """
    running = pipelines.where(F.col("state").isin(*ACTIVE_PIPELINE_STATES) & ~F.coalesce("continuous", F.lit(False)))
    newest = (pipeline_updates.where(~F.col("state").isin(*FINAL_UPDATE_STATES))
              .groupBy("pipeline_id")
              .agg(F.max(F.struct("creation_ms", "update_id", "cause")).alias("update"))
              .select("pipeline_id", "update.update_id", "update.cause"))
    return (owned_by_pipeline(table_meta).drop("table_id")
            .join(running.select("pipeline_id").distinct(), "pipeline_id", "left_semi")
            .join(newest, "pipeline_id").select("table_name", "pipeline_id", "update_id", "cause"))
