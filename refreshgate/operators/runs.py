"""Entities and their runs: name resolution, latest run, previous successful run, and what is due."""
from pyspark.sql import Column, DataFrame, functions as F

from refreshgate.functions.times import utc_text
from refreshgate.operators.signals import ACTIVE_PIPELINE_STATES, FINAL_RUN_STATES, newest_runs, run_of, run_place, start_of

# fixed values: life cycle states of a run that is still going to finish
ACTIVE_RUN_STATES = ("PENDING", "QUEUED", "RUNNING", "BLOCKED", "WAITING_FOR_RETRY", "TERMINATING")
ENTITY_TYPES = ("JOB", "PIPELINE")


def named_entities(jobs: DataFrame, pipelines: DataFrame) -> DataFrame:
    """Every job and pipeline: entity_type, entity_name, entity_id."""
    job = jobs.select(F.lit("JOB").alias("entity_type"), F.col("name").alias("entity_name"),
                      F.col("job_id").cast("string").alias("entity_id"))
    pipeline = pipelines.select(F.lit("PIPELINE").alias("entity_type"), F.col("name").alias("entity_name"),
                                F.col("pipeline_id").alias("entity_id"))
    return job.unionByName(pipeline)


def resolve_names(entities: DataFrame, jobs: DataFrame, pipelines: DataFrame) -> DataFrame:
    """Exact, unique name match of each (entity_type, entity_name): its id, or an error with the number found.

    The ids behind an ambiguous name are `name_matches`, as rows: a name may be used any number of times.
    """
    wanted = entities.select("entity_type", "entity_name").distinct()
    found = (named_entities(jobs, pipelines).groupBy("entity_type", "entity_name")
             .agg(F.count("*").alias("n_found"), F.min("entity_id").alias("entity_id")))
    matched = wanted.join(found, ["entity_type", "entity_name"], "left")
    count = F.coalesce("n_found", F.lit(0).cast("bigint"))
    error = F.concat(F.lit("expected exactly 1 "), "entity_type", F.lit(" named '"), "entity_name", F.lit("', found "),
                     count.cast("string"))
    return matched.select("entity_type", "entity_name", F.when(count == 1, F.col("entity_id")).alias("entity_id"),
                          count.alias("n_found"), F.when(count != 1, error).alias("error"))


def name_matches(entities: DataFrame, jobs: DataFrame, pipelines: DataFrame) -> DataFrame:
    """Every id that bears the name of a wanted entity."""
    wanted = entities.select("entity_type", "entity_name").distinct()
    return named_entities(jobs, pipelines).join(wanted, ["entity_type", "entity_name"], "left_semi")


def run_state(job_runs: DataFrame, pipelines: DataFrame, pipeline_updates: DataFrame) -> DataFrame:
    """(entity_type, entity_id) -> is it active, and the start and id of its latest run or update, whatever its result."""
    job = (job_runs.groupBy("job_id").agg(
        F.bool_or(~F.col("life_cycle_state").isin(*FINAL_RUN_STATES)).alias("active"),
        F.max("start_ms").alias("latest_start_ms"), F.max(run_place()).alias("latest"))
        .select(F.lit("JOB").alias("entity_type"), F.col("job_id").cast("string").alias("entity_id"),
                F.coalesce("active", F.lit(False)).alias("active"), "latest_start_ms", run_of("latest").cast("string").alias("latest_id")))
    update = (pipeline_updates.where(F.col("creation_ms").isNotNull())
              .groupBy("pipeline_id").agg(F.max(F.struct("creation_ms", "update_id")).alias("latest")))
    pipeline = (pipelines.join(update, "pipeline_id", "left")
                .select(F.lit("PIPELINE").alias("entity_type"), F.col("pipeline_id").alias("entity_id"),
                        F.coalesce(F.col("state").isin(*ACTIVE_PIPELINE_STATES), F.lit(False)).alias("active"),
                        F.col("latest.creation_ms").alias("latest_start_ms"),
                        F.col("latest.update_id").alias("latest_id")))
    return job.unionByName(pipeline)


def decide(groups: DataFrame, states: DataFrame) -> DataFrame:
    """Add `action` and `reason` to rows that carry entity_type, entity_id and newest_refresh_ms.

    SKIP when the latest run started at or after the newest refresh, whatever its result; else QUEUE when a run is
    active, else LAUNCH.
    """
    rows = groups.join(states, ["entity_type", "entity_id"], "left")
    return rows.withColumn("action", _action()).withColumn("reason", _reason())


def _action() -> Column:
    return (F.when(F.col("latest_start_ms") >= F.col("newest_refresh_ms"), "SKIP")
            .when(F.col("active"), "QUEUE").otherwise("LAUNCH"))


def _reason() -> Column:
    # fixed values: the texts, here and in `resolve_names` and `already_processed`
    run = F.concat(F.lit("run "), F.coalesce("latest_id", F.lit("None")))
    refresh = utc_text(F.col("newest_refresh_ms"))
    started = utc_text(F.col("latest_start_ms"))
    skip = F.concat(run, F.when(F.col("active"), " (in progress)").otherwise(" (finished)"), F.lit(" started "), started,
                    F.lit(", after the newest source refresh "), refresh)
    queue = F.concat(run, F.lit(" in progress started "), started, F.lit(", before the newest source refresh "), refresh)
    return F.when(F.col("action") == "SKIP", skip).when(F.col("action") == "QUEUE", queue).otherwise("")


def previous_runs(job_runs: DataFrame, pipeline_updates: DataFrame, current_runs: DataFrame | None = None,
                  depth: int | None = None) -> DataFrame:
    """(entity_type, entity_id) -> the latest run that succeeded or is still going, other than the current one.

    Of a job, among its newest `depth` runs if that is given; of a pipeline, any update that has not failed or been
    cancelled.
    `current_runs` holds the (job_id, run_id) that ask; failed and cancelled runs are passed over.
    """
    runs = newest_runs(job_runs, depth)
    if current_runs is not None:
        runs = runs.join(current_runs.select("job_id", "run_id"), ["job_id", "run_id"], "left_anti")
    counts = (F.col("result_state") == "SUCCESS") | (
        F.col("result_state").isNull() & F.col("life_cycle_state").isin(*ACTIVE_RUN_STATES))
    state = F.coalesce("result_state", "life_cycle_state").alias("prev_state")
    # runs are first reduced by hash to one row per job and state; only those few are compared as structs
    per_state = runs.where(F.col("start_ms").isNotNull() & counts).groupBy("job_id", state).agg(F.max(run_place()).alias("place"))
    job = (per_state.withColumns({"start_ms": start_of("place"), "run_id": run_of("place")})
           .groupBy("job_id").agg(F.max(F.struct("start_ms", "run_id", "prev_state")).alias("run"))
           .select(F.lit("JOB").alias("entity_type"), F.col("job_id").cast("string").alias("entity_id"),
                   F.col("run.start_ms").alias("prev_start_ms"), F.col("run.run_id").cast("string").alias("prev_id"),
                   "run.prev_state"))
    kept = F.col("creation_ms").isNotNull() & ~F.coalesce(F.col("state").isin("FAILED", "CANCELED"), F.lit(False))
    pipeline = (pipeline_updates.where(kept).groupBy("pipeline_id")
                .agg(F.max(F.struct("creation_ms", "update_id", "state")).alias("run"))
                .select(F.lit("PIPELINE").alias("entity_type"), F.col("pipeline_id").alias("entity_id"),
                        F.col("run.creation_ms").alias("prev_start_ms"), F.col("run.update_id").alias("prev_id"),
                        F.col("run.state").alias("prev_state")))
    return job.unionByName(pipeline)


def already_processed(gate: DataFrame, resolved: DataFrame, previous: DataFrame) -> DataFrame:
    """Passed gates -> RUN, or ALREADY_PROCESSED when the previous run started at or after the newest refresh;
    ERROR when the name does not resolve."""
    keys = ["entity_type", "entity_name"]
    rows = (gate.where(F.col("passed")).select(*keys, "newest_refresh_ms")
            .join(resolved.select(*keys, "entity_id", "error"), keys, "left")
            .join(previous, ["entity_type", "entity_id"], "left"))
    verdict = (F.when(F.col("entity_id").isNull(), "ERROR")
               .when(F.col("prev_start_ms") >= F.col("newest_refresh_ms"), "ALREADY_PROCESSED").otherwise("RUN"))
    label = F.concat(F.col("entity_type"), F.lit(" '"), F.col("entity_name"), F.lit("'"))
    start, newest = utc_text(F.col("prev_start_ms")), utc_text(F.col("newest_refresh_ms"))
    detail = (F.when(F.col("entity_id").isNull(), F.col("error"))
              .when(F.col("prev_start_ms").isNull(),
                    F.concat(F.lit("No previous successful run of "), label, F.lit(": not processed yet.")))
              .when(F.col("verdict") == "ALREADY_PROCESSED",
                    F.concat(F.lit("Already processed: previous successful run "), "prev_id", F.lit(" ("),
                             F.coalesce("prev_state", F.lit("None")), F.lit(") of "), label, F.lit(" started "), start,
                             F.lit(", after the newest source refresh "), newest, F.lit(".")))
              .otherwise(F.concat(F.lit("Not processed yet: previous successful run "), "prev_id", F.lit(" started "), start,
                                  F.lit(", before the newest source refresh "), newest, F.lit("."))))
    return rows.withColumn("verdict", verdict).withColumn("detail", detail).select(
        *keys, "entity_id", "newest_refresh_ms", "prev_start_ms", "prev_id", "prev_state", "verdict", "detail")
