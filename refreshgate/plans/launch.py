"""The dry-run launch plan: what would be launched for a set of refreshed tables, in which order, and why not."""
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from refreshgate.functions.names import entity_key, list_text, name_list, option_value, truthy
from refreshgate.operators import freshness, gates, runs, signals as sig, tracker as tracker_ops
from refreshgate.plans import ordering
from refreshgate.session import cut_lineage

# fixed values: states of a task that is still going to run, and statuses that fail a launch
ACTIVE_TASK_STATES = ("PENDING", "QUEUED", "RUNNING", "BLOCKED", "WAITING_FOR_RETRY")
FAILING = ("FAILED", "NOT_FOUND")
# fixed values as well: the texts of details, handoffs, waits and notes in this module
WAITING = "WAITING_ON_UPSTREAM"
ROW = ["entity_key", "src_group", "row_id"]


@dataclass(frozen=True)
class Platform:
    """What the platform knows about jobs and pipelines now."""
    job_runs: DataFrame
    jobs: DataFrame
    job_tasks: DataFrame
    active_tasks: DataFrame
    pipelines: DataFrame
    pipeline_updates: DataFrame


def launch_task_params(job_tasks: DataFrame, launch_script: str) -> DataFrame:
    """The launch tasks among all tasks: job_id, tables, covers (ALL or a type), dry_run.

    A task without --dry_run is a dry run, and so is one whose value is still a `{{...}}` reference.
    """
    params = F.coalesce("parameters", F.array().cast("array<string>"))
    dry_run = F.coalesce(option_value(params, "--dry_run"), F.lit("true"))
    return job_tasks.where(F.col("python_file").endswith(launch_script)).select(
        "job_id", name_list(F.coalesce(option_value(params, "--src_tables"), F.lit(""))).alias("tables"),
        F.upper(F.coalesce(option_value(params, "--entity_type"), F.lit("ALL"))).alias("covers"),
        (dry_run.contains("{{") | truthy(dry_run)).alias("dry_run"))


def handoff_tables(job_tasks: DataFrame, launch_script: str) -> DataFrame:
    """(job_id, entity_type, table_name): the job's own live launch task launches readers of the table of that type."""
    live = launch_task_params(job_tasks, launch_script).where(~F.col("dry_run"))
    types = F.when(F.col("covers") == "ALL", F.array(*[F.lit(t) for t in runs.ENTITY_TYPES])).otherwise(F.array("covers"))
    return (live.select(F.col("job_id").cast("string").alias("job_id"), F.explode(types).alias("entity_type"), "tables")
            .select("job_id", "entity_type", F.explode("tables").alias("table_name")).distinct())


def jobs_running_pipelines(active_tasks: DataFrame) -> DataFrame:
    """pipeline_id -> the job whose newest active run has a running task for it."""
    return (active_tasks.where(F.col("life_cycle_state").isin(*ACTIVE_TASK_STATES) & F.col("pipeline_id").isNotNull())
            .groupBy("pipeline_id").agg(F.max(F.struct("start_ms", "run_id", "job_id")).alias("run"))
            .select("pipeline_id", F.col("run.job_id").cast("string").alias("job_id")))


def row_status(groups: DataFrame, resolved: DataFrame, states: DataFrame) -> DataFrame:
    """Groups with entity_id, action and reason, and `status` where the row is settled before planning."""
    keys = ["entity_type", "entity_name"]
    rows = groups.join(resolved.select(*keys, "entity_id", F.col("error").alias("name_error")), keys, "left")
    rows = runs.decide(rows, states)
    known_type = F.col("entity_type").isin(*runs.ENTITY_TYPES)
    status = (F.when(~known_type | (F.col("verdict") != "FRESH"), "SKIPPED").when(F.col("entity_id").isNull(), "NOT_FOUND")
              .when(F.col("action") == "SKIP", "ALREADY_HANDLED"))
    detail = (F.when(~known_type, F.concat(F.lit("unknown entity_type '"), "entity_type", F.lit("'")))
              .when(F.col("verdict") == "UNCHECKED", gates.UNCHECKABLE)
              .when(F.col("verdict") == "STALE", F.concat(F.lit("stale sources: "), list_text(F.col("stale"))))
              .when(F.col("entity_id").isNull(), F.coalesce(F.col("name_error"), F.lit("entity not found")))
              .when(F.col("action") == "SKIP", F.col("reason")))
    no_change = F.when(F.size("no_change") > 0, F.concat(
        F.lit("met by producer run without row changes: "), list_text(F.col("no_change"))))
    reason = F.concat_ws("; ", F.when(F.col("reason") != "", F.col("reason")), no_change)
    return rows.withColumn("status", status).withColumn("detail", detail).withColumn("reason", reason)


def _row_upstreams(planned: DataFrame, sources: DataFrame, kept: DataFrame, handoffs: DataFrame) -> DataFrame:
    """(row, upstream, table) along kept dependencies, with whether the upstream's launch task covers the table."""
    found = (sources.join(kept.withColumnRenamed("entity", "entity_key"), ["entity_key", "table_name"])
             .select(*ROW, "entity_type", "table_name", "upstream", "upstream_level"))
    ids = planned.select(F.col("entity_key").alias("upstream"), F.col("entity_type").alias("upstream_type"),
                         F.col("entity_name").alias("upstream_name"), F.col("entity_id").alias("upstream_id")).distinct()
    covered = handoffs.select(F.col("job_id").alias("upstream_id"), "entity_type", "table_name",
                              F.lit("JOB").alias("upstream_type"), F.lit(True).alias("hands_off"))
    return (found.join(ids, "upstream")
            .join(covered, ["upstream_id", "upstream_type", "entity_type", "table_name"], "left")
            .withColumn("hands_off", F.coalesce("hands_off", F.lit(False))))


def _row_producers(sources: DataFrame, running: DataFrame, handoffs: DataFrame, running_jobs: DataFrame) -> DataFrame:
    """(row, table) whose owner pipeline is running, with whether the job running it hands the row off."""
    busy = running.join(running_jobs, "pipeline_id", "left").withColumn(
        "job_id", F.when(F.col("cause") == "JOB_TASK", F.col("job_id")))
    covered = handoffs.withColumn("hands_off", F.lit(True))
    return (sources.select(*ROW, "entity_type", "table_name").join(busy, "table_name")
            .join(covered, ["job_id", "entity_type", "table_name"], "left")
            .select(*ROW, "table_name", "pipeline_id", "update_id", "job_id",
                    F.coalesce("hands_off", F.lit(False)).alias("hands_off")))


def _uncovered(producers: DataFrame, upstreams: DataFrame, launching: DataFrame) -> DataFrame:
    """Per row and running update, its first table by name that no upstream launched here refreshes."""
    covered = upstreams.join(launching.select(F.col("entity").alias("upstream")), "upstream", "left_semi").select(
        *ROW, "table_name").distinct()
    left = producers.join(covered, ROW + ["table_name"], "left_anti")
    return (left.groupBy(*ROW, "pipeline_id", "update_id")
            .agg(F.min(F.struct("table_name", "hands_off", "job_id")).alias("first"))
            .select(*ROW, "pipeline_id", "update_id", "first.*"))


def launching_entities(planned: DataFrame, upstreams: DataFrame, producers: DataFrame) -> DataFrame:
    """Planned entities with a row that does not wait for another task: (entity).

    A row whose upstream hands it off always waits. Of the others, only one with a running producer that might hand it
    off depends on whether its upstreams launch; just those entities are settled round by round, along the kept
    dependencies.
    """
    rows = planned.select(*ROW)
    handed = upstreams.where("hands_off").select(*ROW).distinct()
    open_rows = rows.join(handed, ROW, "left_anti")
    doubtful = producers.where("hands_off").select(*ROW).distinct()
    sure = open_rows.join(doubtful, ROW, "left_anti").select(F.col("entity_key").alias("entity")).distinct()
    unsure = cut_lineage(open_rows.join(doubtful, ROW, "left_semi").join(
        sure, F.col("entity_key") == F.col("entity"), "left_anti"))
    launching = cut_lineage(sure)
    if unsure.isEmpty():
        return launching
    busy = producers.select(*ROW, "table_name").distinct()
    needs = cut_lineage(upstreams.select(*ROW, "table_name", "upstream").join(unsure, ROW, "left_semi")
                        .join(busy, ROW + ["table_name"], "left_semi").select(*ROW, "upstream").distinct())
    runs_now = cut_lineage(producers.join(unsure, ROW, "left_semi"))
    shared = cut_lineage(upstreams.join(unsure, ROW, "left_semi").select(*ROW, "table_name", "upstream"))
    while not unsure.isEmpty():
        open_entities = unsure.select(F.col("entity_key").alias("upstream")).distinct()
        held = needs.join(open_entities, "upstream", "left_semi").select(*ROW).distinct()
        settled = unsure.join(held, ROW, "left_anti")
        waiting = _uncovered(runs_now, shared, launching).where("hands_off").select(*ROW).distinct()
        going = settled.join(waiting, ROW, "left_anti").select(F.col("entity_key").alias("entity")).distinct()
        # an entity that launches by one row is settled as a whole; otherwise only its settled rows are
        rest = unsure.join(settled, ROW, "left_anti").join(going, F.col("entity_key") == F.col("entity"), "left_anti")
        unsure, launching = cut_lineage(rest), cut_lineage(launching.unionByName(going).distinct())
    return launching


def plan_rows(planned: DataFrame, sources: DataFrame, targets: DataFrame, platform: Platform, table_meta: DataFrame,
              launch_script: str) -> DataFrame:
    """Planned rows with their dry-run status and detail.

    planned: ROW, entity_type, entity_name, entity_id, action, reason. sources: ROW, entity_type, table_name of each
    planned row. targets: (entity, table_name) of the planned entities.
    """
    planned, sources = cut_lineage(planned), cut_lineage(sources)
    entities = planned.select(F.col("entity_key").alias("entity")).distinct()
    edges = cut_lineage(ordering.entity_edges(
        sources.select(F.col("entity_key").alias("entity"), "table_name"), targets))
    levels, dropped = ordering.arrange(entities, edges)
    levels = cut_lineage(levels)
    kept = ordering.kept_edges(edges, levels, dropped)
    handoffs = handoff_tables(platform.job_tasks, launch_script)
    upstreams = cut_lineage(_row_upstreams(planned, sources, kept, handoffs))
    running = sig.running_producers(table_meta, platform.pipelines, platform.pipeline_updates)
    producers = cut_lineage(_row_producers(sources, running, handoffs, jobs_running_pipelines(platform.active_tasks)))
    launching = launching_entities(planned, upstreams, producers)

    ahead = _upstream_steps(upstreams, launching)
    behind = _producer_steps(_uncovered(producers, upstreams, launching))
    rows = (planned.join(levels.withColumnRenamed("entity", "entity_key"), "entity_key")
            .join(ahead, ROW, "left").join(behind, ROW, "left"))
    waiting = F.coalesce("upstream_handoff", "producer_handoff")
    none = F.array().cast("array<string>")
    rows = rows.withColumn("handoff", waiting).withColumn("waits", F.concat(
        F.coalesce("upstream_waits", none), F.coalesce("producer_waits", none)))
    acting = (rows.where(F.col("handoff").isNull()).groupBy("entity_type", "entity_id")
              .agg(F.min(F.struct("src_group", "row_id")).alias("acting")))
    rows = rows.join(acting, ["entity_type", "entity_id"], "left")
    acts = F.struct("src_group", "row_id") == F.col("acting")
    status = (F.when(F.col("handoff").isNotNull(), WAITING).when(acts, F.concat(F.lit("DRY_RUN_"), "action"))
              .otherwise("ALREADY_HANDLED"))
    once = F.concat(F.lit("covered by the run launched for src_group '"), F.col("acting.src_group"), F.lit("'"))
    detail = F.when(F.col("handoff").isNotNull(), F.col("handoff")).when(acts, _dry_run_text()).otherwise(once)
    return rows.withColumn("status", status).withColumn("detail", detail)


def _dry_run_text() -> Column:
    act = F.concat(F.lower("action"), F.lit(" "), "entity_type", F.lit(" id="), "entity_id")
    reason = F.concat_ws("; ", F.when(F.col("reason") != "", F.col("reason")), F.array_join("notes", "; "))
    notes = F.when(F.size(F.coalesce("notes", F.array().cast("array<string>"))) > 0, reason).otherwise(F.col("reason"))
    what = F.when(F.size("waits") > 0, F.concat(F.lit("would wait for "), F.array_join("waits", "; "),
                                                F.lit(", re-check the sources, then "), act)).otherwise(
        F.concat(F.lit("would "), act))
    return F.concat(what, F.when(notes != "", F.concat(F.lit(" ("), notes, F.lit(")"))).otherwise(""))


def _upstream_steps(upstreams: DataFrame, launching: DataFrame) -> DataFrame:
    """Per row: the handoff to its first upstream that takes it, else what it waits for, and notes. Lists are no
    longer than the upstreams of the row's own sources."""
    marked = launching.select(F.col("entity").alias("upstream"), F.lit(True).alias("launches"))
    pairs = (upstreams.groupBy(*ROW, "upstream", "upstream_level", "upstream_type", "upstream_name")
             .agg(F.array_sort(F.collect_set("table_name")).alias("shared"), F.bool_or("hands_off").alias("hands_off"))
             .join(marked, "upstream", "left").withColumn("launches", F.coalesce("launches", F.lit(False))))
    shared, name = list_text(F.col("shared")), F.concat(F.lit("'"), F.col("upstream_name"), F.lit("'"))
    who = F.concat("upstream_type", F.lit(" "), name, F.lit(" (refreshes "), shared, F.lit(")"))
    takes = F.when(F.col("launches"), F.concat(
        F.lit("sources "), shared, F.lit(" are being refreshed by job "), name,
        F.lit(" launched in this task; its launch task launches this entity"))).otherwise(F.concat(
            F.lit("sources "), shared, F.lit(" are refreshed later by job "), name,
            F.lit(" (itself waiting on its upstream); its launch task launches this entity")))
    note = F.concat(who, F.lit(" is waiting on its upstream and has no launch task for this entity: "
                               "launched on its current data"))
    place = (F.col("upstream_level"), F.col("upstream"))

    def texts(condition, text):
        picked = F.array_sort(F.collect_list(F.when(condition, F.struct(*place, text.alias("text")))))
        return F.transform(picked, lambda p: p["text"])

    return pairs.groupBy(*ROW).agg(
        F.min_by(takes, F.when(F.col("hands_off"), F.struct(*place))).alias("upstream_handoff"),
        texts(F.col("launches") & ~F.col("hands_off"), who).alias("upstream_waits"),
        texts(~F.col("launches") & ~F.col("hands_off"), note).alias("notes"))


def _producer_steps(first_tables: DataFrame) -> DataFrame:
    """Per row: the handoff of its first source by name whose running producer hands it off, else the waits."""
    takes = F.concat(F.lit("source "), "table_name", F.lit(" is being refreshed by job "), "job_id",
                     F.lit(", whose launch task launches this entity"))
    wait = F.concat(F.lit("pipeline "), "pipeline_id", F.lit(" update "), "update_id", F.lit(" (running, refreshes "),
                    "table_name", F.lit(")"))
    picked = F.array_sort(F.collect_list(F.struct("table_name", wait.alias("text"))))
    return first_tables.groupBy(*ROW).agg(
        F.min_by(takes, F.when(F.col("hands_off"), F.col("table_name"))).alias("producer_handoff"),
        F.transform(picked, lambda p: p["text"]).alias("producer_waits"))


def launch_plan(tracker: DataFrame, refreshed: DataFrame, signals: freshness.Signals, platform: Platform, now_ms: int,
                launch_script: str, entity_type: str = "ALL") -> DataFrame:
    """One row per tracker row downstream of `refreshed`: its status and detail, upstream-first by `level`."""
    chosen = tracker_ops.candidates(tracker, refreshed, entity_type).withColumn(
        "entity_type", F.upper(F.coalesce("entity_type", F.lit(""))))
    status = freshness.source_status(chosen, signals, now_ms, refreshed)
    groups = gates.group_verdict(status)
    resolved = runs.resolve_names(groups, platform.jobs, platform.pipelines)
    states = runs.run_state(platform.job_runs, platform.pipelines, platform.pipeline_updates)
    rows = row_status(groups, resolved, states).withColumn(
        "entity_key", entity_key(F.col("entity_type"), F.col("entity_name")))
    rows = cut_lineage(rows.select(*ROW, "entity_type", "entity_name", "entity_id", "action", "reason", "status", "detail",
                                   "newest_refresh_ms"))
    planned = rows.where(F.col("status").isNull()).drop("status", "detail")
    keyed = freshness.tracker_rows(chosen).withColumn("entity_key", entity_key(F.col("entity_type"), F.col("entity_name")))
    sources = (keyed.select(*ROW, "entity_type", F.explode(F.array_distinct("tables")).alias("table_name"))
               .join(planned.select(*ROW), ROW, "left_semi"))
    targets = (keyed.select(F.col("entity_key").alias("entity"), F.explode("target_tables").alias("table_name")).distinct()
               .join(planned.select(F.col("entity_key").alias("entity")), "entity", "left_semi"))
    acted = plan_rows(planned, sources, targets, platform, signals.table_meta, launch_script)
    columns = ["entity_name", "entity_type", "src_group", "entity_id", "level", "status", "detail"]
    settled = rows.where(F.col("status").isNotNull()).withColumn("level", F.lit(None).cast("int"))
    return settled.select(*columns).unionByName(acted.select(*columns))


def with_position(plan: DataFrame) -> DataFrame:
    """`plan` with `position` from 1: upstream first, rows without a level last, then by type, name and group.

    Rows are sorted in ranges; a row's position is its place in its range and the number of rows in earlier ranges, so
    the rows are never in one task.
    """
    order = [F.col("level").asc_nulls_last(), "entity_type", "entity_name", "src_group", "status", "detail"]
    ranged = cut_lineage(plan.repartitionByRange(*order).sortWithinPartitions(*order).select(
        "*", F.spark_partition_id().alias("_range"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_place")))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # over one row per range
    earlier = ranged.groupBy("_range").agg(F.count("*").alias("n")).select(
        "_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_earlier"))
    return ranged.join(earlier, "_range").withColumn("position", F.col("_earlier") + F.col("_place") + 1).drop(
        "_range", "_place", "_earlier")


def recheck(groups: DataFrame, resolved: DataFrame, states: DataFrame) -> DataFrame:
    """Rows that waited, looked at again on a newer snapshot: SKIPPED if stale by now, ALREADY_HANDLED if a run
    already includes the data, else the action that is due."""
    rows = row_status(groups, resolved, states)
    stale = F.concat(F.lit("stale sources after waiting for the upstream runs: "), list_text(F.col("stale")))
    return rows.withColumn("detail", F.when(F.col("verdict") == "STALE", stale).otherwise(F.col("detail"))).withColumn(
        "status", F.coalesce("status", F.concat(F.lit("DRY_RUN_"), "action")))


def summary_lines(plan: DataFrame) -> DataFrame:
    """`plan` with the line a summary shows for each row."""
    def padded(text, width):
        return F.concat(text, F.repeat(F.lit(" "), F.greatest(F.lit(width) - F.length(text), F.lit(0))))

    return plan.withColumn("line", F.concat(
        padded(F.col("status"), 19), F.lit(" "), padded(F.col("entity_type"), 8), F.lit(" "), "entity_name", F.lit(" ["),
        "src_group", F.lit("]: "), "detail"))


def plan_summary(plan: DataFrame, failing: tuple[str, ...] = FAILING) -> DataFrame:
    """Rows per status, and whether that status fails the launch."""
    return plan.groupBy("status").agg(F.count("*").alias("n_rows")).withColumn(
        "fails", F.col("status").isin(*failing))


def plan_fails(plan: DataFrame, failing: tuple[str, ...] = FAILING) -> DataFrame:
    """One row: does any status fail the launch."""
    return plan.agg(F.coalesce(F.bool_or(F.col("status").isin(*failing)), F.lit(False)).alias("fails"))
