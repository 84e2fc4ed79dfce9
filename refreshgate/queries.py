"""The library's operators over the test tables, one named query each; every result is flat and comparable."""
import uuid
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from refreshgate import schemas
from refreshgate.functions.names import entity_key, joined
from refreshgate.functions.times import MS_PER_HOUR
from refreshgate.operators import freshness, gates, intervals, lineage, monitor, runs, signals as sig, tracker as tracker_ops
from refreshgate.plans import cycles, impact, launch, ordering
from refreshgate.session import cut_lineage, shared_folder
from refreshgate.sources import stores, tracker_store
from refreshgate.sources.fixtures import BASE_SCHEMAS, FIRST_MS, NOW_MS, Fixtures
from refreshgate.streaming import expiry_wheel, flow_state, refresh_state

LAUNCH_SCRIPT = "launch_downstream.py"
TODAY, USER = "2024-01-31", "tester"
FAILURE_STREAK, SILENT_HOURS = 4, 1
TICK_TIMES = [FIRST_MS + h * MS_PER_HOUR for h in (48, 60, 72, 240, 480, 720)]


class Run:
    """One scale's relations and the results several queries share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.fx = spark, folder, Fixtures(spark, folder)

    @cached_property
    def signals(self) -> freshness.Signals:
        fx = self.fx
        return freshness.gather_signals(fx.table_meta, fx.table_history, fx.flow_definitions, fx.flow_progress, fx.job_runs,
                                        fx.pipeline_events, fx.pipeline_updates)

    @cached_property
    def tracked_signals(self) -> freshness.Signals:
        """Of what the tracker names."""
        fx = self.fx
        return freshness.gather_signals(fx.table_meta, fx.table_history, fx.flow_definitions, fx.flow_progress, fx.job_runs,
                                        fx.pipeline_events, fx.pipeline_updates, tracker=fx.tracker)

    @cached_property
    def status(self) -> DataFrame:
        return freshness.source_status(self.fx.tracker, self.tracked_signals, NOW_MS)

    @cached_property
    def refreshed_status(self) -> DataFrame:
        return freshness.source_status(self.fx.tracker, self.tracked_signals, NOW_MS, self.fx.refreshed)

    @cached_property
    def unproduced(self) -> DataFrame:
        """The tracker without the producers of its sources."""
        return self.fx.tracker.withColumn("src_table_producers", F.lit(None).cast(schemas.PRODUCERS_TYPE))

    @cached_property
    def groups(self) -> DataFrame:
        return gates.group_verdict(self.status)

    @cached_property
    def resolved(self) -> DataFrame:
        return runs.resolve_names(self.fx.tracker, self.fx.jobs, self.fx.pipelines)

    @cached_property
    def states(self) -> DataFrame:
        return runs.run_state(self.fx.job_runs, self.fx.pipelines, self.fx.pipeline_updates)

    @cached_property
    def entities(self) -> DataFrame:
        """Every known job and pipeline with a unique name, in one source group, for lineage registration."""
        named = runs.named_entities(self.fx.jobs, self.fx.pipelines)
        return named.select("entity_type", "entity_name", F.lit("default").alias("src_group")).distinct()

    @cached_property
    def lineage(self) -> lineage.Discovery:
        fx = self.fx
        resolved = runs.resolve_names(self.entities, fx.jobs, fx.pipelines)
        return lineage.Discovery(self.entities, resolved, fx.job_tasks, fx.table_lineage, fx.table_meta, fx.view_deps)

    @cached_property
    def incoming(self) -> DataFrame:
        fx = self.fx
        resolved = runs.resolve_names(self.entities, fx.jobs, fx.pipelines)
        return lineage.tracker_rows(self.entities, resolved, fx.job_tasks, fx.table_lineage, fx.table_meta, fx.view_deps)

    @cached_property
    def edges(self) -> DataFrame:
        rows = freshness.tracker_rows(self.fx.tracker).withColumn(
            "entity", entity_key(F.col("entity_type"), F.col("entity_name")))
        return ordering.entity_edges(rows.select("entity", F.explode("tables").alias("table_name")),
                                     rows.select("entity", F.explode("target_tables").alias("table_name")))

    @cached_property
    def plan(self) -> DataFrame:
        fx = self.fx
        platform = launch.Platform(fx.job_runs, fx.jobs, fx.job_tasks, fx.active_tasks, fx.pipelines, fx.pipeline_updates)
        return launch.launch_plan(fx.tracker, fx.refreshed, self.tracked_signals, platform, NOW_MS, LAUNCH_SCRIPT)

    @cached_property
    def edits(self) -> DataFrame:
        """Five edits of every third entity, a new window for every fifth, a new name for every seventh."""
        rows = self.fx.tracker.select("entity_name", "entity_type", F.regexp_extract("entity_name", r"(\d+)$", 1)
                                      .cast("bigint").alias("n")).distinct()
        e = tracker_ops
        new = F.concat(F.lit("main.raw.feed"), F.col("n").cast("string"))

        def edit(every, action, seq, group=None, table=None, kind=None, producer=None, window=None, name=None):
            none = F.lit(None).cast("string")
            return rows.where(F.col("n") % every == 0).select(
                "entity_name", "entity_type", F.lit(group).cast("string").alias("src_group"),
                F.lit(seq).cast("bigint").alias("seq"), F.lit(action).alias("action"),
                (none if table is None else table).alias("table_name"), F.lit(kind).cast("string").alias("producer_type"),
                (none if producer is None else producer).alias("producer_id"),
                F.lit(window).cast("int").alias("window_mins"), (none if name is None else name).alias("new_name"))

        job = F.col("n").cast("string")
        parts = [edit(3, e.ADD_SOURCE, 1, "daily", new, "JOB", job), edit(3, e.SET_PRODUCER, 2, "daily", new, "JOB", F.lit("77")),
                 edit(3, e.ADD_TARGET, 3, None, F.concat(F.lit("main.gold.export"), job)),
                 edit(3, e.ADD_SKIP, 4, None, F.concat(F.lit("main.demo.t"), F.lit(100).cast("string"))),
                 edit(3, e.ADD_SOURCE, 5, "daily", new, "JOB", F.lit("78")),
                 edit(5, e.SET_WINDOW, 6, "daily", window=90), edit(7, e.RENAME, 7, name=F.concat("entity_name", F.lit("_v2")))]
        edits = parts[0]
        for part in parts[1:]:
            edits = edits.unionByName(part)
        return edits


def _rows_text(impacted):
    return sig.rows_text(impacted).alias("impacted_rows")


STATUS_COLUMNS = ["entity_name", "entity_type", "src_group", "table_name", "window_mins", "producer_type", "producer_id",
                  "last_write_ms", "operation", "success_ms", "signal", "cutoff_ms", "refreshed_at_ms",
                  "data_refreshed_at_ms", "is_fresh", "basis", "met_without_row_changes"]


def last_write(run: Run) -> DataFrame:
    return sig.last_write(run.fx.table_history).select("table_name", "last_write_ms", "operation")


def impacted_rows(run: Run) -> DataFrame:
    return sig.last_write(run.fx.table_history).select("table_name", _rows_text(F.col("impacted")))


def flow_last_completed(run: Run) -> DataFrame:
    done = sig.dataset_completion(run.fx.flow_definitions, run.fx.flow_progress)
    return done.select("pipeline_id", "dataset", "done_ms", "update_id")


def update_row_counts(run: Run) -> DataFrame:
    done = sig.dataset_completion(run.fx.flow_definitions, run.fx.flow_progress)
    return done.select("pipeline_id", "dataset", "update_id", "output_rows", "upserted_rows", "deleted_rows")


def dataset_suffix_match(run: Run) -> DataFrame:
    owned = sig.owned_by_pipeline(run.fx.table_meta)
    datasets = run.fx.flow_definitions.select("pipeline_id", "dataset").distinct()
    return sig.dataset_matches(owned, datasets).select("table_name", "pipeline_id", "dataset")


def events_last_completed(run: Run) -> DataFrame:
    meta = run.fx.table_meta.select("table_name", F.col("table_id").alias("uc_table_id"))
    return sig.events_completion(run.fx.pipeline_events).join(meta, "uc_table_id").select("table_name", "done_ms")


def job_last_success(run: Run) -> DataFrame:
    return sig.job_success(run.fx.job_runs)


def pipeline_last_success(run: Run) -> DataFrame:
    return run.signals.pipeline_success.select("table_name", "pipeline_id", "success_ms", "signal")


def update_covering_table(run: Run) -> DataFrame:
    return sig.update_covering(run.fx.pipeline_updates, sig.owned_by_pipeline(run.fx.table_meta))


def resolve_producer(run: Run) -> DataFrame:
    return run.status.where("checked").select("entity_name", "src_group", "table_name", "producer_type", "producer_id")


def source_status(run: Run) -> DataFrame:
    return run.status.where("checked").select(*STATUS_COLUMNS)


def source_status_text(run: Run) -> DataFrame:
    return freshness.status_text(run.status).select("entity_name", "src_group", "table_name", "description")


def refreshed_now_status(run: Run) -> DataFrame:
    return run.refreshed_status.where("checked").select(*STATUS_COLUMNS)


def group_verdict(run: Run) -> DataFrame:
    return run.groups.select(
        "entity_name", "entity_type", "src_group", "window_mins", "n_sources", "n_stale", "cutoff_ms", "newest_refresh_ms",
        F.array_join("stale", ",").alias("stale"), F.array_join("no_change", ",").alias("no_change"), "verdict")


def entity_gate(run: Run) -> DataFrame:
    return gates.entity_gate(run.groups).select(
        "entity_type", "entity_name", "n_groups", "n_failed", "n_no_change", "newest_refresh_ms", "verdict", "headline")


def gate_lines(run: Run) -> DataFrame:
    return gates.gate_lines(run.groups)


def stale_report(run: Run) -> DataFrame:
    return gates.stale_report(run.groups)


def already_processed(run: Run) -> DataFrame:
    gate = gates.entity_gate(run.groups)
    previous = runs.previous_runs(run.fx.job_runs, run.fx.pipeline_updates)
    return runs.already_processed(gate, run.resolved, previous)


def previous_runs(run: Run) -> DataFrame:
    return runs.previous_runs(run.fx.job_runs, run.fx.pipeline_updates)


def candidates(run: Run) -> DataFrame:
    rows = tracker_ops.candidates(run.fx.tracker, run.fx.refreshed)
    return rows.select("entity_name", "entity_type", "src_group", joined(F.col("src_tables")).alias("src_tables"))


def run_state(run: Run) -> DataFrame:
    return run.states


def decide(run: Run) -> DataFrame:
    groups = run.groups.where(F.col("verdict") == "FRESH").join(
        run.resolved.where(F.col("entity_id").isNotNull()).select("entity_type", "entity_name", "entity_id"),
        ["entity_type", "entity_name"])
    return runs.decide(groups, run.states).select(
        "entity_name", "entity_type", "src_group", "entity_id", "newest_refresh_ms", "action", "reason")


def resolve_name(run: Run) -> DataFrame:
    return run.resolved


def name_matches(run: Run) -> DataFrame:
    return runs.name_matches(run.fx.tracker, run.fx.jobs, run.fx.pipelines)


def owned_tables(run: Run) -> DataFrame:
    return run.lineage.targets


def target_counts(run: Run) -> DataFrame:
    return lineage.target_counts(run.lineage.targets)


def latest_write_edges(run: Run) -> DataFrame:
    return run.lineage.edges.select("entity_type", "entity_name", "target", "source")


def stored_lineage_edges(run: Run) -> DataFrame:
    """The latest-write edges from lineage kept by workspace and day."""
    fx, path = run.fx, f"{shared_folder(run.spark)}/lineage-{uuid.uuid4().hex}"
    stores.store_lineage(fx.raw_lineage, path)
    kept = stores.stored_lineage(run.spark, path, NOW_MS, lookback_days=90, workspace_id="w-1")
    found = lineage.Discovery(run.entities, runs.resolve_names(run.entities, fx.jobs, fx.pipelines), fx.job_tasks, kept, fx.table_meta, fx.view_deps)
    return found.edges.select("entity_type", "entity_name", "target", "source")


def stored_update_rows(run: Run) -> DataFrame:
    """The rows of each dataset's last completed update, from an event log kept with typed details."""
    path = f"{shared_folder(run.spark)}/event-log-{uuid.uuid4().hex}"
    stores.store_event_log(run.fx.event_log, path)
    done = sig.dataset_completion(stores.stored_flow_definitions(run.spark, path),
                                  stores.stored_flow_progress(run.spark, path, run.fx.since_ms))
    return done.select("pipeline_id", "dataset", "update_id", "output_rows", "upserted_rows", "deleted_rows")


def final_targets(run: Run) -> DataFrame:
    return run.lineage.final


def external_inputs(run: Run) -> DataFrame:
    return run.lineage.inputs


def view_expansion(run: Run) -> DataFrame:
    roots = run.fx.table_meta.where(F.col("table_type") == "VIEW").select("table_name")
    return lineage.expand_views(roots, run.fx.table_meta, run.fx.view_deps).where(F.col("kind") == "TABLE").select(
        "root", "name")


def missing_and_unresolved(run: Run) -> DataFrame:
    """All tables, followed to depth 2 over metadata in which some are missing or closed."""
    roots = run.fx.table_meta.select("table_name")
    return lineage.expand_views(roots, run.fx.partial_meta, run.fx.view_deps, max_depth=2).where(F.col("kind") != "TABLE")


def unfollowed_sources(run: Run) -> DataFrame:
    """Over metadata in which some tables are missing or closed."""
    return lineage.unfollowed_sources(lineage.expanded_inputs(run.lineage.inputs, run.fx.partial_meta, run.fx.view_deps))


def source_producers(run: Run) -> DataFrame:
    tables = run.fx.table_lineage.select(F.col("source_table_full_name").alias("table_name")).union(
        run.fx.table_lineage.select("target_table_full_name")).distinct().where(~lineage.is_bookkeeping(F.col("table_name")))
    return lineage.source_producers(tables, run.fx.table_lineage, run.fx.table_meta)


def _flat_producers(column):
    entries = F.array_sort(F.transform(F.map_entries(column), lambda e: F.concat_ws(
        "=", e["key"], F.concat_ws(":", e["value"]["producer_type"], e["value"]["producer_id"]))))
    return F.array_join(entries, ",").alias("producers")


def tracker_rows(run: Run) -> DataFrame:
    return run.incoming.select("entity_name", "entity_type", "src_group", joined(F.col("target_tables")).alias("target_tables"),
                               joined(F.col("src_tables")).alias("src_tables"),
                               _flat_producers(F.col("src_table_producers")), F.coalesce("error", F.lit("")).alias("error"))


def _flat_tracker(rows: DataFrame) -> DataFrame:
    def names(column):
        return F.coalesce(joined(F.col(column)), F.lit("")).alias(column)

    return rows.select(
        "entity_name", "entity_type", F.coalesce("src_group", F.lit("")).alias("src_group"), names("target_tables"),
        names("src_tables"), names("src_tables_to_skip"),
        _flat_producers(F.coalesce("src_table_producers", F.create_map().cast(schemas.PRODUCERS_TYPE))),
        F.col("refresh_window_btn_tables_in_mins").alias("window_mins"), F.col("created_on").cast("string").alias("created_on"),
        F.col("updated_on").cast("string").alias("updated_on"), "created_by", "updated_by")


def tracker_upsert(run: Run) -> DataFrame:
    incoming = run.incoming.where(F.col("error").isNull()).drop("error")
    return _flat_tracker(tracker_ops.upsert(run.fx.tracker, incoming, TODAY, USER))


def tracker_upsert_slots(run: Run) -> DataFrame:
    """The same upsert in two parts, each written to the slots that it touches."""
    store = tracker_store.create_store(run.fx.tracker, f"{shared_folder(run.spark)}/tracker-{uuid.uuid4().hex}", n_slots=8)
    incoming = cut_lineage(run.incoming.where(F.col("error").isNull()).drop("error"))
    is_job = F.col("entity_type") == "JOB"
    for part in (incoming.where(is_job), incoming.where(~is_job)):
        store.upsert(part, TODAY, USER)
    return _flat_tracker(store.read(run.spark))


def tracker_edits(run: Run) -> DataFrame:
    return _flat_tracker(tracker_ops.apply_edits(run.fx.tracker, run.edits, TODAY, USER))


def tracker_validate(run: Run) -> DataFrame:
    """Of the tracker after its edits, with every tenth row registered twice."""
    edited = tracker_ops.apply_edits(run.fx.tracker, run.edits, TODAY, USER)
    again = run.fx.tracker.where((F.regexp_extract("entity_name", r"(\d+)$", 1).cast("bigint") % 10 == 1)
                                 & (F.col("src_group") == "daily"))
    return tracker_ops.validate(tracker_ops.register(edited, again))


def entity_edges(run: Run) -> DataFrame:
    return ordering.shared_tables(run.edges).select("entity", "upstream", F.array_join("tables", ",").alias("tables"))


def running_producers(run: Run) -> DataFrame:
    return sig.running_producers(run.fx.table_meta, run.fx.pipelines, run.fx.pipeline_updates)


def launch_task_params(run: Run) -> DataFrame:
    return launch.launch_task_params(run.fx.job_tasks, LAUNCH_SCRIPT).select(
        "job_id", joined(F.col("tables")).alias("tables"), "covers", "dry_run")


def jobs_running_pipelines(run: Run) -> DataFrame:
    return launch.jobs_running_pipelines(run.fx.active_tasks)


def upstream_levels(run: Run) -> DataFrame:
    entities = run.fx.tracker.select(entity_key(F.col("entity_type"), F.col("entity_name")).alias("entity")).distinct()
    return ordering.upstream_levels(entities, run.edges)


def _refresh_history(run: Run) -> tuple[DataFrame, DataFrame]:
    """All refreshes of tables by writes and completed flows, and the sources they belong to (no job producers)."""
    fx = run.fx
    writes = fx.table_history.where(F.col("operation").isin(*sig.WRITE_OPERATIONS)).select("table_name", F.col("ts_ms").alias("last_write_ms"))
    done = fx.pipeline_events.where(F.col("status") == "COMPLETED").select("uc_table_id", F.col("ts_ms").alias("done_ms"))
    links = expiry_wheel.gate_links(run.unproduced, fx.table_meta)
    return expiry_wheel.write_changes(writes).unionByName(expiry_wheel.completion_changes(done)), links


def fresh_intervals(run: Run) -> DataFrame:
    """Every span in which a group was fresh."""
    rows = freshness.tracker_rows(run.unproduced).select("row_id", "entity_name", "entity_type", "src_group")
    return intervals.fresh_intervals(*_refresh_history(run)).join(rows, "row_id").drop("row_id")


def gate_as_of(run: Run) -> DataFrame:
    """The gate at six instants, from the spans."""
    checked = F.col("window_mins").isNotNull() & (F.size("tables") > 0)
    rows = freshness.tracker_rows(run.unproduced).select("row_id", "entity_name", "entity_type", "src_group", checked.alias("checked"))
    return intervals.gate_as_of(rows, intervals.fresh_intervals(*_refresh_history(run)), TICK_TIMES).drop("row_id", "checked")


def dependency_cycles(run: Run) -> DataFrame:
    """Of a graph with nested cycles, one entity per supplier."""
    entities = run.fx.base("supplier").select(F.concat(F.lit("E"), F.col("s_suppkey").cast("string")).alias("entity"))
    found = cycles.dependency_cycles(entities, run.fx.loops)
    return found.select("entity", "cycle", "n_members", F.array_join("given_up", ",").alias("given_up"))


def impact_closure(run: Run) -> DataFrame:
    """Everything downstream of the refreshed tables in the graph with cycles, from an index stored in slots."""
    edges = run.fx.loops
    reads = edges.select("entity", F.concat(F.lit("main.demo.t"), F.expr("substr(upstream, 2)")).alias("table_name"))
    store = impact.store_index(impact.impact_index(edges), f"{shared_folder(run.spark)}/impact-{uuid.uuid4().hex}", n_slots=16)
    readers = reads.join(run.fx.refreshed, "table_name", "left_semi").select(F.col("entity").alias("upstream"))
    return impact.impact_of(run.fx.refreshed, reads, impact.read_index(store, readers))


def launch_plan(run: Run) -> DataFrame:
    return launch.with_position(launch.summary_lines(run.plan))


def plan_summary(run: Run) -> DataFrame:
    return launch.plan_summary(run.plan)


def recheck(run: Run) -> DataFrame:
    return launch.recheck(run.groups.join(run.resolved.select("entity_type", "entity_name"), ["entity_type", "entity_name"], "left_semi"),
                          run.resolved, run.states).select("entity_name", "entity_type", "src_group", "status", "detail")


def gate_of_requested(run: Run) -> DataFrame:
    """Every named job and pipeline, with or without a tracker row."""
    named = runs.named_entities(run.fx.jobs, run.fx.pipelines)
    return gates.entity_gate(run.groups, named).select("entity_type", "entity_name", "n_groups", "verdict")


def previous_runs_of_others(run: Run) -> DataFrame:
    """As each running run sees it: without itself and the others that run."""
    asking = run.fx.job_runs.where(F.col("life_cycle_state") == "RUNNING").select("job_id", "run_id")
    return runs.previous_runs(run.fx.job_runs, run.fx.pipeline_updates, asking)


def select_rows(run: Run) -> DataFrame:
    return tracker_ops.select_rows(run.fx.tracker, "PIPELINE", src_group="default").select("entity_name", "entity_type")


def status_with_few_signals(run: Run) -> DataFrame:
    """Without the events table and updates, and with histories that cannot be read."""
    fx = run.fx
    signals = freshness.gather_signals(fx.table_meta, fx.table_history, fx.flow_definitions, fx.flow_progress, fx.job_runs,
                                       scan_errors=fx.scan_errors, tracker=fx.tracker)
    return freshness.source_status(fx.tracker, signals, NOW_MS).where("checked").select(
        *STATUS_COLUMNS, F.coalesce("error", F.lit("")).alias("error"))


def consecutive_failures(run: Run) -> DataFrame:
    return monitor.consecutive_failures(run.fx.check_ticks, FAILURE_STREAK)


def no_success_for(run: Run) -> DataFrame:
    return monitor.no_success_for(run.fx.check_ticks, NOW_MS, SILENT_HOURS)


def refresh_gaps(run: Run) -> DataFrame:
    return monitor.refresh_gaps(run.fx.tracker, run.fx.table_history)


def stream_refresh_state(run: Run) -> DataFrame:
    """The commits as a stream, to the end, then the state it leaves behind."""
    spark = run.spark
    where = f"{shared_folder(spark)}/refresh-state-{uuid.uuid4().hex}"
    events = spark.readStream.schema(BASE_SCHEMAS["events"]).option("pathGlobFilter", "events.parquet").parquet(run.folder)
    kinds = ["WRITE", "MERGE", "OPTIMIZE", "STREAMING UPDATE", "RESTORE", "VACUUM END", "DLT REFRESH"]
    number = F.col("event_id")
    history = events.select(
        F.concat(F.lit("main.demo.t"), F.col("user_id").cast("string")).alias("table_name"), number.alias("version"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"),
        F.element_at(F.array(*[F.lit(k) for k in kinds]), (number % 7 + 1).cast("int")).alias("operation"),
        F.create_map(F.lit("numOutputRows"), (number % 4).cast("string"), F.lit("numFiles"), F.lit("1"))
        .alias("operation_metrics"))
    query = refresh_state.track_refreshes(history, f"{where}/state", f"{where}/checkpoint", availableNow=True)
    query.awaitTermination()
    state = refresh_state.read_refresh_state(spark, f"{where}/state")
    return refresh_state.last_write_from_state(state).select(
        "table_name", "last_write_ms", "operation", _rows_text(F.col("impacted")))


def gate_ticks(run: Run) -> DataFrame:
    """Groups whose verdict moved, at six instants, by what was refreshed since the last one or by time alone."""
    fx, last = run.fx, 0
    wheel = expiry_wheel.build(fx.tracker, fx.table_meta, f"{shared_folder(run.spark)}/wheel-{uuid.uuid4().hex}", TICK_TIMES[0],
                               bucket_ms=6 * MS_PER_HOUR)
    for number, now in enumerate(TICK_TIMES):
        def since(rows, column="ts_ms"):
            return rows.where((F.col(column) > last) & (F.col(column) <= now))

        ended = fx.job_runs.where(F.col("end_ms") <= now)
        jobs = sig.job_success(ended.join(since(ended, "end_ms").select("job_id").distinct(), "job_id", "left_semi"))
        changes = (expiry_wheel.write_changes(sig.last_write(since(fx.table_history)))
                   .unionByName(expiry_wheel.completion_changes(sig.events_completion(since(fx.pipeline_events))))
                   .unionByName(expiry_wheel.job_changes(jobs)))
        wheel.tick(changes, now, number)
        last = now
    return wheel.moved(run.spark).select("now_ms", "entity_name", "entity_type", "src_group", "n_sources", "verdict", "n_stale", "stale_at_ms")


def stream_flow_state(run: Run) -> DataFrame:
    """Flow progress as a stream, to the end, then the last completed update of each dataset and its rows."""
    spark, where = run.spark, f"{shared_folder(run.spark)}/flow-state-{uuid.uuid4().hex}"
    orders = spark.readStream.schema(BASE_SCHEMAS["orders"]).option("pathGlobFilter", "orders.parquet").parquet(run.folder)
    order, customer = F.col("o_orderkey"), F.col("o_custkey")
    status = F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "RUNNING").otherwise("FAILED")
    progress = orders.select(
        F.concat(F.lit("p-"), (customer % 40).cast("string")).alias("pipeline_id"), F.concat(F.lit("f-"), customer.cast("string")).alias("flow_name"),
        F.concat(F.lit("u-"), (order - order % 3).cast("string")).alias("update_id"), status.alias("status"), (order % 10).alias("output_rows"),
        (order % 3).alias("upserted_rows"), (order % 2).alias("deleted_rows"), (FIRST_MS + order * 7919 % 2592000 * 1000).alias("ts_ms"))
    flow_state.track_flows(progress, run.fx.flow_definitions, f"{where}/state", f"{where}/checkpoint", availableNow=True).awaitTermination()
    return flow_state.read_flows(spark, f"{where}/state").drop("done_ms")


QUERIES: tuple[Callable[[Run], DataFrame], ...] = (
    last_write, impacted_rows, flow_last_completed, update_row_counts, dataset_suffix_match, events_last_completed,
    job_last_success, pipeline_last_success, update_covering_table, resolve_producer, source_status, source_status_text,
    refreshed_now_status, group_verdict, entity_gate, gate_lines, stale_report, already_processed, previous_runs, candidates,
    run_state, decide, resolve_name, name_matches, owned_tables, target_counts, latest_write_edges, final_targets,
    external_inputs, view_expansion, missing_and_unresolved, unfollowed_sources, source_producers, tracker_rows, tracker_upsert, tracker_edits,
    tracker_validate, entity_edges, running_producers, launch_task_params, jobs_running_pipelines, upstream_levels,
    launch_plan, plan_summary, recheck, gate_of_requested, previous_runs_of_others, select_rows, status_with_few_signals,
    consecutive_failures, no_success_for, refresh_gaps, stream_refresh_state, gate_ticks,
    dependency_cycles, impact_closure, stream_flow_state, tracker_upsert_slots, stored_lineage_edges, stored_update_rows,
    fresh_intervals, gate_as_of)
