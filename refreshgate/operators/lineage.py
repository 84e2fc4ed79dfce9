"""From lineage to tracker rows, for all entities in one plan: what an entity owns, reads and finally writes, and what
produces its sources."""
from functools import cached_property, reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from refreshgate.functions.names import short_name
from refreshgate.schemas import PRODUCERS_TYPE
from refreshgate.session import cut_counted, cut_lineage

ENTITY = ["entity_type", "entity_name"]
# fixed values: table types that are expanded, and names of a pipeline's own bookkeeping tables
VIEW_TYPES = ("VIEW", "METRIC_VIEW")
BOOKKEEPING_PREFIXES = ("__materialization", "event_log_")
NO_ACCESS = "NO_ACCESS"
LEVELS_PER_CUT = 6


def entity_pipelines(resolved: DataFrame, job_tasks: DataFrame) -> DataFrame:
    """Pipelines of each resolved entity: a pipeline is its own, a job has those of its pipeline tasks."""
    known = resolved.where(F.col("entity_id").isNotNull()).select(*ENTITY, "entity_id")
    own = known.where(F.col("entity_type") == "PIPELINE").select(*ENTITY, F.col("entity_id").alias("pipeline_id"))
    tasks = job_tasks.where(F.col("pipeline_id").isNotNull() & (F.col("pipeline_id") != "")).select(
        F.col("job_id").cast("string").alias("entity_id"), "pipeline_id").distinct()
    jobs = known.where(F.col("entity_type") == "JOB").join(tasks, "entity_id").select(*ENTITY, "pipeline_id")
    return own.unionByName(jobs)


def skipped_tasks(resolved: DataFrame, job_tasks: DataFrame) -> DataFrame:
    """Tasks of resolved jobs that run no pipeline and so are not tracked."""
    jobs = resolved.where((F.col("entity_type") == "JOB") & F.col("entity_id").isNotNull()).select(*ENTITY, "entity_id")
    others = job_tasks.where(F.col("pipeline_id").isNull() | (F.col("pipeline_id") == "")).select(
        F.col("job_id").cast("string").alias("entity_id"), "task_key")
    return jobs.join(others, "entity_id").select(*ENTITY, "task_key")


def is_bookkeeping(table: Column) -> Column:
    short = short_name(table)
    return short.startswith(BOOKKEEPING_PREFIXES[0]) | short.startswith(BOOKKEEPING_PREFIXES[1])


def lineage_targets(pipelines: DataFrame, table_lineage: DataFrame, table_meta: DataFrame) -> DataFrame:
    """Tables the entities' pipelines wrote, OWNED or IGNORED with a reason.

    A table is owned when a pipeline of the same entity manages it now. Raw lineage is reduced to distinct (pipeline,
    target) pairs before any join, and metadata to the tables among them.
    """
    written = (table_lineage.where((F.col("entity_type") == "PIPELINE") & F.col("target_table_full_name").isNotNull())
               .select(F.col("entity_id").alias("pipeline_id"), F.col("target_table_full_name").alias("table_name"))
               .where(~is_bookkeeping(F.col("table_name"))).distinct())
    candidates = cut_lineage(pipelines.join(written, "pipeline_id").select(*ENTITY, "table_name").distinct())
    meta = table_meta.join(candidates.select("table_name").distinct(), "table_name", "left_semi").select("table_name", F.col("pipeline_id").alias("owner"), "access", F.lit(True).alias("known"))
    managers = pipelines.select(*ENTITY, F.col("pipeline_id").alias("owner"), F.lit(True).alias("managed"))
    # an unowned table looks up a key of its own, so that NULL owners do not all meet in one partition
    owner_key = F.coalesce(F.col("owner"), F.concat(F.lit("\u0000"), "table_name")).alias("owner_key")
    found = (candidates.join(meta, "table_name", "left").select("*", owner_key)
             .join(managers.withColumnRenamed("owner", "owner_key"), ENTITY + ["owner_key"], "left"))
    readable = F.col("known").isNotNull() & F.coalesce(F.col("access") != NO_ACCESS, F.lit(True))
    reason = (F.when(F.col("known").isNull(), "NotFound").when(F.col("access") == NO_ACCESS, "PermissionDenied")
              .when(F.col("managed").isNull(), F.concat(F.lit("pipeline_id="), F.coalesce("owner", F.lit("None")))))
    status = F.when(readable & F.col("managed").isNotNull(), "OWNED").otherwise("IGNORED")
    return found.select(*ENTITY, "table_name", status.alias("status"), reason.alias("reason"))


def owned_tables(targets: DataFrame) -> DataFrame:
    return targets.where(F.col("status") == "OWNED").select(*ENTITY, "table_name")


def target_counts(targets: DataFrame) -> DataFrame:
    """How many lineage targets are owned, and how many are ignored for each reason."""
    return targets.groupBy("status", F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count("*").alias("n_tables"))


def latest_write_edges(pipelines: DataFrame, owned: DataFrame, table_lineage: DataFrame,
                       facts: DataFrame | None = None) -> DataFrame:
    """(entity, target, source) of each owned table's latest write, with the time the edge was last seen.

    Raw lineage is never shuffled as a whole: the time of each pair's latest write is in its `lineage_facts`, the rows of
    that time name the run, and the rows of that run its sources. Both are picked by joins with a row per pair or run, each
    after a join by the time or the run's hash alone, which few rows pass. The second join is null-safe and its result is
    written, since Spark would ask the keys of later joins to be not null before the first one, and so look at all columns
    of all rows.
    """
    facts = lineage_facts(table_lineage) if facts is None else facts
    writes = table_lineage.where(F.col("entity_type") == "PIPELINE").select(
        F.col("entity_id").alias("pipeline_id"), F.col("target_table_full_name").alias("target"),
        F.col("entity_run_id").alias("run_id"), F.col("source_table_full_name").alias("source"), F.col("ts_ms").alias("seen_ms"))
    targets = owned.withColumnRenamed("table_name", "target")

    def picked(rows: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
        same = [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys]
        return rows.join(few.select(*[F.col(k).alias(f"of_{k}") for k in keys]).distinct(), reduce(and_, same), "left_semi")

    def moment(ms: str) -> Column:
        return F.coalesce(ms, F.lit(0).cast("bigint"))  # of NULL too; `picked` tells them apart

    last = facts.where((F.col("entity_type") == "PIPELINE") & F.col("has_run")).select(
        F.col("entity_id").alias("pipeline_id"), F.col("target_table_full_name").alias("target"), F.col("run_ts_ms").alias("seen_ms"))
    wanted = cut_lineage(pipelines.join(last, "pipeline_id").join(targets, ENTITY + ["target"], "left_semi")
                         .select("pipeline_id", "target", "seen_ms").distinct())
    at_times = writes.join(wanted.select(moment("seen_ms").alias("at")).distinct(), moment("seen_ms") == F.col("at"), "left_semi")
    newest = cut_lineage(picked(at_times, wanted, ["pipeline_id", "target", "seen_ms"])
                         .select("pipeline_id", "target", "run_id", "seen_ms").distinct()
                         .groupBy("pipeline_id", "target")
                         .agg(F.max(F.when(F.col("run_id").isNotNull(), F.struct("seen_ms", "run_id"))).alias("run")))
    latest = (pipelines.join(newest, "pipeline_id").join(targets, ENTITY + ["target"], "left_semi")
              .groupBy(*ENTITY, "target").agg(F.max("run").alias("run"))
              .select(*ENTITY, "target", F.col("run.run_id").alias("run_id")))
    chosen = cut_lineage(latest.join(pipelines, ENTITY))
    written = ["pipeline_id", "target", "run_id"]
    run = F.xxhash64("run_id")  # a number is looked up faster than a name; `picked` tells equal hashes apart
    of_runs = writes.join(chosen.select(run.alias("hash")).distinct(), run == F.col("hash"), "left_semi")
    reduced = cut_lineage(picked(of_runs, chosen, written).groupBy(*written, "source").agg(F.max("seen_ms").alias("seen_ms")))
    return (chosen.join(reduced, written)
            .where(F.col("source").isNotNull() & (F.col("source") != F.col("target")))
            .groupBy(*ENTITY, "target", "source").agg(F.max("seen_ms").alias("seen_ms")))


def final_targets(owned: DataFrame, edges: DataFrame) -> DataFrame:
    """Owned tables no other owned table of the entity reads."""
    read = edges.select(*ENTITY, F.col("source").alias("table_name"))
    return owned.join(read, ENTITY + ["table_name"], "left_anti")


def external_inputs(owned: DataFrame, edges: DataFrame) -> DataFrame:
    """Sources the entity does not own."""
    read = edges.select(*ENTITY, F.col("source").alias("table_name")).distinct()
    return read.join(owned, ENTITY + ["table_name"], "left_anti")


def expand_views(roots: DataFrame, table_meta: DataFrame, view_deps: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Each root name followed through views to the end: (root, name, kind) with kind TABLE, MISSING or UNRESOLVED.

    Breadth first. A name counts at its smallest depth, and names seen before are not followed again, so circular views
    end by themselves. With `max_depth`, a view at that depth is unresolved; a table there is kept. `LEVELS_PER_CUT` levels
    are one lazy plan, since a level's shuffle is reused by the next, and are written without names that were seen before
    them; the walk ends where the last of them is empty.
    """
    readable = table_meta.where(F.coalesce(F.col("access") != NO_ACCESS, F.lit(True)))
    views = readable.where(F.col("table_type").isin(*VIEW_TYPES)).select(F.col("table_name").alias("name"))
    steps = cut_lineage(view_deps.select(F.col("view_name").alias("name"), "dep").where(F.col("dep").isNotNull()).distinct()
                        .join(views, "name", "left_semi"))  # else every level would sort and join both again
    steps = steps.where(F.col("dep").isNotNull())  # said again, or a level would be one thing to the next and another in the result
    level = roots.select(F.col("table_name").alias("root"), F.col("table_name").alias("name")).distinct()
    nearest, depth, more = level.withColumn("depth", F.lit(0)), 0, True
    while more and (max_depth is None or depth < max_depth):
        start = depth
        upto = depth + LEVELS_PER_CUT if max_depth is None else min(depth + LEVELS_PER_CUT, max_depth)
        below = None
        while depth < upto:
            depth += 1
            level = level.join(steps, "name").select("root", F.col("dep").alias("name")).distinct()
            named = level.withColumn("depth", F.lit(depth))
            below = named if below is None else below.unionByName(named)
        if depth != max_depth:
            # an anti-join with the names seen would be put below each level, which then is not the one that the next reads
            seen = nearest.unionByName(below).groupBy("root", "name").agg(F.min("depth").alias("depth"))
            below, found = cut_counted(seen.where(F.col("depth") > start), n=F.count_if(F.col("depth") == depth))
            level, more = below.where(F.col("depth") == depth).select("root", "name"), found["n"]
        nearest = nearest.unionByName(below)
    nearest = nearest.groupBy("root", "name").agg(F.min("depth").alias("depth"))
    meta = table_meta.select(F.col("table_name").alias("name"), "table_type", "access", F.lit(True).alias("known"))
    is_view = F.coalesce(F.col("table_type").isin(*VIEW_TYPES), F.lit(False))
    kind = (F.when(F.col("known").isNull() | (F.col("access") == NO_ACCESS), "MISSING")
            .when(~is_view, "TABLE").when(F.lit(False) if max_depth is None else F.col("depth") >= max_depth, "UNRESOLVED"))
    shown = F.when(F.col("access") == NO_ACCESS, F.concat("name", F.lit(" (no access)"))).otherwise(F.col("name"))
    return (nearest.join(meta, "name", "left").select("root", shown.alias("name"), kind.alias("kind"))
            .where(F.col("kind").isNotNull()))


def expanded_inputs(inputs: DataFrame, table_meta: DataFrame, view_deps: DataFrame,
                    max_depth: int | None = None) -> DataFrame:
    """External inputs of all entities with views expanded: (entity, name, kind). Each name is walked once."""
    walked = expand_views(inputs.select("table_name").distinct(), table_meta, view_deps, max_depth)
    return (inputs.join(walked.withColumnRenamed("root", "table_name"), "table_name")
            .select(*ENTITY, "name", "kind").distinct())


def entity_sources(expanded: DataFrame, owned: DataFrame) -> DataFrame:
    """Tables an entity reads and does not own; views that lead back to its own tables are no source."""
    tables = expanded.where(F.col("kind") == "TABLE").select(*ENTITY, F.col("name").alias("table_name"))
    return tables.join(owned, ENTITY + ["table_name"], "left_anti")


def unfollowed_sources(expanded: DataFrame) -> DataFrame:
    """Names an entity reads that could not be followed to a table: they are in no tracker row, so they are reported."""
    return expanded.where(F.col("kind") != "TABLE")


def job_writers(table_lineage: DataFrame) -> DataFrame:
    """table_name -> the job behind its latest lineage write. Reduced to one row per table and job before the pick."""
    per_job = (table_lineage.where((F.col("entity_type") == "JOB") & F.col("target_table_full_name").isNotNull())
               .groupBy(F.col("target_table_full_name").alias("table_name"), F.col("entity_id").alias("job_id"))
               .agg(F.max("ts_ms").alias("seen_ms")))
    return (per_job.groupBy("table_name").agg(F.max(F.struct("seen_ms", "job_id")).alias("write"))
            .select("table_name", "write.job_id"))


def source_producers(tables: DataFrame, table_lineage: DataFrame, table_meta: DataFrame) -> DataFrame:
    """table_name -> PIPELINE with its owner, else JOB with the latest job writer, else NONE."""
    owner = table_meta.where(F.coalesce(F.col("access") != NO_ACCESS, F.lit(True)) & (F.col("pipeline_id") != "")).select(
        "table_name", "pipeline_id")
    found = (tables.select("table_name").distinct().join(owner, "table_name", "left")
             .join(job_writers(table_lineage), "table_name", "left"))
    kind = (F.when(F.col("pipeline_id").isNotNull(), "PIPELINE").when(F.col("job_id").isNotNull(), "JOB").otherwise("NONE"))
    return found.select("table_name", kind.alias("producer_type"),
                        F.coalesce("pipeline_id", "job_id").alias("producer_id"))


def lineage_facts(table_lineage: DataFrame) -> DataFrame:
    """Lineage reduced on the map side to one row per writer and target with its latest time (ts_ms), that of rows with a run
    id (run_ts_ms), and whether there are any (has_run). A maximum of numbers, so that nothing is sorted."""
    has_run = F.col("entity_run_id").isNotNull()
    return (table_lineage.where(F.col("entity_type").isin("PIPELINE", "JOB") & F.col("target_table_full_name").isNotNull())
            .groupBy("entity_type", "entity_id", "target_table_full_name")
            .agg(F.max("ts_ms").alias("ts_ms"), F.max(F.when(has_run, F.col("ts_ms"))).alias("run_ts_ms"), F.max(has_run).alias("has_run")))


class Discovery:
    """The steps from entities to their sources, each worked out when it is first asked for.

    Raw lineage is read for its facts and twice for the edges, each time without a shuffle of its rows; the resolved names, facts,
    targets, edges and sources are written out, since later steps use them many times.
    """

    def __init__(self, entities: DataFrame, resolved: DataFrame, job_tasks: DataFrame, table_lineage: DataFrame,
                 table_meta: DataFrame, view_deps: DataFrame, max_depth: int | None = None):
        self.entities, self.all_resolved = entities, resolved
        self.job_tasks, self.table_lineage, self.table_meta = job_tasks, table_lineage, table_meta  # raw lineage
        self.view_deps, self.max_depth = view_deps, max_depth

    @cached_property
    def resolved(self) -> DataFrame:
        return cut_lineage(self.all_resolved.join(self.entities.select(*ENTITY).distinct(), ENTITY, "left_semi"))

    @cached_property
    def pipelines(self) -> DataFrame:
        return cut_lineage(entity_pipelines(self.resolved, self.job_tasks))

    @cached_property
    def facts(self) -> DataFrame:
        return cut_lineage(lineage_facts(self.table_lineage))

    @cached_property
    def targets(self) -> DataFrame:
        return cut_lineage(lineage_targets(self.pipelines, self.facts, self.table_meta))

    @cached_property
    def owned(self) -> DataFrame:
        return owned_tables(self.targets)

    @cached_property
    def edges(self) -> DataFrame:
        return cut_lineage(latest_write_edges(self.pipelines, self.owned, self.table_lineage, self.facts))

    @cached_property
    def final(self) -> DataFrame:
        return final_targets(self.owned, self.edges)

    @cached_property
    def inputs(self) -> DataFrame:
        return external_inputs(self.owned, self.edges)

    @cached_property
    def expanded(self) -> DataFrame:
        return expanded_inputs(self.inputs, self.table_meta, self.view_deps, self.max_depth)

    @cached_property
    def sources(self) -> DataFrame:
        return cut_lineage(entity_sources(self.expanded, self.owned))


def tracker_rows(entities: DataFrame, resolved: DataFrame, job_tasks: DataFrame, table_lineage: DataFrame,
                 table_meta: DataFrame, view_deps: DataFrame, subset: DataFrame | None = None,
                 max_depth: int | None = None) -> DataFrame:
    """One incoming tracker row per requested (entity_type, entity_name, src_group), OK or with an error.

    `subset` (entity_type, entity_name, src_group, table_name) narrows a group to some of the discovered sources; a
    name that was not discovered is an error. The arrays are as long as the tracker row itself has to be.
    """
    steps = Discovery(entities, resolved, job_tasks, table_lineage, table_meta, view_deps, max_depth)
    group = ENTITY + ["src_group"]
    requested = cut_lineage(entities.select(*group).distinct())
    sources = steps.sources.join(requested, ENTITY)
    unknown = None
    if subset is not None:
        wanted = subset.select(*group, "table_name").distinct()
        narrowed = wanted.select(*group).distinct().withColumn("narrowed", F.lit(True))
        chosen = wanted.withColumn("chosen", F.lit(True))
        unknown = (wanted.join(sources, group + ["table_name"], "left_anti").groupBy(*group)
                   .agg(F.array_sort(F.collect_set("table_name")).alias("unknown")))
        sources = (sources.join(narrowed, group, "left").join(chosen, group + ["table_name"], "left")
                   .where(F.col("narrowed").isNull() | F.col("chosen")).select(*group, "table_name"))
    producers = source_producers(sources, steps.facts, table_meta)
    entry = F.struct("table_name", F.struct("producer_type", "producer_id"))
    per_group = sources.join(producers, "table_name").groupBy(*group).agg(
        F.array_sort(F.collect_set("table_name")).alias("src_tables"),
        F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("src_table_producers"))
    finals = steps.final.groupBy(*ENTITY).agg(F.array_sort(F.collect_set("table_name")).alias("target_tables"))
    has_pipelines = steps.pipelines.select(*ENTITY).distinct().withColumn("has_pipelines", F.lit(True))
    has_owned = steps.owned.select(*ENTITY).distinct().withColumn("has_owned", F.lit(True))
    names = steps.resolved.select(*ENTITY, "entity_id", F.col("error").alias("name_error"))
    rows = (requested.join(names, ENTITY, "left").join(has_pipelines, ENTITY, "left").join(has_owned, ENTITY, "left")
            .join(finals, ENTITY, "left").join(per_group, group, "left"))
    if unknown is None:
        rows = rows.withColumn("unknown", F.lit(None).cast("array<string>"))
    else:
        rows = rows.join(unknown, group, "left")
    # fixed values: the error texts
    label = F.concat(F.col("entity_type"), F.lit(" '"), F.col("entity_name"), F.lit("'"))
    error = (F.when(F.col("entity_id").isNull(), F.coalesce(F.col("name_error"), F.concat(label, F.lit(" not resolved"))))
             .when(F.col("has_pipelines").isNull(), F.concat(label, F.lit(" has no pipeline tasks — nothing to track.")))
             .when(F.col("has_owned").isNull(), F.concat(F.lit("No tables currently managed by the pipelines of "), label))
             .when(F.col("target_tables").isNull(),
                   F.lit("No final tables found — every owned table is read by another owned table (cycle?)."))
             .when(F.size("unknown") > 0, F.concat(F.lit("sources not among the discovered ones: "),
                                                   F.array_join("unknown", ", "))))
    none = F.array().cast("array<string>")
    return rows.select(
        "entity_name", "entity_type", "src_group", F.coalesce("target_tables", none).alias("target_tables"),
        F.coalesce("src_tables", none).alias("src_tables"),
        F.coalesce("src_table_producers", F.create_map().cast(PRODUCERS_TYPE)).alias("src_table_producers"),
        error.alias("error"))
