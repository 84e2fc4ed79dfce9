"""Relations derived from the TPC-H-like test tables, one SQL template for Spark and DuckDB.

`Fixtures` gives the Spark relations; `with_clause` gives the DuckDB text of the same views for an oracle query.
"""
import zlib
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from refreshgate.functions.names import group_name
from refreshgate.functions.times import MS_PER_DAY, utc_text
from refreshgate.sources import platform

NOW_MS = 1706659200000   # 2024-01-31 00:00 UTC
FIRST_MS = 1704067200000  # 2024-01-01 00:00 UTC; event times spread over 30 days from here
# columns used of the test tables; given, so that no file is opened to infer them
BASE_SCHEMAS = {
    "customer": "c_custkey bigint",
    "supplier": "s_suppkey bigint",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string",
}
BASE_TABLES = tuple(BASE_SCHEMAS)

# what raw lineage holds of a row: itself; for some also another workspace's and an old one; for some of a pipeline two more
_EVERY = "'w-1', null, null, false, 0"
_SOME = (_EVERY, "'w-2', null, 'main.demo.t1', false, 0", f"'w-1', 'main.demo.old', null, false, {200 * MS_PER_DAY}")
_PIPELINE = (*_SOME, "'w-1', null, 'main.demo.__materialization_x', false, 0", "'w-1', null, null, true, 0")
LINEAGE_COPIES = "select kind, workspace_id, other_source, other_target, self, cast(age_ms as bigint) as age_ms from values " + ", ".join(
    f"({kind}, {copy})" for kind, copies in enumerate([(_EVERY,), _SOME, _PIPELINE]) for copy in copies
) + " as copies(kind, workspace_id, other_source, other_target, self, age_ms)"

SPARK_TOKENS = {"micros": "unix_micros", "div": "div", "array": "array", "map": "map_from_arrays"}
DUCKDB_TOKENS = {"micros": "epoch_us", "div": "//", "array": "list_value", "map": "map"}

TEMPLATES = {
    "table_meta": """
        select 'main.demo.t' || c_custkey as table_name, 'tid-' || c_custkey as table_id,
          case c_custkey % 5 when 0 then 'MATERIALIZED_VIEW' when 1 then 'STREAMING_TABLE' when 2 then 'VIEW'
            else 'MANAGED' end as table_type,
          case when c_custkey % 5 < 2 then 'p-' || (c_custkey % 40) end as pipeline_id
        from {customer}""",
    "table_history": """
        select 'main.demo.t' || user_id as table_name, event_id as version,
          {micros}(cast(ts as timestamp)) {div} 1000 as ts_ms,
          case event_id % 7 when 0 then 'WRITE' when 1 then 'MERGE' when 2 then 'OPTIMIZE' when 3 then 'STREAMING UPDATE'
            when 4 then 'RESTORE' when 5 then 'VACUUM END' else 'DLT REFRESH' end as operation,
          {map}({array}('numOutputRows', 'numFiles'), {array}(cast(event_id % 4 as string), '1')) as operation_metrics
        from {events}""",
    "pipeline_events": """
        select 'tid-' || o_custkey as uc_table_id, 'flow_progress' as event_type,
          case o_orderstatus when 'F' then 'COMPLETED' when 'O' then 'RUNNING' else 'FAILED' end as status,
          1704067200000 + (o_orderkey * 7901 % 2592000) * 1000 as ts_ms
        from {orders}""",
    "flow_definitions": """
        select 'p-' || (c_custkey % 40) as pipeline_id, 'f-' || c_custkey as flow_name,
          case c_custkey % 3 when 0 then 'main.demo.t' || c_custkey when 1 then 'demo.t' || c_custkey
            else 't' || c_custkey end as dataset
        from {customer}""",
    "flow_progress": """
        select 'p-' || (o_custkey % 40) as pipeline_id, 'f-' || o_custkey as flow_name,
          'u-' || (o_orderkey - o_orderkey % 3) as update_id,
          case o_orderstatus when 'F' then 'COMPLETED' when 'O' then 'RUNNING' else 'FAILED' end as status,
          o_orderkey % 10 as output_rows, o_orderkey % 3 as upserted_rows, o_orderkey % 2 as deleted_rows,
          1704067200000 + (o_orderkey * 7919 % 2592000) * 1000 as ts_ms
        from {orders}""",
    "job_runs": """
        select o_orderkey % 60 as job_id, o_orderkey as run_id,
          1704067200000 + (o_orderkey * 7907 % 2592000) * 1000 as start_ms,
          1704067200000 + (o_orderkey * 7907 % 2592000) * 1000 + 60000 * (o_orderkey % 30 + 1) as end_ms,
          case o_orderstatus when 'F' then 'SUCCESS' when 'P' then 'FAILED' end as result_state,
          case when o_orderstatus = 'O' then 'RUNNING' else 'TERMINATED' end as life_cycle_state
        from {orders}""",
    "pipeline_updates": """
        select 'p-' || (o_orderkey % 40) as pipeline_id, 'u-' || o_orderkey as update_id,
          case o_orderkey % 11 when 0 then 'FAILED' when 1 then 'CANCELED' when 2 then 'RUNNING' else 'COMPLETED' end as state,
          1704067200000 + (o_orderkey * 7927 % 2592000) * 1000 as creation_ms,
          case when o_orderkey % 7 = 0 then {array}('t' || o_custkey) else {array}() end as refresh_selection,
          case when o_orderkey % 2 = 0 then 'JOB_TASK' else 'API_CALL' end as cause
        from {orders}""",
    "pipelines": """
        select distinct 'p-' || (c_custkey % 40) as pipeline_id,
          'E' || (4 * (case when c_custkey % 40 >= 38 then c_custkey % 40 - 30 else c_custkey % 40 end) + 3) as name,
          case when c_custkey % 4 = 0 then 'RUNNING' else 'IDLE' end as state, c_custkey % 40 = 8 as continuous
        from {customer}""",
    "jobs": """
        select distinct c_custkey % 60 as job_id, 'E' || (c_custkey % 60 % 58) as name from {customer}""",
    "job_pipelines": """
        select distinct c_custkey % 60 as job_id, 'k-' || (c_custkey % 40) as task_key,
          case when c_custkey % 3 <> 2 then 'p-' || (c_custkey % 40) end as pipeline_id
        from {customer}""",
    "launch_tasks": """
        select s_suppkey % 60 as job_id,
          {array}('--tracker_table=x', '--src_tables=main.demo.t' || s_suppkey || ', main.demo.t' || (s_suppkey + 1),
            '--entity_type', case when s_suppkey % 2 = 0 then 'ALL' else 'JOB' end,
            case s_suppkey % 4 when 0 then '--dry_run=true' when 1 then '--dry_run={{job.parameters.d}}'
              else '--dry_run=false' end) as parameters
        from {supplier} where s_suppkey % 3 = 0""",
    "active_tasks": """
        select o_orderkey % 60 as job_id, o_orderkey as run_id,
          1704067200000 + (o_orderkey * 7907 % 2592000) * 1000 as start_ms,
          'p-' || (o_orderkey % 40) as pipeline_id,
          case o_orderkey % 5 when 0 then 'TERMINATED' when 1 then 'TERMINATING' else 'RUNNING' end as life_cycle_state
        from {orders} where o_orderstatus = 'O'""",
    "table_lineage": """
        select 'main.demo.t' || (l_partkey % 100) as source_table_full_name,
          'main.demo.t' || (100 + l_suppkey % 50) as target_table_full_name,
          case when l_suppkey % 5 = 4 then 'JOB' else 'PIPELINE' end as entity_type,
          case when l_suppkey % 5 = 4 then cast(l_suppkey % 60 as string) else 'p-' || ((100 + l_suppkey % 50) % 40) end as entity_id,
          'u-' || (l_orderkey - l_orderkey % 50) as entity_run_id,
          1704067200000 + ((l_orderkey - l_orderkey % 50) * 7919 % 2592000) * 1000 as ts_ms
        from {lineitem}""",
    "view_deps": """
        select 'main.demo.t' || c_custkey as view_name, 'main.demo.t' || (c_custkey {div} 2) as dep
        from {customer} where c_custkey % 5 = 2
        union
        select 'main.demo.t' || c_custkey, 'main.demo.t' || (c_custkey {div} 3) from {customer} where c_custkey % 5 = 2""",
    "tracker": """
        select 'E' || s_suppkey as entity_name, case when s_suppkey % 4 = 3 then 'PIPELINE' else 'JOB' end as entity_type,
          'daily' as src_group, {array}('main.demo.t' || s_suppkey) as target_tables,
          {array}('main.demo.t' || (s_suppkey {div} 2), 'main.demo.t' || (100 + s_suppkey % 50)) as src_tables,
          case when s_suppkey % 10 = 0 then {array}('main.demo.t' || (100 + s_suppkey % 50)) else {array}() end as src_tables_to_skip,
          case when s_suppkey % 17 <> 16 then 1440 end as refresh_window_btn_tables_in_mins
        from {supplier}
        union all
        select 'E' || s_suppkey, case when s_suppkey % 4 = 3 then 'PIPELINE' else 'JOB' end,
          case when s_suppkey % 2 = 0 then 'weekly' end, {array}('main.demo.t' || s_suppkey),
          {array}('main.demo.t' || (100 + (s_suppkey + 7) % 50)), null, 10080
        from {supplier}""",
    "tracker_producers": """
        select 'E' || s_suppkey as entity_name, 'main.demo.t' || (100 + s_suppkey % 50) as src_table,
          'JOB' as producer_type, cast(s_suppkey % 60 as string) as producer_id
        from {supplier} where s_suppkey % 3 = 0""",
    "loops": """
        select 'E' || s_suppkey as entity, 'E' || (s_suppkey {div} 2) as upstream from {supplier} where s_suppkey > 0
        union select 'E' || s_suppkey, 'E' || (s_suppkey + 1) from {supplier} where s_suppkey % 10 in (3, 4, 5)
        union select 'E' || s_suppkey, 'E' || (s_suppkey - 3) from {supplier} where s_suppkey % 10 = 6
        union select 'E' || s_suppkey, 'E' || (s_suppkey - 1) from {supplier} where s_suppkey % 10 = 5
        union select 'E' || s_suppkey, 'E' || (2 * s_suppkey + 1) from {supplier} where s_suppkey % 50 = 7""",
    "check_ticks": """
        select 'E' || (user_id % 20) as entity_name, event_id as tick_id,
          {micros}(cast(ts as timestamp)) {div} 1000 as ts_ms,
          case when event_type in ('error', 'view') then 'FAILED' else 'SUCCESS' end as result
        from {events}""",
}


def _render(name: str, tokens: dict[str, str]) -> str:
    text = TEMPLATES[name]
    for token, value in tokens.items():
        text = text.replace("{" + token + "}", value)
    return text


def duckdb_view(name: str) -> str:
    return _render(name, DUCKDB_TOKENS | {table: table for table in BASE_TABLES})


def with_clause(*names: str) -> str:
    """`WITH RECURSIVE name AS (...), ...` for the given derived views."""
    views = ",\n".join(f"{name} AS ({duckdb_view(name)})" for name in names)
    return f"WITH RECURSIVE {views}"


class Fixtures:
    """The derived relations over one scale's folder, as Spark DataFrames in the canonical schemas."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.now_ms, self.since_ms = NOW_MS, platform.producer_since_ms(NOW_MS)

    def base(self, table: str) -> DataFrame:
        return self.spark.read.schema(BASE_SCHEMAS[table]).parquet(f"{self.folder}/{table}.parquet")

    def view(self, name: str) -> DataFrame:
        """A derived view; the base tables are temporary views named after their folder."""
        used = [table for table in BASE_TABLES if "{" + table + "}" in TEMPLATES[name]]
        place = zlib.crc32(self.folder.encode())
        for table in used:
            self.base(table).createOrReplaceTempView(f"{table}_{place}")
        return self.spark.sql(_render(name, SPARK_TOKENS | {table: f"{table}_{place}" for table in used}))

    @cached_property
    def table_meta(self) -> DataFrame:
        return self.view("table_meta").withColumn("access", F.lit(None).cast("string"))

    @cached_property
    def partial_meta(self) -> DataFrame:
        """Metadata in which every eleventh table is missing and every thirteenth cannot be read."""
        number = F.regexp_extract("table_name", r"(\d+)$", 1).cast("bigint")
        return self.view("table_meta").where(number % 11 != 3).withColumn("access", F.when(number % 13 == 4, "NO_ACCESS"))

    @cached_property
    def table_history(self) -> DataFrame:
        raw = self.view("table_history").select("table_name", "version", F.timestamp_millis("ts_ms").alias("timestamp"), "operation",
                                                F.col("operation_metrics").alias("operationMetrics"))
        return platform.table_history(raw)

    @cached_property
    def scan_errors(self) -> DataFrame:
        """Every sixth table's history cannot be read."""
        number = F.regexp_extract("table_name", r"(\d+)$", 1).cast("bigint")
        return self.view("table_meta").where(number % 6 == 1).select("table_name", F.lit("no access to history").alias("error"))

    @cached_property
    def raw_pipeline_events(self) -> DataFrame:
        """With the nested, semi-structured columns a platform table has."""
        status = F.struct(F.struct("status").alias("flow_progress"))
        return self.view("pipeline_events").select(
            F.timestamp_millis("ts_ms").alias("event_time"), "event_type",
            F.struct("uc_table_id").alias("origin"), F.parse_json(F.to_json(status)).alias("details"))

    @cached_property
    def pipeline_events(self) -> DataFrame:
        return platform.pipeline_events(self.raw_pipeline_events, self.since_ms)

    @cached_property
    def event_log(self) -> DataFrame:
        """Definitions and progress as one event log with VARIANT details."""
        flows = self.view("flow_definitions").select(
            "pipeline_id", F.timestamp_millis(F.lit(FIRST_MS)).alias("timestamp"),
            F.lit("flow_definition").alias("event_type"),
            F.struct("flow_name", F.lit(None).cast("string").alias("update_id")).alias("origin"),
            F.to_json(F.struct(F.struct(F.concat(F.lit("`"), "dataset", F.lit("`")).alias("output_dataset"))
                               .alias("flow_definition"))).alias("details"))
        metrics = F.struct(F.col("output_rows").alias("num_output_rows"), F.col("upserted_rows").alias("num_upserted_rows"),
                           F.col("deleted_rows").alias("num_deleted_rows"))
        progress = self.view("flow_progress").select(
            "pipeline_id", F.timestamp_millis("ts_ms").alias("timestamp"), F.lit("flow_progress").alias("event_type"),
            F.struct("flow_name", "update_id").alias("origin"),
            F.to_json(F.struct(F.struct("status", metrics.alias("metrics")).alias("flow_progress"))).alias("details"))
        return flows.unionByName(progress).withColumn("details", F.parse_json("details"))

    @cached_property
    def flow_definitions(self) -> DataFrame:
        return platform.flow_definitions(self.event_log)

    @cached_property
    def flow_progress(self) -> DataFrame:
        return platform.flow_progress(self.event_log, self.since_ms)

    @cached_property
    def job_runs(self) -> DataFrame:
        return self.view("job_runs")

    @cached_property
    def pipeline_updates(self) -> DataFrame:
        """With creation times as ISO text, as the platform lists them."""
        raw = self.view("pipeline_updates").withColumn(
            "creation_time", F.concat(F.substring_index(utc_text(F.col("creation_ms")), " UTC", 1), F.lit("Z")))
        return platform.pipeline_updates(raw.drop("creation_ms")).withColumn(
            "full_refresh_selection", F.lit(None).cast("array<string>"))

    @cached_property
    def pipelines(self) -> DataFrame:
        return self.view("pipelines")

    @cached_property
    def jobs(self) -> DataFrame:
        return self.view("jobs")

    @cached_property
    def job_tasks(self) -> DataFrame:
        """Pipeline tasks and launch tasks of all jobs."""
        pipeline_tasks = self.view("job_pipelines").select(
            "job_id", "task_key", "pipeline_id", F.lit(None).cast("string").alias("python_file"),
            F.lit(None).cast("array<string>").alias("parameters"))
        launch_tasks = self.view("launch_tasks").select(
            "job_id", F.lit("launch").alias("task_key"), F.lit(None).cast("string").alias("pipeline_id"),
            F.lit("tasks/launch_downstream.py").alias("python_file"), "parameters")
        tasks = pipeline_tasks.unionByName(launch_tasks)
        nested = F.collect_list(F.struct("task_key", "pipeline_id", "python_file", "parameters")).alias("tasks")
        return platform.job_tasks(tasks.groupBy("job_id").agg(nested))

    @cached_property
    def active_tasks(self) -> DataFrame:
        """Of active runs with a list of tasks, one of which runs no pipeline."""
        other = F.struct(F.lit(None).cast("string").alias("pipeline_id"), F.lit("RUNNING").alias("life_cycle_state"))
        return platform.active_tasks(self.view("active_tasks").select(
            "job_id", "run_id", "start_ms", F.array(F.struct("pipeline_id", "life_cycle_state"), other).alias("tasks")))

    @cached_property
    def table_lineage(self) -> DataFrame:
        """Read for one workspace and 90 days."""
        return platform.table_lineage(self.raw_lineage, NOW_MS, lookback_days=90, workspace_id="w-1")

    @cached_property
    def raw_lineage(self) -> DataFrame:
        """A table that also holds another workspace, older days, a pipeline's bookkeeping tables and self-edges. Each row
        of the test table is read once and joined with the copies of its kind, so that a reader's filters come before its names
        are put together."""
        source, target, ts_ms = (F.col(c) for c in ("source_table_full_name", "target_table_full_name", "ts_ms"))
        some = source.endswith("7")
        kind = F.when(some & (F.col("entity_type") == "PIPELINE"), 2).when(some, 1).otherwise(0)
        copies = self.spark.sql(LINEAGE_COPIES)
        rows = self.view("table_lineage").withColumn("kind", kind).join(F.broadcast(copies), "kind")
        copied = rows.select(
            "workspace_id", F.when(F.col("self"), target).otherwise(F.coalesce("other_source", source)).alias("source_table_full_name"),
            F.coalesce("other_target", target).alias("target_table_full_name"), "entity_type", "entity_id", "entity_run_id",
            (ts_ms - F.col("age_ms")).alias("ts_ms"))
        return copied.withColumn("event_date", F.date_add(F.lit("1970-01-01").cast("date"), F.expr(f"cast(ts_ms div {MS_PER_DAY} as int)")))

    @cached_property
    def view_deps(self) -> DataFrame:
        return self.view("view_deps")

    @cached_property
    def tracker(self) -> DataFrame:
        """Tracker rows with the producers folded into the map column."""
        producers = (self.view("tracker_producers").groupBy("entity_name").agg(F.map_from_entries(F.collect_list(
            F.struct("src_table", F.struct("producer_type", "producer_id")))).alias("src_table_producers")))
        return (self.view("tracker").join(producers, "entity_name", "left")
                .withColumn("created_on", F.lit("2024-01-01").cast("date"))
                .withColumn("updated_on", F.lit("2024-01-01").cast("date"))
                .withColumn("created_by", F.lit("setup")).withColumn("updated_by", F.lit("setup")))

    @cached_property
    def loops(self) -> DataFrame:
        """(entity, upstream): dependencies with cycles, some of them nested and some before others."""
        return self.view("loops")

    @cached_property
    def check_ticks(self) -> DataFrame:
        return self.view("check_ticks")

    @cached_property
    def refreshed(self) -> DataFrame:
        """Tables an upstream job has just refreshed: the targets of every third group of rows."""
        rows = self.view("tracker").where(group_name(F.col("src_group")) == "daily")
        return rows.select(F.explode("target_tables").alias("table_name")).where(
            F.regexp_extract("table_name", r"(\d+)$", 1).cast("bigint") % 3 == 0).distinct()
