"""Gates that turn stale by time alone: every group is looked up again at the instant its next source runs out of its window.

A tick judges the groups that read something refreshed since the last tick, and those whose instant has come. Instants
stand in a wheel of time buckets, so a tick opens only the buckets between the last tick and now. Everything else is kept in
slots of about SLOT_ROWS rows by a hash of their key, and a tick opens and rewrites only the slots of what it judges: its
work grows with what has happened, not with the number of groups.

A source is known by its subjects: `w:` table (data writes), `c:` table id (completions of the owning pipeline) and `j:` job
(its last success). It was refreshed at the latest instant among them. A tick has a number; the same number a second time
starts from the same state and replaces what it wrote, so a batch that is repeated after a failure does no harm.
"""
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from refreshgate import schemas
from refreshgate.functions.times import MS_PER_HOUR, MS_PER_MINUTE, whole
from refreshgate.operators import signals as sig
from refreshgate.operators.freshness import resolve_producer, row_sources, tracker_rows
from refreshgate.session import cut_lineage
from refreshgate.sources.slots import SlotStore, delete, numbers
from refreshgate.streaming.refresh_state import read_refresh_state

SLOT_ROWS = 10_000
BUCKET_MS = MS_PER_HOUR
CHANGES = "subject string, refreshed_ms bigint"
ROWS = ("row_id bigint, entity_name string, entity_type string, src_group string, checked boolean, n_sources bigint, "
        "verdict string, n_stale bigint, stale_at_ms bigint")
LINKS = "row_id bigint, pos int, subject string, window_ms bigint"
READERS = "subject string, row_id bigint"
ENTRIES = "row_id bigint, stale_at_ms bigint"
TICKS = "now_ms bigint, consumed bigint"


def gate_links(tracker: DataFrame, table_meta: DataFrame) -> DataFrame:
    """row_id, pos, subject, window_ms: what each checked source's refresh time comes from, by the freshness rule."""
    sources = row_sources(tracker_rows(tracker)).where(F.col("table_name").isNotNull() & F.col("window_mins").isNotNull())
    known = sources.join(table_meta.select("table_name", "table_id", "table_type", "pipeline_id"), "table_name", "left")
    kind, producer = resolve_producer(F.col("pipeline_id"), F.col("tracker_job"))
    is_view = F.coalesce(F.col("table_type") == sig.MATERIALIZED_VIEW, F.lit(False))
    subjects = F.array(F.when(~is_view, F.concat(F.lit("w:"), "table_name")),
                       F.when(kind == "PIPELINE", F.concat(F.lit("c:"), "table_id")),
                       F.when(kind == "JOB", F.concat(F.lit("j:"), producer)))
    # a source without any subject keeps one that nothing refreshes
    named = F.filter(subjects, lambda s: s.isNotNull())
    return known.select("row_id", "pos", (F.col("window_mins").cast("bigint") * MS_PER_MINUTE).alias("window_ms"), F.explode(
        F.when(F.size(named) > 0, named).otherwise(F.array(F.lit("none")))).alias("subject")).select(
        "row_id", "pos", "subject", "window_ms")


def write_changes(last_write: DataFrame) -> DataFrame:
    """Changes of subjects from the `last_write` signal of what was written since the last tick."""
    return last_write.select(F.concat(F.lit("w:"), "table_name").alias("subject"), F.col("last_write_ms").alias("refreshed_ms"))


def completion_changes(events_done: DataFrame) -> DataFrame:
    return events_done.select(F.concat(F.lit("c:"), "uc_table_id").alias("subject"), F.col("done_ms").alias("refreshed_ms"))


def job_changes(job_success: DataFrame) -> DataFrame:
    return job_success.select(F.concat(F.lit("j:"), F.col("job_id").cast("string")).alias("subject"), F.col("done_ms").alias("refreshed_ms"))


@dataclass(frozen=True)
class Wheel:
    path: str
    n_slots: int
    bucket_ms: int = BUCKET_MS

    @property
    def rows(self) -> SlotStore:
        return SlotStore(f"{self.path}/rows", ROWS, "row_id", self.n_slots)

    @property
    def links(self) -> SlotStore:
        return SlotStore(f"{self.path}/links", LINKS, "row_id", self.n_slots)

    @property
    def readers(self) -> SlotStore:
        return SlotStore(f"{self.path}/readers", READERS, "subject", self.n_slots)

    @property
    def values(self) -> SlotStore:
        return SlotStore(f"{self.path}/values", CHANGES, "subject", self.n_slots)

    def last_tick(self, spark: SparkSession, before: int) -> tuple[int, int]:
        """(now_ms, consumed) of the last tick with a number below `before`."""
        number = [v for v in numbers(spark, f"{self.path}/ticks", "version") if v < before][-1]
        row = spark.read.schema(TICKS).parquet(f"{self.path}/ticks/version={number}").first()
        return row.now_ms, row.consumed

    def _enter(self, judged: DataFrame, version: int) -> None:
        """Put rows into the buckets of the instants at which they turn stale."""
        entries = judged.where(F.col("stale_at_ms").isNotNull()).select("row_id", "stale_at_ms").withColumns(
            {"bucket": whole(F.col("stale_at_ms"), self.bucket_ms), "version": F.lit(version)})
        (entries.repartition("bucket").write.partitionBy("bucket", "version").mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").parquet(f"{self.path}/wheel"))

    def due(self, spark: SparkSession, last_ms: int, now_ms: int, before: int) -> DataFrame:
        """row_id of entries in (last_ms, now_ms]: the buckets in between are opened, and no other."""
        paths = []
        for bucket in numbers(spark, f"{self.path}/wheel", "bucket"):
            if last_ms // self.bucket_ms <= bucket <= now_ms // self.bucket_ms:
                paths += [f"{self.path}/wheel/bucket={bucket}/version={v}"
                          for v in numbers(spark, f"{self.path}/wheel/bucket={bucket}", "version") if v < before]
        entries = spark.read.schema(ENTRIES).parquet(*paths) if paths else schemas.empty(spark, ENTRIES)
        return entries.where((F.col("stale_at_ms") > last_ms) & (F.col("stale_at_ms") <= now_ms)).select("row_id")

    def tick(self, changes: DataFrame, now_ms: int, number: int, consumed: int = -1) -> DataFrame:
        """The groups whose verdict or number of stale sources is another than at the last tick, with their state now.

        `changes` (subject, refreshed_ms) holds the present refresh time of every subject that changed. Numbers ascend
        from 0, and time does not run back. An entry of the wheel that later refreshes have overtaken only has its row
        judged once more.
        """
        spark = changes.sparkSession
        last_ms, _ = self.last_tick(spark, number)
        if now_ms < last_ms:
            raise ValueError(f"tick at {now_ms} after one at {last_ms}")
        changes = cut_lineage(changes.groupBy("subject").agg(F.max("refreshed_ms").alias("refreshed_ms")))
        changed_slots = self.values.slots_of(changes)
        touched = self.readers.read(spark, changed_slots, number).join(changes, "subject", "left_semi").select("row_id")
        looked = cut_lineage(touched.unionByName(self.due(spark, last_ms, now_ms, number)).distinct())
        row_slots = self.rows.slots_of(looked)
        old = self.values.read(spark, changed_slots, number).join(changes, "subject", "left_anti")
        self.values.write(old.unionByName(changes), number)
        links = cut_lineage(self.links.read(spark, row_slots, number).join(looked, "row_id", "left_semi"))
        values = self.values.read(spark, self.values.slots_of(links), number + 1)
        kept = self.rows.read(spark, row_slots, number)
        now = cut_lineage(_judged(kept.join(looked, "row_id", "left_semi"), links, values, now_ms))
        self.rows.write(kept.join(looked, "row_id", "left_anti").unionByName(now.drop("was", "n_was")), number)
        self._enter(now, number)
        moved = now.where(~F.col("verdict").eqNullSafe(F.col("was")) | ~F.col("n_stale").eqNullSafe(F.col("n_was")))
        target = f"{self.path}/moved/version={number}"
        moved.select(F.lit(now_ms).cast("bigint").alias("now_ms"), *_names(ROWS)).write.mode("overwrite").parquet(target)
        spark.createDataFrame([(now_ms, consumed)], TICKS).coalesce(1).write.mode("overwrite").parquet(
            f"{self.path}/ticks/version={number}")
        self._forget(spark, changed_slots, row_slots, last_ms, number)
        return spark.read.schema(f"now_ms bigint, {ROWS}").parquet(target)

    def _forget(self, spark: SparkSession, changed_slots: list[int], row_slots: list[int], last_ms: int, number: int) -> None:
        """Drop what neither a reader nor this tick, if it is repeated, can need."""
        self.values.trim(spark, changed_slots, number)
        self.rows.trim(spark, row_slots, number)
        for bucket in numbers(spark, f"{self.path}/wheel", "bucket"):
            if bucket < last_ms // self.bucket_ms:
                delete(spark, f"{self.path}/wheel/bucket={bucket}")

    def moved(self, spark: SparkSession) -> DataFrame:
        """What all ticks have returned."""
        columns = f"now_ms bigint, {ROWS}"
        return spark.read.schema(f"{columns}, version bigint").parquet(f"{self.path}/moved").select(*_names(columns))

    def gate(self, spark: SparkSession) -> DataFrame:
        """The present verdict of every group."""
        return self.rows.read(spark, list(range(self.n_slots)), 1 << 62)


def _names(schema: str) -> list[str]:
    return [column.split()[0] for column in schema.split(", ")]


def _judged(rows: DataFrame, links: DataFrame, values: DataFrame, now_ms: int) -> DataFrame:
    """`rows` with their verdict at `now_ms`, the number of stale sources, and when the next source turns stale."""
    now = F.lit(now_ms).cast("bigint")
    sources = links.join(values, "subject", "left").groupBy("row_id", "pos").agg(
        F.max("refreshed_ms").alias("refreshed_ms"), F.first("window_ms").alias("window_ms"))
    fresh = F.coalesce(F.col("refreshed_ms") >= now - F.col("window_ms"), F.lit(False))
    per_row = sources.groupBy("row_id").agg(
        F.count_if(~fresh).alias("stale"),
        F.min(F.when(fresh, F.col("refreshed_ms") + F.col("window_ms") + 1)).alias("at"))
    found = rows.join(per_row, "row_id", "left")
    verdict = F.when(~F.col("checked"), "UNCHECKED").when(F.col("stale") > 0, "STALE").otherwise("FRESH")
    return found.select("row_id", "entity_name", "entity_type", "src_group", "checked", "n_sources", verdict.alias("verdict"),
                        F.coalesce("stale", F.lit(0).cast("bigint")).alias("n_stale"), F.col("at").alias("stale_at_ms"),
                        F.col("verdict").alias("was"), F.col("n_stale").alias("n_was"))


def build(tracker: DataFrame, table_meta: DataFrame, path: str, first_ms: int, bucket_ms: int = BUCKET_MS,
          slot_rows: int = SLOT_ROWS) -> Wheel:
    """A new wheel under `path` whose tick number 0, at `first_ms` or later, judges every group.

    The number of slots follows from the number of rows and of links, so that slots keep their size however many there are.
    """
    spark = tracker.sparkSession
    rows = tracker_rows(tracker)
    links = cut_lineage(gate_links(tracker, table_meta))
    n_rows = max(rows.count(), links.count())
    wheel = Wheel(path, max(1, -(-n_rows // slot_rows)), bucket_ms)
    checked = F.col("window_mins").isNotNull() & (F.size("tables") > 0)
    none = F.lit(None)
    wheel.rows.write(rows.select(
        "row_id", "entity_name", "entity_type", "src_group", checked.alias("checked"), F.size("tables").cast("bigint").alias("n_sources"),
        none.cast("string").alias("verdict"), none.cast("bigint").alias("n_stale"), none.cast("bigint").alias("stale_at_ms")), -1)
    wheel.links.write(links, -1)
    wheel.readers.write(links.select("subject", "row_id").distinct(), -1)
    wheel._enter(rows.select("row_id", F.lit(first_ms).cast("bigint").alias("stale_at_ms")), -1)
    spark.createDataFrame([(first_ms - 1, -1)], TICKS).coalesce(1).write.mode("errorifexists").parquet(f"{path}/ticks/version=-1")
    return wheel


def on_clock(spark: SparkSession, wheel: Wheel, state_path: str, clock_ms):
    """A foreachBatch function for a clock stream (the `rate` source): every trigger is a tick, whether or not anything
    happened. It takes in the commits that `refresh_state.track_refreshes` has stored under `state_path` since the last one.
    """
    def run(_: DataFrame, batch_id: int) -> None:
        _, seen = wheel.last_tick(spark, batch_id)
        ready = [b for b in numbers(spark, f"{state_path}/changes", "batch") if b > seen]
        if ready and ready[0] > seen + 1:  # batches not seen here are part of a snapshot by now
            stored = read_refresh_state(spark, state_path)
        elif ready:
            stored = spark.read.schema(schemas.REFRESH_STATE).parquet(*(f"{state_path}/changes/batch={b}" for b in ready))
        else:
            stored = schemas.empty(spark, schemas.REFRESH_STATE)
        changes = stored.select("table_name", F.col("ts_ms").alias("last_write_ms"))
        wheel.tick(write_changes(changes), clock_ms(), batch_id, max(ready, default=seen))

    return run
