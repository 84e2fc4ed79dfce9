"""Refresh state kept up to date from a stream of commits, and gates re-evaluated for what a batch changed.

The state is one row per table however long the history is. A running maximum does not depend on order, so late rows
need no watermark. Every batch writes its changed rows to a folder of its own number: a repeated batch overwrites just
itself. Every `compact_every` batches the changes so far are folded into a snapshot, which readers start from, and what
the snapshot before it covers is dropped, so the number of folders stays bounded.
"""
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from refreshgate import schemas
from refreshgate.operators import freshness, gates, signals as sig, tracker as tracker_ops

REFRESH_COLUMNS = ("table_name", "version", "ts_ms", "operation", "operation_metrics")


def _read(spark: SparkSession, path: str, schema: str, folder: str) -> DataFrame:
    """All rows under `path`, with the number in their folder's name; empty before the first batch."""
    full = f"{schema}, {folder} bigint"
    try:
        return spark.read.schema(full).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return schemas.empty(spark, full)


def _newest(rows: DataFrame) -> DataFrame:
    commit = F.struct("version", "ts_ms", "operation", "operation_metrics")
    return (rows.groupBy("table_name").agg(F.max_by(commit, F.struct("ts_ms", "version")).alias("commit"))
            .select("table_name", "commit.*"))


def _latest_completion(rows: DataFrame) -> DataFrame:
    return rows.groupBy("uc_table_id").agg(F.max("done_ms").alias("done_ms"))


@dataclass(frozen=True)
class Kept:
    """A state of one row per key under a folder: changes per batch, snapshots of them, and the heads of whole snapshots."""
    schema: str
    newest: Callable[[DataFrame], DataFrame]

    def heads(self, spark: SparkSession, path: str) -> list[int]:
        """Numbers of the snapshots that are kept, at most three."""
        rows = _read(spark, f"{path}/heads", "n_rows bigint", "upto").select("upto").distinct().orderBy(F.desc("upto")).limit(3)
        return [r["upto"] for r in rows.collect()]

    def read(self, spark: SparkSession, path: str) -> DataFrame:
        """The last snapshot and the changes after it."""
        upto = next(iter(self.heads(spark, path)), None)
        changes = _read(spark, f"{path}/changes", self.schema, "batch")
        if upto is None:
            return self.newest(changes.drop("batch"))
        snapshot = _read(spark, f"{path}/snapshots", self.schema, "upto").where(F.col("upto") == upto)
        return self.newest(snapshot.drop("upto").unionByName(changes.where(F.col("batch") > upto).drop("batch")))

    def store(self, changed: DataFrame, path: str, batch_id: int, compact_every: int) -> str:
        """Write a batch's changes and, every `compact_every` batches, a snapshot; the folder of the changes."""
        target = f"{path}/changes/batch={batch_id}"
        changed.write.mode("overwrite").parquet(target)
        if batch_id and batch_id % compact_every == 0:
            self.compact(changed.sparkSession, path, batch_id)
        return target

    def compact(self, spark: SparkSession, path: str, batch_id: int) -> None:
        """Fold the changes up to `batch_id` into a snapshot and drop what no reader needs any more.

        The snapshot's head is written last, so readers never see half of it. The snapshot before it stays for readers
        that began with it, and the changes after that one.
        """
        self.read(spark, path).write.mode("overwrite").parquet(f"{path}/snapshots/upto={batch_id}")
        rows = spark.read.parquet(f"{path}/snapshots/upto={batch_id}").agg(F.count("*").alias("n_rows"))
        rows.write.mode("overwrite").parquet(f"{path}/heads/upto={batch_id}")
        older = [n for n in self.heads(spark, path) if n < batch_id]
        if older:
            _drop(spark, f"{path}/changes", "batch", older[0] + 1)
            _drop(spark, f"{path}/heads", "upto", older[0])
            _drop(spark, f"{path}/snapshots", "upto", older[0])


def _drop(spark: SparkSession, path: str, name: str, below: int) -> None:
    """Delete the `name=n` folders under `path` with n < `below`."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(root):
        for status in files.listStatus(root):
            number = status.getPath().getName().removeprefix(f"{name}=")
            if number.isdigit() and int(number) < below:
                files.delete(status.getPath(), True)


REFRESHES = Kept(schemas.REFRESH_STATE, _newest)
COMPLETIONS = Kept("uc_table_id string, done_ms bigint", _latest_completion)


def read_refresh_state(spark: SparkSession, path: str) -> DataFrame:
    """The last data-writing commit of each table."""
    return REFRESHES.read(spark, path)


def track_refreshes(table_history: DataFrame, path: str, checkpoint: str, compact_every: int = 100,
                    on_change: Callable[[DataFrame, int], None] | None = None, **trigger) -> StreamingQuery:
    """Start the stream. `table_history` is a streaming DataFrame in the canonical schema; `trigger` as for
    DataStreamWriter.trigger. `on_change` gets each batch's changed rows after they are stored."""
    def store(changed: DataFrame, batch_id: int) -> None:
        target = REFRESHES.store(changed, path, batch_id, compact_every)
        if on_change is not None:
            on_change(changed.sparkSession.read.schema(schemas.REFRESH_STATE).parquet(target), batch_id)

    latest = sig.latest_write_row(table_history).select(*REFRESH_COLUMNS)
    return (latest.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
            .foreachBatch(store).trigger(**trigger).start())


def track_completions(pipeline_events: DataFrame, path: str, checkpoint: str, compact_every: int = 100, **trigger) -> StreamingQuery:
    """The same for completed flows: latest completion per table id."""
    def store(changed: DataFrame, batch_id: int) -> None:
        COMPLETIONS.store(changed, path, batch_id, compact_every)

    return (sig.events_completion(pipeline_events).writeStream.outputMode("update")
            .option("checkpointLocation", checkpoint).foreachBatch(store).trigger(**trigger).start())


def read_completions(spark: SparkSession, path: str) -> DataFrame:
    return COMPLETIONS.read(spark, path)


def last_write_from_state(state: DataFrame) -> DataFrame:
    """Refresh state -> the `last_write` signal, so that a gate reads one row per table and not the history."""
    return sig.last_write(state)


def changed_groups(changed: DataFrame, tracker: DataFrame, signals: freshness.Signals, now_ms: int) -> DataFrame:
    """Verdicts of just the tracker rows that read a changed table."""
    rows = tracker_ops.candidates(tracker, changed.select("table_name").distinct())
    return gates.group_verdict(freshness.source_status(rows, signals, now_ms))


def gate_on_change(tracker: DataFrame, signals_for: Callable[[DataFrame], freshness.Signals], clock_ms: Callable[[], int],
                   state_path: str, out_path: str) -> Callable[[DataFrame, int], None]:
    """An `on_change` for `track_refreshes` that writes the verdicts each batch affects to `out_path`.

    `signals_for` builds the signals from the current `last_write`; `clock_ms` gives the time of the check.
    """
    def run(changed: DataFrame, batch_id: int) -> None:
        state = read_refresh_state(changed.sparkSession, state_path)
        verdicts = changed_groups(changed, tracker, signals_for(last_write_from_state(state)), clock_ms())
        verdicts.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")

    return run
