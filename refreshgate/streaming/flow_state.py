"""Flow progress as a stream: the rows that every update reported, added up while it is open, and the last completed update.

Two steps, each with a state of its own. The first holds every open (pipeline, dataset, update) with its sums so far and
when it completed, in slots by a hash of all three, so that Python is called once per slot and batch and works on columns.
The number of slots stays as it is for as long as the checkpoint does. From its completion on an update passes its totals on
whenever they change, and is forgotten `keep_ms` of event time later; one that never completes is forgotten `open_ms` after
its last row. The second keeps the latest completed update of each dataset, in the folders of `refresh_state.Kept`.

Rows older than the watermark are dropped. Rows of an update that come more than `keep_ms` after its completion, in event
time, are not added to it: they count as another update of the same id.

Job runs and pipeline updates need no open state: their latest success is a running maximum per job, or per pipeline and scope.
"""
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from refreshgate.functions.times import MS_PER_DAY, MS_PER_HOUR
from refreshgate.operators import signals as sig
from refreshgate.streaming.refresh_state import Kept

COUNTS = ("output_rows", "upserted_rows", "deleted_rows")
KEY = ("pipeline_id", "dataset", "update_id")
NO_UPDATE = "\u0000"  # stands for a NULL update id in a state's key
TOTALS = "pipeline_id string, dataset string, update_id string, done_ms bigint, n_rows bigint, " + ", ".join(f"{c} bigint" for c in COUNTS)
OPEN = "updates binary"  # of a slot, as an Arrow stream
NOT_DONE = -1
N_SLOTS = 1024


def _latest(rows: DataFrame) -> DataFrame:
    """The latest completed update of each dataset; of its totals those over the most rows."""
    fields = ("done_ms", "update_id", "n_rows", *COUNTS)
    return (rows.groupBy("pipeline_id", "dataset").agg(F.max(F.struct(*fields)).alias("latest"))
            .select("pipeline_id", "dataset", "latest.*"))


FLOWS = Kept(TOTALS, _latest)
JOBS = Kept("job_id bigint, start_ms bigint, run_id bigint, done_ms bigint", lambda rows: rows.groupBy("job_id").agg(
    F.max(F.struct("start_ms", "run_id", "done_ms")).alias("run")).select("job_id", "run.*"))
SCOPES = Kept("pipeline_id string, scope string, start_ms bigint, update_id string", lambda rows: rows.groupBy("pipeline_id", "scope").agg(
    F.max(F.struct("start_ms", "update_id")).alias("update")).select("pipeline_id", "scope", "update.*"))


def open_totals(progress: DataFrame, flow_definitions: DataFrame, late_ms: int, keep_ms: int, open_ms: int,
                n_slots: int = N_SLOTS) -> DataFrame:
    """Totals of updates that have completed, each time they change. `progress` is a stream in the canonical schema, the
    definitions are a table: of flows first defined later, the progress counts from the next start of the stream."""
    flows = flow_definitions.where(F.col("dataset").isNotNull() & (F.col("dataset") != "")).select(
        "pipeline_id", "flow_name", "dataset").distinct()
    done = F.when((F.col("status") == "COMPLETED") & F.col("ts_ms").isNotNull(), F.greatest("ts_ms", F.lit(0)))
    rows = (progress.withColumn("at", F.timestamp_millis("ts_ms")).withWatermark("at", f"{late_ms} milliseconds")
            .join(flows, ["pipeline_id", "flow_name"])
            .withColumn("update_id", F.coalesce("update_id", F.lit(NO_UPDATE)))
            .select(F.pmod(F.xxhash64(*KEY), F.lit(n_slots)).alias("slot"), *KEY, "at", F.coalesce(done, F.lit(NOT_DONE)).alias("done_ms"),
                    F.coalesce("ts_ms", F.lit(0)).alias("last_ms"), F.lit(1).cast("bigint").alias("n_rows"),
                    *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in COUNTS]))
    by_max, by_sum = ("done_ms", "last_ms", "until_ms", "arrived"), ("n_rows", *COUNTS)
    schema = pa.schema([(c, pa.string()) for c in KEY] + [(c, pa.int64()) for c in (*by_max, *by_sum)])

    def advance(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        parts = [pa.Table.from_pandas(rows.assign(until_ms=0, arrived=1), schema, preserve_index=False) for rows in batches if len(rows)]
        if state.exists:
            parts.append(pa.ipc.open_stream(state.get[0]).read_all())
        updates = pa.concat_tables([schema.empty_table(), *parts]).group_by(list(KEY), use_threads=False).aggregate(
            [(c, "max") for c in by_max] + [(c, "sum") for c in by_sum])
        updates = updates.select([*KEY, *[f"{c}_max" for c in by_max], *[f"{c}_sum" for c in by_sum]]).rename_columns(schema.names)
        last, completed, arrived = updates["last_ms"].to_numpy(), updates["done_ms"].to_numpy(), updates["arrived"].to_numpy() == 1
        until = np.maximum(np.where(completed == NOT_DONE, last + open_ms, completed + keep_ms), now + 1)
        until = np.where(arrived, until, updates["until_ms"].to_numpy())
        held = until >= now
        if held.any():
            kept = updates.set_column(schema.get_field_index("until_ms"), "until_ms", pa.array(until, pa.int64()))
            kept = kept.set_column(schema.get_field_index("arrived"), "arrived", pa.array(np.zeros(len(held), "int64"))).filter(pa.array(held))
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_table(kept)
            state.update((out.getvalue().to_pybytes(),))
            state.setTimeoutTimestamp(max(int(until[held].min()), now + 1))
        elif state.exists:
            state.remove()
        told = updates.filter(pa.array(arrived & (completed != NOT_DONE)))
        if len(told):
            yield told.select([*KEY, "done_ms", *by_sum]).to_pandas()

    totals = rows.groupBy("slot").applyInPandasWithState(advance, TOTALS, OPEN, "update", GroupStateTimeout.EventTimeTimeout)
    # rows of an update without an id cannot be told apart, so they are not counted
    known = F.col("update_id") != NO_UPDATE
    return totals.select("pipeline_id", "dataset", F.when(known, F.col("update_id")).alias("update_id"), "done_ms", "n_rows",
                         *[F.when(known, F.col(c)).alias(c) for c in COUNTS])


def _keep(stream: DataFrame, kept: Kept, path: str, checkpoint: str, compact_every: int, trigger: dict) -> StreamingQuery:
    def store(changed: DataFrame, batch_id: int) -> None:
        kept.store(changed, path, batch_id, compact_every)

    return (stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(store).trigger(**trigger).start())


def track_flows(progress: DataFrame, flow_definitions: DataFrame, path: str, checkpoint: str, late_ms: int = MS_PER_HOUR,
                keep_ms: int = MS_PER_DAY, open_ms: int = 31 * MS_PER_DAY, compact_every: int = 100,
                n_slots: int = N_SLOTS, **trigger) -> StreamingQuery:
    """Start the stream of flow progress; `read_flows` gives what `signals.dataset_completion` gives over all of it."""
    return _keep(open_totals(progress, flow_definitions, late_ms, keep_ms, open_ms, n_slots), FLOWS, path, checkpoint, compact_every, trigger)


def read_flows(spark: SparkSession, path: str) -> DataFrame:
    """(pipeline_id, dataset) -> done_ms, update_id and row counts of the latest completed update."""
    return FLOWS.read(spark, path).select("pipeline_id", "dataset", "done_ms", "update_id", *COUNTS)


def track_job_runs(job_runs: DataFrame, path: str, checkpoint: str, compact_every: int = 100, **trigger) -> StreamingQuery:
    """Start the stream of job runs: each job's latest successful run. A run's final row counts, whenever it comes."""
    done = job_runs.where(F.col("life_cycle_state").isin(*sig.FINAL_RUN_STATES) & (F.col("result_state") == "SUCCESS"))
    latest = done.groupBy("job_id").agg(F.max(F.struct("start_ms", "run_id", F.col("end_ms").alias("done_ms"))).alias("run"))
    return _keep(latest.select("job_id", "run.*"), JOBS, path, checkpoint, compact_every, trigger)


def read_job_success(spark: SparkSession, path: str) -> DataFrame:
    """The `job_success` signal from the kept state."""
    return JOBS.read(spark, path).select("job_id", "done_ms", "run_id")


def track_updates(pipeline_updates: DataFrame, path: str, checkpoint: str, compact_every: int = 100, **trigger) -> StreamingQuery:
    """Start the stream of pipeline updates: the latest completed one per pipeline and scope."""
    return _keep(sig.update_scopes(pipeline_updates), SCOPES, path, checkpoint, compact_every, trigger)


def read_update_scopes(spark: SparkSession, path: str) -> DataFrame:
    return SCOPES.read(spark, path)
