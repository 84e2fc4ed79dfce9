"""Reports over check results and commit history.

An ordered scan per entity or table would put all rows of a busy one in one task, so timelines are cut into chunks of
time: rows are ordered within (key, chunk), and only one summary per chunk is ordered per key.
"""
from pyspark.sql import DataFrame, Window, functions as F

from refreshgate.functions.times import MS_PER_DAY, MS_PER_HOUR, MS_PER_MINUTE, whole
from refreshgate.operators.freshness import tracker_rows
from refreshgate.operators.signals import WRITE_OPERATIONS


def failure_streaks(ticks: DataFrame, chunk_ms: int = MS_PER_HOUR) -> DataFrame:
    """Every unbroken run of failed checks: entity_name, n_failed, first_ms, last_ms.

    A failure's streak is known by the number of successes before it: those before it in its chunk plus those of all
    earlier chunks.
    """
    rows = ticks.select("entity_name", "tick_id", "ts_ms", whole(F.col("ts_ms"), chunk_ms).alias("chunk"),
                        (F.col("result") == "SUCCESS").cast("bigint").alias("ok"))
    in_chunk = Window.partitionBy("entity_name", "chunk").orderBy("ts_ms", "tick_id")
    local = (rows.withColumn("before", F.sum("ok").over(in_chunk)).where(F.col("ok") == 0)
             .groupBy("entity_name", "chunk", "before")
             .agg(F.count("*").alias("n_failed"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms")))
    earlier = Window.partitionBy("entity_name").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (rows.groupBy("entity_name", "chunk").agg(F.sum("ok").alias("n_ok"))
               .select("entity_name", "chunk", F.coalesce(F.sum("n_ok").over(earlier), F.lit(0)).alias("offset")))
    return (local.join(offsets, ["entity_name", "chunk"])
            .groupBy("entity_name", (F.col("offset") + F.col("before")).alias("streak"))
            .agg(F.sum("n_failed").alias("n_failed"), F.min("first_ms").alias("first_ms"),
                 F.max("last_ms").alias("last_ms")).drop("streak"))


def consecutive_failures(ticks: DataFrame, n: int, chunk_ms: int = MS_PER_HOUR) -> DataFrame:
    """Streaks of at least `n` failed checks."""
    return failure_streaks(ticks, chunk_ms).where(F.col("n_failed") >= n)


def no_success_for(ticks: DataFrame, now_ms: int, hours: float) -> DataFrame:
    """Entities whose last success is more than `hours` ago, or that never succeeded."""
    last = ticks.groupBy("entity_name").agg(
        F.max(F.when(F.col("result") == "SUCCESS", F.col("ts_ms"))).alias("last_success_ms"),
        F.count("*").alias("n_ticks"))
    limit = now_ms - int(hours * MS_PER_HOUR)
    return last.where(F.col("last_success_ms").isNull() | (F.col("last_success_ms") < limit))


def write_gaps(table_history: DataFrame, chunk_ms: int = MS_PER_DAY) -> DataFrame:
    """(table_name, gap_ms, n): time between consecutive data writes of a table, within a chunk and from a chunk to the next
    one used, and how often there.

    History is reduced to one row per chunk and length of gap, with the first and last write around such gaps, and the gaps
    between chunks follow from that: both sides come from one shuffle of the writes, so history is read once.
    """
    writes = table_history.where(F.col("operation").isin(*WRITE_OPERATIONS)).select(
        "table_name", "version", "ts_ms", whole(F.col("ts_ms"), chunk_ms).alias("chunk"))
    in_chunk = Window.partitionBy("table_name", "chunk").orderBy("ts_ms", "version")
    inside = writes.withColumn("gap_ms", F.col("ts_ms") - F.lag("ts_ms").over(in_chunk)).groupBy("table_name", "chunk", "gap_ms").agg(
        F.count("*").alias("n"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))
    by_chunk = Window.partitionBy("table_name").orderBy("chunk")
    between = (inside.groupBy("table_name", "chunk").agg(F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"))
               .select("table_name", (F.col("first_ms") - F.lag("last_ms").over(by_chunk)).alias("gap_ms"), F.lit(1).cast("bigint").alias("n")))
    return inside.select("table_name", "gap_ms", "n").unionByName(between).where(F.col("gap_ms").isNotNull())


def gap_summary(gaps: DataFrame, chunk_ms: int = MS_PER_MINUTE) -> DataFrame:
    """table_name -> n_gaps, max_gap_ms and the exact lower median_gap_ms of `gaps` (table_name, gap_ms, n).

    Equal gaps are counted before the shuffle. The chunk of gap lengths that holds the median is found from one count
    per chunk; only that chunk's gaps, of at most `chunk_ms` different lengths, are then ordered.
    """
    counts = gaps.groupBy("table_name", "gap_ms").agg(F.sum("n").alias("n")).withColumn(
        "chunk", whole(F.col("gap_ms"), chunk_ms))
    per_table = Window.partitionBy("table_name")
    n_before = F.sum("n_chunk").over(per_table.orderBy("chunk")) - F.col("n_chunk")
    place = F.expr("(n_gaps + 1) div 2")
    holders = (counts.groupBy("table_name", "chunk").agg(F.sum("n").alias("n_chunk"), F.max("gap_ms").alias("top_ms"))
               .withColumns({"before": n_before, "n_gaps": F.sum("n_chunk").over(per_table),
                             "max_gap_ms": F.max("top_ms").over(per_table)})
               .where((F.col("before") < place) & (F.col("before") + F.col("n_chunk") >= place)))
    ranked = holders.join(counts, ["table_name", "chunk"]).withColumn(
        "reached", F.col("before") + F.sum("n").over(Window.partitionBy("table_name").orderBy("gap_ms")))
    return ranked.groupBy("table_name").agg(F.first("n_gaps").alias("n_gaps"), F.first("max_gap_ms").alias("max_gap_ms"),
                                            F.min(F.when(F.col("reached") >= place, F.col("gap_ms"))).alias("median_gap_ms"))


def refresh_gaps(tracker: DataFrame, table_history: DataFrame, chunk_ms: int = MS_PER_DAY) -> DataFrame:
    """Per tracker row and source: the gaps between its data writes against the row's window (a derived report).

    Only the history of tables that the rows read is looked at. The median is the lower one, and exact.
    """
    rows = tracker_rows(tracker).where(F.col("window_mins").isNotNull()).select(
        "entity_name", "entity_type", "src_group", "window_mins",
        F.explode(F.array_distinct("tables")).alias("table_name"))
    wanted = rows.select("table_name").distinct()
    per_table = gap_summary(write_gaps(table_history.join(wanted, "table_name", "left_semi"), chunk_ms))
    window_ms = F.col("window_mins").cast("bigint") * F.lit(MS_PER_MINUTE)
    return rows.join(per_table, "table_name").select(
        "entity_name", "entity_type", "src_group", "table_name", "window_mins", "n_gaps", "median_gap_ms", "max_gap_ms",
        (window_ms < F.col("median_gap_ms")).alias("window_below_median"),
        (window_ms < F.col("max_gap_ms")).alias("window_below_max"))
