"""When every group was fresh, over all of its history: the gate at any number of instants without asking it once for each.

A source is fresh from a refresh until its window has passed, so its fresh time is the union of such spans. Refreshes of a
subject (see `streaming.expiry_wheel.gate_links`) that follow each other within the window only lengthen a span; what counts
are the breaks between them. Breaks are found within chunks of time and between them, so a subject with most of the refreshes
is dealt over as many tasks as it has chunks, and only its breaks go on. A sweep over the beginnings and ends of its sources'
spans then gives the spans of a group.
"""
from pyspark.sql import DataFrame, Window, functions as F

from refreshgate.functions.times import MS_PER_DAY, whole


def breaks(refreshes: DataFrame, least: DataFrame, chunk_ms: int = MS_PER_DAY) -> DataFrame:
    """(subject, before_ms, after_ms): neighbouring refreshes of a subject further apart than its `least_ms`. The first has no
    `before_ms`, and one more after the last refresh has no `after_ms`.

    refreshes: (subject, refreshed_ms), any number of each; least: (subject, least_ms), one row per subject.
    """
    rows = refreshes.join(least, "subject").select("subject", "least_ms", F.col("refreshed_ms").alias("ms"),
                                                   whole(F.col("refreshed_ms"), chunk_ms).alias("chunk"))
    in_chunk = Window.partitionBy("subject", "chunk").orderBy("ms")
    inside = rows.withColumn("before_ms", F.lag("ms").over(in_chunk))
    apart = F.col("after_ms") - F.col("before_ms") > F.col("least_ms")
    within = inside.select("subject", "least_ms", "before_ms", F.col("ms").alias("after_ms")).where(apart)
    chunks = inside.groupBy("subject", "chunk").agg(F.min("ms").alias("first"), F.max("ms").alias("last"), F.first("least_ms").alias("least_ms"))
    by_chunk = Window.partitionBy("subject").orderBy("chunk")
    between = chunks.select("subject", "least_ms", F.lag("last").over(by_chunk).alias("before_ms"), F.col("first").alias("after_ms")).where(
        F.col("before_ms").isNull() | apart)
    end = chunks.groupBy("subject").agg(F.max("last").alias("before_ms")).select("subject", "before_ms", F.lit(None).cast("bigint").alias("after_ms"))
    return within.unionByName(between).select("subject", "before_ms", "after_ms").unionByName(end)


def subject_spans(refreshes: DataFrame, links: DataFrame, chunk_ms: int = MS_PER_DAY) -> DataFrame:
    """(subject, window_ms, from_ms, until_ms): when each subject was fresh for each window that a source has; disjoint."""
    windows = links.select("subject", "window_ms").distinct()
    least = windows.groupBy("subject").agg(F.min("window_ms").alias("least_ms"))
    wide = F.col("before_ms").isNull() | F.col("after_ms").isNull() | (F.col("after_ms") - F.col("before_ms") > F.col("window_ms"))
    own = breaks(refreshes, least, chunk_ms).join(windows, "subject").where(wide)
    in_order = Window.partitionBy("subject", "window_ms").orderBy(F.col("before_ms").asc_nulls_first(), F.col("after_ms").asc_nulls_last())
    return (own.withColumn("last_ms", F.lead("before_ms").over(in_order)).where(F.col("after_ms").isNotNull())
            .select("subject", "window_ms", F.col("after_ms").alias("from_ms"), (F.col("last_ms") + F.col("window_ms") + 1).alias("until_ms")))


def _sweep(spans: DataFrame, keys: list[str], needed) -> DataFrame:
    """(keys, from_ms, until_ms): when at least `needed` spans of a key are open; `needed` may be a column of the spans."""
    ends = F.explode(F.array(F.struct(F.col("from_ms").alias("at_ms"), F.lit(1).alias("step")),
                             F.struct(F.col("until_ms").alias("at_ms"), F.lit(-1).alias("step")))).alias("end")
    steps = spans.withColumn("needed", needed).select(*keys, "needed", ends).groupBy(*keys, F.col("end.at_ms").alias("at_ms")).agg(
        F.sum("end.step").alias("step"), F.first("needed").alias("needed"))
    in_order = Window.partitionBy(*keys).orderBy("at_ms")
    state = steps.withColumn("open", F.sum("step").over(in_order) >= F.col("needed"))
    moved = state.withColumn("was", F.lag("open", 1, False).over(in_order)).where(F.col("open") != F.col("was"))
    return (moved.withColumn("until_ms", F.lead("at_ms").over(in_order)).where("open")
            .select(*keys, F.col("at_ms").alias("from_ms"), "until_ms"))


def fresh_intervals(refreshes: DataFrame, links: DataFrame, chunk_ms: int = MS_PER_DAY) -> DataFrame:
    """(row_id, from_ms, until_ms): every span [from_ms, until_ms) in which all sources of a group were fresh; disjoint.

    refreshes: (subject, refreshed_ms), any number of each; links: (row_id, pos, subject, window_ms).
    """
    spans = links.join(subject_spans(refreshes, links, chunk_ms), ["subject", "window_ms"])
    sources = _sweep(spans, ["row_id", "pos"], F.lit(1))  # a source may have several subjects
    counts = links.groupBy("row_id").agg(F.count_distinct("pos").alias("n_sources"))
    return _sweep(sources.join(counts, "row_id"), ["row_id"], F.col("n_sources"))


def gate_as_of(rows: DataFrame, intervals: DataFrame, times: list[int]) -> DataFrame:
    """`rows` (row_id, checked and others) once for each of `times`, as now_ms, with their verdict then."""
    asked = rows.withColumn("now_ms", F.explode(F.array(*[F.lit(t).cast("bigint") for t in times])))
    spans = intervals.select(F.col("row_id").alias("id"), "from_ms", "until_ms")
    found = asked.join(spans, (F.col("row_id") == F.col("id")) & (F.col("from_ms") <= F.col("now_ms")) & (F.col("now_ms") < F.col("until_ms")), "left")
    verdict = F.when(~F.col("checked"), "UNCHECKED").when(F.col("id").isNotNull(), "FRESH").otherwise("STALE")
    return found.select(*rows.columns, "now_ms", verdict.alias("verdict"))
