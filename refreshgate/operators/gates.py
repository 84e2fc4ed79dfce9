"""Roll-ups of source status: one verdict per source group, one per entity."""
from pyspark.sql import Column, DataFrame, functions as F

from refreshgate.functions.names import list_text
from refreshgate.functions.times import utc_text
from refreshgate.operators.freshness import ROW_KEY

# fixed values: this text and those of `failure_line`, `entity_gate` and `gate_lines`
UNCHECKABLE = "refresh window is NULL or no source tables to check"


def _in_order(condition: Column) -> Column:
    """Names of the sources that meet `condition`, in the row's own order. Never longer than the row's source list."""
    picked = F.collect_list(F.when(condition, F.struct("pos", "table_name")))
    return F.transform(F.array_sort(picked), lambda s: s["table_name"])


def group_verdict(status: DataFrame) -> DataFrame:
    """One row per tracker row: FRESH, STALE with the stale sources, or UNCHECKED."""
    stale = F.col("checked") & ~F.col("is_fresh")
    groups = status.groupBy(*ROW_KEY, "window_mins").agg(
        F.count("table_name").alias("n_sources"), F.count_if(stale).alias("n_stale"),
        F.bool_and("checked").alias("checked"), F.max("cutoff_ms").alias("cutoff_ms"),
        F.max(F.when(F.col("checked"), F.col("data_refreshed_at_ms"))).alias("newest_refresh_ms"),
        _in_order(stale).alias("stale"),
        _in_order(F.col("checked") & F.col("met_without_row_changes")).alias("no_change"))
    verdict = F.when(~F.col("checked"), "UNCHECKED").when(F.col("n_stale") > 0, "STALE").otherwise("FRESH")
    return groups.withColumn("verdict", verdict).drop("checked")


def stale_report(groups: DataFrame) -> DataFrame:
    """Stale groups with the cutoff they missed and one row per stale source."""
    return groups.where(F.col("verdict") == "STALE").select(
        "entity_name", "entity_type", "src_group", "n_stale", "n_sources", "cutoff_ms",
        F.explode("stale").alias("table_name"))


def failure_line() -> Column:
    group = F.concat(F.lit("src_group '"), F.col("src_group"), F.lit("': "))
    stale = F.concat(group, F.col("n_stale").cast("string"), F.lit(" of "), F.col("n_sources").cast("string"),
                     F.lit(" source(s) not refreshed since "), utc_text(F.col("cutoff_ms")), F.lit(": "),
                     list_text(F.col("stale")))
    return F.when(F.col("verdict") == "UNCHECKED", F.concat(group, F.lit(UNCHECKABLE))).when(
        F.col("verdict") == "STALE", stale)


def _label() -> Column:
    return F.concat(F.col("entity_type"), F.lit(" '"), F.col("entity_name"), F.lit("'"))


def entity_gate(groups: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """One row per entity: PASSED when every group is fresh, else FAILED; ERROR for a requested entity with no row.

    Only counts are rolled up, so an entity may have any number of groups; the failing ones are `gate_lines`.
    """
    keys = ["entity_type", "entity_name"]
    gate = groups.groupBy(*keys).agg(
        F.count("*").alias("n_groups"), F.count_if(F.col("verdict") != "FRESH").alias("n_failed"),
        F.sum(F.size("no_change").cast("bigint")).alias("n_no_change"),
        F.max("newest_refresh_ms").alias("newest_refresh_ms"))
    if requested is not None:
        gate = requested.select(*keys).distinct().join(gate, keys, "left")
    verdict = (F.when(F.col("n_groups").isNull(), "ERROR").when(F.col("n_failed") > 0, "FAILED").otherwise("PASSED"))
    headline = (F.when(F.col("verdict") == "ERROR", F.concat(F.lit("No tracker row for "), _label()))
                .when(F.col("verdict") == "FAILED", F.concat(F.lit("Freshness check FAILED for "), _label(), F.lit(":")))
                .otherwise(F.concat(F.lit("Freshness check PASSED for "), _label(), F.lit(": all "),
                                    F.col("n_groups").cast("string"), F.lit(" source group(s) fresh."))))
    return (gate.withColumn("verdict", verdict).withColumn("passed", F.col("verdict") == "PASSED")
            .withColumn("headline", headline))


def gate_lines(groups: DataFrame) -> DataFrame:
    """The lines under each entity's headline: one per failing group, one per source met without row changes."""
    def entry(kind, line):
        return F.struct(F.lit(kind).alias("kind"), line.alias("line"))

    failed = F.array(F.when(F.col("verdict") != "FRESH", entry("failure", failure_line())))
    met = F.transform("no_change", lambda t: entry("met by producer run without row changes",
                                                   F.concat(t, F.lit(" ["), F.col("src_group"), F.lit("]"))))
    lines = F.filter(F.concat(failed, met), lambda e: e.isNotNull())
    return groups.select("entity_type", "entity_name", "src_group", F.explode(lines).alias("entry")).select(
        "entity_type", "entity_name", "src_group", "entry.*")
