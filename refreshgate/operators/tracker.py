"""Reading, editing and checking tracker rows: every function takes whole tables and returns a whole table."""
from pyspark.sql import Column, DataFrame, functions as F

from refreshgate.functions.names import DEFAULT_GROUP, group_name, without
from refreshgate.operators.freshness import tracker_rows, with_row_id
from refreshgate.operators.runs import ENTITY_TYPES
from refreshgate.schemas import PRODUCERS_TYPE, TRACKER_COLUMNS

DEFAULT_WINDOW_MINS = 5
KEY = ["entity_name", "entity_type", "src_group"]


def select_rows(tracker: DataFrame, entity_type: str = "ALL", entity_name: str | None = None,
                src_group: str = "") -> DataFrame:
    """Rows of one entity type, entity or group; each limit is optional."""
    if entity_type != "ALL":
        tracker = tracker.where(F.col("entity_type") == entity_type)
    if entity_name is not None:
        tracker = tracker.where(F.col("entity_name") == entity_name)
    if src_group:
        tracker = tracker.where(F.coalesce("src_group", F.lit(DEFAULT_GROUP)) == src_group)
    return tracker


def candidates(tracker: DataFrame, refreshed: DataFrame, entity_type: str = "ALL") -> DataFrame:
    """Tracker rows that read one of the `refreshed` tables without skipping it, whatever their type."""
    rows = with_row_id(select_rows(tracker, entity_type))
    hits = (tracker_rows(rows).select("row_id", F.explode("tables").alias("table_name"))
            .join(refreshed.select("table_name"), "table_name", "left_semi").select("row_id").distinct())
    return rows.join(hits, "row_id", "left_semi").select(*tracker.columns)


def upsert(existing: DataFrame, incoming: DataFrame, today: str, user: str) -> DataFrame:
    """The next snapshot of the tracker.

    A matched row takes the incoming targets, sources and producers and keeps its skip list, window and creation
    audit; a new row starts with an empty skip list and the default window. Two incoming rows with one key are an
    error, as they are for MERGE.
    """
    payload = ("target_tables", "src_tables", "src_table_producers")
    unique = (incoming.groupBy(*KEY).agg(F.count("*").alias("n"), F.first(F.struct(*payload)).alias("new"))
              .select(*KEY, F.when(F.col("n") > 1, F.raise_error(F.concat(
                  F.lit("duplicate incoming row for "), "entity_type", F.lit(" '"), "entity_name", F.lit("'"))))
                  .otherwise(F.col("new")).alias("new")))
    old = existing.select(F.struct(*TRACKER_COLUMNS).alias("old"), "entity_name", "entity_type",
                          F.coalesce("src_group", F.lit(DEFAULT_GROUP)).alias("src_group"))
    both = old.join(unique, KEY, "full")
    has_new, has_old = F.col("new").isNotNull(), F.col("old").isNotNull()
    day = F.lit(today).cast("date")

    def kept(name, default) -> Column:
        return F.when(has_old, F.col(f"old.{name}")).otherwise(default).alias(name)

    def audit(name, value) -> Column:
        return F.when(has_new, value).otherwise(F.col(f"old.{name}")).alias(name)

    return both.select(
        "entity_name", "entity_type", kept("src_group", F.col("src_group")),
        *[F.when(has_new, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in payload[:2]],
        kept("src_tables_to_skip", F.array().cast("array<string>")),
        F.when(has_new, F.col("new.src_table_producers")).otherwise(F.col("old.src_table_producers"))
        .alias("src_table_producers"),
        kept("refresh_window_btn_tables_in_mins", F.lit(DEFAULT_WINDOW_MINS)),
        kept("created_on", day), audit("updated_on", day), kept("created_by", F.lit(user)),
        audit("updated_by", F.lit(user)))


def merge_statement() -> str:
    """The same upsert as one MERGE, for a catalog whose tables support row-level changes; to be run with the named
    parameters `tracker` and `incoming`, the names of the table and of the view with the new rows."""
    columns = list(TRACKER_COLUMNS)
    values = {"entity_name": "s.entity_name", "entity_type": "s.entity_type", "src_group": "s.src_group",
              "target_tables": "s.target_tables", "src_tables": "s.src_tables",
              "src_tables_to_skip": "cast(array() AS array<string>)", "src_table_producers": "s.src_table_producers",
              "refresh_window_btn_tables_in_mins": str(DEFAULT_WINDOW_MINS), "created_on": "current_date()",
              "updated_on": "current_date()", "created_by": "current_user()", "updated_by": "current_user()"}
    replaced = ("target_tables", "src_tables", "src_table_producers", "updated_on", "updated_by")
    return (f"MERGE INTO IDENTIFIER(:tracker) AS t USING IDENTIFIER(:incoming) AS s "
            f"ON t.entity_name = s.entity_name AND t.entity_type = s.entity_type "
            f"AND coalesce(t.src_group, '{DEFAULT_GROUP}') = s.src_group "
            f"WHEN MATCHED THEN UPDATE SET {', '.join(f't.{c} = {values[c]}' for c in replaced)} "
            f"WHEN NOT MATCHED THEN INSERT ({', '.join(columns)}) VALUES ({', '.join(values[c] for c in columns)})")


# edit actions, in edits(entity_name, entity_type, src_group, seq, action, table_name, producer_type, producer_id,
# window_mins, new_name); a NULL src_group means every group of the entity
ADD_SOURCE, SET_PRODUCER, ADD_TARGET, ADD_SKIP = "ADD_SOURCE", "SET_PRODUCER", "ADD_TARGET", "ADD_SKIP"
SET_WINDOW, RENAME = "SET_WINDOW", "RENAME"


def apply_edits(tracker: DataFrame, edits: DataFrame, today: str, user: str) -> DataFrame:
    """The tracker after a batch of edits: any number of them is one join, applied in `seq` order within a row."""
    keyed = tracker.withColumn("_group", group_name(F.col("src_group")))
    groups = keyed.select("entity_name", "entity_type", "_group").distinct()
    everywhere = edits.where(F.col("src_group").isNull()).drop("src_group").join(groups, ["entity_name", "entity_type"])
    named = edits.where(F.col("src_group").isNotNull()).withColumnRenamed("src_group", "_group")
    per_group = everywhere.unionByName(named)

    def names(action) -> Column:
        """Tables named by an action, in order; they end up in the row's own array."""
        picked = F.array_sort(F.collect_list(F.when(F.col("action") == action, F.struct("seq", "table_name"))))
        return F.transform(picked, lambda e: e["table_name"])

    def last(action, value) -> Column:
        return F.max_by(value, F.when((F.col("action") == action), F.col("seq")))

    producer = F.when(F.col("action").isin(ADD_SOURCE, SET_PRODUCER) & F.col("producer_type").isNotNull(),
                      F.struct("seq", "table_name", F.struct("producer_type", "producer_id").alias("producer")))
    changes = per_group.groupBy("entity_name", "entity_type", "_group").agg(
        names(ADD_SOURCE).alias("_sources"), names(ADD_TARGET).alias("_targets"), names(ADD_SKIP).alias("_skips"),
        F.array_sort(F.collect_list(producer)).alias("_producers"),
        last(SET_WINDOW, F.col("window_mins")).alias("_window"), last(RENAME, F.col("new_name")).alias("_name"),
        F.lit(True).alias("_edited"))
    rows = keyed.join(changes, ["entity_name", "entity_type", "_group"], "left")
    none = F.array().cast("array<string>")
    entries = F.coalesce("_producers", F.array().cast(
        "array<struct<seq: bigint, table_name: string, producer: struct<producer_type: string, producer_id: string>>>"))
    # the last entry of a table stands
    standing = F.filter(entries, lambda e: ~F.exists(
        entries, lambda o: (o["table_name"] == e["table_name"]) & (o["seq"] > e["seq"])))
    new_map = F.map_from_entries(F.transform(standing, lambda e: F.struct(e["table_name"], e["producer"])))
    old_map = F.coalesce("src_table_producers", F.create_map().cast(PRODUCERS_TYPE))
    set_names = F.transform(standing, lambda e: e["table_name"])
    producers = F.map_concat(F.map_filter(old_map, lambda k, v: ~F.array_contains(set_names, k)), new_map)

    def grown(column, added) -> Column:
        return F.when(F.size(added) > 0, F.array_distinct(F.concat(column, added))).otherwise(column)

    edited = {
        "entity_name": F.coalesce("_name", "entity_name"),
        "target_tables": grown(F.col("target_tables"), F.col("_targets")),
        "src_tables": grown(F.col("src_tables"), F.col("_sources")),
        "src_tables_to_skip": F.when(F.size("_skips") > 0, F.array_distinct(F.concat(
            F.coalesce("src_tables_to_skip", none), F.col("_skips")))).otherwise(F.col("src_tables_to_skip")),
        "src_table_producers": F.when(F.size(standing) > 0, producers).otherwise(F.col("src_table_producers")),
        "refresh_window_btn_tables_in_mins": F.coalesce(F.col("_window"), F.col("refresh_window_btn_tables_in_mins")),
        "updated_on": F.when(F.col("_edited"), F.lit(today).cast("date")).otherwise(F.col("updated_on")),
        "updated_by": F.when(F.col("_edited"), F.lit(user)).otherwise(F.col("updated_by")),
    }
    return rows.select(*[edited.get(c, F.col(c)).alias(c) for c in TRACKER_COLUMNS])


def register(tracker: DataFrame, rows: DataFrame) -> DataFrame:
    """Tracker with hand-written rows added."""
    return tracker.unionByName(rows, allowMissingColumns=True)


def validate(tracker: DataFrame) -> DataFrame:
    """What is wrong with tracker rows: (entity_name, entity_type, src_group, issue, detail).

    Issues of a row are found in the row itself; only repeated keys need a shuffle.
    """
    none = F.array().cast("array<string>")
    skips = F.array_distinct(F.coalesce("src_tables_to_skip", none))
    sources = F.coalesce("src_tables", none)

    def issue(name, detail):
        return F.struct(F.lit(name).alias("issue"), detail.cast("string").alias("detail"))

    known = F.coalesce(F.upper("entity_type").isin(*ENTITY_TYPES), F.lit(False))
    single = F.array(
        F.when(F.col("refresh_window_btn_tables_in_mins").isNull(), issue("window is NULL", F.lit(""))),
        F.when(F.size(without(sources, skips)) == 0, issue("no source tables to check", F.lit(""))),
        F.when(~known, issue("unknown entity_type", F.col("entity_type"))))
    stray = F.transform(F.filter(skips, lambda t: ~F.array_contains(sources, t)),
                        lambda t: issue("skipped table not in src_tables", t))
    found = F.filter(F.concat(single, stray), lambda i: i.isNotNull())
    keys = [F.col("entity_name"), F.col("entity_type"), group_name(F.col("src_group")).alias("src_group")]
    in_row = tracker.select(*keys, F.explode(found).alias("found")).select(*KEY, "found.*")
    repeated = tracker.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1).select(
        *KEY, F.lit("duplicate key").alias("issue"), F.col("n").cast("string").alias("detail"))
    return in_row.unionByName(repeated)
