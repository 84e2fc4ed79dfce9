"""Dependencies between entities and their upstream-first levels."""
from pyspark.sql import DataFrame, functions as F

from refreshgate.session import cut_counted, cut_lineage

STEPS_PER_CUT = 8


def entity_edges(reads: DataFrame, writes: DataFrame) -> DataFrame:
    """(entity, upstream, table_name): `entity` reads a table that `upstream`, another entity, writes.

    reads and writes hold (entity, table_name). Every pair is part of the result; the lists of shared tables are built
    where they are shown.
    """
    consumers = reads.select("entity", "table_name").distinct()
    producers = writes.select(F.col("entity").alias("upstream"), "table_name").distinct()
    return consumers.join(producers, "table_name").where(F.col("entity") != F.col("upstream")).select(
        "entity", "upstream", "table_name")


def shared_tables(edges: DataFrame) -> DataFrame:
    """One row per pair of entities with the sorted tables they share, at most the reader's own sources."""
    return edges.groupBy("entity", "upstream").agg(F.array_sort(F.collect_set("table_name")).alias("tables"))


def _release_points(edges: DataFrame) -> DataFrame:
    """entity -> `point`, for entities that wait for a cycle.

    Entities are let go in (type, name) order whenever all that are left wait for each other, so by the time it is
    v's turn everything before v is placed. What is left then are the entities from which an endless walk upstream
    stays at v or after it. Hence an entity is placed at the turn of its point: the largest, over its endless walks,
    of the smallest entity on the walk. `point(e) = max over upstreams u of min(e, point(u))`, starting from e itself,
    settles in as many rounds as the graph is deep, however many entities have to be let go.
    """
    points, seen = cut_counted(edges.select("entity").distinct().withColumn("point", F.col("entity")), n=F.count(F.lit(1)))
    n_points = seen["n"]
    while True:
        lower = points
        for _ in range(STEPS_PER_CUT):
            upstream = lower.select(F.col("entity").alias("upstream"), F.col("point").alias("upstream_point"))
            lower = (edges.join(upstream, "upstream").groupBy("entity")
                     .agg(F.max(F.least("entity", "upstream_point")).alias("point")))
        points, seen = cut_counted(
            lower.join(points.withColumnRenamed("point", "was"), "entity", "left"), n=F.count(F.lit(1)),
            moved=F.count_if(F.col("point") != F.col("was")))
        points = points.select("entity", "point")
        # points only ever sink, so none moved over several steps means none will
        if seen["n"] == n_points and not seen["moved"]:
            return points
        n_points = seen["n"]


def _dropped_edges(edges: DataFrame) -> DataFrame:
    """Edges of a released entity (its own point) to upstreams placed no earlier than itself."""
    points = _release_points(edges)
    upper = points.select(F.col("entity").alias("upstream"), F.col("point").alias("upstream_point"))
    released = points.where(F.col("point") == F.col("entity")).select("entity")
    return (edges.join(released, "entity", "left_semi").join(upper, "upstream")
            .where(F.col("upstream_point") >= F.col("entity")).select("entity", "upstream"))


def _walks(edges: DataFrame) -> DataFrame:
    """entity -> steps of the longest walk upstream over `edges`, STEPS_PER_CUT at most; of entities with an upstream."""
    steps = edges.select("entity").distinct().withColumn("steps", F.lit(1))
    for _ in range(STEPS_PER_CUT - 1):
        upstream = steps.select(F.col("entity").alias("upstream"), F.col("steps").alias("upstream_steps"))
        steps = edges.join(upstream, "upstream", "left").groupBy("entity").agg(
            (F.max(F.coalesce("upstream_steps", F.lit(0))) + 1).alias("steps"))
    return steps


def among(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity, upstream) of `edges` with both ends in `entities`."""
    return (edges.join(entities.select("entity"), "entity", "left_semi")
            .join(entities.select(F.col("entity").alias("upstream")), "upstream", "left_semi").select("entity", "upstream"))


def long_walks(edges: DataFrame) -> tuple[DataFrame, dict]:
    """`_walks` as a written table, with the number of entities whose walks are not at their end (n_open) and the most
    steps of the others (top, NULL if there are none)."""
    unfinished = F.col("steps") == STEPS_PER_CUT
    return cut_counted(_walks(edges), n=F.count(F.lit(1)), n_open=F.count_if(unfinished),
                       top=F.max(F.when(~unfinished, F.col("steps"))))


def arrange(entities: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(levels, dropped): entity -> level, such that an entity comes after everything it waits for, and the
    (entity, upstream) dependencies given up because they close a cycle.

    An entity's level is the length of its longest walk upstream. Walks are followed STEPS_PER_CUT steps at a time; those
    at their end are settled, and the rest go on among themselves. If a number of steps is met by no walk at its end,
    everything that is left waits for a cycle: the first of the rest in (type, name) order would be placed next and give
    up the dependencies it still has, again and again; `_release_points` finds all of those at once, and what remains has
    no cycle. Rounds grow with the depth of the graph, not with the number of entities or cycles.
    """
    nodes = entities.select("entity").distinct()
    edges, seen = cut_counted(among(edges.select("entity", "upstream").distinct(), nodes), n=F.count(F.lit(1)))
    all_edges, settled, dropped, open_nodes, n_nodes, base, highest = edges, [], None, nodes, None, 0, 0
    while seen["n"]:
        walks, walked = long_walks(edges)
        if n_nodes is not None and walked["n"] < n_nodes:  # some have no open upstream left
            highest = max(highest, base)
        highest = max(highest, base + (walked["top"] or 0))
        steps = open_nodes.join(walks, "entity", "left").select("entity", F.coalesce("steps", F.lit(0)).alias("steps"))
        settled.append(steps.where(F.col("steps") < STEPS_PER_CUT).select("entity", (F.col("steps") + base).alias("level")))
        open_nodes, n_nodes = walks.where(F.col("steps") == STEPS_PER_CUT).select("entity"), walked["n_open"]
        if not n_nodes:
            break
        edges, seen = cut_counted(among(edges, open_nodes), n=F.count(F.lit(1)))
        base += STEPS_PER_CUT
        if walked["top"] != STEPS_PER_CUT - 1:  # every entity left waits for a cycle
            dropped = cut_lineage(_dropped_edges(edges))
            edges, seen = cut_counted(edges.join(dropped, ["entity", "upstream"], "left_anti"), n=F.count(F.lit(1)))
            settled_above = all_edges.join(open_nodes, "entity", "left_semi").join(
                open_nodes.select(F.col("entity").alias("upstream")), "upstream", "left_anti")
            base = highest if settled_above.isEmpty() else highest + 1
    if not settled or n_nodes:
        settled.append(open_nodes.select("entity", F.lit(base).alias("level")))
    levels = settled[0]
    for more in settled[1:]:
        levels = levels.unionByName(more)
    return levels, edges.limit(0) if dropped is None else dropped


def upstream_levels(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """entity -> level, upstream first."""
    return arrange(entities, edges)[0]


def kept_edges(edges: DataFrame, levels: DataFrame, dropped: DataFrame) -> DataFrame:
    """Edges between arranged entities that were not given up, with the upstream's level."""
    upper = levels.select(F.col("entity").alias("upstream"), F.col("level").alias("upstream_level"))
    return (edges.join(levels.select("entity"), "entity", "left_semi").join(upper, "upstream")
            .join(dropped, ["entity", "upstream"], "left_anti")
            .select("entity", "upstream", "table_name", "upstream_level"))
