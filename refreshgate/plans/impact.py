"""What lies downstream of a table, however far, and at what distance.

The index holds, for every entity, all entities downstream of it with the least number of hand-offs. It is made by
doubling: two entities more than k and at most 2k apart are joined by one that is exactly k from the first, so the index is
complete after as many rounds as the logarithm of the longest distance, cycles or not. A question is then one look-up of the
readers of its tables, not a walk.
"""
from pyspark.sql import DataFrame, functions as F

from refreshgate.session import cut_counted
from refreshgate.sources.slots import SlotStore

INDEX = "upstream string, entity string, distance int"


def impact_index(edges: DataFrame) -> DataFrame:
    """(upstream, entity, distance) of all pairs of different entities of which the second is downstream of the first.

    The result is as large as there are such pairs. Each round joins the pairs that are exactly `reach` apart with the
    nearer ones, so a pair is met once for each entity on its shortest paths at that distance.
    """
    first = edges.where(F.col("entity") != F.col("upstream")).select("upstream", "entity").distinct().withColumn("distance", F.lit(1))
    known, seen = cut_counted(first, n=F.count(F.lit(1)))
    farthest, reach = known, 1
    while seen["n"]:
        onward = known.select(F.col("upstream").alias("middle"), F.col("entity").alias("last"), F.col("distance").alias("more"))
        found = (farthest.join(onward, F.col("entity") == F.col("middle")).where(F.col("upstream") != F.col("last"))
                 .groupBy("upstream", F.col("last").alias("entity")).agg(F.min(F.col("distance") + F.col("more")).alias("distance"))
                 .join(known.select("upstream", "entity"), ["upstream", "entity"], "left_anti"))
        reach *= 2
        new, seen = cut_counted(found, n=F.count_if(F.col("distance") == reach))
        known, farthest = known.unionByName(new), new.where(F.col("distance") == reach)
    return known


def store_index(index: DataFrame, path: str, n_slots: int) -> SlotStore:
    """The index in slots by upstream, so that a question opens only the slots of the entities it starts from."""
    store = SlotStore(path, INDEX, "upstream", n_slots)
    store.write(index, 0)
    return store


def read_index(store: SlotStore, starts: DataFrame) -> DataFrame:
    """Rows of a stored index for the entities in `starts` (upstream)."""
    return store.read(starts.sparkSession, store.slots_of(starts), 1).join(starts.distinct(), "upstream", "left_semi")


def impact_of(tables: DataFrame, reads: DataFrame, index: DataFrame) -> DataFrame:
    """(table_name, entity, distance): everything downstream of each table. A direct reader is at distance 1.

    reads: (entity, table_name). An entity that reads what it writes itself may be downstream of its own table.
    """
    readers = tables.select("table_name").distinct().join(reads.select("entity", "table_name").distinct(), "table_name")
    beyond = readers.select("table_name", F.col("entity").alias("upstream")).join(index, "upstream").select(
        "table_name", "entity", (F.col("distance") + 1).alias("distance"))
    return readers.select("table_name", "entity", F.lit(1).alias("distance")).unionByName(beyond).groupBy(
        "table_name", "entity").agg(F.min("distance").alias("distance"))
