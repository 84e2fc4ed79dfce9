"""Which entities wait for each other, and which dependencies are given up so that they can be placed at all.

Cycles are the strongly connected components of the dependency graph. Two entities of one component wait for the same entities,
and the same ones wait for them; so a dependency whose ends differ in the largest name among either is on no cycle and is cut.
Once nothing is left to cut, the ends of all dependencies that hang together wait for one largest name, which waits for all of
them: what hangs together is a component. Hashes of the names are orders like the names themselves; the more of them are
followed at once, the more is cut in a round. All steps are joins and aggregations over edges.
"""
from pyspark.sql import Column, DataFrame, functions as F

from refreshgate.plans.ordering import STEPS_PER_CUT, among, arrange
from refreshgate.session import cut_counted

N_ORDERS = 4  # that of the names, which alone makes it exact, and hashes that cut more at once
UP, DOWN = ([f"{side}{k}" for k in range(N_ORDERS)] for side in ("up", "down"))


def _ranks(entity: str) -> list[Column]:
    return [F.col(entity), *[F.xxhash64(entity, F.lit(k)) for k in range(1, N_ORDERS)]]


def _largest(edges: DataFrame) -> DataFrame:
    """entity -> the largest of each order among itself and all it waits for (UP), and among itself and all that wait for
    it (DOWN); of every entity that `edges` name."""
    own = edges.select("entity").union(edges.select("upstream")).distinct()
    links = cut_counted(
        edges.select("entity", F.col("upstream").alias("other"), F.lit(True).alias("is_up"), F.lit(False).alias("is_down"))
        .union(edges.select("upstream", "entity", F.lit(False), F.lit(True)))
        .union(own.select("entity", "entity", F.lit(True), F.lit(True))), n=F.count(F.lit(1)))[0]
    largest = links.where(F.col("is_up") & F.col("is_down")).select(
        "entity", *[rank.alias(c) for side in (UP, DOWN) for rank, c in zip(_ranks("entity"), side)])
    itself, moved = F.col("is_up") & F.col("is_down"), 1
    best = [F.max(F.when(F.col("is_up"), F.col(c))).alias(c) for c in UP] + [F.max(F.when(F.col("is_down"), F.col(c))).alias(c) for c in DOWN]
    was = [F.max(F.when(itself, F.col(c))).alias(f"was_{c}") for c in UP + DOWN]
    while moved:
        for step in range(STEPS_PER_CUT):
            met = links.join(largest.withColumnRenamed("entity", "other"), "other")
            largest = met.groupBy("entity").agg(*best, *(was if step == STEPS_PER_CUT - 1 else []))
        differs = [F.col(c) != F.col(f"was_{c}") for c in UP + DOWN]
        largest, seen = cut_counted(largest, moved=F.count_if(F.greatest(*differs)))
        largest, moved = largest.select("entity", *UP, *DOWN), seen["moved"]
    return largest


def cycle_members(edges: DataFrame) -> DataFrame:
    """(entity, cycle) for every entity that waits for itself by way of others; a cycle is named by its smallest member.

    Cycles that share an entity are one.
    """
    left, seen = cut_counted(edges.where(F.col("entity") != F.col("upstream")).select("entity", "upstream").distinct(), n=F.count(F.lit(1)))
    n_left = seen["n"]
    while n_left:
        largest = _largest(left)
        upper = largest.select(F.col("entity").alias("upstream"), *[F.col(c).alias(f"of_{c}") for c in UP + DOWN])
        same = [F.col(c) == F.col(f"of_{c}") for c in UP + DOWN]
        left, seen = cut_counted(left.join(largest, "entity").join(upper, "upstream").where(F.least(*same)).select("entity", "upstream"),
                                 n=F.count(F.lit(1)))
        if seen["n"] == n_left:
            named = largest.groupBy(UP[0]).agg(F.min("entity").alias("cycle"))
            return largest.select("entity", UP[0]).join(named, UP[0]).select("entity", "cycle")
        n_left = seen["n"]
    return left.select("entity", F.col("upstream").alias("cycle"))


def dependency_cycles(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities on a cycle or that give up a dependency: entity, cycle, n_members (NULL off cycles), given_up (upstreams,
    sorted, at most the entity's own).

    What is given up is what `ordering.arrange` has to drop; an entity off any cycle gives up one too if it is let go
    before a cycle that it waits for.
    """
    members = cycle_members(among(edges, entities))
    sizes = members.groupBy("cycle").agg(F.count("*").alias("n_members"))
    _, dropped = arrange(entities, edges)
    given = dropped.groupBy("entity").agg(F.array_sort(F.collect_set("upstream")).alias("given_up"))
    return members.join(sizes, "cycle").join(given, "entity", "full").select(
        "entity", "cycle", "n_members", F.coalesce("given_up", F.array().cast("array<string>")).alias("given_up"))
