import random

import pytest
from pyspark.sql import functions as F

from helpers import records, relation
from refreshgate.plans import cycles, impact
from refreshgate.sources.slots import SlotStore

EDGES = "entity string, upstream string"


def plain_reach(edges):
    """entity -> {upstream: least number of steps}."""
    out = {}
    for start in {e for pair in edges for e in pair}:
        seen, level, d = {}, {start}, 0
        while level:
            d += 1
            level = {u for e, u in edges if e in level} - set(seen)
            seen.update(dict.fromkeys(level, d))
        out[start] = seen
    return out


def plain_members(edges):
    reach = plain_reach([(e, u) for e, u in edges if e != u])
    return sorted((a, min(b for b in reach[a] if a in reach[b])) for a in reach if a in reach[a])


def graph(kind):
    rng = random.Random(kind)
    if kind == "chain":
        return [(f"n{k:02d}", f"n{k + 1:02d}") for k in range(40)]
    if kind == "ring":
        return [(f"n{k:02d}", f"n{(k + 1) % 25:02d}") for k in range(25)] + [("tail", "n03"), ("n04", "head"), ("n04", "n04")]
    if kind == "nested":
        return [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "b"), ("e", "a"), ("x", "y"), ("y", "x"), ("y", "e"), ("z", "x"), ("q", "q")]
    n = {"sparse": 30, "dense": 14}[kind]
    return [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(n * (1 if kind == "sparse" else 3))]


@pytest.mark.parametrize("kind", ["chain", "nested", "dense"])
def test_members(spark, kind):
    edges = graph(kind)
    assert records(cycles.cycle_members(relation(spark, EDGES, edges + edges[:3])), "entity", "cycle") == plain_members(edges)


def test_cycles_in_a_row_are_found_at_once(spark, monkeypatch):
    """Of 12 cycles of which each waits for the next, the last has the largest names."""
    edges = [(f"n{k:02d}", f"n{k + 1:02d}") for k in range(23)] + [(f"n{k + 1:02d}", f"n{k:02d}") for k in range(0, 24, 2)]
    cuts, cut = [], cycles.cut_counted
    monkeypatch.setattr(cycles, "cut_counted", lambda *a, **b: cuts.append(1) or cut(*a, **b))
    assert records(cycles.cycle_members(relation(spark, EDGES, edges)), "entity", "cycle") == plain_members(edges)
    assert len(cuts) <= 20


def test_dependency_cycles(spark):
    edges = [("a", "b"), ("b", "a"), ("c", "a"), ("k", "p"), ("p", "q"), ("q", "p"), ("p", "gone")]
    entities = relation(spark, "entity string", [(e,) for e in "abckpqz"])
    # k comes before the cycle it waits for, so it is let go first
    assert records(cycles.dependency_cycles(entities, relation(spark, EDGES, edges))) == [
        ("a", "a", 2, ["b"]), ("b", "a", 2, []), ("k", None, None, ["p"]), ("p", "p", 2, ["q"]), ("q", "p", 2, [])]
    assert cycles.dependency_cycles(entities, relation(spark, EDGES, [])).count() == 0


@pytest.mark.parametrize("kind", ["chain", "ring"])
def test_impact(spark, tmp_path, kind):
    edges = graph(kind)
    index = impact.impact_index(relation(spark, EDGES, edges))
    want = sorted((u, e, d) for e, found in plain_reach(edges).items() for u, d in found.items() if u != e)
    assert records(index, "upstream", "entity", "distance") == want
    reads = relation(spark, "entity string, table_name string", [(e, f"t-{u}") for e, u in edges] + [("lone", "t-out"), ("lone", "t-out")])
    asked = relation(spark, "table_name string", [(f"t-{edges[2][1]}",), ("t-out",), ("t-unknown",)])
    store = impact.store_index(index, str(tmp_path / "index"), 4)
    readers = reads.join(asked, "table_name").selectExpr("entity as upstream")
    found = impact.impact_of(asked, reads, impact.read_index(store, readers))
    distances = {("t-out", "lone"): 1}
    for reader in {e for e, u in edges if u == edges[2][1]}:
        table = f"t-{edges[2][1]}"
        for entity, d in [(reader, 1)] + [(e, d + 1) for u, e, d in want if u == reader]:
            distances[table, entity] = min(d, distances.get((table, entity), d))
    assert records(found, "table_name", "entity", "distance") == sorted((*k, d) for k, d in distances.items())


def test_slots(spark, tmp_path):
    store = SlotStore(str(tmp_path / "s"), "k string, v int", "k", 8)
    store.write(relation(spark, store.schema, [(f"k{n}", n) for n in range(50)]), 0)
    some = relation(spark, "k string", [("k1",), ("k2",)])
    slots = store.slots_of(some)
    store.write(store.read(spark, slots, 1).withColumn("v", F.lit(-1)), 1)
    assert {r["v"] for r in store.read(spark, slots, 2).collect()} == {-1}
    assert {r["v"] for r in store.read(spark, slots, 1).collect()} != {-1}
    assert store.read(spark, list(range(8)), 9).count() == 50
