import random

from helpers import records, relation
from refreshgate import schemas
from refreshgate.operators import lineage, runs

META = "table_name string, table_id string, table_type string, pipeline_id string, access string"


def meta(spark, *rows):
    return relation(spark, META, [(n, None, kind, owner, access) for n, kind, owner, access in rows])


def lineage_rows(spark, *rows):
    return relation(spark, schemas.TABLE_LINEAGE, [("w", kind, who, run, src, dst, t, None) for kind, who, run, src, dst, t in rows])


def test_tracker_rows_from_lineage(spark):
    entities = relation(spark, "entity_type string, entity_name string, src_group string", [
        ("JOB", "J", "default"), ("JOB", "none", "default"), ("JOB", "twice", "default"), ("PIPELINE", "P2", "default"),
        ("PIPELINE", "loop", "default"), ("PIPELINE", "idle", "default")])
    jobs = relation(spark, schemas.JOBS, [(1, "J"), (2, "none"), (3, "twice"), (4, "twice")])
    pipes = relation(spark, schemas.PIPELINES, [(i, n, "IDLE", False) for i, n in
                                                [("p1", "P1"), ("p2", "P2"), ("p3", "loop"), ("p4", "idle")]])
    tasks = relation(spark, schemas.JOB_TASKS, [(1, "a", "p1", None, None), (1, "b", "p1", None, None), (1, "c", None, "x.py", None),
                                                (2, "d", None, "y.py", None)])
    tables = meta(
        spark, ("m.s.silver", "STREAMING_TABLE", "p1", None), ("m.s.gold", "MATERIALIZED_VIEW", "p1", None),
        ("m.s.sink", "MANAGED", None, None), ("m.s.v", "VIEW", None, None), ("m.s.base", "MANAGED", None, None),
        ("m.s.feed", "MANAGED", None, None), ("m.s.out", "MANAGED", "p2", None), ("m.s.x", "MANAGED", "p3", None),
        ("m.s.y", "MANAGED", "p3", None), ("m.s.closed", "MANAGED", "p1", lineage.NO_ACCESS))
    deps = relation(spark, schemas.VIEW_DEPS, [("m.s.v", "m.s.base"), ("m.s.v", "m.s.silver"), ("m.s.v", "m.s.gone")])
    lines = lineage_rows(
        spark, ("PIPELINE", "p1", "u2", "m.s.feed", "m.s.silver", 20), ("PIPELINE", "p1", "u2", "m.s.silver", "m.s.silver", 20),
        ("PIPELINE", "p1", "u1", "m.s.old", "m.s.silver", 10), ("PIPELINE", "p1", "u2", None, "m.s.silver", 20),
        ("PIPELINE", "p1", "u2", "m.s.silver", "m.s.gold", 21), ("PIPELINE", "p1", "u2", "m.s.v", "m.s.gold", 21),
        ("PIPELINE", "p1", "u2", "m.s.v", "m.s.sink", 21), ("PIPELINE", "p1", "u2", "m.s.v", "m.s.__materialization_1", 21),
        ("PIPELINE", "p1", "u2", "m.s.v", "m.s.closed", 21), ("PIPELINE", "p1", "u2", "m.s.v", "m.s.lost", 21),
        ("PIPELINE", "p2", "u3", "m.s.gold", "m.s.out", 5), ("PIPELINE", "p3", "u4", "m.s.x", "m.s.y", 5),
        ("PIPELINE", "p3", "u4", "m.s.y", "m.s.x", 5), ("JOB", "7", "r1", None, "m.s.feed", 3), ("JOB", "8", "r2", None, "m.s.feed", 4))
    resolved = runs.resolve_names(entities, jobs, pipes)
    steps = lineage.Discovery(entities, resolved, tasks, lines, tables, deps)
    assert records(steps.targets.where("entity_name = 'J'"), "table_name", "status", "reason") == [
        ("m.s.closed", "IGNORED", "PermissionDenied"), ("m.s.gold", "OWNED", None), ("m.s.lost", "IGNORED", "NotFound"),
        ("m.s.silver", "OWNED", None), ("m.s.sink", "IGNORED", "pipeline_id=None")]
    assert records(steps.edges.where("entity_name = 'J'"), "target", "source") == [
        ("m.s.gold", "m.s.silver"), ("m.s.gold", "m.s.v"), ("m.s.silver", "m.s.feed")]
    assert records(steps.expanded.where("entity_name = 'J'"), "name", "kind") == [
        ("m.s.base", "TABLE"), ("m.s.feed", "TABLE"), ("m.s.gone", "MISSING"), ("m.s.silver", "TABLE")]
    assert records(lineage.skipped_tasks(resolved, tasks), "entity_name", "task_key") == [("J", "c"), ("none", "d")]
    rows = lineage.tracker_rows(entities, resolved, tasks, lines, tables, deps)
    got = {r.entity_name: r for r in rows.collect()}
    assert (got["J"].target_tables, got["J"].src_tables, got["J"].error) == (["m.s.gold"], ["m.s.base", "m.s.feed"], None)
    assert {k: tuple(v) for k, v in got["J"].src_table_producers.items()} == {"m.s.base": ("NONE", None), "m.s.feed": ("JOB", "8")}
    assert (got["P2"].src_tables, tuple(got["P2"].src_table_producers["m.s.gold"])) == (["m.s.gold"], ("PIPELINE", "p1"))
    assert got["none"].error == "JOB 'none' has no pipeline tasks — nothing to track."
    assert got["twice"].error == "expected exactly 1 JOB named 'twice', found 2"
    assert got["loop"].error.startswith("No final tables found") and got["idle"].error.startswith("No tables currently managed")

    subset = relation(spark, "entity_type string, entity_name string, src_group string, table_name string",
                      [("JOB", "J", "default", "m.s.feed"), ("PIPELINE", "P2", "default", "m.s.nope")])
    narrowed = {r.entity_name: r for r in lineage.tracker_rows(entities, resolved, tasks, lines, tables, deps, subset).collect()}
    assert narrowed["J"].src_tables == ["m.s.feed"] and list(narrowed["J"].src_table_producers) == ["m.s.feed"]
    assert narrowed["P2"].error == "sources not among the discovered ones: m.s.nope"


def _expand(tables, deps, root, max_depth):
    """Breadth first over single names."""
    found, depth, frontier, seen = set(), 0, {root}, {root}
    while frontier:
        following = set()
        for name in frontier:
            kind, access = tables.get(name, (None, None)) if name in tables else ("gone", None)
            if name not in tables:
                found.add((name, "MISSING"))
            elif access == lineage.NO_ACCESS:
                found.add((f"{name} (no access)", "MISSING"))
            elif kind not in lineage.VIEW_TYPES:
                found.add((name, "TABLE"))
            elif max_depth is not None and depth >= max_depth:
                found.add((name, "UNRESOLVED"))
            else:
                following |= {d for v, d in deps if v == name} - seen
        seen |= following
        frontier, depth = following, depth + 1
    return {(root, name, kind) for name, kind in found}


def test_view_expansion_on_random_graphs(spark):
    rng = random.Random(3)
    for max_depth in (0, 2, 8, None):
        names = [f"n{i}" for i in range(14)]
        tables = {n: (rng.choice(["VIEW", "VIEW", "METRIC_VIEW", "MANAGED", None]), rng.choice([None] * 6 + [lineage.NO_ACCESS]))
                  for n in names if rng.random() < 0.9}
        deps = sorted({(rng.choice(names), rng.choice(names)) for _ in range(26)})
        got = lineage.expand_views(relation(spark, "table_name string", [(n,) for n in names]),
                                   meta(spark, *[(n, k, None, a) for n, (k, a) in tables.items()]),
                                   relation(spark, schemas.VIEW_DEPS, deps), max_depth)
        want = set().union(*[_expand(tables, deps, n, max_depth) for n in names])
        assert {tuple(r) for r in got.select("root", "name", "kind").collect()} == want


def test_a_long_chain_of_views_is_followed_to_its_table(spark):
    names = [f"v{i:02d}" for i in range(20)]
    deps = [*zip(names, names[1:]), (names[-1], "t"), (names[3], names[1])]
    rows = meta(spark, *[(n, "VIEW", None, None) for n in names], ("t", "MANAGED", None, None))
    got = lineage.expand_views(relation(spark, "table_name string", [(names[0],)]), rows, relation(spark, schemas.VIEW_DEPS, deps))
    assert records(got) == [(names[0], "t", "TABLE")]


def test_facts_are_a_row_per_writer_and_target(spark):
    """However many runs and sources a table has; the edges are still those of the latest run, ties and NULLs included."""
    def row(pipeline, run, source, target, ts, kind="PIPELINE"):
        return ("w", kind, pipeline, run, source, target, ts, None)

    rows = [row("p1", f"r{n:03d}", f"s{n % 7}", "t1", n) for n in range(150)]
    rows += [row("p1", "r149", "early", "t1", 3), row("p1", "r149", "t1", "t1", 149), row("p1", "r149", None, "t1", 149), row("p1", None, "no run", "t1", 900)]
    rows += [row("p1", "ra", "a", "t2", 50), row("p2", "rb", "b", "t2", 50), row("p2", "rb", "c", "t2", None), row("p2", "rc", "d", "t2", None)]
    rows += [row("p1", "rx", "x", "t3", None), row("p1", "ry", "y", "t3", None), row("p1", None, "z", "t4", 5), row("9", "r", "j", "t1", 7, "JOB"), row("9", "q", "k", "t1", 8, "JOB")]
    facts = lineage.lineage_facts(relation(spark, schemas.TABLE_LINEAGE, rows))
    columns = ("entity_id", "target_table_full_name", "ts_ms", "run_ts_ms", "has_run")
    assert records(facts, *columns) == sorted([("p1", "t1", 900, 149, True), ("p1", "t2", 50, 50, True), ("p2", "t2", 50, 50, True), ("p1", "t3", None, None, True),
                                               ("p1", "t4", 5, None, False), ("9", "t1", 8, 8, True)], key=repr)
    pipelines = relation(spark, "entity_type string, entity_name string, pipeline_id string", [("JOB", "J", "p1"), ("JOB", "J", "p2")])
    owned = relation(spark, "entity_type string, entity_name string, table_name string", [("JOB", "J", f"t{n}") for n in (1, 2, 3, 4)])
    edges = lineage.latest_write_edges(pipelines, owned, relation(spark, schemas.TABLE_LINEAGE, rows))
    assert records(edges, "target", "source", "seen_ms") == [("t1", "early", 3), ("t1", "s2", 149), ("t2", "b", 50), ("t2", "c", None), ("t3", "y", None)]


def test_other_rows_of_lineage_are_asked_for_one_number_alone(spark, tmp_path, monkeypatch):
    """Of the kind of their writer and their time or run, before anything else: a row of another time or run needs no names."""
    rows = [("w", "PIPELINE", "p", f"r{n}", f"s{n}", "t", n, None) for n in range(9)] + [("w", "PIPELINE", None, None, None, None, None, None)]
    relation(spark, schemas.TABLE_LINEAGE, rows).write.parquet(str(tmp_path / "lineage"))
    raw, plans, cut = spark.read.parquet(str(tmp_path / "lineage")), [], lineage.cut_lineage
    monkeypatch.setattr(lineage, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    pipelines = relation(spark, "entity_type string, entity_name string, pipeline_id string", [("JOB", "J", "p")])
    owned = relation(spark, "entity_type string, entity_name string, table_name string", [("JOB", "J", "t")])
    facts = cut(lineage.lineage_facts(raw))
    edges = lineage.latest_write_edges(pipelines, owned, raw, facts)
    assert records(edges, "target", "source", "seen_ms") == [("t", "s8", 8)]
    plans.append(edges._jdf.queryExecution().executedPlan().toString())
    scans = [line for plan in plans for line in plan.splitlines() if "FileScan" in line and "entity_run_id" in line]
    assert len(scans) == 2 and all("PushedFilters: [IsNotNull(entity_type), EqualTo(entity_type,PIPELINE)]" in line for line in scans)


def test_metadata_is_reduced_to_the_tables_written(spark):
    pipelines = relation(spark, "entity_type string, entity_name string, pipeline_id string", [("PIPELINE", "P", "p")])
    rows = relation(spark, schemas.TABLE_LINEAGE, [("w", "PIPELINE", "p", "r", "s", t, 1, None) for t in ("t0", "t1", "gone")])
    known = meta(spark, *[(f"t{n}", "MANAGED", "p" if n else "q", None) for n in range(50)])
    targets = lineage.lineage_targets(pipelines, rows, known)
    assert records(targets, "table_name", "status", "reason") == [("gone", "IGNORED", "NotFound"), ("t0", "IGNORED", "pipeline_id=q"), ("t1", "OWNED", None)]
    assert "LeftSemi" in targets._jdf.queryExecution().optimizedPlan().toString()


def test_a_level_of_views_is_worked_out_once(spark, tmp_path, monkeypatch):
    """Not a second time for the levels below it."""
    plans, cut = [], lineage.cut_counted
    monkeypatch.setattr(lineage, "cut_counted", lambda df, **counts: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df, **counts))
    names = [f"v{n}" for n in range(9)]
    deps = [*zip(names, names[1:]), (names[-1], "t"), (names[3], names[1])]
    rows = meta(spark, *[(n, "VIEW", None, None) for n in names], ("t", "MANAGED", None, None))
    relation(spark, "table_name string", [(names[0],), (names[2],)]).write.parquet(str(tmp_path / "roots"))
    roots = spark.read.parquet(str(tmp_path / "roots"))  # known to be small
    monkeypatch.setattr(lineage, "LEVELS_PER_CUT", 3)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = records(lineage.expand_views(roots, rows, relation(spark, schemas.VIEW_DEPS, deps)))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert got == [(names[0], "t", "TABLE"), (names[2], "t", "TABLE")]
    assert plans[0].count("Inner") == 3 and "LeftSemi" not in plans[0]  # one join a level, the views found before all of them
