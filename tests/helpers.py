from datetime import datetime, timezone

from refreshgate import schemas
from refreshgate.operators.freshness import gather_signals


def ms(text: str) -> int:
    """`2026-10-12 01:00` in UTC -> epoch ms."""
    return int(datetime.fromisoformat(text).replace(tzinfo=timezone.utc).timestamp() * 1000)


def at(clock: str) -> int:
    return ms(f"2026-10-12 {clock}")


def records(df, *columns):
    """Rows as plain tuples, sorted."""
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)


def tracker(spark, *rows):
    """Rows of (name, type, group, targets, sources, skip, producers, window)."""
    full = [tuple(r) + (None, None, None, None) for r in rows]
    return spark.createDataFrame(full, schemas.TRACKER)


def relation(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def signals(spark, meta=(), history=(), definitions=(), progress=(), runs=(), events=None, updates=None, errors=None):
    def optional(schema, rows):
        return None if rows is None else relation(spark, schema, list(rows))

    return gather_signals(
        relation(spark, schemas.TABLE_META, list(meta)), relation(spark, schemas.TABLE_HISTORY, list(history)),
        relation(spark, schemas.FLOW_DEFINITIONS, list(definitions)), relation(spark, schemas.FLOW_PROGRESS, list(progress)),
        relation(spark, schemas.JOB_RUNS, list(runs)), optional(schemas.PIPELINE_EVENTS, events),
        optional(schemas.PIPELINE_UPDATES, updates), optional(schemas.SCAN_ERRORS, errors))
