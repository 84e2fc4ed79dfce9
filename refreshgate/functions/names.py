"""Expressions over names, name lists and task parameters."""
from pyspark.sql import Column, functions as F

DEFAULT_GROUP = "default"


def group_name(src_group: Column) -> Column:
    """NULL or empty group -> `default`."""
    return F.when((src_group == "") | src_group.isNull(), DEFAULT_GROUP).otherwise(src_group)


def entity_key(entity_type: Column, entity_name: Column) -> Column:
    """One string that sorts like (type, name)."""
    return F.concat_ws(":", entity_type, entity_name)


def short_name(table: Column) -> Column:
    return F.element_at(F.split(table, r"\."), -1)


def dotted_suffixes(table: Column) -> Column:
    """`a.b.c` -> [`a.b.c`, `b.c`, `c`]: every dataset name that counts as the table."""
    parts = F.split(table, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)),
                       lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def name_list(text: Column) -> Column:
    """Names split on comma or blank, trimmed, without empties and repeats."""
    names = F.transform(F.split(text, "[, ]"), lambda n: F.regexp_replace(n, r"^\s+|\s+$", ""))
    return F.array_distinct(F.filter(names, lambda n: n != ""))


def truthy(text: Column) -> Column:
    return F.lower(F.trim(text)).isin("true", "1", "yes")


def without(tables: Column, skip: Column) -> Column:
    """`tables` less those in `skip`, keeping order and repeats."""
    skip = F.coalesce(skip, F.array().cast("array<string>"))
    return F.filter(tables, lambda t: ~F.array_contains(skip, t))


def option_value(parameters: Column, option: str) -> Column:
    """Last value given for `--option=value` or `--option value` in a parameter list, else NULL."""
    marks = F.transform(parameters, lambda p, i: F.struct(p.alias("word"), F.get(parameters, i + 1).alias("following")))
    hits = F.filter(marks, lambda m: m["word"].startswith(option + "=")
                    | ((m["word"] == option) & m["following"].isNotNull()))
    last = F.element_at(hits, -1)
    return F.when(F.size(hits) > 0,
                  F.when(last["word"] == option, last["following"])
                  .otherwise(last["word"].substr(F.lit(len(option) + 2), F.length(last["word"]))))


def list_text(names: Column) -> Column:
    """`['a', 'b']`, the way name lists read in messages."""
    return F.when(F.size(names) > 0, F.concat(F.lit("['"), F.array_join(names, "', '"), F.lit("']"))).otherwise("[]")


def joined(names: Column) -> Column:
    """Sorted, comma-joined text of a name list."""
    return F.array_join(F.array_sort(names), ",")
