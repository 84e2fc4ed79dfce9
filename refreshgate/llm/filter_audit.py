"""How filters interact: what every filter removes, and what is lost by it, in every order in which they can be applied.

A document is known by the set of filters that it fails, its mask. In the lexicographic list of all orders, the orders
that begin with the same filters stand together: their Lehmer ranks are one interval. A mask is removed at step s by the
orders that begin with s - 1 filters it passes and one it fails, hence on a few intervals of ranks. The count of a mask is
added where such an interval begins and taken off where it ends; prefix sums over the ranks then give what is removed at a
step under every order. Counts per part and mask are made first, so the work on orders does not grow with the corpus.
"""
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from refreshgate.session import cut_lineage

BLANKS = " \t\n\x0b\f\r"
FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT = 200, 50, 3
SYMBOLS = r"[#$%&*|]"
COUNTS = ("n", "good", "toxic")


def lehmer_rank(order: tuple[int, ...]) -> int:
    """The place of an order in the lexicographic list of all orders of the same filters."""
    return sum(sum(later < own for later in order[k + 1:]) * factorial(len(order) - 1 - k) for k, own in enumerate(order))


def removal_intervals(n_filters: int) -> list[tuple[int, int, int, int]]:
    """(mask, step, first rank, rank after the last): under the orders of these ranks, `mask` is removed at `step`.

    A prefix of an order is completed in (n - step)! ways, the least of which has the remaining filters ascending.
    """
    found = []
    for step in range(1, n_filters + 1):
        for prefix in permutations(range(n_filters), step):
            rest = [f for f in range(n_filters) if f not in prefix]
            first = lehmer_rank((*prefix, *rest))
            passed, last = sum(1 << f for f in prefix[:-1]), 1 << prefix[-1]
            for mask in range(1, 1 << n_filters):
                if mask & last and not mask & passed:
                    found.append((mask, step, first, first + factorial(n_filters - step)))
    return found


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask, digest of every row: the conditions that a text meets by itself, and what names its copies."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
                       text.alias("text"))
    words = F.split(F.btrim("text", F.lit(BLANKS)), "[ \\t-\\r]+")
    rows = rows.select("doc_id", "part", "text", words.alias("words"))
    n = F.when(F.element_at("words", 1) == "", 0).otherwise(F.size("words"))
    capitals = F.length("text") - F.length(F.regexp_replace("text", "[A-Z]", ""))
    conditions = (n < MIN_WORDS, 100 * F.size(F.array_distinct("words")) < MIN_DISTINCT_PERCENT * n,
                  100 * capitals > MAX_CAPITAL_PERCENT * F.length("text"), F.col("text").rlike(SYMBOLS))
    mask = sum((F.when(c, 1 << k).otherwise(0) for k, c in enumerate(conditions)), F.lit(0))
    return rows.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))


def mask_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents of each part by the filters they fail, the copy condition included.

    A row is a copy if a smaller doc_id has the same text. Rows are first counted per text, part and labels, with the
    smallest id and its number of rows, so copies of one text meet as a few rows, however many there are.
    """
    own = cut_lineage(failures(docs))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    group = ["digest", "part", "mask", "good", "toxic"]
    named = own.where("doc_id IS NOT NULL").join(marks, "doc_id", "left").select(
        "doc_id", "digest", "part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    per_id = named.groupBy("doc_id", *group).agg(F.count("*").alias("n"))
    per_text = per_id.groupBy(*group).agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "n")).alias("first"))
    lowest = F.min("first.doc_id").over(Window.partitionBy("digest"))  # a text has one row per part and pair of labels
    firsts = F.when(F.col("first.doc_id") == lowest, F.col("first.n")).otherwise(0)
    split = per_text.withColumn("firsts", firsts).select(*group, F.explode(F.array(
        F.struct(F.lit(0).alias("copy"), F.col("firsts").alias("n")),
        F.struct(F.lit(1).alias("copy"), (F.col("n") - F.col("firsts")).alias("n")))).alias("x"))
    with_id = split.select("part", (F.col("mask") + F.col("x.copy") * (1 << FILTERS.index("E"))).alias("mask"), "good", "toxic", "x.n")
    # rows without an id have no label and are copies of nothing
    without = own.where("doc_id IS NULL").groupBy("part", "mask").agg(F.count("*").alias("n")).select(
        "part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic"), "n")
    return with_id.unionByName(without).where("n > 0").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic"))


def _orders(spark: SparkSession, filters: str) -> DataFrame:
    """rank, filter_order: a fixed table of n! rows."""
    return spark.createDataFrame([(k, "".join(p)) for k, p in enumerate(permutations(filters))], "rank int, filter_order string")


def interactions(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley from `mask_counts`.

    Bit k of a mask is the k-th of `filters`, which stand in ascending order. Windows run over the ranks or steps of one
    part; joins are with fixed tables of at most n! rows.
    """
    spark, n_filters = counts.sparkSession, len(filters)
    n_orders = factorial(n_filters)
    counts = cut_lineage(counts)
    intervals = spark.createDataFrame(removal_intervals(n_filters), "mask int, step int, first int, after int")
    ends = F.explode(F.array(F.struct(F.col("first").alias("rank"), F.lit(1).alias("sign")),
                             F.struct(F.col("after").alias("rank"), F.lit(-1).alias("sign")))).alias("end")
    changes = (counts.join(F.broadcast(intervals), "mask").select("part", "step", *COUNTS, ends)
               .where(F.col("end.rank") < n_orders)
               .groupBy("part", "step", F.col("end.rank").alias("rank"))
               .agg(*(F.sum(F.col(c) * F.col("end.sign")).alias(c) for c in COUNTS)))
    totals = counts.groupBy("part").agg(F.sum("n").alias("n_docs"))
    cells = totals.select("part", "n_docs", F.explode(F.sequence(F.lit(1), F.lit(n_filters))).alias("step")).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(n_orders - 1))).alias("rank"))
    so_far = Window.partitionBy("part", "step").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    sums = cells.join(changes, ["part", "step", "rank"], "left").select(
        "part", "n_docs", "step", "rank", *(F.coalesce(F.sum(c).over(so_far), F.lit(0)).alias(c) for c in COUNTS))
    steps = Window.partitionBy("part", "rank").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    rows = sums.withColumn("kept", F.col("n_docs") - F.sum("n").over(steps)).join(F.broadcast(_orders(spark, filters)), "rank")
    rows = rows.withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    each = counts.select("part", "mask", "n", F.explode(F.array(*(F.lit(k) for k in range(n_filters)))).alias("k")).where(
        F.expr("(mask >> k) & 1 = 1"))
    name: Column = F.substring(F.lit(filters), F.col("k") + 1, F.lit(1))
    fails = each.groupBy("part", name.alias("filter")).agg(
        F.sum("n").alias("fails"), F.sum(F.when(F.expr("mask = 1 << k"), F.col("n")).otherwise(0)).alias("alone"))
    rows = rows.join(fails, ["part", "filter"], "left")
    long = {"kept": F.col("kept"), "removed": F.col("n"), "redundant": F.coalesce("fails", F.lit(0)) - F.col("n"),
            "unique_fails": F.coalesce("alone", F.lit(0)), "good_lost": F.col("good"), "toxic_lost": F.col("toxic"),
            "shapley": F.sum("n").over(Window.partitionBy("part", "filter"))}
    return rows.select("part", "filter_order", "step", *(c.cast("long").alias(k) for k, c in long.items()))


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`interactions` of the five filters over whole texts, per value of `lang` (NULL as the empty string).

    A: under 200 words; B: under half of the words distinct; C: over 3 % capitals A-Z; D: one of `#$%&*|`; E: a smaller
    doc_id has the same text, in any part. A NULL text is empty: it fails A, and E like any other. Rows that share an id
    and a text are no copies of each other. A row without an id counts, has no label and fails no E. A label counts if
    any row of `labels` gives it. No documents, no rows. Other columns are not read.
    """
    return interactions(mask_counts(docs, labels))


def oracle() -> str:
    """DuckDB SQL that walks through every order, mask by mask."""
    words = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
    return f"""
WITH texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
lowest AS (SELECT t, min(doc_id) AS low FROM texts GROUP BY t),
judged AS (
  SELECT part, [len({words}) < 200, 100 * len(list_distinct({words})) < 50 * len({words}),
      100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), regexp_matches(t, '[#$%&*|]'),
      coalesce(doc_id > low, false)] AS fails,
    EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.quality = 1) AS good,
    EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1) AS toxic
  FROM texts d JOIN lowest USING (t)),
counted AS (SELECT part, fails, good, toxic, count(*) AS n FROM judged GROUP BY ALL),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 3, 4, 5]) AS k),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order, [a.k, b.k, c.k, d.k, e.k] AS ks
  FROM letters a JOIN letters b ON b.k <> a.k JOIN letters c ON c.k NOT IN (a.k, b.k)
    JOIN letters d ON d.k NOT IN (a.k, b.k, c.k) JOIN letters e ON e.k NOT IN (a.k, b.k, c.k, d.k)),
cells AS (SELECT filter_order, ks, unnest([1, 2, 3, 4, 5])::INTEGER AS step FROM orders),
seen AS (
  SELECT *, list_bool_or(list_transform(ks[:step - 1], lambda k: fails[k])) IS TRUE AS gone, fails[ks[step]] AS hit
  FROM cells, counted),
summed AS (
  SELECT part, filter_order, step, any_value(ks[step]) AS k, sum(n) FILTER (NOT gone AND NOT hit) AS kept, sum(n) FILTER (NOT gone AND hit) AS removed,
    sum(n) FILTER (gone AND hit) AS redundant, sum(n) FILTER (hit AND len(list_filter(fails, lambda x: x)) = 1) AS unique_fails,
    sum(n) FILTER (NOT gone AND hit AND good) AS good_lost, sum(n) FILTER (NOT gone AND hit AND toxic) AS toxic_lost
  FROM seen GROUP BY ALL)
SELECT part, filter_order, step, {", ".join(f"coalesce({c}, 0)::BIGINT AS {c}" for c in
       ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
  coalesce(sum(removed) OVER (PARTITION BY part, k), 0)::BIGINT AS shapley
FROM summed"""
