"""Exact top-k by inner product with length buckets.

Vectors are sorted by length and cut into buckets of similar length. A query comes with a lower bound of its k-th best
score; for a bucket, that bound over the query's and the bucket's length is a local cosine threshold. Above 1, the bucket
holds nothing for the query. A high threshold confines each coordinate of a match's direction, so the bucket's sorted
coordinate lists are cut to the feasible ranges; a low one only bounds the match's length, so a prefix of the bucket is
taken. The integer products of what is left are computed, and decide.

Components are integers of any size, held as floating-point numbers, which are exact for what `floor` returns. Products
of vectors whose sums could lose a bit are first estimated, and computed in Python integers where the estimate may decide.
"""
from collections.abc import Iterator
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from refreshgate.llm.batches import map_batches
from refreshgate.session import cut_lineage, share_code

COORDINATE_COSINE = 0.8  # local thresholds from here on prune by coordinates
FOCUS = 3  # coordinates looked at
SEED_ROWS = 4096  # vectors that give every query its first bound; a bound of any quality leaves the result exact
QUERY_ROWS, BUCKET_ROWS, RANGE_BUCKETS = 2048, 4096, 4
SLACK = 1e-9  # more than what rounding adds to an estimate or a length, as a share of both lengths
EXACT = 2.0 ** 53


def integer_vectors(vectors: DataFrame, scale: float = 64.0) -> DataFrame:
    """vec_id, v (floor(scale * x) of each component) and its length, of the rows of (vec_id, embedding) that take part.

    Vectors that are NULL or hold NULL or non-finite components take no part, nor do rows without an id. A finite
    component beyond the range of a double once scaled is an error.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("embedding")
            x = own.flatten().to_numpy(zero_copy_only=False).astype(float)
            sizes = np.where(own.is_null().to_numpy(zero_copy_only=False), 0,
                             own.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64)
            edges = np.concatenate(([0], np.cumsum(sizes)))
            bad = np.concatenate(([0], np.cumsum(~np.isfinite(x))))
            whole = (bad[edges[1:]] == bad[edges[:-1]]) & own.is_valid().to_numpy(zero_copy_only=False)
            with np.errstate(invalid="ignore", over="ignore"):
                v = np.floor(scale * x)
                if (np.isinf(v) & np.isfinite(x)).any():
                    raise ValueError("a scaled component is beyond the range of a double")
                rows = [v[a:b] for a, b in zip(edges, edges[1:])]
                length = np.array([np.sqrt(np.dot(r, r)) for r in rows])
            made = pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(rows, pa.list_(pa.float64())), pa.array(length, pa.float64())],
                                              ["vec_id", "v", "length"])
            yield made.filter(pa.array(whole, pa.bool_()))

    picked = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return map_batches(picked.where("vec_id IS NOT NULL"), run, "vec_id long, v array<double>, length double")


def _dense(rows: list, width: int) -> np.ndarray:
    """Rows of integers, padded with zeros to one width."""
    out = np.zeros((len(rows), width))
    for k, row in enumerate(rows):
        out[k, :len(row)] = row
    return out


def _lengths(v: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((v * v).sum(1))


def _estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of all rows in floating point; not a number where a term is beyond its range."""
    with np.errstate(invalid="ignore", over="ignore"):
        return a @ b.T


def exact_scores(q: np.ndarray, v: np.ndarray, largest: np.ndarray, estimates: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, scores, beyond) of the rows of `v` whose product with q is `least` or more.

    largest: of each row's components. Estimates are exact where no sum can lose a bit. A score beyond 64 bits is cut off
    there and marked.
    """
    with np.errstate(over="ignore"):
        calm = np.abs(q).max(initial=0) * largest * len(q) < EXACT
        error = SLACK * np.sqrt(np.dot(q, q)) * largest * np.sqrt(len(q))
    places = np.flatnonzero(calm & (estimates >= least))
    scores = estimates[places].astype(np.int64)
    beyond = np.zeros(len(places), bool)
    if not calm.all():
        with np.errstate(invalid="ignore"):
            open_rows = np.flatnonzero(~calm & ~(estimates < least - error))
        own = [int(x) for x in q.tolist()]
        made = [(p, s) for p in open_rows.tolist() if (s := sum(map(mul, own, map(int, v[p].tolist())))) >= least]
        cut = np.array([min(max(s, -2 ** 63), 2 ** 63 - 1) for _, s in made], np.int64)
        places = np.concatenate((places, np.array([p for p, _ in made], np.int64)))
        beyond = np.concatenate((beyond, np.array([s != int(c) for (_, s), c in zip(made, cut)], bool)))
        scores = np.concatenate((scores, cut))
    return places, scores, beyond


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by score, then by smaller id."""
    if len(ids) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        place = np.flatnonzero(scores >= least)
    else:
        place = np.arange(len(ids))
    return place[np.lexsort((ids[place], -scores[place]))[:k]]


def bucket_matches(q: np.ndarray, bound: float, v: np.ndarray, lengths: np.ndarray, lists: dict[int, tuple]) -> np.ndarray:
    """Rows of a bucket (longest first) that may reach `bound` with q; all that do are among them."""
    with np.errstate(over="ignore"):
        own = np.sqrt(np.dot(q, q))
    if bound <= 0 or own == 0 or not np.isfinite(own):
        if bound > 0 and own > 0:
            return np.arange(len(v))
        return np.arange(len(v)) if bound <= 0 else np.zeros(0, np.int64)
    cosine = bound / (own * max(lengths[0], 1e-300))
    if cosine > 1 + SLACK:
        return np.zeros(0, np.int64)
    prefix = int(np.searchsorted(-lengths, -(bound / own) * (1 - SLACK), side="right"))
    if cosine < COORDINATE_COSINE:
        return np.arange(prefix)
    found = None
    for f in np.argsort(-np.abs(q), kind="stable")[:FOCUS]:
        unit = q[f] / own
        spread = np.sqrt(max(0.0, (1 - unit * unit) * (1 - min(1.0, cosine) ** 2)))
        if f not in lists:
            direction = v[:, f] / np.maximum(lengths, 1e-300)
            order = np.argsort(direction, kind="stable")
            lists[f] = order, direction[order]
        order, ordered = lists[f]
        # a match's cosine c is at least `cosine`, and its coordinate lies within spread of unit * c for that c
        low, high = (-1.0 if unit <= -cosine else unit * cosine - spread), (1.0 if unit >= cosine else unit * cosine + spread)
        rows = order[np.searchsorted(ordered, low - SLACK):np.searchsorted(ordered, high + SLACK, side="right")]
        found = rows if found is None else np.intersect1d(found, rows, assume_unique=True)
    return np.sort(found[found < prefix])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of `vectors` with the highest integer product for each row of `queries`.

    Both have (vec_id, embedding). Rows with a query's own vec_id are not its candidates. A repeated query id is
    answered once, for its smallest vector; repeated candidate rows all count. Ties go to the smaller vec_id. A shorter
    vector counts as padded with zeros; an empty one scores 0. Components may have any finite size; a score among the best
    that does not fit 64 bits is an error. Fewer than k candidates are all returned.
    """
    spark = vectors.sparkSession
    rows = cut_lineage(integer_vectors(vectors, scale))
    asked = cut_lineage(integer_vectors(queries, scale).groupBy("vec_id").agg(F.min("v").alias("v")))
    n, width = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    n_asked, wide = asked.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    width = max(width, wide, 1)
    seeds = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SEED_ROWS).collect()
    shared = spark.sparkContext.broadcast((np.array([r["vec_id"] for r in seeds], np.int64), _dense([r["v"] for r in seeds], width)))

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seed_ids, seed_rows = shared.value
        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            bounds, reach = np.full(len(ids), -np.inf), np.zeros(len(ids))
            seed_lengths = _lengths(seed_rows)
            for start in range(0, len(ids), 256):
                q = _dense(batch.column("v").slice(start, 256).to_pylist(), width)
                lengths = np.maximum(_lengths(q), 1e-300)
                with np.errstate(invalid="ignore", over="ignore"):
                    scores = _estimates(q, seed_rows) - SLACK * np.outer(lengths, seed_lengths)
                scores[(ids[start:start + 256, None] == seed_ids[None, :]) | ~np.isfinite(scores)] = -np.inf
                if len(seed_ids) >= k:
                    bounds[start:start + 256] = np.partition(scores, len(seed_ids) - k, axis=1)[:, len(seed_ids) - k]
                reach[start:start + 256] = bounds[start:start + 256] / lengths
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(bounds), pa.array(np.maximum(reach, 0))],
                                             ["vec_id", "v", "bound", "reach"])

    # queries of similar reach (the least length of a match) share a block
    with_bound = cut_lineage(map_batches(asked, bounded, "vec_id long, v array<double>, bound double, reach double"))
    n_blocks = -(-n_asked // QUERY_ROWS)
    bands = min(16, max(1, n_blocks))
    cuts = with_bound.approxQuantile("reach", [b / bands for b in range(1, bands)], 0.01) if bands > 1 and n_asked else []
    band = sum(((F.col("reach") > c).cast("int") for c in cuts), F.lit(0))
    each = max(1, -(-n_blocks // bands))
    block = (band * each + F.pmod(F.xxhash64("vec_id"), F.lit(each))).cast("int")
    blocks = cut_lineage(with_bound.groupBy(block.alias("block")).agg(
        F.collect_list(F.struct("vec_id", "v", "bound")).alias("queries"), F.min("reach").alias("reach")))

    # buckets: ranges of length, each cut into rows of BUCKET_ROWS vectors
    n_ranges = max(1, -(-n // (BUCKET_ROWS * RANGE_BUCKETS)))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, number, place = [], 0, TaskContext.get().partitionId()

        def bucket(table: pa.Table) -> pa.RecordBatch:
            ids, v = table.column("vec_id").to_numpy(), _dense(table.column("v").to_pylist(), width)
            return pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([number], pa.int32()),
                                               pa.array([table.column("length")[0].as_py()]), pa.array([ids.tobytes()], pa.binary()),
                                               pa.array([v.tobytes()], pa.binary())], ["range", "bucket", "longest", "ids", "vectors"])

        for batch in batches:
            held.append(batch)
            while sum(b.num_rows for b in held) >= BUCKET_ROWS:
                table = pa.Table.from_batches(held)
                yield bucket(table.slice(0, BUCKET_ROWS))
                number, held = number + 1, table.slice(BUCKET_ROWS).to_batches()
        if sum(b.num_rows for b in held):
            yield bucket(pa.Table.from_batches(held))

    ordered = rows.repartitionByRange(n_ranges, F.col("length").desc(), "vec_id").sortWithinPartitions(F.col("length").desc(), "vec_id")
    buckets = cut_lineage(map_batches(ordered, packed, "range int, bucket int, longest double, ids binary, vectors binary"))

    # one group per bucket and block of queries, without those that the bucket's longest vector rules out
    pairs = buckets.select("range", "bucket", "longest", F.explode(F.sequence(F.lit(0), F.lit(bands * each - 1))).alias("block")).join(
        blocks.select("block", "reach"), "block").where(F.col("reach") <= F.col("longest") * (1 + SLACK)).drop("reach", "longest")
    pairs = cut_lineage(pairs)
    sides = pairs.join(buckets.drop("longest"), ["range", "bucket"]).unionByName(
        pairs.join(blocks.drop("reach"), "block"), allowMissingColumns=True)

    def matched(table: pa.Table) -> pa.Table:
        sides = table.to_pylist()
        asked_rows = next(r["queries"] for r in sides if r["queries"] is not None)
        bucket = next(r for r in sides if r["vectors"] is not None)
        ids, v = np.frombuffer(bucket["ids"], np.int64), np.frombuffer(bucket["vectors"], np.float64).reshape(-1, width)
        lengths, largest, lists, out, rest = _lengths(v), np.abs(v).max(1, initial=0), {}, [], []
        q = _dense([r["v"] for r in asked_rows], width)

        def keep(row: int, rows: np.ndarray, estimates: np.ndarray) -> None:
            other = ids[rows] != asked_rows[row]["vec_id"]
            rows, estimates = rows[other], estimates[other]
            places, scores, beyond = exact_scores(q[row], v[rows], largest[rows], estimates, asked_rows[row]["bound"])
            found = ids[rows[places]]
            best = _best(found, scores, k)
            out.append((np.full(len(best), asked_rows[row]["vec_id"]), found[best], scores[best], beyond[best]))

        for row, own in enumerate(asked_rows):
            rows = bucket_matches(q[row], own["bound"], v, lengths, lists)
            if len(rows) > len(ids) // 4:
                rest.append((row, len(rows)))  # a long prefix: verified in one product with others
            elif len(rows):
                keep(row, rows, _estimates(q[row:row + 1], v[rows])[0])
        for start in range(0, len(rest), 128):
            some = rest[start:start + 128]
            estimates = _estimates(q[[row for row, _ in some]], v)
            for own, (row, _) in zip(estimates, some):
                keep(row, np.arange(len(ids)), own)
        columns = [np.concatenate([o[c] for o in out]) if out else np.zeros(0, np.int64) for c in range(4)]
        return pa.table([*(pa.array(c.astype(np.int64)) for c in columns[:3]), pa.array(columns[3].astype(bool))],
                        ["query_id", "vec_id", "score", "beyond"])

    share_code(spark)
    found = sides.groupBy("range", "bucket", "block").applyInArrow(matched, "query_id long, vec_id long, score long, beyond boolean")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    fits = F.when(F.col("beyond"), F.raise_error(F.lit("a score does not fit 64 bits"))).otherwise(F.col("score"))
    return ranked.select("query_id", "rank", "vec_id", fits.cast("long").alias("score"))
