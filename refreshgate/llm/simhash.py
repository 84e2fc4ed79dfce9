"""Near-duplicates by SimHash, found through an inverted index of byte positions.

Two fingerprints of 8 bytes that differ in at most 3 bits (`max_bits`) have at least 5 bytes in common: the guaranteed minimum of
shared (position, byte) postings. Lists of a single (position, byte) would each hold 1/256 of all fingerprints, so the
index is kept by four postings at once: a fingerprint stands in 70 lists, one per choice of 4 positions, and pairs that
share those four bytes or more meet there. The shared positional bytes of a pair are tallied, pairs with just the four
are dropped, and the rest is verified bit by bit; a pair with the guaranteed five meets in five lists or more.

A list holds distinct fingerprints with 32 bits in common, 2 ** -32 of all that are not alike; copies of a text are one
fingerprint. Of a list only a spanning forest of its links goes on, never all pairs.
"""
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T
from xxhash import xxh64_intdigest

from refreshgate.llm.batches import id_and_text, map_batches, text_slices
from refreshgate.llm.components import components
from refreshgate.session import cut_lineage

SHINGLE = 3
SEED = 42
BYTES = 8
MAX_BITS = 3
PAIRWISE = 4096  # longer lists look up every fingerprint within reach instead of comparing pairs
BITS_OF_BYTE = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
SPOT = np.arange(BYTES) * 256


def min_matches(max_bits: int) -> int:
    """Positional bytes that two fingerprints of at most `max_bits` differing bits share."""
    if not 0 <= max_bits < BYTES - 1:
        raise ValueError(f"max_bits has to leave two bytes in common: {max_bits}")
    return BYTES - max_bits


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a text: a bit is 1 if it is set in over half the hashes of its word shingles; 0 without words."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII blanks only
    if not words:
        return 0
    shingles = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) >= shingle else iter([b" ".join(words)])
    hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), "<u8")
    spots = hashes.view(np.uint8).reshape(-1, BYTES) + SPOT
    ones = np.bincount(spots.ravel(), minlength=BYTES * 256).reshape(BYTES, 256) @ BITS_OF_BYTE
    return int(np.packbits((2 * ones > len(hashes)).ravel(), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every row."""
    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                fp = np.array([fingerprint(t, shingle) for t in part.column("text").to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return map_batches(id_and_text(docs), run, "doc_id long, fp long")


def postings(fps: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(list, fingerprint) of every fingerprint: the list's number is its positions' rank and their bytes, one fewer than
    the guaranteed minimum."""
    choices = tuple(combinations(range(BYTES), min_matches(max_bits) - 1))
    lists = np.empty((len(choices), len(fps)), np.uint64)
    for rank, places in enumerate(choices):
        key = np.full(len(fps), rank, np.uint64)
        for p in places:
            key = (key << np.uint64(8)) | ((fps >> np.uint64(8 * p)) & np.uint64(255))
        lists[rank] = key
    return lists.ravel(), np.tile(fps, len(choices))


def near(a: np.ndarray, b: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Which pairs have enough positional bytes in common and, verified, differ in few enough bits."""
    differing = a ^ b
    tally = sum(((differing >> np.uint64(8 * p)) & np.uint64(255)) == 0 for p in range(BYTES))
    found = tally >= min_matches(max_bits)
    found[found] = np.bitwise_count(differing[found]) <= max_bits
    return found


def spanning_links(fps: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Links (indices) that hold together each group that near pairs of one list connect."""
    if len(fps) > PAIRWISE:
        return _spanning_by_lookup(fps, max_bits)
    links, rest = [], np.arange(len(fps))
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            hit = near(np.broadcast_to(fps[at], len(rest)), fps[rest], max_bits)
            links += [(int(at), int(x)) for x in rest[hit]]
            queue += rest[hit].tolist()
            rest = rest[~hit]
    return links


def _spanning_by_lookup(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """As spanning_links, for long lists: their fingerprints differ in few of the 64 bits, so all within reach are looked up.

    A mask of few bits leaves at least the guaranteed bytes as they are, so here the count drops nothing.
    """
    varying = np.bitwise_or.reduce(fps ^ fps[0])
    bits = [b for b in range(64) if (int(varying) >> b) & 1]
    ordered = np.sort(fps)
    lowest = np.arange(len(fps))
    reach = [sum(1 << b for b in some) for k in range(1, max_bits + 1) for some in combinations(bits, k)]
    while True:
        before = lowest.copy()
        for mask in reach:
            other = ordered ^ np.uint64(mask)
            place = np.minimum(np.searchsorted(ordered, other), len(ordered) - 1)
            lowest = np.where(ordered[place] == other, np.minimum(lowest, lowest[place]), lowest)
        lowest = lowest[lowest]
        if (lowest == before).all():
            break
    places = np.argsort(fps)
    return [(int(places[r]), int(places[i])) for i, r in enumerate(lowest) if r != i]


def _links(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Spanning links of the lists of a task; rows come ordered by list, and a list may run over several batches."""
    held_list, held_fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

    def linked(keys, fps):
        edges = np.concatenate(([0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]))
        pairs = []
        for k in np.flatnonzero(np.diff(edges) > 1):
            members = fps[edges[k]:edges[k + 1]]
            pairs += [(members[i], members[j]) for i, j in spanning_links(members, max_bits)]
        ends = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], ["a", "b"])

    waiting = []
    for batch in batches:
        keys, fps = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        if not len(keys):
            continue
        if waiting and keys[-1] == waiting[0][0][0] and waiting[0][0][0] == waiting[-1][0][-1]:
            waiting.append((keys, fps))  # one list goes on through the whole batch
            continue
        held_list, held_fp = (np.concatenate([w[c] for w in waiting] + [(keys, fps)[c]]) for c in (0, 1))
        last = np.searchsorted(held_list, held_list[-1])
        yield linked(held_list[:last], held_fp[:last])
        waiting = [(held_list[last:], held_fp[last:])]
    if waiting:
        yield linked(*(np.concatenate([w[c] for w in waiting]) for c in (0, 1)))


def near_links(nodes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Links (a, b) between the distinct fingerprints `fp` of `nodes` that leave no near pair unconnected."""
    def run(batches):
        for batch in batches:
            keys, fps = postings(batch.column(0).to_numpy().view(np.uint64), max_bits)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(fps.view(np.int64))], ["list", "fp"])

    def link(batches):
        yield from _links(batches, max_bits)

    listed = map_batches(nodes.select("fp"), run, "list long, fp long")
    return map_batches(listed.repartition("list").sortWithinPartitions("list"), link, "a long, b long").distinct()


def near_duplicates(marked: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """fp, root, component_id for the (doc_id, fp) rows of `marked`.

    root is one fingerprint of the component, component_id the smallest doc_id among all fingerprints reachable. Rows
    with equal fingerprints belong together. NULL ids are passed over; a component of NULL ids alone has a NULL id.
    """
    nodes = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = components(near_links(nodes, max_bits)).withColumnRenamed("node", "fp")
    rooted = cut_lineage(nodes.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root")))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return cut_lineage(rooted.join(lowest, "root").select("fp", "root", "component_id"))


def classes(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fp, component_id of every row of `docs`. A NULL text has no words and so fingerprint 0, linked like any other.

    Repeated rows are a row each, in one component; other columns are not read; an empty table gives no rows.
    """
    marked = cut_lineage(fingerprints(docs, shingle))
    return marked.join(near_duplicates(marked, max_bits), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each component of `docs`, unchanged: the smallest doc_id (NULL last), then the smallest fingerprint.

    Texts are matched by (doc_id, fp), which spreads copies over all tasks. Of rows that repeat both, the one with the
    smallest hash over all columns stays.
    """
    marked = cut_lineage(fingerprints(docs, shingle))
    found = marked.join(near_duplicates(marked, max_bits), "fp")
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce(
        "doc_id", F.lit(0)).alias("id"), "fp")).alias("row"))
    names = [f"{name}_of_row" + "_" * max(map(len, docs.columns)) for name in ("no_id", "id", "fp", "place")]
    no_id, row_id, fp, place = names
    first = first.select(F.col("row.no_id").alias(no_id), F.col("row.id").alias(row_id), F.col("row.fp").alias(fp))

    def run(batches):
        for batch in batches:
            for part in text_slices(batch):
                marks = np.array([fingerprint(t, shingle) for t in part.column("text").to_pylist()], np.uint64).view(np.int64)
                yield part.append_column(fp, pa.array(marks))

    schema = T.StructType([*docs.schema.fields, T.StructField(fp, T.LongType())])
    texts = map_batches(docs, run, schema).withColumns({
        no_id: F.col("doc_id").isNull(), row_id: F.coalesce(F.col("doc_id").cast("long"), F.lit(0))})
    one = Window.partitionBy(no_id, row_id, fp).orderBy(F.xxhash64(*docs.columns))
    return texts.join(first, [no_id, row_id, fp], "left_semi").withColumn(place, F.row_number().over(one)).where(
        F.col(place) == 1).select(*docs.columns)
