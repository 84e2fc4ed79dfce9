"""Best-fit packing of documents into sequences of a fixed capacity.

A plan over the counts of each piece length, at most `capacity` numbers, decides where every piece goes; the pieces are
never in one place. Pieces above a third of the capacity go at most two to a sequence, so they are matched greedily:
the longest with the longest that fits beside it. Smaller pieces then go, longest first, into the smallest gap that
holds them. Pieces are told apart by their rank among those of the same length, from counts per task and length.
"""
import bisect
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from refreshgate.llm.batches import id_and_text, map_batches, text_slices
from refreshgate.llm.tokens import encoder
from refreshgate.session import cut_lineage

CAPACITY = 2048
END_ID = 0
Run = tuple[int, int, int, int, int]  # first rank, end, first sequence, pieces per sequence, offset of the first


def plan(counts: dict[int, int], capacity: int) -> dict[int, list[Run]]:
    """Where the pieces of each length go: runs of ranks that fill runs of sequences alike.

    The number of runs depends on the capacity alone: each length splits a few ranges of equal sequences.
    """
    left = {length: n for length, n in counts.items() if n > 0}
    runs: dict[int, list[Run]] = defaultdict(list)
    done: dict[int, int] = defaultdict(int)
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> ranges of sequences with it
    made = 0

    def place(length: int, n: int, first: int, each: int, offset: int) -> None:
        runs[length].append((done[length], done[length] + n, first, each, offset))
        done[length] += n
        left[length] -= n

    large = sorted(length for length in left if 3 * length > capacity)
    for length in reversed(large):
        for fit in reversed(large[:bisect.bisect_right(large, min(length, capacity - length))]):
            n = left[length] // 2 if fit == length else min(left[length], left[fit])
            if n > 0:
                place(length, n, made, 1, 0)
                place(fit, n, made, 1, length)
                gaps[capacity - length - fit].append((made, n))
                made += n
        if n := left[length]:
            place(length, n, made, 1, 0)
            gaps[capacity - length].append((made, n))
            made += n
    for length in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        gap = length
        while n := left[length]:
            while gap <= capacity and not gaps[gap]:
                gap += 1
            if gap > capacity:
                count = -(-n // (capacity // length))
                gaps[capacity].append((made, count))
                made, gap = made + count, capacity
            first, count = gaps[gap].pop()
            each = min(n, gap // length)
            used = min(count, n // each)
            place(length, used * each, first, each, capacity - gap)
            gaps[gap - each * length].append((first, used))
            if count > used:
                gaps[gap].append((first + used, count - used))
    return runs


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens; if it is too long, all but the first are full."""
    head = n % capacity if n > capacity else n
    starts = [0] if head else []
    starts += range(head, n, capacity)
    return [(a, b - a) for a, b in zip(starts, [*starts[1:], n])]


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, keep_ids: bool) -> DataFrame:
    """Every document's pieces, with the task that made them and their rank there among those of their length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, ranks = encoder(tokenizer).encode, TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            for some in text_slices(batch):
                rows, ids = [], []
                found = encode([t or "" for t in some.column("text").to_pylist()])
                for doc, own in zip(some.column("doc_id").to_pylist(), found):
                    own = np.append(own, np.uint32(end_id))
                    for number, (start, length) in enumerate(cut(len(own), capacity)):
                        piece = own[start:start + length]
                        rows.append((doc, number, start, length, zlib.crc32(piece.astype("<u4").tobytes()), part, ranks[length]))
                        ranks[length] += 1
                        if keep_ids:
                            ids.append(piece.astype(np.int64))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), TYPES)]
                if keep_ids:
                    columns.append(pa.array(ids, pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, NAMES + ["ids"] * keep_ids)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long" + ", ids array<long>" * keep_ids
    return map_batches(id_and_text(docs), run, schema)


NAMES = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank"]
TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids) of every piece of every row of `docs`.

    A document is its ids and `end_id`. One longer than `capacity` is cut into full pieces, the first taking what
    remains; no other is cut. The offsets of a sequence have no gaps. A NULL or empty text is the end id alone; repeated
    rows and NULL ids are packed like others; extra columns are not read.
    """
    made = cut_lineage(pieces(docs, tokenizer, capacity, end_id, keep_ids))
    counts = cut_lineage(made.groupBy("length", "part").agg(F.count("*").alias("n")))
    totals = counts.groupBy("length").agg(F.sum("n").alias("n")).collect()  # one row per length
    runs = {length: np.array(own, np.int64) for length, own in plan({r["length"]: r["n"] for r in totals}, capacity).items()}
    shared = docs.sparkSession.sparkContext.broadcast(runs)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    ranked = made.join(earlier, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("earlier"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros_like(rank), np.zeros_like(rank)
            for one in np.unique(length):
                own, at = shared.value[one], length == one
                row = own[np.searchsorted(own[:, 1], rank[at], side="right")]
                nth = rank[at] - row[:, 0]
                sequence[at], offset[at] = row[:, 2] + nth // row[:, 3], row[:, 4] + nth % row[:, 3] * one
            more = ["ids"] * keep_ids
            columns = [*map(batch.column, NAMES[:5]), pa.array(sequence), pa.array(offset), *map(batch.column, more)]
            yield pa.RecordBatch.from_arrays(columns, [*NAMES[:5], "sequence_id", "offset", *more])

    schema = ("doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
              + ", ids array<long>" * keep_ids)
    return map_batches(ranked.select(*NAMES[:5], "rank", *["ids"] * keep_ids), run, schema)
