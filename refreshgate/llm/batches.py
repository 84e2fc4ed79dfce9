"""Helpers for operators that work on Arrow batches of text."""
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from refreshgate.session import share_code

SLICE_BYTES = 1 << 20  # text handled at once by the vectorised parts of a task, whatever the batch size


def text_slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Row ranges of `batch` of about `limit` bytes of text each; a longer text is a range of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes, dtype=np.int64) // limit
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for start, end in zip(edges, edges[1:]):
        if end > start:
            yield batch.slice(start, end - start)


def utf8_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array without nulls, and the n + 1 places where its texts begin and end."""
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[ends[0]:ends[-1]], ends - ends[0]


def segment_sums(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of `values` between consecutive `edges`, zero for empty ranges."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[edges[1:]] - total[edges[:-1]]


def id_remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, mod `modulus`; NULL for a NULL id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def id_and_text(docs: DataFrame, *more: str) -> DataFrame:
    """The columns an operator reads, whatever else the table holds."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """`mapInArrow`, with this package importable in the tasks."""
    share_code(df.sparkSession)
    return df.mapInArrow(run, schema)
