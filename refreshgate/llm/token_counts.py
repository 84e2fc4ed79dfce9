"""Token counts of documents in flat token files that have no index.

A token file is the ids of one document after another as little-endian integers of a fixed width, an end id after each.
Files are scanned in blocks: a vectorised search finds the end ids, and a block reports the tokens before its first end,
between ends, and after its last. A prefix scan over the blocks of a file gives each block the number of documents
before it and the position after the last end before it, which stitches documents that run over block boundaries.

Files may be gzip-compressed; they are then unpacked block by block.
"""
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from refreshgate.llm.batches import id_and_text, map_batches, text_slices
from refreshgate.llm.tokens import encoder
from refreshgate.session import cut_lineage

END_ID = 50256
WIDTH = 2
BLOCK_TOKENS = 1 << 20
ROWS_PER_FILE = 50_000


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, width: int = WIDTH) -> DataFrame:
    """Write flat token files under `path`; return doc_id with its place: shard (the writing task) and doc_no in it.

    Special tokens in a text count as ordinary text, so that `end_id` stands only at ends. A tokenizer with more ids than
    `width` bytes can hold is an error. `docs` is read twice and must
    give the same rows in the same order, as a table of files does. A NULL text is written as an empty document.
    The text sink writes the bytes as they are, with the end id's bytes as its row separator, and compresses the files.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer, True)
        if own.tokenizer.get_vocab_size() > 256 ** width:
            raise ValueError(f"ids of {tokenizer} need more than {width} bytes")
        encode = own.encode
        for batch in batches:
            for part in text_slices(batch):
                made = [ids.astype(f"<u{width}").tobytes() for ids in encode([t or "" for t in part.column("text").to_pylist()])]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["ids"])

    rows = id_and_text(docs)
    separator = end_id.to_bytes(width, "little").decode("latin-1")
    map_batches(rows.select("text"), run, "ids binary").select(F.col("ids").cast("string")).write.option(
        "encoding", "ISO-8859-1").option("lineSep", separator).option("maxRecordsPerFile", ROWS_PER_FILE).option("compression", "gzip").text(path)
    return rows.select("doc_id", F.spark_partition_id().alias("shard"),
                       F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("doc_no"))


def pieces(content: memoryview, packed: bool, size: int) -> Iterator[bytes | memoryview]:
    """The bytes of a file, unpacked if need be, `size` at a time; one empty piece for an empty file."""
    if not packed:
        yield from (content[start:start + size] for start in range(0, max(1, len(content)), size))
        return
    engine, rest, held, any_sent = zlib.decompressobj(31), content, b"", False
    while rest or not engine.eof:
        part = engine.decompress(rest, size - len(held))
        held, rest = held + part, engine.unconsumed_tail
        if engine.eof:
            rest = engine.unused_data
            engine = zlib.decompressobj(31) if rest else engine
        elif not part and not rest:
            raise ValueError("a compressed token file ends early")
        if len(held) == size:
            yield held
            held, any_sent = b"", True
    if held or not any_sent:
        yield held


def _blocks(end_id: int, width: int, block_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, file, packed, content in zip(*batch.columns):
                for number, data in enumerate(pieces(memoryview(content.as_buffer()), packed.as_py(), block_tokens * width)):
                    block = np.frombuffer(data, f"<u{width}")
                    ends = np.flatnonzero(block == end_id)
                    head, after = (int(ends[0]), int(ends[-1]) + 1) if len(ends) else (len(block), 0)
                    yield pa.RecordBatch.from_arrays([
                        pa.array([shard.as_py()], pa.int32()), pa.array([file.as_py()], pa.int32()), pa.array([number], pa.int32()),
                        pa.array([len(block)], pa.int64()), pa.array([len(ends)], pa.int64()), pa.array([head], pa.int64()),
                        pa.array([after], pa.int64()), pa.array([np.diff(ends) - 1], pa.list_(pa.int64()))],
                        ["shard", "file", "block", "tokens", "ends", "head", "after", "inner"])
    return run


def count_tokens(spark: SparkSession, path: str, end_id: int = END_ID, width: int = WIDTH,
                 block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """shard, doc_no, n_tokens of every document in the token files under `path`, without its end id.

    The files of a shard follow each other. Tokens after the last end of a shard are a document too. Empty documents
    have 0 tokens; without files there are no rows.
    """
    name = F.substring_index("path", "/", -1)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select(
        F.regexp_extract(name, r"^part-(\d+)", 1).cast("int").alias("shard"),
        F.coalesce(F.expr("try_cast(regexp_extract(path, '-c([0-9]+)[^/]*$', 1) AS INT)"), F.lit(0)).alias("file"),
        F.col("path").endswith(".gz").alias("packed"), "content")
    blocks = map_batches(files, _blocks(end_id, width, block_tokens), "shard int, file int, block int, tokens long, ends long, "
                         "head long, after long, inner array<long>")
    order = Window.partitionBy("shard").orderBy("file", "block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = blocks.withColumns({"start": F.coalesce(F.sum("tokens").over(before), F.lit(0)),
                                 "docs": F.coalesce(F.sum("ends").over(before), F.lit(0)),
                                 "final": F.lead("shard").over(order).isNull()})
    ended = F.when(F.col("ends") > 0, F.col("start") + F.col("after"))
    stitched = placed.withColumn("open", F.coalesce(F.max(ended).over(before), F.lit(0)))
    first = F.col("start") + F.col("head") - F.col("open")
    rest = F.col("start") + F.col("tokens") - F.greatest("open", F.coalesce(ended, F.lit(0)))
    lengths = F.concat(F.when(F.col("ends") > 0, F.concat(F.array(first), "inner")).otherwise(F.array().cast("array<bigint>")),
                       F.when(F.col("final") & (rest > 0), F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    return stitched.select("shard", "docs", F.posexplode(lengths).alias("place", "n_tokens")).select(
        "shard", (F.col("docs") + F.col("place")).alias("doc_no"), "n_tokens")


def document_counts(docs: DataFrame, path: str, tokenizer: str) -> DataFrame:
    """doc_id and n_tokens of every row of `docs`, counted in the token files that it is written to under `path`."""
    places = write_token_files(docs, path, tokenizer)
    counts = cut_lineage(count_tokens(docs.sparkSession, path))
    shards = places.groupBy("shard").agg(F.count("*").alias("rows")).join(
        counts.groupBy("shard").agg(F.count("*").alias("found")), "shard", "full")
    if shards.where("coalesce(rows, 0) <> coalesce(found, 0)").limit(1).count():
        raise ValueError("the table changed its rows between two reads")
    return places.join(counts, ["shard", "doc_no"]).select("doc_id", "n_tokens")
