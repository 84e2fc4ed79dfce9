"""WARC archives as a chunked record table.

A payload longer than `chunk_bytes` is written as WARC segments (one record and its continuations), so that no record
of an archive is larger than a chunk; reading gives one row per record identifier and chunk number. Digests are carried
along: every chunk row has the SHA-1 and the size of the payload up to its end, and the last chunk's are the payload's.

Archives are gzip-compressed files of the text sink: a record ends in a line feed, which is the row separator.
"""
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from refreshgate.llm.batches import map_batches
from refreshgate.session import cut_lineage

CHUNK_BYTES = 1 << 20
MIN_REVISIT_BYTES = 1000
DATE = "1970-01-01T00:00:00Z"
#: Fixed value of the WARC standard.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_ID = "none"


def _record(kind: str, record_id: str, more: list[str], block: bytes) -> bytes:
    """A record without its final line feed."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", *more, f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r"


def records_of(page_id: int | None, url: str | None, payload: memoryview, digest: str, response_id: int | None, date: str,
               chunk_bytes: int) -> Iterator[bytes]:
    """The WARC record of a page, or its segments; a revisit (of `response_id`) carries no payload."""
    name = f"urn:page:{NO_ID if page_id is None else page_id}"
    uri = " ".join((url or "").split())
    common = [f"WARC-Date: {date}", f"WARC-Target-URI: {uri}"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    first = [*common, "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if response_id is not None:
        yield _record("revisit", name, [*first, f"WARC-Refers-To: <urn:page:{response_id}>", f"WARC-Profile: {PROFILE}"], http)
        return
    if len(payload) <= chunk_bytes:
        yield _record("response", name, first, http + payload)
        return
    for number, start in enumerate(range(0, len(payload), chunk_bytes), 1):
        part, segment = payload[start:start + chunk_bytes], [f"WARC-Segment-Number: {number}"]
        if start + chunk_bytes >= len(payload):
            segment.append(f"WARC-Segment-Total-Length: {len(http) + len(payload)}")
        if number == 1:
            yield _record("response", name, [*first, *segment], http + part)
        else:
            yield _record("continuation", f"{name}:{number}", [f"WARC-Date: {date}", *segment, f"WARC-Segment-Origin-ID: <{name}>"],
                          bytes(part))


def write_archives(pages: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES, min_revisit: int = MIN_REVISIT_BYTES,
                   date: str = DATE) -> None:
    """Write a record per row of `pages` (page_id, url, html) to new archives under `path`.

    Of rows with equal payloads of at least `min_revisit` bytes, that with the largest page_id is the response and the
    others revisit it; where all their ids are NULL, and for smaller payloads, every row is a response. A row that
    repeats the response's id and payload is a response too. A NULL html is an empty payload. Extra columns are not read.

    Only payloads that occur more than once meet the table of responses by their digest; each other row has a join key
    of its own, so that neither a frequent payload nor the many small ones gather in a task that Spark cannot split.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload")).withColumns(
        {"digest": F.sha1("payload"), "n_bytes": F.octet_length("payload")})
    large = F.col("n_bytes") >= min_revisit
    newest = cut_lineage(rows.where(large).groupBy("digest", "n_bytes").agg(
        F.max("page_id").alias("response_id"), F.count("*").alias("n")).where("n > 1").select(
        F.concat_ws(":", "digest", "n_bytes").alias("key"), "response_id"))
    keyed = rows.withColumn("key", F.when(large, F.concat_ws(":", "digest", "n_bytes")).otherwise(
        F.concat(F.lit("small:"), F.xxhash64("page_id", "url").cast("string"))))
    joined = keyed.join(newest, "key", "left").select(
        "page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("response_id")), F.col("response_id"))
        .alias("response_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            page, url, payload, digest, response = batch.columns
            made, size = [], 0
            for k in range(batch.num_rows):
                for record in records_of(page[k].as_py(), url[k].as_py(), memoryview(payload[k].as_buffer()), digest[k].as_py(),
                                         response[k].as_py(), date, chunk_bytes):
                    made.append(record)
                    size += len(record)
                    if size > 4 * chunk_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["record"])
                        made, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["record"])

    map_batches(joined, run, "record binary").select(F.col("record").cast("string")).write.option("lineSep", "\n").option(
        "compression", "gzip").text(path)


class _Reader:
    """Turns the lines of archives, in order, into chunk rows; holds at most a chunk and a line."""

    def __init__(self, chunk_bytes: int, payloads: bool):
        self.chunk_bytes, self.payloads = chunk_bytes, payloads
        self.place, self.rows, self.waiting = "between", [], 0

    def line(self, line: bytes) -> None:
        if self.place == "body":
            self._body(line + b"\n")
        elif line not in (b"\r", b"") or self.place in ("head", "http"):
            getattr(self, f"_{self.place}")(line.rstrip(b"\r"))

    def _between(self, line: bytes) -> None:
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not the beginning of a WARC record: {line[:80]!r}")
        self.place, self.head = "head", {}

    def _head(self, line: bytes) -> None:
        if line:
            name, _, value = line.decode("utf-8", "replace").partition(":")
            self.head[name.lower()] = value.strip()
            return
        head, self.left = self.head, int(self.head["content-length"])
        self.kind = head["warc-type"]
        if self.kind != "continuation":
            self.record, self.http = head, {}
            self.sha, self.bytes, self.number, self.held, self.size = hashlib.sha1(), 0, 0, [], 0
        self.more = "warc-segment-number" in head and "warc-segment-total-length" not in head
        self.place = "http" if self.kind in ("response", "revisit") else "body"
        if not self.left:
            self._end()

    def _http(self, line: bytes) -> None:
        self.left -= len(line) + 2
        if line:
            name, _, value = line.decode("latin-1").partition(":")
            self.http[name.lower()] = value.strip()
            return
        self.place = "body"
        if not self.left:
            self._end()

    def _body(self, data: bytes) -> None:
        data = data[:self.left]
        self.left -= len(data)
        self.sha.update(data)
        self.bytes += len(data)
        if self.payloads:
            self.held.append(data)
        self.size += len(data)
        if not self.left:
            self._end()
        elif self.size >= self.chunk_bytes:
            self._chunk(False)

    def _end(self) -> None:
        self.place = "between"
        if self.size or not self.more:
            self._chunk(not self.more)

    def _chunk(self, last: bool) -> None:
        stated = self.record.get("warc-payload-digest", "").removeprefix("sha1:")
        kind = self.record["warc-type"]
        digest, size = (stated, int(self.http.get("content-length", 0))) if kind == "revisit" else (self.sha.hexdigest(), self.bytes)
        if last and stated and stated != digest:
            raise ValueError(f"payload of {self.record['warc-record-id']} does not have its digest")
        self.rows.append((self.record["warc-record-id"].strip("<>"), self.number, b"".join(self.held) if self.payloads else None,
                          digest, size, last, kind, self.record.get("warc-refers-to", "").strip("<>") or None,
                          self.record.get("warc-target-uri")))
        self.waiting += self.size
        self.number, self.held, self.size = self.number + 1, [], 0

    def taken(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * len(COLUMNS)
        self.rows, self.waiting = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, COLUMNS.values())], list(COLUMNS))


COLUMNS = {"record_id": pa.string(), "chunk": pa.int32(), "data": pa.binary(), "digest": pa.string(), "bytes": pa.int64(),
           "last": pa.bool_(), "record_type": pa.string(), "refers_to": pa.string(), "uri": pa.string()}


def read_chunks(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES, payloads: bool = True) -> DataFrame:
    """record_id, chunk (from 0), data, digest, bytes, last, record_type, refers_to, uri of every chunk of the archives.

    `digest` and `bytes` are of the payload up to the chunk's end; for a revisit, which has no data, those it states.
    With `payloads` false, `data` is NULL. A compressed file is read by one task, line by line.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.col("value").cast("binary").alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(chunk_bytes, payloads)
        for batch in batches:
            for line in batch.column(0):
                reader.line(line.as_py())
                if reader.waiting > 4 * chunk_bytes:
                    yield reader.taken()
            yield reader.taken()
        if reader.place != "between":
            raise ValueError("an archive ends within a record")

    return map_batches(lines, run, "record_id string, chunk int, data binary, digest string, bytes long, last boolean, "
                       "record_type string, refers_to string, uri string")


def page_id(record_id) -> "F.Column":
    """The page a record id names; NULL for a page without an id."""
    return F.expr(f"try_cast(substring_index({record_id}, ':', -1) AS BIGINT)")
