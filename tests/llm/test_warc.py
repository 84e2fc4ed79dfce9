import gzip
import hashlib
from pathlib import Path

import pytest

from refreshgate.llm import warc

BIG = "<p>größe 漢字</p>\n" * 300
ROWS = [(1, "http://a/1", BIG), (2, "http://a/2", BIG), (3, None, None), (4, "http://a/4\r\nx: y", ""), (5, "u", "small"), (6, "u", "small"),
        (None, "u", BIG), (7, "u", "y" * 999), (8, "u", "y" * 999), (9, "u", "z" * 1000), (10, "u", "z" * 1000), (10, "u", "z" * 1000),
        (11, "u", "\r\n\r\nWARC/1.1\r\n\r\nHTTP/1.1 200 OK\r\n\r\n" * 40), (12, "u", "no line feed " * 4000), (None, "u", "w" * 2000),
        (None, "v", "w" * 2000), (13, "u", "ends in line feed\n")]
SCHEMA = "page_id long, url string, html string, digest string, key string, payload string, response_id string, n string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "d", "k", "p", "r", "n") for r in rows], SCHEMA).repartition(3)


def brute(rows):
    out = []
    for page, _, html in rows:
        payload = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == payload and p is not None]
        top = max(same, default=None)
        revisit = len(payload) >= 1000 and top is not None and page != top
        out.append((page, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("chunk_bytes", [100, 1001, 1 << 20])
def test_round_trip(spark, tmp_path, chunk_bytes):
    path = str(tmp_path / "warc")
    warc.write_archives(pages(spark, ROWS), path, chunk_bytes=chunk_bytes)
    read = warc.read_chunks(spark, path, chunk_bytes=chunk_bytes)
    last = read.where("last").select(warc.page_id("record_id").alias("p"), "bytes", "digest", "record_type", warc.page_id("refers_to").alias("r"))
    assert sorted(map(tuple, last.collect()), key=repr) == brute(ROWS)
    whole = {}
    for r in read.orderBy("record_id", "chunk").collect():
        assert len(r["data"]) < chunk_bytes + (1 << 17)
        if r["record_type"] == "response" and r["record_id"] not in ("urn:page:none", "urn:page:10"):
            whole[r["record_id"]] = whole.get(r["record_id"], b"") + r["data"]
            assert r["digest"] == hashlib.sha1(whole[r["record_id"]]).hexdigest() and r["bytes"] == len(whole[r["record_id"]])
    for page, _, html in ROWS:
        if f"urn:page:{page}" in whole:
            assert whole[f"urn:page:{page}"] == (html or "").encode()
    for file in Path(path).glob("part-*.gz"):
        assert not (text := gzip.decompress(file.read_bytes())) or text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")


def test_empty_and_broken(spark, tmp_path):
    path = str(tmp_path / "none")
    warc.write_archives(pages(spark, []), path)
    assert warc.read_chunks(spark, path).count() == 0
    broken = str(tmp_path / "broken")
    Path(broken).mkdir()
    sha = hashlib.sha1(b"other").hexdigest()
    Path(broken, "part-0.gz").write_bytes(gzip.compress(
        f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Payload-Digest: sha1:{sha}\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n".encode()))
    with pytest.raises(Exception, match="does not have its digest"):
        warc.read_chunks(spark, broken).count()
