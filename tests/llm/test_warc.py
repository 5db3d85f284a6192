from __future__ import annotations

import gzip
import hashlib
import io
import re

import pytest

from pagemill.llm import queries, warc


def plain(rows):
    out = set()
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == data and p is not None]
        again = len(data) >= 1000 and same and page != max(same) and sum((h or "").encode() == data for _, _, h in rows) > 1
        out.add((page, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", max(same) if again else None))
    return out


def test_round_trip_of_odd_pages(spark, tmp_path):
    big = "é\r\n\r\nWARC/1.1\r\n" * 40_000  # many chunks, and text that looks like a record
    rows = [(1, "http://a/x y\r\n", big), (2, None, big), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"),
            (7, "é", "x" * 1000), (8, "v", "x" * 1000), (None, "v", "x" * 1000), (9, "v", "y" * 999), (10, "v", "y" * 999)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", warc.F.lit("z"))
    manifest = warc.archive(spark, pages, f"file://{tmp_path}/w")
    chunks = warc.read(manifest).collect()
    got = {(r.page_id and int(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to and int(r.refers_to)) for r in warc.summary(warc.read(manifest, data=False)).collect()}
    assert got == plain(rows)
    mine = sorted((c for c in chunks if c.record_id == "<urn:page:2>"), key=lambda c: c.chunk_no)
    assert len(mine) > 5 and b"".join(bytes(c.data) for c in mine) == big.encode()
    so_far = b""
    for k, c in enumerate(mine):
        so_far += bytes(c.data)
        assert (c.chunk_no, c.payload_bytes, c.payload_digest) == (k, len(so_far), hashlib.sha1(so_far).hexdigest())
        assert len(c.data) <= warc.CHUNK and c.last == (k == len(mine) - 1)
    assert {c.target_uri for c in chunks if c.record_id == "<urn:page:1>"} == {"http://a/x%20y%0D%0A"}
    assert sum(r.n_records for r in manifest.collect()) == len(rows)


def test_rolls_files_and_takes_no_rows(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"{i} " * 2000) for i in range(40)], "page_id long, url string, html string")
    rows = warc.chunked(warc.records(pages)).coalesce(1)
    manifest = warc.write(rows, f"file://{tmp_path}/w", file_bytes=3000, level=1)
    assert manifest.count() > 2 and warc.summary(warc.read(manifest)).count() == 40
    empty = warc.archive(spark, pages.limit(0), f"file://{tmp_path}/e")
    assert empty.count() == 0 and warc.read(empty).count() == 0


def test_plain_archives_and_damage():
    body = b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nhi"
    record = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:5>\r\nContent-Type: application/http\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    for data in (info + record, gzip.compress(info) + gzip.compress(record), gzip.compress(info + record)):
        for size in (1, 7, 1 << 16):
            got = list(warc.parse(io.BytesIO(data), size))
            assert b"".join(c.data for c in got) == b"hi" and got[-1].last and got[-1].payload_bytes == 2
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(record[:-8])))
    bad = record.replace(b"Content-Type", b"WARC-Payload-Digest: sha1:%s\r\nContent-Type" % (b"A" * 32))
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(bad)))


def test_files_on_disk_follow_the_format(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<p>x</p>")], "page_id long, url string, html string")
    path = warc.archive(spark, pages, f"file://{tmp_path}/w").first().path.removeprefix("file://")
    text = gzip.open(path).read()
    assert re.fullmatch(rb"WARC/1\.1\r\n(?:[\w-]+: [^\r\n]+\r\n)+\r\nHTTP/1\.1 200 OK\r\n(?:[\w-]+: [^\r\n]+\r\n)+\r\n<p>x</p>\r\n\r\n", text)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    got = {tuple(r) for r in queries.op3_warc(spark, sf).collect()}
    pages = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    assert got == plain(pages)
