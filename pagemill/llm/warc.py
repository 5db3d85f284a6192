"""WARC archives as a table of chunks: payloads of any size are written and read piece by piece.

A chunk row is a record's identifier, a chunk number, the bytes, and the length
and SHA-1 of the payload up to and with that chunk.  Archives lie under a folder
that all executors share, gzipped record by record; the files that count are
those a manifest table lists, so what a lost or repeated task leaves is ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple
from urllib.parse import quote, unquote

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.operators.scale import join_dimension, stage, staging_root

CHUNK = 1 << 16
REVISIT_BYTES = 1000  # equal payloads of fewer bytes are stored each time
FILE_BYTES = 256 << 20
_HEADER = 1 << 20  # longest header line that is read

# Fixed values of the WARC 1.1 format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAME = "urn:page:"

CHUNK_SCHEMA = (
    "record_id string, record_type string, target_uri string, refers_to string, chunk_no long, "
    "data binary, payload_bytes long, payload_digest string, last boolean"
)


def _open(uri: str, write: bool):
    """A stream of the file in whatever store the URI names."""
    store, path = fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    if not write:
        return store.open_input_stream(path, compression=None)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path, compression=None)


def records(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Rows (page, url, payload, n_bytes, digest, refers_to), one per page.

    The payload is the html in UTF-8, of a null nothing.  Of pages with equal
    payloads of REVISIT_BYTES or more, that with the largest id is stored and
    the others refer to it; a null id counts as smallest, and pages that share
    the largest id are each stored.
    """
    payload = F.coalesce(html, F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).alias("page"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"n_bytes": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")})
    stored = rows.filter(F.col("n_bytes") >= REVISIT_BYTES).groupBy("digest")
    stored = stored.agg(F.max("page").alias("stored"), F.count(F.lit(1)).alias("n")).filter("n > 1 and stored is not null")
    told = join_dimension(rows, stage(stored.drop("n"), "stored-payloads"), ["digest"], "left")
    again = F.col("stored").isNotNull() & ~F.coalesce(F.col("page") == F.col("stored"), F.lit(False))
    return told.withColumn("refers_to", F.when(again, F.col("stored"))).drop("stored")


def chunked(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """Records as chunk rows, a record's chunks in order and side by side; a revisit has one, empty."""
    stored = F.when(F.col("refers_to").isNull(), F.col("n_bytes")).otherwise(0)
    last = F.greatest(F.lit(0), F.ceil(stored / size) - 1).cast("long")
    spread = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk_no"))
    at = (F.col("chunk_no") * size + 1).cast("int")
    piece = F.when(F.col("refers_to").isNull(), F.substring("payload", at, F.lit(size))).otherwise(F.lit(b""))
    return spread.select(
        F.col("page").cast("string"), "url", "n_bytes", "digest", F.col("refers_to").cast("string"), "chunk_no",
        (F.col("chunk_no") == last).alias("last"), piece.alias("data"),
    )


def _name(page: str | None) -> str:
    return f"<{NAME}{'-' if page is None else quote(page, safe='')}>"


def _page(name: str | None) -> str | None:
    page = (name or "")[1 + len(NAME) : -1]
    return None if page in ("", "-") else unquote(page)


def _head(row, date: str) -> bytes:
    """The lines of a record before its payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row.n_bytes}\r\n\r\n".encode()
    again = row.refers_to is not None
    lines = {
        "WARC-Type": "revisit" if again else "response",
        "WARC-Record-ID": _name(row.page),
        "WARC-Date": date,
        "WARC-Target-URI": None if row.url is None else quote(row.url, safe=":/?#[]@!$&'()*+,;=%-._~"),
        "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(row.digest)).decode(),
        "WARC-Profile": PROFILE if again else None,
        "WARC-Refers-To": _name(row.refers_to) if again else None,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(http) + (0 if again else row.n_bytes)),
    }
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines.items() if v is not None).encode() + b"\r\n" + http


def write(chunks: DataFrame, folder: str, *, date: str = "1970-01-01T00:00:00Z", level: int = 6, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write chunk rows as archives under ``folder``; returns the manifest (path, n_records), a stored table.

    A task writes its partition's records as they come and begins a new file
    beyond ``file_bytes``; no rows make no file.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = path = None
        n, sha, packer = 0, None, None
        for batch in batches:
            for row in batch.itertuples(index=False):
                if out is None:
                    path, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0
                    out = _open(path, True)
                if row.chunk_no == 0:
                    packer, sha = zlib.compressobj(level, zlib.DEFLATED, 31), hashlib.sha1()
                    out.write(packer.compress(_head(row, date)))
                sha.update(row.data)
                out.write(packer.compress(row.data))
                if row.last:
                    if row.refers_to is None and sha.hexdigest() != row.digest:
                        raise ValueError(f"chunks of page {row.page} do not make its payload")
                    out.write(packer.compress(b"\r\n\r\n") + packer.flush())
                    n += 1
                    if out.tell() >= file_bytes:
                        out.close()
                        out = None
                        yield pd.DataFrame({"path": [path], "n_records": [n]})
        if out is not None:
            out.close()
            yield pd.DataFrame({"path": [path], "n_records": [n]})

    def plain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return run(b.astype(object).where(b.notna(), None) for b in batches)

    return stage(chunks.mapInPandas(plain, "path string, n_records long"), "warc-manifest")


class _Stream:
    """Bytes of an archive, gzipped in members or plain, never more than a chunk or a line at once."""

    def __init__(self, file, size: int):
        self.file, self.size, self.held = file, size, b""
        first = file.read(max(2, size))
        self.raw, self.gz = first, zlib.decompressobj(31) if first[:2] == b"\x1f\x8b" else None

    def _more(self) -> bool:
        while True:
            if self.gz is None:
                got, self.raw = self.raw, b""
            else:
                if self.gz.eof and self.raw:
                    self.gz = zlib.decompressobj(31)
                got = b"" if self.gz.eof else self.gz.decompress(self.raw, self.size)
                self.raw = self.gz.unused_data if self.gz.eof else self.gz.unconsumed_tail
            if got:
                self.held += got
                return True
            if not self.raw:
                self.raw = self.file.read(self.size)
                if not self.raw:
                    if self.gz is not None and not self.gz.eof:
                        raise ValueError("archive ends inside a member")
                    return False

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the archive."""
        while (end := self.held.find(b"\r\n")) < 0:
            if len(self.held) > _HEADER:
                raise ValueError("header line too long")
            if not self._more():
                if self.held:
                    raise ValueError("archive ends inside a record")
                return None
        out, self.held = self.held[:end], self.held[end + 2 :]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes in pieces of the chunk size, but for the last."""
        while n:
            want = min(n, self.size)
            while len(self.held) < want:
                if not self._more():
                    raise ValueError("archive ends inside a record")
            out, self.held = self.held[:want], self.held[want:]
            n -= want
            yield out


class Chunk(NamedTuple):
    record_id: str | None
    record_type: str | None
    target_uri: str | None
    refers_to: str | None
    chunk_no: int
    data: bytes | None
    payload_bytes: int
    payload_digest: str | None
    last: bool


def _fields(stream: _Stream) -> tuple[dict[str, str], int]:
    out, size = {}, 0
    while line := stream.line():
        name, _, value = line.decode("utf-8", "replace").partition(":")
        out[name.strip().lower()] = value.strip()
        size += len(line) + 2
    return out, size + 2


def parse(file, size: int = CHUNK, data: bool = True) -> Iterator[Chunk]:
    """Chunk rows of the response, revisit and resource records of one archive, in order.

    Digest and length of a stored payload come from its bytes and must agree
    with the header; those of a revisit, whose payload is elsewhere, from the
    header.
    """
    stream = _Stream(file, size)
    while (line := stream.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head, _ = _fields(stream)
        left = int(head["content-length"])
        kind, http = head.get("warc-type"), {}
        if left and head.get("content-type", "").startswith("application/http"):
            _, used = stream.line(), 0
            used = len(_) + 2
            http, more = _fields(stream)
            left -= used + more
        label, _, code = head.get("warc-payload-digest", "").partition(":")
        named = (base64.b32decode(code).hex() if len(code) == 32 else code.lower()) if label == "sha1" else None
        about = (head.get("warc-record-id"), kind, head.get("warc-target-uri"), head.get("warc-refers-to"))
        if kind == "revisit":
            for _ in stream.take(left):
                pass
            yield Chunk(*about, 0, b"" if data else None, int(http.get("content-length", 0)), named, True)
            continue
        sha, n, number = hashlib.sha1(), 0, 0
        for piece in stream.take(left) if left else (b"",):
            sha.update(piece)
            n += len(piece)
            last = n == left
            if last and named and sha.hexdigest() != named:
                raise ValueError(f"payload of {about[0]} does not match its digest")
            if kind in ("response", "resource"):
                yield Chunk(*about, number, piece if data else None, n, sha.copy().hexdigest(), last)
            number += 1


def read(manifest: DataFrame, *, data: bool = True) -> DataFrame:
    """Chunk rows of all archives in the manifest, a task per file; without ``data`` the bytes are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                with _open(path, False) as file:
                    yield from _frames(parse(file, data=data))

    files = manifest.select("path")
    return files.repartition(max(1, files.count())).mapInPandas(run, CHUNK_SCHEMA)


def _frames(chunks: Iterable[Chunk], rows: int = 2000, held_bytes: int = 8 << 20) -> Iterator[pd.DataFrame]:
    held, size = [], 0
    for chunk in chunks:
        held.append(chunk)
        size += len(chunk.data or b"")
        if len(held) >= rows or size >= held_bytes:
            yield pd.DataFrame(held, columns=Chunk._fields)
            held, size = [], 0
    if held:
        yield pd.DataFrame(held, columns=Chunk._fields)


def archive(spark: SparkSession, pages: DataFrame, folder: str | None = None, **columns: str) -> DataFrame:
    """Archive ``pages`` under a new folder of the shared one and return the manifest.

    A null html is an empty payload, a null url has no target line, a null id is named ``-``.
    """
    folder = folder or f"{staging_root(spark)}/warc/{uuid.uuid4().hex}"
    if "://" not in folder:
        folder = folder if folder.startswith("file:") else f"file://{folder}"
    return write(chunked(records(pages, **columns)), folder)


def summary(chunks: DataFrame) -> DataFrame:
    """One row per record from its last chunk: page_id (text), payload_bytes, payload_digest, record_type, refers_to (text)."""
    page = F.udf(_page, "string")
    return chunks.filter("last").select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to")
    )
