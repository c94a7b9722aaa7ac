"""A DataSource for WARC files: a partition a file, HTML responses only, read through a stream of records."""

from __future__ import annotations

import io
import re
import zlib
from collections.abc import Iterator
from typing import BinaryIO

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAX_BODY = 256 * 2**20
SCHEMA = "key string, content binary, content_type string, url string, fetched string, status long, file string, ordinal long, at long"


class Members(io.RawIOBase):
    """What the gzip members of a stream hold, one after the other, up to the first broken place."""

    def __init__(self, raw: BinaryIO):
        self.raw, self.open, self.input, self.output = raw, zlib.decompressobj(31), b"", b""

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.output:
            if self.open.eof:
                self.input, self.open = self.open.unused_data, zlib.decompressobj(31)
            self.input = self.input or self.raw.read(2**16)
            if not self.input:
                return 0
            try:
                self.output = self.open.decompress(self.input, 2**20)
            except zlib.error:
                return 0
            self.input = self.open.unconsumed_tail
        n = min(len(into), len(self.output))
        into[:n], self.output = self.output[:n], self.output[n:]
        return n


def records(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-cased name, block) of a WARC stream; a broken tail ends it."""
    try:
        while line := stream.readline():
            if not line.startswith(b"WARC/"):
                continue
            headers: dict[str, str] = {}
            while (line := stream.readline()).strip():
                name, _, value = line.decode("utf-8", "replace").partition(":")
                headers[name.strip().lower()] = value.strip()
            size = int(headers.get("content-length", "-1"))
            if size < 0:
                return
            if size > MAX_BODY:
                while size > 0 and (part := stream.read(min(size, 2**20))):
                    size -= len(part)
                continue
            block = stream.read(size)
            if len(block) < size:
                return
            yield headers, block
    except (EOFError, OSError, zlib.error, ValueError):
        return


def response(headers: dict[str, str], block: bytes) -> dict | None:
    """An HTML response's columns, or None for any other record."""
    if headers.get("warc-type") != "response" or "warc-target-uri" not in headers:
        return None
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        head, gap, body = block.partition(b"\n\n")
    lines = head.decode("latin-1").splitlines()
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    kind = fields.get("content-type", "")
    if "text/html" not in kind.lower():
        return None
    if "chunked" in fields.get("transfer-encoding", "").lower():
        body = _unchunked(body)
    if fields.get("content-encoding", "").lower() in ("gzip", "x-gzip", "deflate"):
        try:
            body = zlib.decompressobj(47).decompress(body, MAX_BODY)
        except zlib.error:
            pass
    m = re.match(r"HTTP/\S+\s+(\d{3})", lines[0]) if lines else None
    key = headers["warc-target-uri"].strip("<>")
    return {"key": key, "content": body, "content_type": kind, "url": key, "fetched": headers.get("warc-date"), "status": int(m[1]) if m else None}


def _unchunked(body: bytes) -> bytes:
    out, stream = [], io.BytesIO(body)
    while line := stream.readline():
        try:
            size = int(line.split(b";")[0], 16)
        except ValueError:
            return body
        if not size:
            break
        out.append(stream.read(size))
        stream.readline()
    return b"".join(out)


class WarcSource(DataSource):
    """spark.read.format("tagloom_warc").load(path): a file or a folder of .warc and .warc.gz files that workers can open."""

    @classmethod
    def name(cls) -> str:
        return "tagloom_warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(self.options["path"])


class WarcReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = re.sub(r"^file:(//)?(?=/)", "", path)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        info = store.get_file_info(at)
        files = [info] if info.is_file else store.get_file_info(fs.FileSelector(at, recursive=True))
        names = sorted(f.path for f in files if f.is_file and f.path.endswith((".warc", ".warc.gz")))
        return [InputPartition(x) for x in enumerate(names)] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs

        if partition.value is None:
            return
        k, name = partition.value
        store = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        with store.open_input_stream(name, compression=None) as raw:
            stream = io.BufferedReader(Members(raw)) if name.endswith(".gz") else io.BufferedReader(raw)
            for ordinal, (headers, block) in enumerate(records(stream)):
                r = response(headers, block)
                if r:
                    yield (r["key"], r["content"], r["content_type"], r["url"], r["fetched"], r["status"], name, ordinal, (k << 40) + ordinal)
