"""Pages to files, and results to Arrow."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from xxhash import xxh3_64_hexdigest


def file_name(key: str) -> str:
    """A key as the stem of a file; one that had to be changed ends in a digest of the key, so that no two keys share a file."""
    own = re.sub(r'[\\/:*?"<>|\x00-\x1f]', "_", key)
    if own == key and 0 < len(key.encode("utf-8", "replace")) <= 200 and not re.search(r"~[0-9a-f]{16}$", key):
        return own
    return f"{own[:40]}~{xxh3_64_hexdigest(key.encode('utf-8', 'surrogatepass'))}"


def write_html(pages: DataFrame, folder: str, suffix: str = "") -> int:
    """A file for each row of (key, html) in a folder that all workers share; the number of files."""
    stem, end = folder.rstrip("/"), suffix

    def run(batches):
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(stem) if "://" in stem else (fs.LocalFileSystem(), stem)
        store.create_dir(at, recursive=True)
        for b in batches:
            for key, said in zip(b.column("key").to_pylist(), b.column("html").to_pylist(), strict=True):
                with store.open_output_stream(f"{at}/{file_name(key)}{end}.html") as out:
                    out.write((said or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], names=["n"])

    return pages.select("key", "html").mapInArrow(run, "n long").groupBy().sum("n").first()[0] or 0


def write_warc(pages: DataFrame, folder: str, stem: str = "part") -> int:
    """A .warc file for each part of (key, content binary, content_type, fetched, status), its rows in the part's order; the number of records."""
    to = folder.rstrip("/")

    def run(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        store, at = fs.FileSystem.from_uri(to) if "://" in to else (fs.LocalFileSystem(), to)
        store.create_dir(at, recursive=True)
        n = 0
        with store.open_output_stream(f"{at}/{stem}-{TaskContext.get().partitionId():05d}.warc") as out:
            for b in batches:
                for key, content, kind, fetched, status in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    block = f"HTTP/1.1 {status} -\r\nContent-Type: {kind}\r\n\r\n".encode() + content
                    head = f"WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: {key}\r\nWARC-Date: {fetched}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}\r\n\r\n"
                    out.write(head.encode() + block + b"\r\n\r\n")
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return pages.select("key", "content", "content_type", "fetched", "status").mapInArrow(run, "n long").groupBy().sum("n").first()[0] or 0


def to_arrow(rows: DataFrame) -> pa.Table:
    """A result as an Arrow table, for hand-off to other tools; it has to fit the driver."""
    return rows.toArrow()
