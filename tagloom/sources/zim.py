"""ZIM files in two steps: a DataSource of their directory, then the bodies of the entries that are wanted.

The directory is small beside the bodies, so keys are chosen and repeats dropped before any cluster is unpacked; entries are then
dealt by cluster, and a task unpacks each of its clusters once.
"""

from __future__ import annotations

import bz2
import lzma
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAGIC = 0x044D495A
ENTRIES = 50_000  # of the directory, to a partition
SCHEMA = "key string, mime string, cluster long, blob long, file string, at long"
_CONTENT = (b"A", b"C")


def opened(path: str, uri: str | None = None):
    """A file that can be read at any place; uri: where the store is, for names without it."""
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.FileSystem.from_uri(uri)[0] if uri and "://" in uri else fs.LocalFileSystem(), path)
    return store.open_input_file(at)


class Zim:
    """The directory and the clusters of one open file."""

    def __init__(self, file):
        self.file, self.size = file, file.size()
        head = self.at(0, 80)
        if len(head) < 80 or struct.unpack_from("<I", head)[0] != MAGIC:
            raise ValueError("not a ZIM file")
        self.entries, self.clusters = struct.unpack_from("<II", head, 24)
        self.paths, _, self.cluster_list, self.mimes = struct.unpack_from("<QQQQ", head, 32)
        (self.end,) = struct.unpack_from("<Q", head, 72)
        self.end = self.end if 80 <= self.end <= self.size else self.size

    def at(self, start: int, size: int) -> bytes:
        self.file.seek(start)
        return self.file.read(max(0, min(size, self.size - start)))

    def mime_types(self) -> list[str]:
        size = 4096
        while b"\0\0" not in (raw := self.at(self.mimes, size)) and len(raw) == size:
            size *= 2
        return [x.decode("utf-8", "replace") for x in raw.partition(b"\0\0")[0].split(b"\0")]

    def directory(self, first: int, last: int) -> Iterator[tuple[bytes, int, int, int, str, str]]:
        """(namespace, number of the MIME type, cluster, blob, path, title) of the entries first to last - 1 that have a body."""
        raw = self.at(self.paths + 8 * first, 8 * (last - first))
        places = struct.unpack(f"<{len(raw) // 8}Q", raw[: len(raw) // 8 * 8])
        base, held = 0, b""
        for place in places:
            size = 2**16
            while True:
                if not (base <= place and place + 16 <= base + len(held)):
                    base, held = place, self.at(place, size)
                own = place - base
                kind = struct.unpack_from("<H", held, own)[0] if len(held) - own >= 16 else 0xFFFF
                if kind >= 0xFFFD:  # redirects and deleted entries
                    break
                path_end = held.find(b"\0", own + 16)
                title_end = held.find(b"\0", path_end + 1) if path_end >= 0 else -1
                if title_end >= 0:
                    cluster, blob = struct.unpack_from("<II", held, own + 8)
                    yield held[own + 3 : own + 4], kind, cluster, blob, held[own + 16 : path_end].decode("utf-8", "replace"), held[path_end + 1 : title_end].decode("utf-8", "replace")
                    break
                if base + len(held) >= self.size:
                    break  # the file ends in the entry
                base, held, size = 0, b"", size * 2 if base == place else size

    def cluster(self, number: int) -> list[bytes]:
        """The blobs of a cluster."""
        raw = self.at(self.cluster_list + 8 * number, 16)
        (start,) = struct.unpack_from("<Q", raw)
        after = [p for p in struct.unpack(f"<{len(raw) // 8}Q", raw)[1:] if number + 1 < self.clusters and p > start]
        raw = self.at(start, (after[0] if after else self.end) - start)
        body, width = unpacked(raw[0] & 15, raw[1:]), 8 if raw[0] & 16 else 4
        n = int.from_bytes(body[:width], "little") // width
        ends = struct.unpack_from(f"<{n}{'Q' if width == 8 else 'I'}", body)
        return [body[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def unpacked(kind: int, raw: bytes) -> bytes:
    if kind in (0, 1):
        return raw
    if kind == 2:
        return zlib.decompress(raw)
    if kind == 3:
        return bz2.decompress(raw)
    if kind == 4:
        return lzma.LZMADecompressor().decompress(raw)
    if kind == 5:
        import zstandard

        try:
            return zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        except zstandard.ZstdError as e:
            raise ValueError(str(e)) from e
    raise ValueError(f"unknown packing {kind}")


class ZimSource(DataSource):
    """spark.read.format("tagloom_zim").load(path): the HTML articles in the directory of a file, or of all .zim files of a folder."""

    @classmethod
    def name(cls) -> str:
        return "tagloom_zim"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return ZimReader(self.options["path"])


class ZimReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = re.sub(r"^file:(//)?(?=/)", "", path)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        info = store.get_file_info(at)
        files = [info] if info.is_file else store.get_file_info(fs.FileSelector(at, recursive=True))
        out = []
        for k, name in enumerate(sorted(f.path for f in files if f.is_file and (f.path.endswith(".zim") or info.is_file))):
            with opened(name, self.path) as file:
                n = Zim(file).entries
            out += [InputPartition((k, name, i, min(i + ENTRIES, n))) for i in range(0, n, ENTRIES)]
        return out or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        k, name, first, last = partition.value
        with opened(name, self.path) as file:
            zim = Zim(file)
            mimes = zim.mime_types()
            for i, (space, kind, cluster, blob, path, title) in enumerate(zim.directory(first, last)):
                mime = mimes[kind] if kind < len(mimes) else ""
                if space in _CONTENT and mime.startswith("text/html"):
                    yield (unicodedata.normalize("NFC", title or path), mime, cluster, blob, name, (k << 40) + first + i)


def with_bodies(entries: DataFrame, path: str) -> DataFrame:
    """entries(key, cluster, blob, file, at) -> (key, html, file, at). A body that can't be read or isn't UTF-8 is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zim, name, number, blobs = None, None, None, []
        for batch in batches:
            said: list[str | None] = []
            keys, rows, size = [], [], 0
            for key, cluster, blob, own, at in zip(*(batch.column(c).to_pylist() for c in ("key", "cluster", "blob", "file", "at")), strict=True):
                if own != name:
                    zim, name, number = Zim(opened(own, path)), own, None
                if cluster != number:
                    try:
                        blobs = zim.cluster(cluster)
                    except (ValueError, OSError, EOFError, IndexError, struct.error, zlib.error, lzma.LZMAError):
                        blobs = []
                    number = cluster
                try:
                    said.append(blobs[blob].decode("utf-8") if blob < len(blobs) else None)
                except UnicodeDecodeError:
                    said.append(None)
                keys.append(key)
                rows.append((own, at))
                size += len(said[-1] or "")
                if size > 16_000_000:
                    yield _bodies(keys, said, rows)
                    said, keys, rows, size = [], [], [], 0
            yield _bodies(keys, said, rows)

    dealt = entries.repartition("file", "cluster").sortWithinPartitions("file", "cluster", "blob")
    return dealt.mapInArrow(run, "key string, html string, file string, at long")


def _bodies(keys: list[str], said: list[str | None], rows: list[tuple[str, int]]) -> pa.RecordBatch:
    columns = [pa.array(keys, pa.string()), pa.array(said, pa.string()), pa.array([f for f, _ in rows], pa.string()), pa.array([a for _, a in rows], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["key", "html", "file", "at"])
