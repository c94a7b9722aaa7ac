import lzma
import struct
import zlib

import pytest
import zstandard

from tagloom import cli
from tagloom.operators.corpus import Corpus
from tagloom.sources import readers, zim

PACKED = {1: lambda x: x, 2: zlib.compress, 4: lzma.compress, 5: zstandard.ZstdCompressor().compress}


def archive(entries, clusters, broken=()):
    """A file of entries (namespace, MIME number, cluster, blob, path, title), None for a redirect, and clusters (packing, wide, blobs)."""
    mimes = b"text/html\0image/png\0text/html; charset=utf-8\0\0"
    out = bytearray(80) + mimes
    places = []
    for e in entries:
        places.append(len(out))
        if e is None:
            out += struct.pack("<HBcII", 0xFFFF, 0, b"A", 0, 0) + b"to\0to\0"
        else:
            space, mime, cluster, blob, path, title = e
            out += struct.pack("<HBcIII", mime, 0, space, 0, cluster, blob) + path.encode() + b"\0" + title.encode() + b"\0"
    paths = len(out)
    out += struct.pack(f"<{len(places)}Q", *places)
    starts = []
    for i, (packing, wide, blobs) in enumerate(clusters):
        starts.append(len(out))
        width, ends = (8 if wide else 4), [0]
        for b in blobs:
            ends.append(ends[-1] + len(b))
        body = struct.pack(f"<{len(ends)}{'Q' if wide else 'I'}", *(x + width * len(ends) for x in ends)) + b"".join(blobs)
        body = b"nonsense" if i in broken else PACKED[packing](body)
        out += bytes([packing | 16 * wide]) + body
    list_at = len(out)
    out += struct.pack(f"<{len(starts)}Q", *starts)
    struct.pack_into("<IHH", out, 0, zim.MAGIC, 6, 1)
    struct.pack_into("<IIQQQQ", out, 24, len(entries), len(clusters), paths, 0, list_at, 80)
    struct.pack_into("<Q", out, 72, len(out))
    return bytes(out) + b"\0" * 16


LONG = "long/" + "x" * 70_000
ENTRIES = [
    (b"A", 0, 0, 0, "one", "One"), None, (b"A", 0, 1, 1, "cafe", "Café"), (b"-", 0, 0, 1, "style", ""), (b"A", 1, 0, 1, "pic", "P"),
    (b"C", 2, 2, 0, "untitled", ""), (b"A", 0, 3, 0, "again", "One"), (b"A", 0, 3, 1, LONG, ""), (b"A", 0, 1, 0, "bad", "Bad"), (b"A", 0, 4, 0, "lost", "Lost"),
]
CLUSTERS = [(1, False, [b"<p>1", b"no"]), (4, False, [b"\xff\xfe<p>", "<p>é".encode()]), (5, True, [b"<p>u"]), (2, False, [b"<p>late", b"<p>long"]), (5, False, [b"<p>gone"])]


@pytest.fixture
def path(tmp_path):
    (tmp_path / "a.zim").write_bytes(archive(ENTRIES, CLUSTERS, broken=[4]))
    return str(tmp_path / "a.zim")


def test_articles_in_order_of_the_directory(spark, path):
    rows = readers.zim(spark, path).orderBy("at").collect()
    want = [("One", "<p>1"), ("Café", "<p>é"), ("untitled", "<p>u"), (LONG, "<p>long"), ("Bad", None), ("Lost", None)]
    assert [(r["key"], r["html"]) for r in rows] == want and len({r["at"] for r in rows}) == 6
    assert [r["key"] for r in readers.source(spark, path, keys=["Café", "no"]).collect()] == ["Café"]
    assert sorted(r["key"] for r in readers.zim(spark, path, limit=2).collect()) == ["Café", "One"]


def test_directory_in_parts_and_folders(spark, path, monkeypatch, tmp_path):
    (tmp_path / "b.zim").write_bytes(archive([(b"A", 0, 0, 0, "two", "Two"), (b"A", 0, 0, 1, "one", "One")], [(1, True, [b"<p>2", b"<p>other"])]))
    monkeypatch.setattr(zim, "ENTRIES", 3)
    parts = zim.ZimReader(str(tmp_path)).partitions()
    assert [(p.value[2], p.value[3]) for p in parts] == [(0, 3), (3, 6), (6, 9), (9, 10), (0, 2)]
    found = [r for p in parts for r in zim.ZimReader(str(tmp_path)).read(p)]
    assert [r[0] for r in found] == ["One", "Café", "untitled", "One", LONG, "Bad", "Lost", "Two", "One"] and [r[5] for r in found] == sorted({r[5] for r in found})
    assert {(r["key"], r["html"]) for r in readers.zim(spark, str(tmp_path), keys=["One", "Two"]).collect()} == {("One", "<p>1"), ("Two", "<p>2")}


def test_no_zim_and_no_entries(spark, tmp_path):
    (tmp_path / "x.zim").write_bytes(b"nothing")
    with pytest.raises(ValueError):
        zim.ZimReader(str(tmp_path / "x.zim")).partitions()
    (tmp_path / "x.zim").write_bytes(archive([], []))
    assert readers.zim(spark, str(tmp_path / "x.zim")).count() == 0


def test_convert_counts_failures(spark, path, tmp_path, capsys):
    out = str(tmp_path / "made")
    assert cli.main(["convert", path, out], spark) == 0 and capsys.readouterr().out == "Prepared: 6\nConverted: 4\nFailed: 2\n"
    assert [r["values"] for r in Corpus.open(spark, out).scan_text("p").collect()] == [["1"], ["é"], ["u"], ["long"]]
    assert cli.main(["extract", path, "untitled"], spark) == 0 and capsys.readouterr().out == "<p>u\n"
