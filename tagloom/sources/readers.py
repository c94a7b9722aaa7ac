"""Pages from folders, single files, web-crawl and offline-reader archives, and written corpora."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.charset import decode_html
from ..operators.corpus import Corpus, parse_pages
from ..operators.ingest import first_by_key, first_of_each


def _decoded(files: DataFrame, columns: list[str]) -> DataFrame:
    """content binary (and content_type, url where there) -> html, in Arrow batches."""
    schema = ", ".join([*(f"`{c}` {files.schema[c].dataType.simpleString()}" for c in columns), "html string"])

    def run(batches):
        for b in batches:
            kinds = b.column("content_type").to_pylist() if "content_type" in b.schema.names else [None] * b.num_rows
            urls = b.column("url").to_pylist() if "url" in b.schema.names else [None] * b.num_rows
            said = [None if x is None else decode_html(x, t, u) for x, t, u in zip(b.column("content").to_pylist(), kinds, urls, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(said, pa.string())], names=[*columns, "html"])

    return files.mapInArrow(run, schema)


def folder(spark: SparkSession, path: str, key: str = "stem") -> DataFrame:
    """(key, html) of a folder's .htm and .html files. key: "stem" takes the folder's own files, "relpath" all below, by relative path."""
    if key not in ("stem", "relpath"):
        raise ValueError(key)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", key == "relpath").option("pathGlobFilter", "*.[hH][tT][mM]*").load(path)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(root).toUri().getPath()
    plain = F.regexp_replace("path", r"^[a-z]+:(//[^/]*)?", "")
    if key == "stem":
        own = F.regexp_replace(F.element_at(F.split(plain, "/"), -1), r"\.[^.]*$", "")
        files = files.where(F.regexp_replace(plain, r"/[^/]*$", "") == root.rstrip("/"))
    else:
        own = F.substring(plain, len(root.rstrip("/")) + 2, 2**31 - 1)
    return _decoded(files.select(own.alias("key"), "content"), ["key"])


def _listed(spark: SparkSession, rows: DataFrame, keys: Iterable[str] | str | None) -> DataFrame:
    """Rows whose key is in an iterable, or in a file with a key a line."""
    if keys is None:
        return rows
    if isinstance(keys, str):
        return rows.join(normalized(spark.read.text(keys).toDF("key")).where("key <> ''").distinct(), "key", "left_semi")
    own = normalized(spark.createDataFrame([(k,) for k in keys], "key string")).where("key <> ''").distinct()
    return rows.join(own, "key", "left_semi")


def warc(spark: SparkSession, path: str, keys: Iterable[str] | str | None = None, limit: int | None = None) -> DataFrame:
    """(key, html, fetched, status, file, ordinal, at) of HTML responses; of repeated addresses the first in source order.

    at numbers them by file, then record: distinct, and the archive order of what is made of them. keys: only these, as an iterable
    or the path of a file with a key a line. limit: the first so many in source order. Repeats are found by keys alone, so bodies
    aren't dealt out unless very many are late.
    """
    from .warc import WarcSource

    spark.dataSource.register(WarcSource)
    rows = first_by_key(_listed(spark, spark.read.format("tagloom_warc").load(path), keys), "at")
    if limit is not None:
        rows = rows.orderBy("at").limit(limit)
    return _decoded(rows, ["key", "fetched", "status", "file", "ordinal", "at"])


def zim(spark: SparkSession, path: str, keys: Iterable[str] | str | None = None, limit: int | None = None) -> DataFrame:
    """(key, html, file, at) of the HTML articles of ZIM files, keyed by title, or path where that is empty, in NFC; as warc().

    An article whose cluster can't be unpacked or that isn't UTF-8 has null html, and so a parse error in a corpus.
    """
    from .zim import ZimSource, with_bodies

    spark.dataSource.register(ZimSource)
    entries = first_of_each(_listed(spark, spark.read.format("tagloom_zim").load(path), keys), "at")
    return with_bodies(entries.orderBy("at").limit(limit) if limit is not None else entries, path)


def normalized(keys: DataFrame) -> DataFrame:
    import unicodedata

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([None if k is None else unicodedata.normalize("NFC", k.strip("\r\n")) for k in b.column("key").to_pylist()], pa.string())], names=["key"])

    return keys.select("key").mapInArrow(run, "key string")


def kind_of(path: str) -> str:
    return "warc" if path.endswith((".warc", ".warc.gz")) else "zim" if path.endswith(".zim") else "dir"


def source(spark: SparkSession, path: str, kind: str | None = None, keys: Iterable[str] | str | None = None, limit: int | None = None) -> DataFrame:
    """(key, html, ...) of a source, by kind (dir, warc, zim) or by its name."""
    kind = kind or kind_of(path)
    if kind != "dir":
        return {"warc": warc, "zim": zim}[kind](spark, path, keys, limit)
    pages = _listed(spark, folder(spark, path, "relpath"), keys)
    return pages.orderBy("key").limit(limit) if limit is not None else pages


def tally(accepted: DataFrame, seen: DataFrame) -> DataFrame:
    """One row: pages seen, prepared, and collapsed into an earlier one with the same key."""
    rows = seen.select("key", F.lit(False).alias("own")).union(accepted.select("key", F.lit(True)))
    counts = rows.agg(F.count_if(~F.col("own")).alias("seen"), F.count_if("own").alias("prepared"), F.count_distinct(F.when(~F.col("own"), F.col("key"))).alias("distinct_keys"))
    return counts.withColumn("collapsed", F.col("seen") - F.col("distinct_keys"))


def open_any(spark: SparkSession, path: str) -> Corpus:
    """A written corpus, a folder of pages, or one page, told apart by what is there."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/CURRENT")):
        return Corpus.open(spark, path)
    if fs.getFileStatus(at).isDirectory():
        return parse_pages(folder(spark, path, "stem"))
    files = spark.read.format("binaryFile").load(path)
    own = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return parse_pages(_decoded(files.select(own.alias("key"), "content"), ["key"]))
