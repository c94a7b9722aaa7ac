"""What the operators share: written intermediate tables, text access in Arrow batches, hashing."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_MADE: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where it is unset and all runs on this machine (tests), a folder of this process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="tagloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def written(df: DataFrame) -> DataFrame:
    """df, computed once and written as Parquet to the shared folder: its lineage is cut and any lost executor can read it again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tagloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _MADE.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._tagloom_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables of written() that no later result reads."""
    for table in tables:
        path = getattr(table, "_tagloom_path", None)
        for entry in [x for x in _MADE if x[1] == path]:
            _MADE.remove(entry)
            _delete(*entry)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


@atexit.register
def _clean() -> None:
    for spark, path in _MADE:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended; the folder's owner removes what is left
            return


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def named(names: Iterable[str]) -> list[Column]:
    """Columns by their whole names, dots and backticks included."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in names]


BITMAPS = 4096  # of 4 KB each: as many as a broadcast may hold


def among(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of docs whose doc_id is in ids(doc_id), exactly, and all others, those without a doc_id included.

    The ids are packed into bitmaps, a row of 4 KB for each run of 32,768 ids that has any. While there are few of those, they
    are broadcast and no row of docs moves; beyond BITMAPS rows are dealt by doc_id instead.
    """
    bucket, bits = free_name(docs, "id_bucket"), free_name(docs, "id_bits")
    packed = ids.where("doc_id is not null").groupBy(F.bitmap_bucket_number("doc_id").alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position("doc_id")).alias(bits))
    maps = written(packed)
    known, rest = docs.where("doc_id is not null"), docs.where("doc_id is null")
    if maps.count() > BITMAPS:
        own = ids.select("doc_id").distinct()
        return known.join(own, "doc_id", "left_semi"), known.join(own, "doc_id", "left_anti").union(rest)
    at = "bitmap_bit_position(doc_id)"
    held = F.expr(f"coalesce(conv(hex(substring({bits}, CAST({at} DIV 8 AS INT) + 1, 1)), 16, 10) & shiftleft(1, CAST({at} % 8 AS INT)) <> 0, false)")
    flagged = known.withColumn(bucket, F.bitmap_bucket_number("doc_id")).join(F.broadcast(maps), bucket, "left")
    return flagged.where(held).select(*named(docs.columns)), flagged.where(~held).select(*named(docs.columns)).union(rest)


def mapped(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], dict | None]]) -> DataFrame:
    """mapInArrow: make() runs once a task and returns the function from a batch to columns by name."""
    names = [f.split()[0] for f in _split_top(schema)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            columns = each(batch)
            if columns is not None:
                yield pa.RecordBatch.from_arrays([_array(columns[n]) for n in names], names=names)

    return df.mapInArrow(run, schema)


def _array(x):
    if isinstance(x, pa.ChunkedArray):
        return x.combine_chunks()
    return x if isinstance(x, pa.Array) else pa.array(x)


def _split_top(schema: str) -> list[str]:
    out, depth, last = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(schema[last:i].strip())
            last = i + 1
    return [*out, schema[last:].strip()]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finisher of 64-bit integers, so that sums of products become evenly spread hashes."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


class WordHashes(dict):
    """64-bit hash of each word; forgets all words when it holds `most`, so a task's memory is bounded."""

    def __init__(self, most: int = 400_000):
        from xxhash import xxh3_64_intdigest

        super().__init__()
        self._most, self._hash = most, xxh3_64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self._most:
            self.clear()
        self[word] = out = self._hash(word)
        return out
