"""Document fingerprints by winnowing: of every window of rolling k-gram hashes the least, rightmost of equal ones, with its position.

Any passage of `gram + window - 1` code points that two texts share gives both a common (hash, place in the passage).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM, WINDOW = 12, 48
_LOW = np.uint64(2**20 - 1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = 2**19


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64; the base is odd, so it has one."""
    ones = np.ones(n, np.uint64)
    up, down = ones.copy(), ones
    up[1:], down[1:] = _BASE, np.uint64(pow(int(_BASE), -1, 2**64))
    return np.cumprod(up), np.cumprod(down)


def rolled(x: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hashes of all runs of k values, modulo 2**64: each is a difference of two sums from the start, so k doesn't matter to the work."""
    up, down = _powers(1 << (len(x) - 1).bit_length())
    sums = np.cumsum(x * down[: len(x)])
    h = sums[k - 1 :].copy()
    h[1:] -= sums[: len(x) - k]
    h *= up[k - 1 : len(x)]
    return h


def winnow(text: str, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes and positions (code points) of the chosen k-grams. A text of fewer than `gram` code points is one gram; "" has none."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if not len(x):
        return np.empty(0, np.uint32), np.empty(0, np.uint32)
    k = min(gram, len(x))
    n = len(x) - k + 1
    found, places = [], []
    span = min(window, n)
    for at in range(0, n - span + 1, _BLOCK):
        m = min(_BLOCK + span - 1, n - at)  # hashes in this block: its windows start at its first _BLOCK places
        h = rolled(x[at : at + m + k - 1], k)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0x94D049BB133111EB)
        # Hash above, place from the right below: the least key is the least hash and, of equal ones, the rightmost.
        key = (h & ~_LOW) | (_LOW - np.arange(m, dtype=np.uint64))
        size = 1
        while size * 2 <= span:
            key = np.minimum(key[:-size], key[size:])
            size *= 2
        if size < span:
            key = np.minimum(key[: len(key) - (span - size)], key[span - size :])
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
        found.append((key >> np.uint64(32)).astype(np.uint32))
        places.append((_LOW - (key & _LOW)).astype(np.int64) + at)
    found, places = np.concatenate(found), np.concatenate(places)
    own = np.concatenate([[True], places[1:] != places[:-1]])
    return found[own], places[own].astype(np.uint32)


def as_string(fingerprint: tuple[np.ndarray, np.ndarray]) -> str:
    """16 hex digits for each chosen gram: hash, then position."""
    return np.stack(fingerprint, axis=1).astype(">u4").tobytes().hex()


def likeness(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> float:
    """Jaccard similarity of the chosen hashes, positions aside; 1 for two empty texts."""
    a, b = set(x[0].tolist()), set(y[0].tolist())
    return len(a & b) / len(a | b) if a or b else 1.0


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, positions array<long>, hashes array<long>, fingerprint). Null text: as "". Rows as in docs; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [winnow(x.as_py() or "", gram, window) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([p.tolist() for _, p in own], pa.list_(pa.int64())),
                    pa.array([h.tolist() for h, _ in own], pa.list_(pa.int64())),
                    pa.array([as_string(x) for x in own], pa.string()),
                ],
                names=["doc_id", "positions", "hashes", "fingerprint"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, positions array<long>, hashes array<long>, fingerprint string")


SAMPLE = 32  # ids that decide where a part ends


def _longs(values: list[int]) -> Column:
    """A constant array, however long."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>") if values else F.array().cast("array<long>")


def _beyond(cuts: list[int], x: Column) -> Column:
    """How many of some descending numbers are greater than x: first by every so many of them, then inside that stretch."""
    step = max(1, math.isqrt(len(cuts)))
    heads = F.size(F.filter(_longs(cuts[::step]), lambda c: c > x))
    stretch = F.slice(_longs(cuts), (F.greatest(heads, F.lit(1)) - 1) * step + 1, F.lit(step))
    return F.when(heads == 0, 0).otherwise((heads - 1) * step + F.size(F.filter(stretch, lambda c: c > x)))


def with_next(docs: DataFrame, parts: int) -> DataFrame:
    """docs(doc_id long, text) in descending doc_id, each part followed by the first row of the next: columns part, halo, doc_id, text.

    Parts are ranges of doc_id of about equal numbers of rows, cut by a sample of SAMPLE ids a part, chosen by a hash; so it
    doesn't matter how ids are spread, and the driver holds no more than that sample. A part is a task. Only the first row of each
    part travels twice. Null doc_ids come last.
    """
    ids = docs.select("doc_id")
    n = ids.count()
    sample = ids.where("doc_id is not null").where(F.pmod(F.xxhash64("doc_id"), F.lit(max(n, 1))) < SAMPLE * parts)
    cuts = sorted({r["doc_id"] for r in sample.distinct().collect()}, reverse=True)[SAMPLE::SAMPLE] if parts > 1 else []
    own = F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(_beyond(cuts, F.col("doc_id"))).cast("int")
    first = {r["part"]: r["m"] for r in ids.groupBy(own.alias("part")).agg(F.max("doc_id").alias("m")).collect()}  # a row a part
    there = sorted(first)
    before = dict(zip(there, [there[-1:], *([p] for p in there)], strict=False))
    none = len(cuts) + 1  # the part of null ids, whose rows all lead
    leads = F.when(F.col("part") == none, True).otherwise(F.col("doc_id") == F.element_at(_longs([first.get(p) or 0 for p in range(none)]), F.col("part") + 1))
    places = F.array(F.struct(F.col("part"), F.lit(False).alias("halo")))
    halo = F.array(F.struct(F.element_at(_longs([before.get(p, [0])[0] for p in range(none + 1)]), F.col("part") + 1).cast("int").alias("part"), F.lit(True).alias("halo")))
    rows = docs.select("doc_id", "text").withColumn("part", own).select("doc_id", "text", F.inline(F.when(leads, F.concat(places, halo)).otherwise(places)))
    return rows.repartitionById(len(cuts) + 2, "part").sortWithinPartitions("part", "halo", F.desc_nulls_last("doc_id"), F.xxhash64("text"))


def edited_pairs(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """docs(doc_id long, text) -> (doc_id, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next).

    A document's edited text has its last floor(n_chars / 3) code points replaced by the first as many, or all, of the next
    document's, in descending doc_id; after the last comes the first. Rows that share a doc_id follow each other by a hash of
    their text. Null text: as "". Null doc_ids come last, in one part. A table of one row: it is its own next. No rows: no rows. Other
    columns are ignored.
    """
    parts = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        last = None  # part, doc_id, text, fingerprint: waits for its next
        size = 0
        for batch in batches:
            for part, halo, doc_id, text in zip(*(batch.column(c) for c in ("part", "halo", "doc_id", "text")), strict=True):
                part, halo, doc_id, text = part.as_py(), halo.as_py(), doc_id.as_py(), text.as_py() or ""
                if halo and (last is None or last[0] != part):
                    continue  # the part has had its next
                own = winnow(text, gram, window)
                if last is not None and last[0] == part:
                    _, i, x, f = last
                    k = len(x) // 3
                    edited = x[: len(x) - k] + text[:k]
                    g = winnow(edited, gram, window)
                    made.append((i, len(x), edited, as_string(f), as_string(g), likeness(f, g), likeness(f, own)))
                    size += len(x)
                last = None if halo else (part, doc_id, text, own)
                if size > 2_000_000:
                    yield _rows(made)
                    made, size = [], 0
        yield _rows(made)

    schema = "doc_id long, n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return with_next(docs, parts).mapInArrow(run, schema)


def _rows(made: list[tuple]) -> pa.RecordBatch:
    names = ["doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in made], k) for i, k in enumerate(kinds)], names=names)
