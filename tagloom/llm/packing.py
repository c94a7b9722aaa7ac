"""Packing of tokenized documents into sequences of fixed capacity: large items in pairs, small ones best-fit in the gaps.

Only the number of pieces of each length matters to a packing, and there are at most `capacity` lengths. So the plan is made
on the driver from a histogram of at most `capacity` rows, whatever the corpus, and says which ranks among the pieces of
a length go to which sequences. Ranks are counted in two levels, so that no task holds all pieces of a common length.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import mapped, written

GPT_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_bpe(path: str):
    """text -> ids (numpy uint32) of a byte-level BPE tokenizer file, special strings taken as their ids.

    The file's vocabulary and merges run in tiktoken's engine, which merges by rank as that file's model does.
    """
    import tiktoken

    model = json.loads(open(path, encoding="utf-8").read())
    signs = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(c): c for c in signs} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in signs)}
    special = {t["content"]: t["id"] for t in model["added_tokens"]}
    ranks = {bytes(byte[c] for c in w): i for w, i in model["model"]["vocab"].items() if w not in special}
    engine = tiktoken.Encoding(path, pat_str=GPT_PATTERN, mergeable_ranks=ranks, special_tokens=special)
    names = tuple(special)

    def encode(text: str) -> np.ndarray:
        if any(x in text for x in names):
            return np.array(engine.encode(text, allowed_special="all"), np.uint32)
        return engine.encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)

    return encode


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document; the checksum is of the ids as little-endian unsigned 32-bit integers."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"

    def make():
        encode = byte_bpe(tokenizer)

        def each(batch: pa.RecordBatch) -> dict:
            doc, piece, start, length, crc = [], [], [], [], []
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.uint32(end_id)).astype("<u4")
                at, k, head = 0, 0, len(ids) % capacity or capacity
                while at < len(ids):
                    own = ids[at : at + (capacity if k else head)]
                    doc.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(len(own))
                    crc.append(zlib.crc32(own))
                    at, k = at + len(own), k + 1
            return {"doc_id": pa.array(doc, pa.int64()), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())}

        return each

    return mapped(docs.select("doc_id", "text"), schema, make)


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, number of sequences n, layers, first sequence, offset).

    A row holds n * layers ranks: rank r is the i-th, i = r - first rank, and goes to sequence `first sequence + i % n`, at
    `offset + i // n * length`. A group of equal gaps is left with less than half of its gap by any length that fills it, so it
    is filled 11 times at most for 2048 tokens, and the number of rows depends on the number of lengths alone.

    counts: pieces of each length. Lengths over a third of the capacity are large: at most two share a sequence, each largest
    one taking the largest partner that fits. Then smaller lengths, from the largest down, go to the tightest gaps that hold
    them. Groups of sequences with equal contents are handled as one, so the work depends on the number of lengths.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    used = dict.fromkeys(left, 0)
    rows: list[tuple[int, int, int, int, int, int]] = []
    made = 0
    gaps: list[int] = []  # sorted sizes of gaps
    bins: dict[int, list[tuple[int, int]]] = {}  # of a gap: (first sequence, number of sequences)

    def give(n: int, c: int, first: int, offset: int, layers: int = 1) -> None:
        rows.append((n, used[n], c, layers, first, offset))
        used[n] += c * layers
        left[n] -= c * layers

    def gap(size: int, first: int, c: int) -> None:
        if size and c:
            if size not in bins:
                bins[size] = []
                insort(gaps, size)
            bins[size].append((first, c))

    large = sorted(n for n in left if 3 * n > capacity)
    while large:
        n = large[-1]
        if not left[n]:
            large.pop()
            continue
        i = bisect_left(large, capacity - n + 1) - 1
        while i >= 0 and not (left[large[i]] - (large[i] == n) > 0):
            i -= 1
        partner = large[i] if i >= 0 else None
        if partner is None:
            c = left[n]
            give(n, c, made, 0)
            gap(capacity - n, made, c)
        else:
            c = left[n] // 2 if partner == n else min(left[n], left[partner])
            give(n, c, made, 0)
            give(partner, c, made, n)
            gap(capacity - n - partner, made, c)
        made += c
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            i = bisect_left(gaps, n)
            if i == len(gaps):
                gap(capacity, made, 1 + (left[n] - 1) // (capacity // n))
                made += 1 + (left[n] - 1) // (capacity // n)
                continue
            size = gaps[i]
            first, c = bins[size].pop()
            if not bins[size]:
                del bins[size]
                gaps.pop(i)
            each = size // n  # after one goes in, the rest of that gap is the tightest for the next
            full = min(c, left[n] // each)
            if full:
                give(n, full, first, capacity - size, each)
            gap(size - each * n, first, full)
            first, c = first + full, c - full
            if c and left[n] and left[n] < each:
                k = left[n]
                give(n, 1, first, capacity - size, k)
                gap(size - k * n, first, 1)
                first, c = first + 1, c - 1
            gap(size, first, c)
    return rows


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, bucket_rows: int = 100_000) -> DataFrame:
    """docs(doc_id long, text) -> (doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row a piece.

    A document is its ids and then end_id; longer ones than `capacity` are cut into pieces of that length, the first of which
    may be shorter. Every row of docs gives pieces, repeated rows and null doc_ids too; a null text is empty, one piece of
    end_id alone. Other columns are ignored; an empty table gives no rows. The tokenizer's path must be readable on executors.
    """
    pieces = written(pieces_of(docs, tokenizer, capacity, end_id))
    buckets = 1 + pieces.count() // bucket_rows
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(buckets)))
    sums = written(pieces.groupBy("length", "bucket").agg(F.count("*").alias("n")))
    counts = {r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    by_bucket = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("length", "bucket", F.coalesce(F.sum("n").over(by_bucket), F.lit(0)).alias("before"))
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = pieces.withColumn("rank", F.row_number().over(own) - 1).join(before, ["length", "bucket"])  # dealt by the window's keys already
    return in_sequences(ranked.withColumn("rank", F.col("rank") + F.col("before")), plan(counts, capacity), counts)


def in_sequences(ranked: DataFrame, rows: list[tuple[int, int, int, int, int, int]], counts: dict[int, int]) -> DataFrame:
    """ranked (pieces with their rank among those of a length) -> pieces with sequence_id and offset, where they are.

    The rows of the plan, in order of length and rank, cut the numbers from 0 to the number of pieces into intervals. A piece's
    interval is found by bisection, so it costs the same however many rows a length has.
    """
    lengths = np.array(sorted(counts), np.int64)
    base = np.cumsum([0] + [counts[n] for n in lengths.tolist()])
    table = np.array(sorted(rows), np.int64).reshape(-1, 6)
    starts = base[np.searchsorted(lengths, table[:, 0])] + table[:, 1]
    _, first, width, _, sequence, offset = table.T.copy()

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(starts, base[np.searchsorted(lengths, length)] + rank, side="right") - 1
            layer, i = np.divmod(rank - first[at], width[at])
            out = {c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
            return {**out, "sequence_id": pa.array(sequence[at] + i), "offset": pa.array(offset[at] + layer * length)}

        return each

    names = ("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return mapped(ranked.select(*names), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long", make)


def sequences(docs: DataFrame, placed: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """docs and the rows that pack() gave for them -> (sequence_id, ids array<long>): the packed sequences themselves.

    Texts are tokenized again, so that packing itself never holds or moves ids. doc_ids must be distinct.
    """
    own = placed.select("doc_id", F.struct("start", "length", "sequence_id", "offset").alias("p")).groupBy("doc_id").agg(F.collect_list("p").alias("places"))
    joined = docs.select("doc_id", "text").join(own, "doc_id")

    def make():
        encode = byte_bpe(tokenizer)

        def each(batch: pa.RecordBatch) -> dict:
            rows = []
            for text, places in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist(), strict=True):
                ids = [*encode(text or "").tolist(), end_id]
                rows += [(p["sequence_id"], p["offset"], ids[p["start"] : p["start"] + p["length"]]) for p in places]
            return {"sequence_id": pa.array([r[0] for r in rows], pa.int64()), "at": pa.array([r[1] for r in rows], pa.int64()), "ids": pa.array([r[2] for r in rows], pa.list_(pa.int64()))}

        return each

    parts = mapped(joined, "sequence_id long, at long, ids array<long>", make)
    every = F.sort_array(F.collect_list(F.struct("at", "ids")))
    return parts.groupBy("sequence_id").agg(F.flatten(F.transform(every, lambda x: x["ids"])).alias("ids"))
