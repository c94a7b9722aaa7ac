"""Exact top-k search by inner product: a Voronoi join.

Pivots cut the vectors into cells. A summary of each cell, its radius and its vectors nearest the pivot, bounds the scores that
any query has there: q.p - |q| d <= q.x <= q.p + |q| d for x at distance d from pivot p. A query goes only to cells whose
upper bound reaches what the summaries already promise it, and a cell's data only to the parts of queries that it can matter to;
there they are solved locally, and local results are merged.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import mapped, written

ROWS, QUERIES = 8192, 4096  # of a cell's rows and of its queries, about so many meet in a task's memory at once
CHUNK = 256  # vectors that are held against all pivots at once


def scaled(vector: Column) -> Column:
    """floor(256 * x) of each component; null where the vector or a component is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    whole = F.transform(vector, lambda x: F.floor(256 * x.cast("double")))
    return F.when(vector.isNotNull() & ~bad, whole)


def _ints(column: pa.Array) -> list[np.ndarray]:
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy() - column.offsets[0].as_py()
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact integer products; in floating point where that can hold every partial sum."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * max(1, q.shape[1])
    if most < 2**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return np.array([(x * row).sum(axis=1) for row in q], np.int64).reshape(len(q), len(x))


class Cells:
    """Pivots by dimension; the null vector is one of each, so that every vector has a cell."""

    def __init__(self, pivots: list[list[int]]):
        self.pivots: dict[int, np.ndarray] = {}
        for d in {len(p) for p in pivots}:
            self.pivots[d] = np.array([[0] * d, *sorted({tuple(p) for p in pivots if len(p) == d})], np.float64)

    def of(self, dim: int) -> np.ndarray:
        return self.pivots.get(dim, np.zeros((1, dim)))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell of each row and an upper bound of its distance to the pivot."""
        p = self.of(x.shape[1])
        cell = np.concatenate([((p**2).sum(axis=1) - 2 * (x[at : at + CHUNK] @ p.T)).argmin(axis=1) for at in range(0, len(x), CHUNK)])
        return cell, np.sqrt(((x - p[cell]) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-6


def _by_dim(vectors: list[np.ndarray]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        out.setdefault(len(v), []).append(i)
    return out


def query_parts(cells: Cells, asked: dict[tuple[int, int], int]) -> dict[tuple[int, int], tuple[int, int]]:
    """(dimension, cell) -> (first part, number of parts) of the queries that lie in it; asked: queries by (dimension, cell).

    Parts hold about QUERIES queries of cells that are near each other, along the main axis of the pivots, so that they need much
    the same data; a cell with more queries than that has parts of its own.
    """
    out, part = {}, 0
    for d in sorted({d for d, _ in asked}):
        own = np.array([c for e, c in asked if e == d and asked[e, c]], np.int64)
        p = cells.of(d)[own]
        axis = np.linalg.svd(p - p.mean(axis=0), full_matrices=False)[2][0] if d and len(own) > 1 else np.zeros(d)
        room = 0
        for c in own[np.argsort(p @ axis, kind="stable")].tolist():
            n = asked[d, c]
            if n > QUERIES:
                many = -(-n // QUERIES)
                out[d, c], part, room = (part + 1, many), part + many, 0
                continue
            if n > room:
                part, room = part + 1, QUERIES
            out[d, c], room = (part, 1), room - n
        part += 1
    return out


def placements(placed: DataFrame, sent: DataFrame, counts: DataFrame) -> DataFrame:
    """(vec_id, v, dim, cell, block, part): each row once for each part of queries of which one at least may need its cell, and not at all if none does."""
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    need = sent.select("dim", "cell", "part").distinct().join(counts, ["dim", "cell"]).select("dim", "cell", "part", every)
    block = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col("blocks")).cast("int").alias("block")
    return placed.join(counts, ["dim", "cell"]).select("vec_id", "v", "dim", "cell", block).join(need, ["dim", "cell", "block"])


def pivots(once: DataFrame, n: int, m: int) -> DataFrame:
    """(v): the m rows of n whose ids hash lowest, in a table of their own.

    Collected straight from the sort, m rows of each task would go to the driver. Hashes are spread evenly, so a bound leaves few
    more than m rows to sort; should it leave fewer, there are fewer pivots, which no result depends on.
    """
    own = F.xxhash64("vec_id")
    bound = (m + 8 * math.isqrt(m) + 8 << 64) // max(n, 1) - 2**63
    few = once.where(own <= bound) if bound < 2**63 else once
    return written(few.orderBy(own, "vec_id").limit(m).select("v"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, most_pivots: int = 4096) -> DataFrame:
    """vectors(vec_id long, v array<long>) -> (query_id, rank, vec_id, score): each query's k highest inner products, ties to the lesser vec_id.

    Queries are rows of vectors too and don't meet themselves. Null ids and null vectors, or with a null component, take no
    part; rows that share a vec_id count once, with the least vector. Vectors of different length don't meet. Fewer than k others: all of them. No rows:
    no rows. Products must fit 64 bits. Pivots are sqrt(rows) rows, `most_pivots` at most, picked by a hash of their ids, so what the
    driver and every task hold of pivots and summaries is bounded by most_pivots * k.
    """
    able = vectors.where("vec_id is not null and v is not null and not exists(v, x -> x is null)")
    once = written(able.groupBy("vec_id").agg(F.min("v").alias("v")))
    n = once.count()
    cells = Cells([r["v"] for r in pivots(once, n, max(1, min(most_pivots, math.isqrt(n)))).collect()])

    def placing():
        def each(batch: pa.RecordBatch) -> dict:
            own = _ints(batch.column("v"))
            cell, far = np.zeros(len(own), np.int32), np.zeros(len(own))
            for rows in _by_dim(own).values():
                cell[rows], far[rows] = cells.nearest(np.array([own[i] for i in rows], np.float64))
            return {"vec_id": batch.column("vec_id"), "v": batch.column("v"), "dim": pa.array([len(x) for x in own], pa.int32()), "cell": pa.array(cell), "far": pa.array(far)}

        return each

    placed = written(mapped(once, "vec_id long, v array<long>, dim int, cell int, far double", placing))
    order = Window.partitionBy("dim", "cell", "salt").orderBy("far", "vec_id")
    # The k + 1 nearest to each pivot, first within salted parts of a cell: one row of those may be the query itself.
    near = placed.select("dim", "cell", "far", "vec_id", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt")).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    summary = near.groupBy("dim", "cell").agg(F.slice(F.sort_array(F.collect_list("far")), 1, k + 1).alias("nearest"))
    sizes = placed.groupBy("dim", "cell").agg(F.max("far").alias("radius"), F.count("*").alias("n"), F.count_if(is_query).alias("q"))
    table = {(r["dim"], r["cell"]): r for r in sizes.join(summary, ["dim", "cell"]).collect()}  # a row a cell
    parts = query_parts(cells, {at: r["q"] for at, r in table.items()})
    own_cells = {d: np.array(sorted(c for e, c in table if e == d)) for d in {d for d, _ in table}}
    radius = {d: np.array([table[d, c]["radius"] for c in cs]) for d, cs in own_cells.items()}
    promised = {d: (np.repeat(np.arange(len(cs)), [len(table[d, c]["nearest"]) for c in cs]), np.concatenate([table[d, c]["nearest"] for c in cs])) for d, cs in own_cells.items()}
    blocks = {d: np.array([-(-table[d, c]["n"] // ROWS) for c in cs]) for d, cs in own_cells.items()}

    def sending():
        def each(batch: pa.RecordBatch) -> dict:
            own, ids, home = _ints(batch.column("v")), batch.column("vec_id").to_pylist(), batch.column("cell").to_pylist()
            row, to = [], []
            for d, every in _by_dim(own).items():
                at, far = promised[d]
                for lo in range(0, len(every), CHUNK):
                    rows = every[lo : lo + CHUNK]
                    q = np.array([own[i] for i in rows], np.float64)
                    to_pivot, size = q @ cells.of(d)[own_cells[d]].T, np.sqrt((q**2).sum(axis=1))[:, None] * (1 + 1e-9)
                    least = to_pivot[:, at] - size * far
                    m = least.shape[1] - k - 1  # the k + 1 best promises leave k without the query
                    bar = np.partition(least, m, axis=1)[:, m] if m >= 0 else np.full(len(q), -np.inf)
                    slack = 1e-3 + 1e-9 * (size[:, 0] + 1) * (np.abs(to_pivot).max(axis=1) + 1)
                    i, c = np.nonzero(to_pivot + size * radius[d] >= (bar - slack)[:, None])
                    row += [rows[x] for x in i.tolist()]
                    to += own_cells[d][c].tolist()
            part = []
            for i in row:
                first, n = parts[len(own[i]), home[i]]
                part.append(first + (ids[i] * 0x9E3779B97F4A7C15 >> 20) % n)
            return {"query_id": pa.array([ids[i] for i in row], pa.int64()), "dim": pa.array([len(own[i]) for i in row], pa.int32()), "cell": pa.array(to, pa.int32()), "part": pa.array(part, pa.int32())}

        return each

    asking = placed.where(is_query)
    sent = written(mapped(asking.select("vec_id", "v", "cell"), "query_id long, dim int, cell int, part int", sending))
    rows = [(d, int(c), int(b)) for d, cs in own_cells.items() for c, b in zip(cs, blocks[d], strict=True)] or [(0, 0, 1)]
    counts = F.broadcast(placed.sparkSession.createDataFrame(rows, "dim int, cell int, blocks int"))  # a row a cell
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    # Merged: `sent` packs so well on disk that its files' size would let far too many rows be broadcast through the driver.
    queries = sent.hint("merge").join(asking.select(F.col("vec_id").alias("query_id"), "v"), "query_id").join(counts, ["dim", "cell"]).select("query_id", "v", "dim", "cell", "part", every)
    queries = queries.toDF(*queries.columns)  # columns of its own: both sides come from the same tables
    data = placements(placed, sent, counts).toDF("dim", "cell", "block", "vec_id", "v", "part")

    def solve(left, right):
        ids, x = right.column("vec_id").to_numpy(), right.column("v").combine_chunks()
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            x = np.array(_ints(x)).reshape(len(ids), -1)
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], x[order]
            names, q = left.column("query_id").to_pylist(), np.array(_ints(left.column("v").combine_chunks())).reshape(left.num_rows, -1)
            for at in range(0, len(names), 256):
                scores = _scores(q[at : at + 256], x)
                for name, s in zip(names[at : at + 256], scores, strict=True):
                    m = min(k + 1, len(s))
                    bar = np.partition(s, len(s) - m)[len(s) - m]
                    good = np.nonzero(s >= bar)[0]
                    best = good[np.argsort(-s[good], kind="stable")][: k + 1]  # ids ascend, so ties go to the lesser one
                    out += [(name, int(ids[j]), int(s[j])) for j in best if ids[j] != name][:k]
        return pa.table({n: pa.array([r[i] for r in out], pa.int64()) for i, n in enumerate(("query_id", "vec_id", "score"))})

    keys = ["dim", "cell", "block", "part"]
    local = queries.groupBy(*keys).cogroup(data.groupBy(*keys)).applyInArrow(solve, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(d.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id % 50 = 0 AND q.vec_id <> d.vec_id
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 5
"""
