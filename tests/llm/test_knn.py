import random

import numpy as np
from pyspark.sql import functions as F

from tagloom.llm import knn

from .util import collected


def brute(rows, k=5, every=5):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None for x in v):
            good[i] = min(good.get(i, v), v)
    out = []
    for q, x in good.items():
        if q % every == 0:
            best = sorted(((-int(np.dot(x, y)), i) for i, y in good.items() if i != q and len(y) == len(x)))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return sorted(out)


def asked(spark, rows, monkeypatch=None, **more):
    frame = spark.createDataFrame(rows, "vec_id long, v array<long>")
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in collected(knn.top_k(frame, F.col("vec_id") % 5 == 0, **more)))


def test_against_brute_force(spark):
    rng = random.Random(1)
    centres = [[rng.randrange(-99, 99) for _ in range(6)] for _ in range(9)]
    rows = [(i, [x + rng.randrange(-9, 9) for x in rng.choice(centres)]) for i in range(400)]
    rows += [(1000 + i, [7, 7, 7, 7, 7, 7]) for i in range(60)]  # one common vector: ties
    assert asked(spark, rows) == brute(rows)


def test_odd_vectors_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(knn, "ROWS", 16)
    monkeypatch.setattr(knn, "QUERIES", 4)
    rng = random.Random(2)
    rows = [(i, [rng.randrange(-5, 5) for _ in range(3)]) for i in range(120)]
    rows += [(5, [1, 2]), (200, None), (None, [1, 2, 3]), (205, [1, None, 2]), (210, [4, 4]), (211, [3, 3]), (215, []), (220, [9, 9, 9, 9]), (7, [0, 0, 0]), (7, [0, 0, 0])]
    assert asked(spark, rows) == brute(rows)
    assert asked(spark, []) == []
    assert asked(spark, [(5, [1])]) == []
    huge = [(i, [2**30 + i, -(2**29) * i]) for i in range(12)]
    assert asked(spark, huge) == brute(huge)


def test_scaling_and_what_takes_no_part(spark):
    rows = [(1, [0.5, -0.001]), (2, None), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, [None, 1.0])]
    got = collected(spark.createDataFrame(rows, "vec_id long, e array<float>").select("vec_id", knn.scaled(F.col("e")).alias("v")))
    assert [r["v"] for r in got] == [[128, -1], None, None, None, None]


def test_data_go_where_bounds_reach(spark, monkeypatch):
    """Far clusters: each part of queries gets the few cells near it, not all rows, though there are many parts."""
    monkeypatch.setattr(knn, "QUERIES", 8)
    rng = random.Random(5)
    rows = [(i, [(20_000 if j == i % 8 else 0) + rng.randrange(9) for j in range(8)]) for i in range(800)]
    copies = {}

    def counted(placed, sent, counts, real=knn.placements):
        out = real(placed, sent, counts)
        copies["rows"], copies["parts"] = out.count(), sent.select("part").distinct().count()
        return out

    monkeypatch.setattr(knn, "placements", counted)
    assert asked(spark, rows) == brute(rows)
    assert copies["parts"] >= 160 // 8 and copies["rows"] < len(rows) * copies["parts"] / 3


def test_each_pivot_reaches_the_driver_once(spark, monkeypatch):
    """Whatever the number of tasks: not as many pivots from every one of them."""
    conf = {"spark.sql.files.maxPartitionBytes": "64k", "spark.sql.files.openCostInBytes": "64k"}
    before, taken, cells = {k: spark.conf.get(k) for k in conf}, [], knn.Cells
    monkeypatch.setattr(knn, "Cells", lambda pivots: taken.append(pivots) or cells(pivots))
    v = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda j: F.pmod(F.xxhash64("id", j), F.lit(99)))
    frame = spark.range(0, 6400, 1, 32).select(F.col("id").alias("vec_id"), v.alias("v"))
    context = spark.sparkContext
    try:
        for k, x in conf.items():
            spark.conf.set(k, x)
        context.setJobGroup("pivots", "")
        knn.top_k(frame, F.col("vec_id") % 100 == 0)
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, x in before.items():
            spark.conf.set(k, x)
    lowest = frame.orderBy(F.xxhash64("vec_id"), "vec_id").limit(80).collect()
    assert sorted(taken[0]) == sorted(r["v"] for r in lowest)
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    store, tracker = context._jsc.sc().statusStore(), context.statusTracker()
    ran = [store.lastStageAttempt(s) for job in tracker.getJobIdsForGroup("pivots") for s in tracker.getJobInfo(job).stageIds]
    assert max(s.numTasks() for s in ran) >= 32 and max(s.resultSize() for s in ran) < 400_000  # 80 pivots are 45 KB


def test_links_of_queries_are_not_broadcast(spark):
    """However small their files: a few bytes there may be many rows in the driver."""
    rows = spark.createDataFrame([(i, [i, 7]) for i in range(50)], "vec_id long, v array<long>")
    plan = knn.top_k(rows, F.col("vec_id") % 5 == 0)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [query_id#" in plan and "BroadcastHashJoin [query_id#" not in plan


def test_parts_of_queries():
    cells = knn.Cells([[i * 10, 0] for i in range(1, 30)])
    own = knn.query_parts(cells, {(2, c): n for c, n in [(1, 10), (2, 4096), (3, 0), (4, 9000), (5, 7), (29, 1)]} | {(0, 0): 3})
    assert (2, 3) not in own and own[2, 4][1] == 3 and all(n == 1 for at, (_, n) in own.items() if at != (2, 4))
    spans = [set(range(first, first + n)) for at, (first, n) in own.items() if at in ((2, 4), (2, 2), (0, 0))]
    assert all(not a & b for i, a in enumerate(spans) for b in spans[:i])
