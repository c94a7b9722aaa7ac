import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tagloom.llm import queries
from tagloom.llm.winnowing import _BASE, _beyond, as_string, edited_pairs, fingerprints, likeness, rolled, winnow, with_next

from .util import collected, documents, odd_rows


def brute(text, gram, window):
    """Chosen (hash, place) by definition, from the operator's hashes of single grams."""
    if not text:
        return []
    k = min(gram, len(text))
    keys = [int(winnow(text[i : i + k], k, 1)[0][0]) for i in range(len(text) - k + 1)]
    out = []
    for a in range(max(1, len(keys) - window + 1)):
        own = range(a, min(a + window, len(keys)))
        best = max(own, key=lambda i: (-keys[i], i))
        if not out or out[-1] != best:
            out.append(best)
    return sorted({(keys[i], i) for i in out}, key=lambda x: x[1])


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab é😀", max_size=80), st.integers(1, 6), st.integers(1, 9))
def test_winnow_is_the_rightmost_least_of_each_window(text, gram, window):
    h, p = winnow(text, gram, window)
    assert list(zip(h.tolist(), p.tolist(), strict=True)) == brute(text, gram, window)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 0x10FFFF), min_size=1, max_size=70), st.integers(1, 20))
def test_rolled_hashes_are_those_of_each_run(values, k):
    k = min(k, len(values))
    want = [sum(v * int(_BASE) ** (k - 1 - j) for j, v in enumerate(values[i : i + k])) % 2**64 for i in range(len(values) - k + 1)]
    assert rolled(np.array(values, np.uint64), k).tolist() == want


@settings(max_examples=40, deadline=None)
@given(st.text(alphabet="abcdefg ", min_size=30, max_size=60), st.text(max_size=30), st.text(max_size=30))
def test_shared_passages_are_always_seen(shared, before, after):
    x, y = winnow(shared, 8, 12), winnow(before + shared + after, 8, 12)
    assert set(x[0].tolist()) & set(y[0].tolist())  # 30 code points are more than gram + window - 1


def test_long_texts_in_blocks_are_as_in_one(monkeypatch):
    from tagloom.llm import winnowing

    text = "".join(chr(97 + i * i % 23) for i in range(5000))
    whole = winnow(text)
    monkeypatch.setattr(winnowing, "_BLOCK", 256)
    assert as_string(winnow(text)) == as_string(whole)


def expected(rows):
    own = sorted(((i, t or "") for i, t in rows), key=lambda r: r[0] if r[0] is not None else -(2**70), reverse=True)
    out = []
    for a, (i, x) in enumerate(own):
        following = own[(a + 1) % len(own)][1]
        k = len(x) // 3
        edited = x[: len(x) - k] + following[:k]
        out.append((i, len(x), edited, as_string(winnow(x)), likeness(winnow(x), winnow(edited)), likeness(winnow(x), winnow(following))))
    return out


def key(r):
    return str(r)


def test_edited_pairs_follow_ids_downwards(spark):
    rows = odd_rows()
    got = [(r["doc_id"], r["n_chars"], r["edited"], r["fingerprint"], r["near_edited"], r["near_next"]) for r in collected(edited_pairs(documents(spark, rows)))]
    assert sorted(got, key=key) == sorted(expected(rows), key=key)


def test_sparse_ids_and_edges(spark):
    rows = [(i * i * i * 1_000_003 - 10**12, f"text {i} " * 9) for i in range(150)]
    got = [(r["doc_id"], r["n_chars"], r["edited"], r["fingerprint"], r["near_edited"], r["near_next"]) for r in collected(edited_pairs(documents(spark, rows)))]
    assert sorted(got) == sorted(expected(rows))
    assert collected(edited_pairs(documents(spark, []))) == []
    alone = collected(edited_pairs(documents(spark, [(1, "abcdef")])))
    assert [(r["edited"], r["near_next"]) for r in alone] == [("abcdab", 1.0)]


def test_parts_are_even_however_ids_are_spread(spark):
    rows = [(i, "x") for i in range(3000)] + [(2**62 + i, "y") for i in range(300)] + [(-(2**62), "z"), (None, "n")]
    got = with_next(documents(spark, rows, extra=False), 10)
    sizes = {r["part"]: r["count"] for r in got.where("not halo").groupBy("part").count().collect()}
    assert sum(sizes.values()) == len(rows) and len(sizes) >= 9 and max(sizes.values()) < 3 * len(rows) / 10
    assert got.where("halo").count() == len(sizes) and got.where("not halo and text = 'y'").select("part").distinct().count() <= 3


def test_place_among_cuts(spark):
    cuts = [90, 70, 50, 30, 10, -5, -(2**63)]
    frame = spark.createDataFrame([(x,) for x in (2**63 - 1, 90, 89, 70, 31, 30, 0, -5, -6, -(2**63))], "x long")
    for some in (cuts, cuts[:1], []):
        assert [r["k"] for r in frame.select("x", _beyond(some, F.col("x")).alias("k")).collect()] == [sum(c > r["x"] for c in some) for r in frame.collect()]


def test_fingerprints_keep_positions(spark):
    rows = collected(fingerprints(documents(spark, [(1, "x" * 5 + "hello world, hello moon"), (2, None)])))
    assert rows[1]["positions"] == [] and rows[1]["fingerprint"] == ""
    assert len(rows[0]["positions"]) == len(rows[0]["hashes"]) == len(rows[0]["fingerprint"]) // 16


def test_query_against_brute_force(spark, sf_dir):
    got = collected(queries.op1_winnowing(spark, sf_dir))
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = {i: (n, hashlib.sha256(e.encode()).hexdigest(), f, a, b) for i, n, e, f, a, b in expected(docs)}
    assert {r["doc_id"]: (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["near_edited"], r["near_next"]) for r in got} == want
    assert np.mean([r["near_edited"] for r in got]) > np.mean([r["near_next"] for r in got]) + 0.2
