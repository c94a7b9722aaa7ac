import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tagloom.llm import packing, queries

from .util import BYTE_BPE, collected, documents, odd_rows

THEIRS = Tokenizer.from_file(BYTE_BPE)


def check(rows, got, capacity):
    """Pieces are those of the documents, and each sequence is gapless and no longer than the capacity."""
    want = []
    for i, t in rows:
        ids = np.array([*THEIRS.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at, k, size = 0, 0, len(ids) % capacity or capacity
        while at < len(ids):
            own = ids[at : at + size]
            want.append((i, k, at, len(own), zlib.crc32(own.tobytes())))
            at, k, size = at + size, k + 1, capacity
    assert sorted([tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got], key=str) == sorted(want, key=str)
    filled = defaultdict(list)
    for r in got:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in filled.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(filled)


def test_query(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = collected(queries.op9_packing(spark, sf_dir))
    n = check(rows, got, 2048)
    assert n <= 1.02 * -(-sum(r["length"] for r in got) // 2048) + 1


def test_odd_rows_in_many_buckets(spark):
    rows = odd_rows() + [(100 + i, "tok " * (i % 40)) for i in range(200)] + [(999, "<|endoftext|> a<|endoftext|>")]
    check(rows, collected(packing.pack(documents(spark, rows), BYTE_BPE, capacity=64, bucket_rows=50)), 64)
    assert collected(packing.pack(documents(spark, []), BYTE_BPE)) == []


def test_sequences(spark):
    rows = [(i, "some words " * i) for i in range(30)]
    placed = packing.pack(documents(spark, rows), BYTE_BPE, capacity=48)
    own = collected(packing.sequences(documents(spark, rows), placed, BYTE_BPE, capacity=48))
    every = sorted(x for r in own for x in r["ids"])
    assert every == sorted(x for _, t in rows for x in [*THEIRS.encode(t, add_special_tokens=False).ids, 0]) and max(len(r["ids"]) for r in own) <= 48


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 30), max_size=30))
def test_plan_places_every_rank_once(counts):
    placed, bins = defaultdict(set), defaultdict(list)
    for length, first, n, layers, sequence, offset in packing.plan(counts, 60):
        for k in range(n * layers):
            assert first + k not in placed[length]
            placed[length].add(first + k)
            bins[sequence + k % n].append((offset + k // n * length, length))
    assert {n: len(x) for n, x in placed.items()} == counts
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 60 and sum(3 * n > 60 for _, n in own) <= 2


def test_plan_is_close_to_the_bound():
    rng = random.Random(1)
    counts = defaultdict(int)
    for _ in range(20_000):
        counts[min(2048, int(rng.lognormvariate(6.3, 1)) + 1)] += 1
    total = sum(n * c for n, c in counts.items())
    rows = packing.plan(counts, 2048)
    assert 1 + max(s + n - 1 for _, _, n, _, s, _ in rows) <= 1.005 * total / 2048 + 1
    more = packing.plan({n: 100_000 * c for n, c in counts.items()}, 2048)
    assert len(rows) < 24 * len(counts) and len(more) < 24 * len(counts)  # whatever the number of pieces


@pytest.mark.parametrize("text", ["", "x", " leading", "tabs\t\t\n\n  end  ", "😀é́", "<|endoftext|>", "a<|endoftext|>b <|endo", "don't I'LL 12 345  6", "\x1c\x85\xa0 "])
def test_ids_as_the_library(text):
    assert packing.byte_bpe(BYTE_BPE)(text).tolist() == THEIRS.encode(text, add_special_tokens=False).ids
