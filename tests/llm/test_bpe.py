import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tagloom.llm import bpe, queries

from .util import WORD_BPE, collected, documents, odd_rows

OURS, THEIRS = bpe.WordBpe(WORD_BPE), Tokenizer.from_file(WORD_BPE)


def theirs(text):
    ids = THEIRS.encode(text or "", add_special_tokens=False).ids
    return ids, THEIRS.decode(ids, skip_special_tokens=False)


def ours(texts, tool=OURS):
    return [(np.frombuffer(i, "<u4").tolist(), d.decode()) for i, d in tool.encode_batch(texts)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from("aàbΣςİß' 1½\n\t\x1c\u0085　.<|>-́é日😀"), st.characters(max_codepoint=0x24F, exclude_categories=["Cs"])), max_size=30), min_size=1, max_size=4))
def test_as_the_library(texts):
    assert ours(texts) == [theirs(t) for t in texts]


def test_special_and_long_words():
    texts = ["<|endoftext|>x<|startoftext|> Hi<|endoftext|", "a" * 700 + " " + "thequick" * 300, "", " \n ", "don''t 'S we'LL"]
    assert ours(texts) == [theirs(t) for t in texts]


def test_one_word_and_many_words_agree_with_plain_merging():
    rng = random.Random(2)
    pairs = {(int(k) >> 20, int(k) & (2**20 - 1)): int(r) for k, r in zip(OURS.keys, OURS.ranks, strict=True)}
    for _ in range(60):
        raw = np.frombuffer("".join(rng.choices("thenrasio", k=rng.randrange(1, 33))).encode(), np.uint8)
        ids = OURS.inner[raw]
        ids[-1] = OURS.last[raw[-1]]
        plain = ids.tolist()
        while ranks := [pairs.get(p, 10**9) for p in zip(plain, plain[1:], strict=False)]:
            if min(ranks) == 10**9:
                break
            i = ranks.index(min(ranks))
            plain[i : i + 2] = [int(OURS.merged[ranks[i]])]
        assert OURS.merge_one(ids.tolist()) == plain
        assert OURS.merge_many([ids], 32)[0].tolist() == plain


def test_forgetting_pieces_changes_nothing():
    small = bpe.WordBpe(WORD_BPE, most=3)
    texts = [f"word{i % 7} thing{i % 5}, Other" for i in range(40)]
    assert [x for t in texts for x in ours([t], small)] == [theirs(t) for t in texts]


def test_query_and_odd_rows(spark, sf_dir):
    got = {r["doc_id"]: r for r in collected(queries.op7_bpe(spark, sf_dir))}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids, said = theirs(r["text"])
        own = got[r["doc_id"]]
        assert own["n_tokens"] == len(ids) and own["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert own["decoded_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    rows = odd_rows()
    got = collected(bpe.encoded(documents(spark, rows), WORD_BPE))
    key = str
    want = [(i, *theirs(t)) for i, t in rows]
    assert sorted([(r["doc_id"], np.frombuffer(r["ids"], "<u4").tolist(), r["decoded"]) for r in got], key=key) == sorted(want, key=key)
    assert collected(bpe.encoded(documents(spark, []), WORD_BPE)) == []
