import re

from tagloom.llm import licenses, queries

from .util import collected, documents, odd_rows


def brute(text):
    w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    at, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        own = [i for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
        at += own
        labels |= {label} if own else set()
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


COLUMNS = ("n_words", "n_base", "first_word", "last_word", "base_labels")


def test_query_against_brute_force(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in collected(queries.op10_licenses(spark, sf_dir))}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        own = got[r["doc_id"]]
        assert tuple(own[c] for c in COLUMNS) == brute(r["text"])
        assert set(filter(None, own["base_labels"].split(","))) <= set(filter(None, own["labels"].split(",")))


def test_phrases_and_notices(spark):
    texts = [
        "the MIT license, mit-LICENSE; Apache license version 2.0", "CC BY-NC-SA 4.0", "gnu general public license gnu general public license", "mit licenses cc  by", "Apache licenseé",
        "Permission is hereby granted, free of charge, to any person who is obtaining a copy of this software and associated documentation files",
        "free of charge to any person", "", "!!!", "license", "cc cc by by", "x " * 5000 + "cc by",
    ]
    got = {r["doc_id"]: r for r in collected(licenses.scan(documents(spark, list(enumerate(texts)))))}
    assert all(tuple(got[i][c] for c in COLUMNS) == brute(t) for i, t in enumerate(texts))
    assert got[0]["labels"] == "apache,apache-2.0,mit" and got[1]["labels"] == "cc-by,cc-by-nc,cc-by-nc-sa" and got[5]["labels"] == "mit" and got[5]["base_labels"] == ""
    assert 0.8 <= got[5]["score"] < 1 and got[6]["labels"] == "" and got[6]["score"] == 0 and got[2]["n_base"] == 2


def test_odd_rows(spark):
    got = collected(licenses.scan(documents(spark, odd_rows())))
    assert sorted([(r["doc_id"], *(r[c] for c in COLUMNS)) for r in got], key=str) == sorted([(i, *brute(t)) for i, t in odd_rows()], key=str)
    assert collected(licenses.scan(documents(spark, []))) == []


def test_names_that_are_repeated_and_long_texts(spark, monkeypatch):
    """A label doesn't get lost where its name is repeated, nor at the seams of a text that is split in stretches."""
    texts = ["isc license " * n for n in range(1, 6)] + ["bsd license " * 4 + "mozilla public license " * 3, "cc by cc by cc by nc", "BSD license of bsd license", "isc. x license", "mozilla " * 9 + "public license"]
    want = [("isc", 1.0)] * 5 + [("bsd,mpl", 1.0), ("cc-by,cc-by-nc", 1.0), ("bsd", 1.0), ("", 0.0), ("mpl", 1.0)]
    for stretch in (1 << 22, 7):
        monkeypatch.setattr(licenses, "STRETCH", stretch)
        got = {r["doc_id"]: r for r in collected(licenses.scan(documents(spark, list(enumerate(texts)))))}
        assert [(got[i]["labels"], got[i]["score"]) for i in range(len(texts))] == want
        assert all(tuple(got[i][c] for c in COLUMNS) == brute(t) for i, t in enumerate(texts))
