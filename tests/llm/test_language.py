import numpy as np
from pyspark.sql import functions as F

from tagloom.llm import language, queries

from .util import collected, documents, odd_rows


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in collected(queries.op2_language_id(spark, sf_dir))}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text").collect()
    assert set(got) == {r["doc_id"] for r in docs}
    held = [r for r in docs if got[r["doc_id"]]["held_out"]]
    assert held and sum(got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) / len(held) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_odd_texts(spark):
    train = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), (None, "en"), ("le chat", None)])]
    frame = spark.createDataFrame(train, "doc_id long, text string, lang string")
    own = language.Classifier(language.prototypes(frame, F.lit(True)))
    assert own.names == ["de", "en"]
    rows = odd_rows()
    got = collected(language.predicted(documents(spark, rows), own))
    assert len(got) == len(rows)
    und = {r["doc_id"] for r in got if r["lang_pred"] == "und"}
    assert und == {1, 2, 3, -3} and all(r["score"] == 0 for r in got if r["lang_pred"] == "und")
    assert own.predict("und der hund")[0] == "de" and own.predict("and the dog")[0] == "en"
    assert own.predict("THE DOG")[1] == own.predict("the dog")[1]
    assert collected(language.predicted(documents(spark, []), own)) == []
    assert {r["doc_id"] for r in collected(language.kept(documents(spark, rows), own))} == {r[0] for r in rows} - und


def test_nothing_to_learn_from(spark):
    own = language.Classifier(language.prototypes(documents(spark, [(1, "x")]), F.lit(True)))
    assert own.predict("text")[0] == "und"


def test_vectors_are_bound_permuted_letters():
    e = language.Encoder()
    codes, counts = e.trigrams("ab")
    v = e.vector(codes, counts)
    want = 0
    for a, b, c in (("\0", "a", "b"), ("a", "b", "\0")):
        x, y, z = (e.third[0 if s == "\0" else ord(s) - 96].astype(int) for s in (a, b, c))
        want = want + language.np.roll(x, 2) * language.np.roll(y, 1) * z
    assert (v == want).all()


def test_texts_with_letters_stay_where_nothing_was_learned(spark):
    docs = documents(spark, odd_rows())
    left = language.kept(docs, language.Classifier(language.prototypes(docs, F.lit(True))))  # no lang is set
    assert left.columns == docs.columns and sorted(str(r["doc_id"]) for r in collected(left)) == sorted(str(i) for i, t in odd_rows() if t and any(c.isalpha() for c in t))


def test_predictions_against_brute_force(spark):
    """Trigram by trigram, letter by letter, in plain numbers."""
    texts = [("the cat sat on the mat and the dog", "en"), ("le chat est sur la table et le chien", "fr"), ("die Katze ist auf dem Tisch und der Hund", "de"), ("Was ist das? Ça va!", None), ("the le die", None), ("12 !", None), (None, None)]
    docs = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(texts)], "doc_id long, text string, lang string")
    first, second, third = (v.astype(int) for v in language.letter_vectors())
    table = language.letter_classes()

    def vector(text):
        said = [int(table[ord(c)]) for c in (text or "").lower()]
        if not any(said):
            return None
        seq = [0]
        for c in [*said, 0]:
            if c or seq[-1]:
                seq.append(c)
        return sum(first[a] * second[b] * third[c] for a, b, c in zip(seq, seq[1:], seq[2:], strict=False)).astype(float)

    unit = {x: vector(t) / np.linalg.norm(vector(t)) for t, x in texts if x}
    shared = sum(unit.values())
    shared /= np.linalg.norm(shared)
    own = {x: v - (v @ shared) * shared for x, v in unit.items()}
    got = {r["doc_id"]: r for r in collected(language.predicted(docs, language.Classifier(language.prototypes(docs, F.lit(True)))))}
    for i, (t, _) in enumerate(texts):
        v = vector(t)
        if v is None:
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        rest = v - (v @ shared) * shared
        cosines = {x: float(rest @ p / np.linalg.norm(rest) / np.linalg.norm(p)) for x, p in own.items()}
        best = max(cosines, key=cosines.get)
        assert got[i]["lang_pred"] == best and abs(got[i]["score"] - 1 / sum(np.exp(12 * (c - cosines[best])) for c in cosines.values())) < 1e-4
