import math
import random
import re

from pyspark.sql import functions as F

from tagloom.llm import queries, toxicity

from .util import collected, documents, odd_rows


def marks(g, text):
    return [p for paths in g.clauses(text) for p, _, _ in paths]


def plainly_scored(g, text):
    """The score by its definition, from positions in clauses; no machine, no shared code but the grammar's numbers."""
    clauses = [re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)*|[\"“”„«»]", c) for c in re.split(r"[.!?;:\n|]", text.lower())]
    paths = []
    for at, words in enumerate(clauses):
        targets = any(w in toxicity.TARGET for w in words)
        for i, w in enumerate(words):
            before = words[: i + 1]
            marks = "n" * any(x in toxicity.NEGATION for x in before[-4:])
            marks += "t" * targets
            told = [j for j, x in enumerate(before) if x in toxicity.REPORTED]
            marks += "r" * (bool(told) or sum(x in '"“”„«»' for x in before) % 2)
            factor = {"n": 0.75, "t": 1.15, "r": 0.75}
            for stem in g.insults:
                if (w == stem[:-1] if stem[-1] == "$" else w.startswith(stem)):
                    paths.append((at, "I" + marks, stem, g.weights.get("I" + marks, 1) * math.prod(factor[m] for m in marks)))
            if w in toxicity.THREAT and targets:
                paths.append((at, "T" + marks, None, g.weights.get("T" + marks, 1) * math.prod(factor[m] for m in marks)))
    total = []
    for at in {p[0] for p in paths}:
        own = {}
        for _, _, stem, factor in (p for p in paths if p[0] == at):
            n = sum(p[2] == stem for p in paths)
            table = {1: 4.0} if stem is None else g.insults[stem]
            own[stem] = max(own.get(stem, 0), factor * max([w for k, w in table.items() if k <= n], default=0))
        if max(own.values()):
            total.append(0.9 * max(own.values()) + 0.1 * sum(own.values()))
    if not total:
        return g.base
    return max(g.base, 1 / (1 + math.exp(2.2 - max(total) - min(2, 0.1 * (sum(total) - max(total))))))


GRAMMAR = toxicity.Grammar({"idiot$": {1: 6.0}, "vequ": {2: 7.0, 3: 7.5}, "kil": {1: 3.2}, "no$": {2: 3.0}}, {"It": 1.1, "Inr": 0.4, "Ttr": 0.6})


def test_scores_against_their_definition():
    rng = random.Random(5)
    vocabulary = ["idiot", "idiots", "vequa", "vequi", "kill", "killer", "no", "not", "you", "said", '"', "“", "a", "fine", "day", "b's"]
    for _ in range(3000):
        words = [rng.choice(vocabulary) + rng.choice([" "] * 6 + [". ", "\n", ", ", " | "]) for _ in range(rng.randrange(24))]
        text = "".join(words)
        assert math.isclose(GRAMMAR.score(text), plainly_scored(GRAMMAR, text), rel_tol=1e-9), text


def test_query_scores_against_their_definition(spark):
    rows = odd_rows()
    docs = documents(spark, rows)
    got = sorted((str(r["doc_id"]), round(r["score"], 9)) for r in collected(toxicity.scored(docs, GRAMMAR)))
    want = sorted((str(r["doc_id"]), round(plainly_scored(GRAMMAR, r["text"] or ""), 9)) for r in docs.select("doc_id", "text").collect())
    assert got == want


def test_a_word_may_be_of_several_classes():
    assert sorted(marks(GRAMMAR, "kill you")) == ["It", "Tt"] and marks(GRAMMAR, "kill time") == ["I"]
    assert marks(GRAMMAR, "no idiot") == ["In", "In"]  # "no" is an insult here and still negates


def test_patterns_of_clauses():
    g = toxicity.Grammar({"idiot$": {1: 6.0}, "vequ": {2: 7.0}})
    assert marks(g, "You are an idiot. Fine day! They said: idiot") == ["It", "I"]
    assert marks(g, "he is not an idiot") == ["Int"]
    assert marks(g, "she said he is an idiot") == ["Itr"] and marks(g, 'the word "idiot" here') == ["Ir"]
    assert marks(g, "I will kill you") == ["Tt"] and marks(g, "kill time") == []
    assert marks(g, "idiots idiotic") == [] and marks(g, "VEQUAI x") == ["I"]
    plain, negated, reported = (g.score(x) for x in ("this idiot", "not this idiot", "wrote this idiot"))
    assert plain > negated and plain > reported and g.score("") == g.score("good day") == g.base
    assert g.score("vequa") == g.base and g.score("vequa, then vequi") > 0.9
    assert 0 <= g.score("idiot " * 500 + ". idiot" * 500) <= 1


def test_lexicon_takes_what_explains_toxic_documents(monkeypatch):
    """A word that comes along with an insult explains nothing; it enters, if at all, as a companion that is frequent enough by itself and no variant."""
    docs = [["loser$*1", "lose*1", "copied$*1"]] * 30 + [["loser$*1", "lose*1"]] * 20 + [["vequ*1", "vequ*2", "vequa$*1"]] * 25 + [["vequ*1", "vequ*2"]] * 15 + [["once$*1"]] * 2
    benign = {"lose*1": 9, "vequ*1": 300}
    names = sorted({f for d in docs for f in d})
    counts = [(f, sum(f in d for d in docs), benign.get(f, 0)) for f in names]
    own = [[names.index(f) for f in d] for d in docs]

    def chosen(companion):
        monkeypatch.setattr(toxicity, "COMPANION", companion)
        return {(s, n) for s, table in toxicity.lexicon(counts, own, len(docs), 900, 10).items() for n in table}

    assert chosen(math.inf) == {("loser$", 1), ("vequ", 2)}
    assert chosen(0.7) == {("loser$", 1), ("vequ", 2)}  # "copied" is in 30 documents, "loser" in 50
    assert chosen(0.5) == chosen(0.1) == {("loser$", 1), ("vequ", 2), ("copied$", 1)}
    assert len(toxicity.lexicon(counts, own, len(docs), 900, 1)) == 1 and toxicity.lexicon([], [], 0, 5, 3) == {}


def test_held_out(spark):
    sf_dir = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in collected(queries.op6_toxicity(spark, sf_dir))}
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    held = [(got[r["doc_id"]], r["toxic"]) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if got[r["doc_id"]]["held_out"]]
    hit = sum(p["predicted"] and t for p, t in held)
    assert hit / sum(t for _, t in held) > 0.75
    assert hit / max(1, sum(p["predicted"] for p, _ in held)) > 0.95
    assert all(0 <= p["score"] <= 1 and p["predicted"] == (p["score"] >= 0.3) for p in got.values())


def test_odd_rows_and_no_labels(spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (77, None), (4, 5)], "doc_id long, toxic int")
    docs = documents(spark, odd_rows())
    g = toxicity.learned(docs, labels, F.lit(True))
    rows = collected(toxicity.scored(docs, g))
    assert len(rows) == len(odd_rows()) and all(r["predicted"] == 0 for r in rows)
    assert collected(toxicity.scored(documents(spark, []), toxicity.learned(docs, labels.limit(0), F.lit(True)))) == []
    bad = toxicity.Grammar({"one$": {1: 9.0}})
    assert sorted(r["doc_id"] for r in collected(toxicity.scored(docs, bad)) if r["predicted"]) == [4, 5]
    left = toxicity.kept(docs, bad)
    assert left.columns == docs.columns and left.count() == len(odd_rows()) - 2
