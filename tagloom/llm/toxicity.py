"""Toxicity by a weighted finite-state grammar over clauses: insult, threat, target, negation and reported-speech transducers.

Learned from labelled rows: the insult lexicon (words and word beginnings with their log-odds) and the weight of each pattern
that the composed transducers can accept. Fixed: the closed word classes below and the machines themselves.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import mapped

NEGATION = frozenset("not no never neither nor isn't aren't wasn't don't doesn't ain't ne pas jamais non nicht kein keine keinen nie niemals nunca jamás tampoco ni".split())
TARGET = frozenset("you your you're yourself he she they him her them his their this that these those tu toi vous votre ton ta il elle ils elles du dich dir dein deine sie ihr er tú ti usted ustedes vosotros él ella ellos ellas".split())
REPORTED = frozenset("said says say wrote writes told called quoted claimed reportedly allegedly dit disait écrit sagte sagt schrieb nannte dijo dice escribió llamó".split())
THREAT = frozenset("kill hurt stab shoot destroy murder beat strangle tuer tuerai frapper töten umbringen schlagen matar mataré matarte golpear".split())
QUOTES = frozenset("\"“”„«»")
CLAUSE = re.compile(r"[.!?;:\n|]+")
WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)*|[\"“”„«»]")
LETTERS = re.compile(r"[^\W\d_]+")
REACH = 4  # tokens over which a negation carries
LONGEST = 8  # letters of a word beginning in the lexicon

# Weight, as a factor of the insult's own, that a pattern has before any label is seen: negated and reported insults say less, aimed ones more.
PRIOR = {"n": 0.75, "t": 1.15, "r": 0.75}  # by mark
PRIOR_DOCS = 4.0
PRIOR_ODDS = -2.2  # log-odds of a toxic document before any evidence
THREAT_WEIGHT = 4.0
LEAST_WEIGHT = 3.0
COMPANION = 0.1  # of the most frequent chosen feature's documents: as many has a feature that enters beside the chosen ones
REPEATS = 3  # a stem may have to stand up to so many times to say something


def features(text: str) -> list[str]:
    """stem*n for each word, ended by $, and word beginning of a text, for each n up to REPEATS that it stands there at least as often."""
    count: Counter[str] = Counter()
    for w, c in Counter(LETTERS.findall(text.lower())).items():
        for k in range(2, min(len(w), LONGEST) + 1):
            count[w[:k]] += c
        count[w + "$"] += c
    return [f"{stem}*{n}" for stem, c in count.items() for n in range(1, min(c, REPEATS) + 1)]


def weight_of(t: int, b: int, toxic: int, benign: int) -> float:
    return math.log((t + 0.5) / (toxic + 1)) - math.log((b + 0.5) / (benign + 1))


def lexicon(counts: list[tuple[str, int, int]], toxic: list[list[int]], n_toxic: int, n_benign: int, most: int) -> dict[str, dict[int, float]]:
    """stem -> number of times -> weight, at most `most` features; counts: (feature, toxic documents, other documents).

    toxic: of each toxic document, the places in counts of the features it has. Features are chosen greedily, each for the toxic
    documents that none chosen before explains; so words that only come along with an insult explain nothing. A feature enters if
    its excess among those documents is beyond chance for so many candidates. Then companions enter: no variants of the chosen
    ones, and in at least COMPANION of the documents of the most frequent one. A document may hold one of those alone.
    """
    if not counts or not n_toxic:
        return {}
    share, bar = n_toxic / (n_toxic + n_benign), math.log(len(counts)) + 4
    owner = np.repeat(np.arange(len(toxic)), [len(x) for x in toxic])
    feature = np.concatenate([np.asarray(x, np.int64) for x in toxic]) if toxic else np.empty(0, np.int64)
    order = np.argsort(feature, kind="stable")
    starts = np.searchsorted(feature[order], np.arange(len(counts) + 1))
    left = np.bincount(feature, minlength=len(counts)).astype(np.float64)
    b = np.array([x[2] for x in counts], np.float64)
    heavy = np.array([weight_of(t, o, n_toxic, n_benign) >= LEAST_WEIGHT for _, t, o in counts])
    tie = np.array([(len(f) - 2 * int(f[-1]) * LONGEST) * 1e-6 for f, _, _ in counts])  # of equal ones the least times, then the longest stem
    open_ = np.ones(len(toxic), bool)
    out: dict[str, dict[int, float]] = {}
    for _ in range(most):
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = left * np.log(left / ((left + b) * share)) + np.where(b > 0, b * np.log(b / ((left + b) * (1 - share))), 0)
        gain = np.where(heavy & (left > b), np.nan_to_num(gain, nan=-1), -1)
        k = int(np.argmax(gain + tie))
        if gain[k] < bar:
            break
        stem, _, n = counts[k][0].rpartition("*")
        out.setdefault(stem, {})[int(n)] = weight_of(counts[k][1], counts[k][2], n_toxic, n_benign)
        heavy[k] = False
        docs = owner[order[starts[k] : starts[k + 1]]]
        docs = docs[open_[docs]]
        open_[docs] = False
        gone = np.isin(owner, docs)
        left -= np.bincount(feature[gone], minlength=len(counts))
    # Then those that would do as well on their own: nearly as frequent as the chosen ones, and no variants of them.
    total = np.array([x[1] for x in counts], np.float64)
    least = COMPANION * max((t for f, t, _ in counts if int(f[-1]) in out.get(f[:-2], ())), default=math.inf)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = total * np.log(total / ((total + b) * share)) + np.where(b > 0, b * np.log(b / ((total + b) * (1 - share))), 0)
    weights = {k: weight_of(counts[k][1], counts[k][2], n_toxic, n_benign) for k in np.nonzero(heavy & (gain >= bar) & (total >= least))[0].tolist()}
    taken = len([n for table in out.values() for n in table])
    for k in sorted(weights, key=lambda k: (-round(weights[k], 1), -tie[k], counts[k][0])):
        stem, _, n = counts[k][0].rpartition("*")
        if taken < most and not any(stem.startswith(x.rstrip("$")) or x.startswith(stem.rstrip("$")) for x in out):
            out[stem] = {int(n): weights[k]}
            taken += 1
    return out


class Transducer(NamedTuple):
    """A finite-state machine over a tape of symbol sets. From a state, the first of `reads` at a place has a move; without one, `other` tells the next state.

    A place where the machine then is in a state above 0 gets `mark`, at places that hold `only` if that is set.
    """

    mark: str
    reads: str
    moves: dict[tuple[int, str], int]
    other: tuple[int, ...]
    only: str = ""

    def run(self, tape: list[str], back: bool = False) -> list[str]:
        """The tape with marks added; back: read from its end."""
        state, out = 0, []
        for place in reversed(tape) if back else tape:
            symbol = next((x for x in self.reads if x in place), "")
            state = self.moves.get((state, symbol), self.other[state])
            out.append(place + self.mark if state and self.mark not in place and (not self.only or self.only in place) else place)
        return out[::-1] if back else out


# Symbols are upper-case: I insult, T threat, Y target, N negation, R reporting verb, Q quotation mark. Marks are lower-case.
NEGATED = Transducer("n", "N", {(s, "N"): REACH for s in range(REACH + 1)}, (0, *range(REACH)))
SPOKEN = Transducer("r", "RQ", {(0, "R"): 2, (1, "R"): 2, (0, "Q"): 1, (1, "Q"): 0}, (0, 1, 2))
AIMED = Transducer("t", "Y", {(0, "Y"): 1}, (0, 1))  # run from both ends: a target anywhere in the clause
INSULTING = Transducer("i", "I", {(0, "I"): 1, (1, "I"): 1}, (0, 0))
THREATENING = Transducer("h", "T", {(0, "T"): 1, (1, "T"): 1}, (0, 0), only="t")  # reads what AIMED wrote


def composed(tape: list[str]) -> list[str]:
    """The tape of one clause as the five transducers leave it, each reading what those before it wrote."""
    for machine, back in ((NEGATED, False), (SPOKEN, False), (AIMED, False), (AIMED, True), (INSULTING, False), (THREATENING, False)):
        tape = machine.run(tape, back)
    return tape


class Grammar:
    """The composed transducers with their weights. A text is scored by its clauses, a clause by the paths that the transducers accept in it."""

    def __init__(self, insults: dict[str, dict[int, float]], weights: dict[str, float] | None = None, base: float = 0.05):
        self.insults, self.weights, self.base = insults, weights or {}, base
        own = [re.escape(f[:-1]) + r"(?![^\W\d_])" if f[-1] == "$" else re.escape(f) for f in sorted(insults)]
        own += [re.escape(w) + r"(?![^\W\d_])" for w in sorted(THREAT)]
        self._any = re.compile(r"(?<![^\W\d_])(?:" + "|".join(own) + ")")

    def stems(self, word: str) -> list[str]:
        """The lexicon's stems that a word has."""
        own = [word[:k] for k in range(2, min(len(word), LONGEST) + 1) if word[:k] in self.insults]
        return [*own, word + "$"] if word + "$" in self.insults else own

    def symbols(self, word: str) -> str:
        """What a word may be, of several classes at once too."""
        own = "I" if self.stems(word) else ""
        for symbol, words in (("T", THREAT), ("Y", TARGET), ("N", NEGATION), ("R", REPORTED), ("Q", QUOTES)):
            own += symbol if word in words else ""
        return own

    def clause(self, words: list[str]) -> list[tuple[str, str, float]]:
        """(pattern, stem, factor) of every accepted path of one clause: a path ends in an insult or, where a target is, a threat."""
        out = []
        for word, place in zip(words, composed([self.symbols(w) for w in words]), strict=True):
            marks = "".join(c for c in "ntr" if c in place)
            for head, stems in (("I", self.stems(word) if "i" in place else []), ("T", ["THREAT"] if "h" in place else [])):
                factor = self.weights.get(head + marks, 1.0) * math.prod(PRIOR[c] for c in marks)
                out += [(head + marks, stem, factor) for stem in stems]
        return out

    def clauses(self, text: str) -> list[list[tuple[str, str, float]]]:
        """The accepted paths of each clause that has any."""
        low = text.lower()
        if not self._any.search(low):
            return []
        found = (self.clause(WORD.findall(c)) for c in CLAUSE.split(low) if self._any.search(c))
        return [paths for paths in found if paths]

    def evidence(self, text: str) -> list[tuple[float, str]]:
        """(weight, heaviest path's pattern) of each clause that has weight, the heaviest first.

        A path weighs what its stem does, times its pattern's factor; a stem that says something only when repeated weighs so
        once that many paths of the text's clauses end in it. A clause weighs what its heaviest path does, and a tenth of what
        the heaviest paths of its other stems do.
        """
        found = self.clauses(text)
        times = Counter(stem for paths in found for _, stem, _ in paths)
        weight = {stem: max((w for n, w in self.insults.get(stem, {1: THREAT_WEIGHT}).items() if n <= c), default=0.0) for stem, c in times.items()}
        out = []
        for paths in found:
            best: dict[str, tuple[float, str]] = {}
            for pattern, stem, factor in paths:
                best[stem] = max(best.get(stem, (0.0, "")), (weight[stem] * factor, pattern))
            first, *rest = sorted(best.values(), reverse=True)
            if first[0]:
                out.append((first[0] + 0.1 * sum(w for w, _ in rest), first[1]))
        return sorted(out, reverse=True)

    def score(self, text: str) -> float:
        """The base rate without a matched clause; else the heaviest clause, and a tenth of the rest, as log-odds on top of PRIOR_ODDS."""
        found = [w for w, _ in self.evidence(text)]
        if not found:
            return self.base
        x = found[0] + min(2.0, 0.1 * sum(found[1:])) + PRIOR_ODDS
        return max(self.base, 1 / (1 + math.exp(-x)))


def _shingle_hash(seed: int):
    return lambda k: F.xxhash64(F.lit(seed), F.slice("_w", k, 3))


def told_apart(sample: DataFrame, keys: int = 4) -> DataFrame:
    """sample(doc_id, text, toxic) with few copies of one text: of rows with an equal least hash of three-word shingles, the first, for each of several hashes."""
    w = F.split(F.lower("text"), r"\s+")
    rows = sample.withColumn("_w", w)
    for i in range(keys):
        keyed = rows.withColumn("_k", F.array_min(F.transform(F.sequence(F.lit(1), F.greatest(F.size("_w") - 2, F.lit(1))), _shingle_hash(i))))
        first = keyed.groupBy("toxic", "_k").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
        rows = rows.join(first, "doc_id", "left_semi")
    return rows.drop("_w")


def labelled(docs: DataFrame, labels: DataFrame, learns: Column, most: int) -> DataFrame:
    """(doc_id, text, toxic) of at most `most` labelled documents of each class that may be learned from, chosen by a hash of their ids."""
    mine = labels.where("doc_id is not null and toxic in (0, 1)").where(learns).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # Top-k per class: each task hands on `most` rows at most.
    some = [mine.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for t in (0, 1)]
    chosen = F.broadcast(some[0].union(some[1]))  # 2 * most rows of an id and a label
    return docs.where(learns).select("doc_id", "text").join(chosen, "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic")


def learned(docs: DataFrame, labels: DataFrame, learns: Column, most: int = 5000, patterns: int = 400) -> Grammar:
    """A grammar fitted on a bounded sample: `most` documents of each class, `patterns` entries in the lexicon.

    Of the sample, documents that told_apart() takes for copies count once. Features weighed on the driver are those of at least four
    toxic documents and LEAST_WEIGHT, the 50 * patterns in most toxic documents; rarer ones are not learned. All of these bound the
    fit alone: every text is scored whole.
    """
    from ._common import dropped, written

    sampled = written(labelled(docs, labels, learns, most))
    sample = written(told_apart(sampled))
    totals = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, benign = totals.get(1, 0), totals.get(0, 0)

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            count: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for text, t in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                count[t].update(features(text))
            names = [*count[1], *(f for f in count[0] if f not in count[1])]
            return {"feature": pa.array(names, pa.string()), "t": pa.array([count[1][f] for f in names], pa.int64()), "b": pa.array([count[0][f] for f in names], pa.int64())}

        return each

    summed = mapped(sample, "feature string, t long, b long", make).groupBy("feature").agg(F.sum("t").alias("t"), F.sum("b").alias("b"))
    # What could enter the lexicon at all, the most frequent first: a bounded number of rows for the driver.
    able = summed.where(f"t >= 4 and (t + 0.5) * {benign + 1} >= {math.exp(LEAST_WEIGHT)} * (b + 0.5) * {toxic + 1}").orderBy(F.desc("t"), "feature").limit(50 * patterns)
    counts = [tuple(r) for r in able.collect()]
    place = {f: i for i, (f, _, _) in enumerate(counts)}

    def having():
        def each(batch: pa.RecordBatch) -> dict:
            own = [np.array([place[f] for f in features(x) if f in place], np.int32).tobytes() for x in batch.column("text").to_pylist()]
            return {"own": pa.array(own, pa.binary())}

        return each

    rows = mapped(sample.where("toxic = 1"), "own binary", having).where("length(own) > 0").collect()  # of `most` documents at most
    grammar = Grammar(lexicon(counts, [np.frombuffer(r["own"], np.int32) for r in rows], toxic, benign, patterns))

    def seen():
        def each(batch: pa.RecordBatch) -> dict:
            found = [(grammar.evidence(x) or [(0.0, "")])[0][1] for x in batch.column("text").to_pylist()]
            return {"pattern": pa.array(found, pa.string()), "toxic": batch.column("toxic")}

        return each

    rows = mapped(sample, "pattern string, toxic int", seen).groupBy("pattern").agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).collect()
    share = toxic / max(1, toxic + benign)
    for r in rows:  # at most one for each pattern of the grammar
        if r["pattern"]:
            # The share of toxic documents, drawn to 0.9 by PRIOR_DOCS documents; a pattern that is right as often as that keeps its weight.
            p = (r["t"] + 0.9 * PRIOR_DOCS) / (r["n"] + PRIOR_DOCS)
            grammar.weights[r["pattern"]] = max(0.05, math.log(p / (1 - p) / (share / (1 - share) if 0 < share < 1 else 1)) / math.log(9)) if p < 1 else 1.0
        else:
            grammar.base = min(0.2, (r["t"] + 0.5) / (r["n"] + 1))
    dropped(sampled, sample)
    return grammar


def scored(docs: DataFrame, grammar: Grammar, threshold: float = 0.3) -> DataFrame:
    """docs(doc_id long, text) -> (doc_id, score, predicted int).

    Null and empty texts: no clause, the base rate. Every row of docs gives a row, null doc_ids and repeated rows too; other columns
    are ignored; an empty table gives no rows. Without labels to learn from, the lexicon is empty and only threats match.
    """

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            texts = [x or "" for x in batch.column("text").to_pylist()]
            score = [grammar.score(x) for x in texts]
            return {
                "doc_id": batch.column("doc_id"),
                "score": pa.array(score, pa.float64()),
                "predicted": pa.array([int(s >= threshold) for s in score], pa.int32()),
            }

        return each

    return mapped(docs.select("doc_id", "text"), "doc_id long, score double, predicted int", make)


def fold(column: str, parts: int) -> Column:
    """crc32 of an id as text, modulo parts."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % parts


def kept(docs: DataFrame, grammar: Grammar, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, with all their columns, that aren't predicted as toxic; rows are judged one by one, as in scored()."""

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([grammar.score(x or "") < threshold for x in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
