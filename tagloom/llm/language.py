"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram is its letters' vectors, permuted by place and bound by
multiplication; a text is the sum of its trigrams' vectors; a language the sum of its documents' vectors. A text gets the
language whose prototype is nearest by cosine, after the part that all prototypes share is taken from both.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import mapped

DIMENSIONS = 1024
CLASSES = 256
UND = "und"


def letter_vectors(seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The vectors of all letter classes, permuted for the first, second and third place. Class 0 stands for what is no letter."""
    own = np.random.default_rng(seed).integers(0, 2, (CLASSES, DIMENSIONS), dtype=np.int8) * 2 - 1
    return np.roll(own, 2, axis=1), np.roll(own, 1, axis=1), own


def letter_classes() -> np.ndarray:
    """Class of each code point: 0 for what is no letter, own classes for a-z and Latin letters, hashed ones for all others."""
    table = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
            table[c] = c - 96 if 97 <= c <= 122 else 27 + (c - 0xC0 if 0xC0 <= c < 0x180 and c - 0xC0 < 160 else 160 + c % 69)
    return table


class Encoder:
    """Texts to sums of trigram vectors."""

    def __init__(self):
        self.table, (self.first, self.second, self.third) = letter_classes(), letter_vectors()

    def trigrams(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the distinct trigrams and their numbers; runs of what is no letter count as one sign. Empty without a letter."""
        x = self.table[np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
        if not x.any():
            return np.empty(0, np.int64), np.empty(0, np.int64)
        x = np.concatenate([[0], x, [0]]).astype(np.int64)
        x = x[np.concatenate([[True], (x[1:] != 0) | (x[:-1] != 0)])]
        return np.unique((x[:-2] << 16) | (x[1:-1] << 8) | x[2:], return_counts=True)

    def vector(self, codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        out = np.zeros(DIMENSIONS, np.float32)
        for i in range(0, len(codes), 2048):
            c = codes[i : i + 2048]
            bound = self.first[c >> 16] * self.second[(c >> 8) & 255] * self.third[c & 255]
            out += counts[i : i + 2048].astype(np.float32) @ bound.astype(np.float32)
        return out


def prototypes(docs: DataFrame, learns: Column, most: int = 8000) -> dict[str, np.ndarray]:
    """Language -> sum of unit document vectors, over about `most` documents with text and lang that may be learned from.

    The sample is a share of all such documents, taken by a hash of the id and fixed by their number; it bounds the work, and
    languages number at most a few hundred, so what comes to the driver is bounded too.
    """
    able = docs.where("text is not null and lang is not null and doc_id is not null").where(learns)
    n = able.count()
    share = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_003)) < math.ceil(1_000_003 * min(1.0, most / max(n, 1)))

    def make():
        encoder = Encoder()

        def each(batch: pa.RecordBatch) -> dict:
            sums: dict[str, np.ndarray] = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                codes, counts = encoder.trigrams(text)
                if len(codes):
                    v = encoder.vector(codes, counts).astype(np.float64)
                    # Whole numbers: sums don't depend on the order of partitions.
                    sums[lang] = sums.get(lang, 0) + np.rint(v / np.linalg.norm(v) * 2**20).astype(np.int64)
            return {"lang": pa.array(list(sums), pa.string()), "v": pa.array([x.tolist() for x in sums.values()], pa.list_(pa.int64()))}

        return each

    sums = mapped(able.where(share).select("text", "lang"), "lang string, v array<long>", make)
    each = sums.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    out: dict[str, np.ndarray] = {}
    for r in each.collect():  # languages * DIMENSIONS rows
        out.setdefault(r["lang"], np.zeros(DIMENSIONS))[r["i"]] = r["x"]
    return {k: v for k, v in sorted(out.items()) if v.any()}


class Classifier:
    def __init__(self, learned: dict[str, np.ndarray]):
        self.names = list(learned)
        unit = np.array([v / np.linalg.norm(v) for v in learned.values()]) if learned else np.zeros((0, DIMENSIONS))
        self.shared = unit.mean(axis=0) if len(unit) > 1 else np.zeros(DIMENSIONS)
        self.shared /= np.linalg.norm(self.shared) or 1.0
        own = unit - np.outer(unit @ self.shared, self.shared)
        self.own = own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)
        self.encoder = None

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score in 0 to 1, and cosine of the text with what all prototypes share; und, 0, 0 without a letter."""
        self.encoder = self.encoder or Encoder()
        codes, counts = self.encoder.trigrams(text)
        if not len(codes) or not self.names:
            return UND, 0.0, 0.0
        v = self.encoder.vector(codes, counts).astype(np.float64)
        size = np.linalg.norm(v) or 1.0
        along = float(v @ self.shared)
        rest = v - along * self.shared
        cosines = self.own @ rest / (np.linalg.norm(rest) or 1.0)
        best = int(np.argmax(cosines))
        odds = np.exp(12 * (cosines - cosines[best]))
        return self.names[best], float(1 / odds.sum()), along / size

    def has_letter(self, text: str | None) -> bool:
        self.encoder = self.encoder or Encoder()
        return len(self.encoder.trigrams(text)[0]) > 0

    def __getstate__(self):
        return self.__dict__ | {"encoder": None}


def predicted(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """docs(doc_id long, text) -> (doc_id, lang_pred, score, typical).

    lang_pred is a learned language, or und with score 0 where the text is null or has no letter, or nothing was learned.
    typical is the cosine of the text with the part that all languages share. Every row of docs gives a row, repeated rows and null
    doc_ids too; other columns are ignored; an empty table gives no rows.
    """

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            found = [classifier.predict(x.as_py()) for x in batch.column("text")]
            return {
                "doc_id": batch.column("doc_id"),
                "lang_pred": pa.array([x[0] for x in found], pa.string()),
                "score": pa.array([x[1] for x in found], pa.float64()),
                "typical": pa.array([x[2] for x in found], pa.float64()),
            }

        return each

    return mapped(docs.select("doc_id", "text"), "doc_id long, lang_pred string, score double, typical double", make)


def kept(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """The rows of docs, with all their columns, whose language can be told: all but those whose text is null or has no letter.

    With nothing learned no language can be named, which says nothing of the texts: those with a letter stay all the same.
    """

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([classifier.predict(x.as_py())[0] != UND or classifier.has_letter(x.as_py()) for x in batch.column("text")], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
