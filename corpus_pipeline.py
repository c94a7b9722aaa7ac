"""From raw documents to packed training sequences: each stage works on what the one before it kept.

Toxic documents go, then documents whose language can't be told, then passages that repeat across documents, then all but one of each
group of near duplicates; what is left is tokenized and packed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import language, lines, minhash, packing, toxicity
from tagloom.llm._common import written
from tagloom.llm.queries import tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _chosen(docs: DataFrame, ids: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS).join(ids, "doc_id", "left_semi").select(*COLUMNS)


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar, fitted on all labels, doesn't predict as toxic."""
    grammar = toxicity.learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    return toxicity.kept(docs.select(*COLUMNS), grammar)


def language_known(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language that can be told; those without a letter go."""
    own = language.Classifier(language.prototypes(docs, F.lit(True)))
    return language.kept(docs.select(*COLUMNS), own)


def repeated_lines_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that an earlier one has; a document of which nothing is left goes."""
    out = lines.without_repeated_lines(docs.select(*COLUMNS))
    left = out.where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the least doc_id."""
    found = minhash.near_duplicates(docs, k=5, percent=80)
    return _chosen(docs, found.where("kept").select("doc_id"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences."""
    return packing.pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic_out),
    ("language_id", language_known),
    ("line_dedup", repeated_lines_out),
    ("minhash_near_dedup", near_duplicates_out),
    ("best_fit_packing", packed),
]

#: Learned scores and a tokenizer are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
