from pyspark.sql import functions as F

import corpus_pipeline
from tagloom.llm import language, toxicity

from . import test_lines, test_minhash, test_packing
from .util import collected, documents, odd_rows


def brute(spark, docs, sf_dir):
    """The stages one after the other over plain rows; what is learned comes from the operators' own fit."""
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    grammar = toxicity.learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.lit(True))
    rows = [(i, t) for i, t in rows if grammar.score(t or "") < 0.3]
    left = documents(spark, rows, extra=False).join(docs.select("doc_id", "lang"), "doc_id")
    own = language.Classifier(language.prototypes(left, F.lit(True)))
    rows = [(i, t) for i, t in rows if own.predict(t)[0] != "und"]
    rows = [(i, t) for i, t, _, gone in test_lines.brute(rows) if not gone or t.strip(" ")]
    keep = {r[0] for r in test_minhash.brute(rows, 5) if r[3]}
    return [(i, t) for i, t in rows if i in keep]


def test_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = brute(spark, docs, sf_dir)
    got = collected(corpus_pipeline.run(spark, sf_dir))
    test_packing.check(want, got, 2048)
    assert 0 < len(want) < docs.count()


def test_stages_return_the_columns_of_documents(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "line_dedup", "minhash_near_dedup", "best_fit_packing"]
    docs = documents(spark, odd_rows()).withColumn("source", F.lit(None).cast("string"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == corpus_pipeline.COLUMNS
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_clean_documents_stay(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("doc_id", F.col("doc_id"))
    kept = corpus_pipeline.language_known(spark, docs, sf_dir)
    assert kept.count() == docs.count()  # every one has letters
