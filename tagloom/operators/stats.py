"""Figures of a corpus: sizes a page, their distribution, symbols that a shared dictionary would serve."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .corpus import Corpus

METRICS = ["n_nodes", "max_depth", "list_entries", "distinct_pairs", "ext_tag_names", "ext_attr_names", "symbols"]
PERCENTILES = (50.0, 99.0, 99.9, 99.99, 99.999)


def per_page(corpus: Corpus) -> DataFrame:
    """(pos, key, METRICS) of each page."""
    n = corpus.nodes
    sizes = n.groupBy("pos", "key").agg(
        F.count("*").alias("n_nodes"),
        F.max("depth").alias("max_depth"),
        F.sum(F.coalesce(F.size("classes"), F.lit(0)).cast("long") + F.coalesce(F.size("attrs"), F.lit(0))).alias("list_entries"),
        F.count_distinct(F.when(~F.col("is_std"), F.col("tag"))).alias("ext_tag_names"),
    )
    a = n.where("kind = 'element'").select("pos", F.explode("attrs").alias("a")).select("pos", "a.name", "a.value")
    pairs = a.groupBy("pos").agg(F.count_distinct("name", "value").alias("distinct_pairs"), F.count_distinct(F.when(F.col("name").contains("-"), F.col("name"))).alias("ext_attr_names"))
    symbols = n.select("pos", F.explode("classes").alias("s")).union(n.where("NOT is_std").select("pos", "tag")).groupBy("pos").agg(F.count_distinct("s").alias("symbols"))
    out = sizes.join(pairs, "pos", "left").join(symbols, "pos", "left")
    return out.select("pos", "key", *(F.coalesce(F.col(m).cast("long"), F.lit(0).cast("long")).alias(m) for m in METRICS))


def _long(pages: DataFrame) -> DataFrame:
    return pages.unpivot(["pos", "key"], METRICS, "metric", "value")


def histogram(pages: DataFrame, cap: int = 65_535) -> DataFrame:
    """(metric, bucket, n, ...) by number of binary digits, with the metric's exact maximum, a page that has it, and the pages over cap."""
    rows = _long(pages)
    bits = F.when(F.col("value") <= 0, 0).otherwise(F.length(F.bin(F.col("value")))).alias("bucket")
    counts = rows.select("metric", bits).groupBy("metric", "bucket").agg(F.count("*").alias("n"))
    most = rows.groupBy("metric").agg(F.max("value").alias("max_value"), F.max_by("key", F.struct("value", "key")).alias("max_key"), F.count_if(F.col("value") > cap).alias("over_cap"))
    return counts.join(most, "metric")


def percentiles(pages: DataFrame) -> DataFrame:
    """(metric, percentile, bound): the upper bound of the bucket that holds the percentile, at most the maximum."""
    own = histogram(pages)
    w = Window.partitionBy("metric")
    up = own.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w))
    rows = up.select("metric", "bucket", "upto", "total", "max_value", F.explode(F.array(*(F.lit(p) for p in PERCENTILES))).alias("percentile"))
    hit = rows.where(F.col("upto") >= F.ceil(F.col("total") * F.col("percentile") / 100))
    return hit.groupBy("metric", "percentile").agg(F.min(F.least(F.pow(F.lit(2), F.col("bucket")).cast("long") - 1, F.col("max_value"))).alias("bound"))


def coverage(pages: DataFrame, bits: tuple[int, ...] = (15, 16, 17)) -> DataFrame:
    """One row: pages, and those with more nodes than so many bits can number."""
    return pages.agg(F.count("*").alias("pages"), *(F.count_if(F.col("n_nodes") > 2**b).alias(f"over_2_{b}") for b in bits))


def shared_symbols(corpus: Corpus, bundle: int = 1000) -> DataFrame:
    """(bundle, rank, symbol, pages, gain, covered): of each run of pages, classes and custom names by what sharing them would save."""
    n = corpus.nodes.withColumn("bundle", F.floor(F.col("pos") / bundle))
    symbols = n.select("bundle", "pos", F.explode("classes").alias("symbol")).union(n.where("NOT is_std").select("bundle", "pos", "tag")).distinct()
    freq = symbols.groupBy("bundle", "symbol").agg(F.count("*").alias("pages"))
    gain = freq.withColumn("gain", (F.col("pages") - 1) * F.length("symbol"))
    w = Window.partitionBy("bundle").orderBy(F.desc("gain"), "symbol")
    return gain.withColumn("rank", F.row_number().over(w)).withColumn("covered", F.sum("gain").over(w)).select("bundle", "rank", "symbol", "pages", "gain", "covered")
