"""Pages from a stream into a stored corpus, batch by batch."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.corpus import Corpus, parse_pages


def append_stream(pages: DataFrame, path: str, checkpoint: str, key: str = "key", html: str = "html", meta: Iterable[str] = (), most_segments: int = 64, **trigger) -> StreamingQuery:
    """Each micro-batch of a streaming DataFrame is appended to the corpus at path, which is made by the first.

    Keys that the corpus has are skipped, so a batch that is run again after a failure changes nothing. Pages that can't be parsed are
    left out. A corpus of more than most_segments segments is compacted; the old ones stay for readers until Corpus.vacuum. State is the corpus itself: no watermark, no bound on how late a repeated key is recognized.
    """
    meta = list(meta)

    def one(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        jvm = spark._jvm
        current = jvm.org.apache.hadoop.fs.Path(f"{path}/CURRENT")
        if current.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(current):
            Corpus.open(spark, path).append(path, batch, key, html, meta, on_error="skip")
            if Corpus.segments(spark, path) > most_segments:
                Corpus.compact(spark, path)
        else:
            parse_pages(batch, key, html, meta).write(path)

    return pages.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def live_counts(pages: DataFrame, selector: str, key: str = "key", html: str = "html") -> DataFrame:
    """(key, idx, tag, id) of the matches of a one-compound selector in a stream of pages; every page is parsed as it comes."""
    from pyspark.sql import functions as F

    from ..operators.ingest import parse_rows
    from ..plans.compile import is_local, local_list
    from ..plans.selector import Selector

    own = Selector.of(selector).alternatives
    if not is_local(own):
        raise ValueError("a stream takes selectors without combinators, :has and [text] only")
    rows = parse_rows(pages.select(F.lit(0).cast("long").alias("pos"), F.col(key).alias("key"), F.col(html).alias("html")))
    return rows.where(local_list(own)).select("key", "idx", "tag", "id")
