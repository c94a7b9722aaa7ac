"""License scans by diagonal voting.

The rolling word k-grams of texts are joined with the places that they have in templates. A hit at word i of a text and place j
of a template votes for the diagonal i - j; a copy of the template gives votes on one diagonal, or on neighbouring ones
where words were put in or left out. Neighbouring diagonals are merged, cut where places start over, and the spans that their
hits cover are verified.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import mapped, written

K = 2
REACH = 2  # diagonals at most so far apart are merged
COVER = 0.8  # share of a template's k-grams that a span must have

#: Phrases whose every place counts: label by phrase.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Further names and the openings of notices: label by words. Found where enough of their k-grams stand in order.
TEMPLATES = {
    "cc by nc": "cc-by-nc", "cc by sa": "cc-by-sa", "cc by nd": "cc-by-nd", "cc by nc sa": "cc-by-nc-sa", "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by", "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl",
    "mozilla public license": "mpl", "bsd license": "bsd", "2 clause bsd license": "bsd-2-clause", "3 clause bsd license": "bsd-3-clause", "isc license": "isc",
    "eclipse public license": "epl", "boost software license": "boost", "apache license version 2 0": "apache-2.0",
    "gnu general public license version 2": "gpl-2.0", "gnu general public license version 3": "gpl-3.0",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "you may not use this file except in compliance with the license": "apache",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
}

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_STOP = re.compile(rb"[^0-9a-z\x80-\xff]")
STRETCH = 1 << 22  # bytes of a text that are split into words at once


def grams() -> tuple[dict[bytes, int], list[tuple[int, str, int, int, bool, str]]]:
    """Number of each word that a template has, and (gram, template, place, number of grams, base, label) of all grams: a fixed, small table.

    A gram is told by its words' numbers, as one number: a hash without collisions.
    """
    tables = [(True, PHRASES), (False, TEMPLATES)]
    words = sorted({w for _, table in tables for phrase in table for w in phrase.split()})
    number = {w.encode(): i for i, w in enumerate(words)}
    out = []
    for base, table in tables:
        for phrase, label in table.items():
            w = [number[x.encode()] for x in phrase.split()]
            out += [(w[i] * len(words) + w[i + 1], phrase, i, len(w) - 1, base, label) for i in range(len(w) - 1)]
    return number, out


def rolled(docs: DataFrame, number: dict[bytes, int]) -> DataFrame:
    """(doc_id, h, n_words, grams array<struct<pos, gram>>): the rolling grams of each text; those with a word that no template has join nothing and are left out."""

    stretch = STRETCH

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            total, sizes, places, codes = [], [0], [], []
            for text in batch.column("text").to_pylist():
                low, at, n, last, found = (text or "").encode("utf-8", "surrogatepass").lower(), 0, 0, -1, 0
                while at < len(low):
                    cut = _STOP.search(low, at + stretch) if at + stretch < len(low) else None
                    to = cut.start() if cut else len(low)
                    words = _WORD.findall(low, at, to)
                    ids = np.concatenate([[last], np.fromiter(map(number.get, words, repeat(-1)), np.int64, len(words))])
                    hit = np.nonzero((ids[:-1] >= 0) & (ids[1:] >= 0))[0]
                    places.append(hit + n - 1)
                    codes.append(ids[hit] * len(number) + ids[hit + 1])
                    found += len(hit)
                    n, last, at = n + len(words), ids[-1], to
                total.append(n)
                sizes.append(found)
            pos, gram = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (places, codes))
            pairs = pa.StructArray.from_arrays([pa.array(pos, pa.int64()), pa.array(gram, pa.int64())], names=["pos", "gram"])
            return {"doc_id": batch.column("doc_id"), "h": batch.column("h"), "n_words": pa.array(total, pa.int64()), "grams": pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pairs)}

        return each

    return mapped(docs.select("doc_id", "text", F.xxhash64("text").alias("h")), "doc_id long, h long, n_words long, grams array<struct<pos:long,gram:long>>", make)


def scan(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans).

    Words are runs of a-z, 0-9 and signs beyond ASCII, A-Z lowered. Base places are those of whole PHRASES, each counted; base_labels are
    theirs, labels also those of TEMPLATES with a span that has COVER of its k-grams and is at most twice as long; both distinct,
    sorted, joined by commas. A span's places rise: where they start over, as in a name that is repeated, another span begins. score
    is the largest cover of a label, 0 without one; spans are (label, first word, words, cover).

    Null text: as "": no words, no labels. Every row of docs gives a row; rows of equal doc_id (null too) and text have the
    same results. Other columns are ignored. No rows: no rows.
    """
    number, table = grams()
    own = written(rolled(docs, number))
    counted = own.select("doc_id", "h", "n_words")
    fixed = F.broadcast(docs.sparkSession.createDataFrame(table, "gram long, template string, place int, total int, base boolean, label string"))  # fixed size
    hits = own.select("doc_id", "h", F.inline("grams")).join(fixed, "gram")
    hits = hits.select("doc_id", "h", "template", "base", "label", "total", "pos", "place", (F.col("pos") - F.col("place")).alias("diagonal")).distinct()

    each = Window.partitionBy("doc_id", "h", "template", "base")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(each.orderBy("diagonal", "pos")) > F.when(F.col("base"), 0).otherwise(REACH), F.lit(True))
    merged = hits.withColumn("new", apart.cast("int")).withColumn("run", F.sum("new").over(each.orderBy("diagonal", "pos").rowsBetween(Window.unboundedPreceding, 0)))
    along = Window.partitionBy("doc_id", "h", "template", "base", "run").orderBy("pos", "place")
    over = F.coalesce(F.col("place") <= F.lag("place").over(along), F.lit(True))
    merged = merged.withColumn("over", over.cast("int")).withColumn("part", F.sum("over").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    spans = (
        merged.groupBy("doc_id", "h", "template", "base", "label", "total", "run", "part")
        .agg(F.count("*").alias("votes"), F.min("pos").alias("start"), (F.max("pos") - F.min("pos") + K).alias("words"))
        .withColumn("cover", F.col("votes") / F.col("total"))
        .where(F.when(F.col("base"), F.col("votes") == F.col("total")).otherwise((F.col("cover") >= COVER) & (F.col("words") <= 2 * (F.col("total") + 1))))
    )
    by_doc = spans.groupBy("doc_id", "h").agg(
        F.count_if("base").alias("n_base"),
        F.min(F.when(F.col("base"), F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("base"), F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("base"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("cover").alias("score"),
        F.sort_array(F.collect_list(F.struct("start", "words", "label", "cover"))).alias("spans"),
    )
    found = by_doc.withColumnsRenamed({"doc_id": "_id", "h": "_h"})
    out = counted.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("h").eqNullSafe(F.col("_h")), "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), "spans",
    )


def oracle() -> str:
    """SQL that makes its own grams of the phrases, as strings, and finds base places by their words."""
    rows = ", ".join(f"('{phrase}', {str(base).lower()}, '{label}')" for base, table in ((True, PHRASES), (False, TEMPLATES)) for phrase, label in table.items())
    return rf"""
WITH t(phrase, base, label) AS (VALUES {rows}
), p AS (SELECT phrase, base, label, string_split(phrase, ' ') AS t FROM t
), g AS (SELECT phrase, label, len(t) - 1 AS total, unnest(range(len(t) - 1)) AS place, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) AS gram FROM p WHERE NOT base
), d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents
), x AS (SELECT doc_id, unnest(w) AS a, generate_subscripts(w, 1) - 1 AS pos FROM d
), y AS (SELECT doc_id, pos, a, lead(a) OVER o AS b, lead(a, 2) OVER o AS c, lead(a, 3) OVER o AS e FROM x WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
), base AS (
  SELECT y.doc_id, y.pos, p.label FROM y JOIN p ON p.base AND y.a = p.t[1] AND y.b = p.t[2] AND (len(p.t) < 3 OR y.c = p.t[3]) AND (len(p.t) < 4 OR y.e = p.t[4])
), hits AS (SELECT y.doc_id, g.phrase, g.label, g.total, g.place, y.pos, y.pos - g.place AS diagonal FROM y JOIN g ON y.a || ' ' || y.b = g.gram
), n AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER o <= {REACH} THEN 0 ELSE 1 END AS new FROM hits WINDOW o AS (PARTITION BY doc_id, phrase ORDER BY diagonal, pos)
), r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, phrase ORDER BY diagonal, pos ROWS UNBOUNDED PRECEDING) AS run FROM n
), q AS (SELECT *, CASE WHEN place > lag(place) OVER o THEN 0 ELSE 1 END AS fresh FROM r WINDOW o AS (PARTITION BY doc_id, phrase, run ORDER BY pos, place)
), z AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, phrase, run ORDER BY pos, place ROWS UNBOUNDED PRECEDING) AS part FROM q
), s AS (SELECT doc_id, label, count(*) / any_value(total) AS cover FROM z GROUP BY doc_id, phrase, label, run, part HAVING count(*) / any_value(total) >= {COVER} AND max(pos) - min(pos) + {K} <= 2 * (any_value(total) + 1)
), l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(cover) AS score FROM (SELECT doc_id, label, cover FROM s UNION ALL SELECT doc_id, label, 1 FROM base) GROUP BY doc_id
), f AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM base GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN f ON d.doc_id = f.doc_id LEFT JOIN l ON d.doc_id = l.doc_id
"""
