"""Removal of passages that repeat across documents: hashed windows of three lines, first occurrences kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import among, dropped, free_name, named, written

_PLACES = 2**32  # a place is doc_id * _PLACES + pos, as a decimal: it orders as (doc_id, pos) does and fits a hash aggregate's buffer


def windows(docs: DataFrame, lines: int = 3) -> DataFrame:
    """(doc_id, pos, h1, h2) of every window of consecutive lines that has a line that isn't blank.

    Lines become two hashes and a mark each before windows are formed, so what is sliced and exploded are fixed-size values.
    """
    line = F.transform(F.split("text", "\n", -1), lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), (F.trim(x) != "").alias("said")))
    hashed = docs.where(F.col("doc_id").isNotNull() & ((F.instr("text", "\n") > 0) | F.lit(lines == 1))).select("doc_id", line.alias("w"))
    each = [F.slice("w", i + 1, F.greatest(F.size("w") - (lines - 1), F.lit(0))).alias(f"l{i}") for i in range(lines)]
    rows = hashed.select("doc_id", F.posexplode(F.arrays_zip(*each)).alias("pos", "z"))
    own = [F.col(f"z.l{i}") for i in range(lines)]
    said = F.greatest(*(x["said"].cast("int") for x in own)) == 1
    return rows.where(said).select("doc_id", "pos", F.xxhash64(*(x["a"] for x in own)).alias("h1"), F.xxhash64(*(x["b"] for x in own)).alias("h2"))


def repeated_lines(docs: DataFrame, lines: int = 3) -> DataFrame:
    """(doc_id, starts array<int>): where later occurrences of repeated windows start.

    A window's first place and number come from one aggregate with map-side combining. Windows with so many occurrences that they
    would weigh on a task are few, fewer than 4 a partition, and meet their occurrences by broadcast; all others by hash.
    """
    own = written(windows(docs, lines))
    place = F.col("doc_id").cast("decimal(20,0)") * F.lit(_PLACES).cast("decimal(11,0)") + F.col("pos")
    groups = written(own.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"))
    bar = 1 + (groups.agg(F.sum("n")).first()[0] or 0) // (4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    hot = own.join(F.broadcast(groups.where(F.col("n") > bar)), ["h1", "h2"])
    rest = own.join(F.broadcast(groups.where(F.col("n") > bar).select("h1", "h2")), ["h1", "h2"], "left_anti").join(groups.where(F.col("n") <= bar), ["h1", "h2"])
    later = hot.unionByName(rest).where(place > F.col("first"))
    out = written(later.groupBy("doc_id").agg(F.array_sort(F.collect_set("pos")).alias("starts")))
    dropped(own, groups)
    return out


def _cut(starts: Column, lines: int) -> Column:
    return F.array_distinct(F.flatten(F.transform(starts, lambda x: F.sequence(x, x + lines - 1))))


def without_repeated_lines(docs: DataFrame, lines: int = 3) -> DataFrame:
    """docs(doc_id, text, ...) -> docs with `text` changed, and n_lines, n_removed long.

    A window is `lines` consecutive lines, split at \\n alone and compared as they are. Windows of blank lines only don't
    count. Of all occurrences of a window, the first by (doc_id, position) stays; the lines that any other occurrence covers
    are removed, overlaps once. Every removed line stays at an earlier place. Windows are told apart by two 64-bit hashes.
    Documents that lose nothing stay where they are; only the others meet their cuts.

    Null text or doc_id: unchanged, n_removed 0 (n_lines null without text). Fewer than `lines` lines: unchanged. Rows that share a
    doc_id are taken as one document, whose occurrences at one position count as one. A document that loses all its lines has
    the text "". Other columns are kept, whatever their names; an n_lines or n_removed among them, in any case, is replaced. An
    empty table gives no rows.
    """
    kept = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    starts, to = free_name(docs, "starts"), free_name(docs, "cut_id")
    cuts = repeated_lines(docs, lines).toDF(to, starts)
    inside, outside = among(docs.select(*named(kept)), cuts.select(F.col(to).alias("doc_id")))
    w = F.split("text", "\n", -1)
    stay = F.array_except(F.sequence(F.lit(0), F.size(w) - 1), _cut(F.col(starts), lines))
    left = F.concat_ws("\n", F.transform(stay, lambda i: F.element_at(w, i + 1)))

    def shaped(rows: DataFrame, text: Column, removed: Column) -> DataFrame:
        own = (text.alias(c) if c.lower() == "text" else x for c, x in zip(kept, named(kept), strict=True))
        return rows.select(*own, F.when(F.col("text").isNotNull(), F.size(w)).cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"))

    same = shaped(outside, F.col("text"), F.lit(0))
    text = F.when(F.col("text").isNotNull() & F.col(starts).isNotNull(), left).otherwise(F.col("text"))
    removed = F.when(F.col("text").isNotNull() & F.col(starts).isNotNull(), F.size(w) - F.size(stay)).otherwise(0)
    return same.unionByName(shaped(inside.join(cuts, F.col("doc_id") == F.col(to), "left"), text, removed))


ORACLE = """
WITH line AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS pos
  FROM documents WHERE text IS NOT NULL
), win AS (
  SELECT doc_id, pos, l AS a, lead(l) OVER o AS b, lead(l, 2) OVER o AS c FROM line WINDOW o AS (PARTITION BY doc_id ORDER BY pos)
), good AS (
  SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS k
  FROM win WHERE c IS NOT NULL AND trim(a || b || c, ' ') <> ''
), cut AS (
  SELECT DISTINCT doc_id, pos + unnest([0, 1, 2]) AS pos FROM good WHERE k > 1
), kept AS (
  SELECT l.doc_id, string_agg(l.l, chr(10) ORDER BY l.pos) AS text, count(*) AS n
  FROM line l ANTI JOIN cut c ON l.doc_id = c.doc_id AND l.pos = c.pos GROUP BY l.doc_id
)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
  CAST(len(string_split(d.text, chr(10))) AS BIGINT) AS n_lines,
  CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) - coalesce(k.n, 0) END AS BIGINT) AS n_removed
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
