"""Near-duplicate documents: min-max hashing, banding, exact confirmation, connected components.

Of every permutation both the least and the greatest value are kept, so `n_values` signature entries cost `n_values / 2`
hash evaluations; either collides for two sets with probability equal to their Jaccard similarity.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import WordHashes, among, dropped, mapped, mixed, written
from .graph import components

P = np.uint64(0x9E3779B97F4A7C15)
BLOCK = 256
BYTES = 32 << 20  # of sets, about so many of a block's members and as many of its queried ones are in a task's memory at once


def shingle_hashes(text: str | None, k: int, cache: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of all words as one where there are fewer; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    width = min(k, len(words))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        out *= P
        out += h[i : len(h) - width + 1 + i]
    return np.unique(mixed(out))


def signer(bands: int, rows: int, seed: int = 7):
    """A function from a set's hashes to its band keys."""
    n = (bands * rows + 1) // 2
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    b = rng.integers(0, 2**63, n, dtype=np.uint64)
    place = np.arange(1, bands + 1, dtype=np.uint64)

    def sign(h: np.ndarray) -> np.ndarray:
        low, high = np.full(n, 2**64 - 1, np.uint64), np.zeros(n, np.uint64)
        for i in range(0, len(h), 1024):
            x = h[i : i + 1024, None] * a + b
            np.minimum(low, x.min(axis=0), out=low)
            np.maximum(high, x.max(axis=0), out=high)
        both = np.concatenate([low, high])[: bands * rows].reshape(rows, bands)  # a band draws on `rows` permutations
        out = place.copy()
        for row in both:
            out = mixed(out * P + row)
        return out

    return sign


def signatures(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    def make():
        cache, sign = WordHashes(), signer(bands, rows)
        from xxhash import xxh3_128_hexdigest

        def each(batch: pa.RecordBatch) -> dict:
            n, digest, keys = [], [], []
            for text in batch.column("text"):
                h = shingle_hashes(text.as_py(), k, cache)
                n.append(len(h))
                digest.append(xxh3_128_hexdigest(h.tobytes()) if len(h) else None)
                keys.append(sign(h).view(np.int64) if len(h) else None)
            flat = np.concatenate([x for x in keys if x is not None]) if any(n) else np.empty(0, np.int64)
            ends = np.cumsum([0] + [bands * (x is not None) for x in keys]).astype(np.int32)
            return {
                "doc_id": batch.column("doc_id"),
                "n_shingles": pa.array(n, pa.int64()),
                "digest": pa.array(digest, pa.string()),
                "keys": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
            }

        return each

    return mapped(docs.select("doc_id", "text"), "doc_id long, n_shingles long, digest string, keys array<long>", make)


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """(rep, hashes binary) of documents."""

    def make():
        cache = WordHashes()

        def each(batch: pa.RecordBatch) -> dict:
            sets = [shingle_hashes(x.as_py(), k, cache).tobytes() for x in batch.column("text")]
            return {"rep": batch.column("doc_id"), "hashes": pa.array(sets, pa.binary())}

        return each

    return mapped(docs.select("doc_id", "text"), "rep long, hashes binary", make)


def _common_size(x: np.ndarray, y: np.ndarray) -> int:
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum())


def confirmed(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b, x, y: hashes) -> the (a, b) with 100 * |x and y| >= percent * |x or y|."""

    def make():
        def each(batch: pa.RecordBatch) -> dict:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                near = 100 * min(len(x), len(y)) >= percent * max(len(x), len(y))
                both = _common_size(x, y) if near else 0
                keep.append(near and 100 * both >= percent * (len(x) + len(y) - both))
            keep = pa.array(keep, pa.bool_())
            return {n: batch.column(n).filter(keep) for n in "ab"}

        return each

    return mapped(pairs, "a long, b long", make)


def block_links(rows: list[tuple[int, int, bool, pa.Buffer | bytes]], percent: int) -> list[tuple[int, int]]:
    """Links between members of different components, as a spanning forest. rows: (rep, component, queried, hashes).

    Only pairs with one queried member at least are compared: the others are members of one component already. Overlaps of
    a slice of members come from one matrix product over the shingles that they share, so memory depends on the slice.
    """
    rows = [v for _, v in sorted({r[:3]: r for r in rows}.items())]
    sets = [np.frombuffer(r[3], np.uint64) for r in rows]
    sizes = np.array([len(s) for s in sets])
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    asked = [i for i, r in enumerate(rows) if r[2]]
    out = []
    for lo in range(0, len(asked), BLOCK):
        q = asked[lo : lo + BLOCK]
        vocabulary = np.unique(np.concatenate([sets[i] for i in q]))
        for at in range(0, len(rows), BLOCK):
            m = range(at, min(at + BLOCK, len(rows)))
            both = np.zeros((len(q), len(m)), np.float32)
            for part in range(0, len(vocabulary), 8192):
                own = vocabulary[part : part + 8192]

                def bits(which, own=own):
                    out = np.zeros((len(which), len(own)), np.float32)
                    for r, i in enumerate(which):
                        at = np.searchsorted(own, sets[i])
                        at[at == len(own)] = 0
                        out[r, at[own[at] == sets[i]]] = 1
                    return out

                both += bits(q) @ bits(m).T
            either = sizes[q][:, None] + sizes[list(m)][None, :] - both
            for i, j in zip(*np.nonzero(100 * both >= percent * either), strict=True):
                a, b = find(rows[q[i]][1]), find(rows[m[j]][1])
                if a != b:
                    root[max(a, b)] = min(a, b)
                    out.append((rows[q[i]][0], rows[m[j]][0]))
    return out


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = 40, rows: int = 5) -> DataFrame:
    """docs(doc_id long, text) -> (doc_id, n_shingles, component_id, kept), a row for each row of docs.

    A document's set is its distinct k-word shingles (A-Z lowered, words split at ASCII white space). Documents link if
    100 * |A and B| >= percent * |A or B|; component_id is the least doc_id that links reach and kept marks that document.
    Candidates come from `bands` bands of `rows` min-max values (a pair at 0.8 is missed with probability 1.3e-7); every link
    is confirmed on full sets of 64-bit shingle hashes.

    Copies (equal sets) meet in an aggregate first and only the least doc_id goes on. In each band group, all members are
    compared with its least member: as many rows as members. What that leaves open, pairs of members in different
    components, is then compared in blocks, of which a task holds a bounded number of rows and bytes; of bands with the same
    members one counts. No pair is left out and none is written out unless it joins two components.

    Null, empty and wordless texts: an empty set, linked with nothing. Fewer than k words: one shingle of them all. A null
    doc_id: component_id null, kept true, linked with nothing. Rows that share a doc_id count as one document. Other columns of docs are
    ignored; an empty table gives no rows.
    """
    sig = written(signatures(docs, k, bands, rows))
    known = sig.where("doc_id is not null and digest is not null")
    reps = known.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))

    # One row of each set: its copies never reach the bands.
    first = known.select(F.col("doc_id").alias("rep"), "n_shingles", "keys").join(reps.select("rep"), "rep", "left_semi")
    banded = first.select("rep", (8 * F.col("n_shingles")).alias("size"), F.explode("keys").alias("key"))
    groups = banded.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("other")).where("pivot < other")
    members = written(banded.join(groups.select("key", "pivot"), "key").where("rep <> pivot"))
    pairs = written(members.select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct())
    wanted = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b"))
    sets = written(shingle_sets(among(docs.select("doc_id", "text"), wanted)[0], k))

    left = pairs.join(sets.select(F.col("rep").alias("a"), F.col("hashes").alias("x")), "a")
    links = written(confirmed(left.join(sets.select(F.col("rep").alias("b"), F.col("hashes").alias("y")), "b").select("a", "b", "x", "y"), percent))
    found = components(links)

    # Open: band groups whose members, the pivot aside, are in several components.
    placed = written(
        members.join(found.withColumnRenamed("node", "rep"), "rep", "left")
        .select("key", "rep", "size", F.coalesce("component", "rep").alias("component"))
    )
    who = [F.sum(F.xxhash64(F.lit(i), "rep").cast("decimal(20,0)")).alias(f"w{i}") for i in (0, 1)]
    sized = placed.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("size").alias("b"), *who)
    open_ = (
        sized.groupBy("key")
        .agg(
            F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("parts"), F.max("n").alias("n_main"), F.max_by("b", F.struct("n", "component")).alias("b_main"),
            F.sum("n").alias("n_all"), F.sum("b").alias("b_all"), F.sum("w0").alias("w0"), F.sum("w1").alias("w1"),
        )
        .where("parts > 1")
    )
    # Of bands that brought the same members together, one: near documents share many bands, and would be compared in each.
    open_ = open_.join(open_.groupBy("w0", "w1", "n_all").agg(F.min("key").alias("key")).select("key"), "key", "left_semi")
    unsolved = written(
        placed.join(open_, "key").select(
            "key", "rep", "component",
            (F.col("component") != F.col("main")).alias("queried"),
            F.ceil(F.greatest(F.col("n_all") / (16 * BLOCK), F.col("b_all") / BYTES)).cast("int").alias("blocks"),
            F.ceil(F.greatest((F.col("n_all") - F.col("n_main")) / (4 * BLOCK), (F.col("b_all") - F.col("b_main")) / BYTES)).cast("int").alias("q_blocks"),
        )
    )
    if not unsolved.isEmpty():
        # A member goes, as one of all, to one block for each block of queried members; a queried member also to every block.
        as_member = unsolved.select(
            "key", "rep", "component", F.lit(False).alias("queried"),
            F.pmod(F.xxhash64("rep"), "blocks").alias("i"), F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)).alias("j"),
        )
        as_query = unsolved.where("queried").select(
            "key", "rep", "component", "queried",
            F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("i"), F.pmod(F.xxhash64("rep", F.lit(1)), "q_blocks").cast("int").alias("j"),
        )
        units = as_member.union(as_query).join(sets, "rep")

        def solve(table):
            hashes = [x.as_buffer() for x in table.column("hashes")]  # views of the batch, not copies
            got = block_links(list(zip(*(table.column(c).to_pylist() for c in ("rep", "component", "queried")), hashes, strict=True)), percent)
            return pa.table({"a": pa.array([x[0] for x in got], pa.int64()), "b": pa.array([x[1] for x in got], pa.int64())})

        more = written(units.groupBy("key", "i", "j").applyInArrow(solve, "a long, b long"))
        found = components(links.union(more))

    joined = written(reps.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("digest", "copies", F.coalesce("component", "rep").alias("component")))
    dropped(members, pairs, sets, placed, unsolved)
    # Sets with so many copies that they would weigh on a task are few, and their rows stay where they are; rows without a set are spread by id.
    bar = 1 + sig.count() // (4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    common = joined.where(F.col("copies") > bar).select("digest", F.col("component").alias("common"))
    out = sig.select("doc_id", "n_shingles", "digest").join(F.broadcast(common), "digest", "left")  # fewer rows than 4 * partitions
    apart = F.when(F.col("common").isNull(), F.col("digest"))
    out = out.withColumn("digest", F.coalesce(apart, F.col("doc_id").cast("string"))).join(joined.where(F.col("copies") <= bar).drop("copies"), "digest", "left")
    own = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("common", "component", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w
), r AS (SELECT s.s AS s, min(doc_id) AS rep FROM (SELECT doc_id, list_sort(s) AS s FROM s) s WHERE len(s) > 0 GROUP BY ALL
), u AS (SELECT rep, len(s) AS n, unnest(s) AS x FROM r
), links AS (
  SELECT a.rep AS a, b.rep AS b FROM u a JOIN u b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (SELECT a AS node, a AS c FROM e UNION SELECT e.b, reach.c FROM reach JOIN e ON e.a = reach.node
), comp AS (SELECT node, min(c) AS c FROM reach GROUP BY node)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(comp.c, r.rep, s.doc_id) AS component_id,
  s.doc_id = coalesce(comp.c, r.rep, s.doc_id) AS kept
FROM s LEFT JOIN r ON list_sort(s.s) = r.s LEFT JOIN comp ON comp.node = r.rep
"""
