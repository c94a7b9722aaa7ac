"""A keyed set of parsed pages and the questions asked of it, each a DataFrame.

docs(pos, key, checksum, n_nodes, parse_error, metadata...) and nodes (operators.ingest.NODES). pos is the place in archive order.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping
from contextlib import contextmanager
from itertools import groupby

import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import serialize
from ..functions.tree import Node, rows_of
from ..plans.compile import attribute_value, has_attribute, select
from ..plans.selector import Selector
from ..session import written
from .document import Document
from .filter import Filter
from .ingest import NODES, as_batch, first_by_key, first_of_each, parse_docs, parse_rows, without_keys

Sel = Selector | str
_PACKED = {"compression": "zstd", "parquet.compression.codec.zstd.level": "1", "parquet.page.row.count.limit": "200000"}  # rows are short and alike: pages of the usual 20,000 cost half as much again to write
SYSTEM = ["pos", "key", "checksum", "n_nodes", "parse_error"]
META_TYPES = {str: T.StringType(), int: T.LongType(), float: T.DoubleType(), bool: T.BooleanType()}


class Corpus:
    """docs and nodes; dealt(n), where it is known, gives nodes in n parts by hash of pos without moving nodes, meta the metadata by pos."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, dealt: Callable[[int], DataFrame] | None = None, meta: DataFrame | None = None):
        self.docs, self.nodes, self._dealt, self._meta = docs, nodes, dealt, meta

    # -- sources and sinks

    @staticmethod
    def open(spark: SparkSession, path: str) -> Corpus:
        """A written corpus: the segments that its pointer names. Nothing but file lists is read now.

        nodes are bucketed by pos: joins and groupings by page, which all selectors and texts come down to, don't shuffle.
        """
        path = _qualified(spark, path)
        buckets, segments = _current(spark, path)
        return Corpus(spark.read.parquet(*(f"{path}/docs/{s}" for s in segments)), _bucketed(spark, path, buckets, segments))

    def write(self, path: str, buckets: int | None = None) -> Corpus:
        """Stored in so many buckets by pos (the session's shuffle partitions), replacing what is there in one step.

        Pages are dealt out before they are parsed, so that is the one time they move.
        """
        spark = self.docs.sparkSession
        path = _qualified(spark, path)
        buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        nodes = self._dealt(buckets) if self._dealt else self.nodes.repartition(buckets, "pos")
        _point(spark, path, buckets, [self._stored(path, nodes, buckets, in_order=bool(self._dealt))])
        return Corpus.open(spark, path)

    def _stored(self, path: str, nodes: DataFrame, buckets: int, like: DataFrame | None = None, in_order: bool = False) -> str:
        """Write nodes and their docs as a new segment, which nothing points to yet; like: docs whose columns the segment's must have.

        in_order: a task has a bucket, and each page's nodes one after the other, so they are written as they come. Sorting them would
        spill: packed, millions of nodes are a few MB, as rows hundreds of bytes each.
        """
        spark, segment = self.docs.sparkSession, uuid.uuid4().hex
        at = f"{path}/nodes/segment={segment}"
        out = nodes.write.format("parquet").bucketBy(buckets, "pos")
        out = out if in_order else out.sortBy("pos", "idx")
        with _set(spark, {"spark.sql.maxConcurrentOutputFileWriters": "8", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"} if in_order else {}):
            out.options(**_PACKED).option("path", at).saveAsTable(f"tagloom_{segment}")
        spark.sql(f"DROP TABLE tagloom_{segment}")  # the catalog's entry; the files stay
        docs = docs_of(spark.read.schema(NODES).parquet(at))
        meta = self._meta if self._meta is not None else self.docs.drop(*(c for c in SYSTEM if c != "pos"))
        if len(meta.columns) > 1:
            docs = docs.join(meta, "pos", "left")
        if like is not None:
            docs = like.limit(0).unionByName(docs, allowMissingColumns=True)
        docs.repartitionByRange("key").sortWithinPartitions("key").write.option("compression", "zstd").parquet(f"{path}/docs/{segment}")
        return segment

    def append(self, path: str, pages: DataFrame, key: str = "key", html: str = "html", meta: Iterable[str] = (), order: str | None = None, on_error: str = "raise") -> Corpus:
        """This corpus, stored at path, with pages added after its own; keys that it has are skipped, of new ones the first counts.

        on_error: "raise" stops at a page that can't be parsed, "skip" leaves it out. Only the new pages are written; a crash leaves the
        old version readable.
        """
        spark, path = self.docs.sparkSession, _qualified(self.docs.sparkSession, path)
        buckets, segments = _current(spark, path)
        base = self.docs.agg(F.coalesce(F.max("pos") + 1, F.lit(0))).first()[0]
        meta = list(meta)
        own = pages.select(F.col(key).cast("string").alias("key"), F.col(html).alias("html"), *meta, *([F.col(order).cast("long").alias("_at")] if order else []))
        more = parse_pages(without_keys(own, self.docs, "_at" if order else None), "key", "html", meta, order="_at" if order else None, base=base)
        nodes = more._dealt(buckets)
        segment = more._stored(path, nodes if on_error == "raise" else nodes.where("parse_error is null"), buckets, like=self.docs, in_order=True)  # a page that failed is one row
        if on_error == "raise":
            bad = spark.read.parquet(f"{path}/docs/{segment}").where("parse_error is not null").select("key", "parse_error").first()
            if bad:
                for name in (f"nodes/segment={segment}", f"docs/{segment}"):
                    fs, at = _fs(spark, f"{path}/{name}")
                    fs.delete(at, True)
                raise ValueError(f"{bad['key']}: {bad['parse_error']}")
        _point(spark, path, buckets, [*segments, segment])
        return Corpus.open(spark, path)

    @staticmethod
    def compact(spark: SparkSession, path: str, buckets: int | None = None) -> Corpus:
        """All segments rewritten as one, in so many buckets (as many as before); nothing is parsed again. The old ones stay until vacuum().

        As many buckets as before are rewritten one by one, without a shuffle or a sort.
        """
        path = _qualified(spark, path)
        own, before = Corpus.open(spark, path), _current(spark, path)[0]
        buckets = buckets or before
        _point(spark, path, buckets, [own._stored(path, own.nodes.repartition(buckets, "pos"), buckets, in_order=buckets == before)])
        return Corpus.open(spark, path)

    @staticmethod
    def segments(spark: SparkSession, path: str) -> int:
        return len(_current(spark, _qualified(spark, path))[1])

    @staticmethod
    def vacuum(spark: SparkSession, path: str) -> int:
        """Delete the segments that the current version doesn't name, and say how many; nobody may be at work on another version."""
        path = _qualified(spark, path)
        _, segments = _current(spark, path)
        own = {f"segment={s}" for s in segments} | set(segments)
        gone = 0
        for part in ("nodes", "docs"):
            fs, at = _fs(spark, f"{path}/{part}")
            for status in fs.listStatus(at):
                if status.getPath().getName() not in own:
                    fs.delete(status.getPath(), True)
                    gone += part == "docs"
        return gone

    def persist(self) -> Corpus:
        """Kept in memory and on disk from the first use on."""
        return Corpus(self.docs.persist(), self.nodes.persist(), self._dealt, self._meta)

    def changed(self, change) -> Corpus:
        """Every page after change(tree), a mutate.Tree; pages are rebuilt one by one on the workers. Pages that couldn't be parsed stay as they are."""
        nodes = changed_rows(self.nodes, change)
        extra = [c for c in self.docs.columns if c not in SYSTEM]
        docs = docs_of(nodes)
        return Corpus(docs.join(self.docs.select("pos", *extra), "pos") if extra else docs, nodes)

    # -- footer questions: docs alone

    def keys(self) -> DataFrame:
        return self.docs.select("pos", "key").orderBy("pos")

    def count(self) -> int:
        return self.docs.count()

    __len__ = count

    def __contains__(self, key: str) -> bool:
        return not self.docs.where(F.col("key") == key).isEmpty()

    def skipped(self) -> DataFrame:
        """Pages that couldn't be parsed, and why."""
        return self.docs.where("parse_error is not null").select("pos", "key", "parse_error").orderBy("pos")

    def meta_schema(self) -> dict[str, type] | None:
        names = {v.typeName(): k for k, v in META_TYPES.items()}
        out = {f.name: names[f.dataType.typeName()] for f in self.docs.schema if f.name not in SYSTEM}
        return out or None

    def meta_table(self) -> DataFrame:
        if self.meta_schema() is None:
            raise ValueError("no metadata")
        return self.docs.select("pos", "key", *(self.meta_schema() or ())).orderBy("pos")

    def lookup(self, key: str | None = None, pos: int | None = None) -> DataFrame:
        """The docs row of a key or a place; negative places count from the end."""
        if key is not None:
            return self.docs.where(F.col("key") == key)
        if pos < 0:
            return self.docs.orderBy(F.desc("pos")).offset(-pos - 1).limit(1)
        return self.docs.where(F.col("pos") == pos)

    def doc(self, key: str | None = None, pos: int | None = None) -> Document | None:
        """One page, rebuilt from its rows; None if there is none."""
        row = self.lookup(key, pos).first()
        if row is None:
            return None
        rows = self.nodes.where(F.col("pos") == row["pos"]).orderBy("idx").collect()
        meta = {k: row[k] for k in self.meta_schema() or ()}
        return Document(linked([as_node(r) for r in rows]), row["key"], meta or None)

    get = doc

    def __getitem__(self, at: int | str) -> Document:
        found = self.doc(key=at) if isinstance(at, str) else self.doc(pos=at)
        if found is None:
            raise (KeyError if isinstance(at, str) else IndexError)(at)
        return found

    def __iter__(self) -> Iterator[Document]:
        """Every page in order, a task's pages at a time on the driver: for small corpora; questions of large ones are DataFrames."""
        names = list(self.meta_schema() or ())
        rows = self.nodes.join(self.docs.select("pos", *(F.col(m).alias(f"_m_{m}") for m in names)), "pos") if names else self.nodes
        for _, own in groupby(rows.orderBy("pos", "idx").toLocalIterator(), key=lambda r: r["pos"]):
            own = list(own)
            yield Document(linked([as_node(r) for r in own]), own[0]["key"], {m: own[0][f"_m_{m}"] for m in names} or None)

    # -- selection

    def select(self, selector: Sel, within: DataFrame | None = None) -> DataFrame:
        """All matches as rows of nodes; within: matches inside the subtrees of these rows only."""
        found = select(self.nodes, selector)
        if within is not None:
            k = within.select(F.col("pos").alias("k_pos"), F.col("idx").alias("k_idx"), F.col("end_idx").alias("k_end"))
            found = found.join(k, (F.col("pos") == F.col("k_pos")) & (F.col("idx") > F.col("k_idx")) & (F.col("idx") < F.col("k_end")), "left_semi")
        return found

    def texts(self, rows: DataFrame, column: str = "text_content") -> DataFrame:
        """Distinct rows with the text of each: all text nodes inside, those in script and style only if the row is one; "" if there are none."""
        t = self.nodes.where("kind = 'text'").select(F.col("pos").alias("t_pos"), F.col("idx").alias("t_idx"), F.col("text").alias("t_text"), F.col("raw").alias("t_raw"))
        own = rows.withColumn("r_raw", F.coalesce(F.col("tag").isin("script", "style"), F.lit(False)))
        inside = (F.col("pos") == F.col("t_pos")) & (F.col("t_idx") > F.col("idx")) & (F.col("t_idx") < F.col("end_idx")) & (F.col("r_raw") | ~F.col("t_raw"))
        pieces = F.collect_list(F.when(F.col("t_idx").isNotNull(), F.struct("t_idx", "t_text")))
        said = F.array_join(F.transform(F.sort_array(pieces), lambda x: x["t_text"]), "")
        # The other columns travel through the aggregate, so that there is no second join to bring them back.
        rest = [F.first(c).alias(c) for c in rows.columns if c not in ("pos", "idx")]
        return own.join(t, inside, "left").groupBy("pos", "idx").agg(*rest, said.alias(column)).select(*rows.columns, column)

    def own_texts(self, rows: DataFrame, column: str = "own_text") -> DataFrame:
        """rows with the text directly in each; null if there is none."""
        t = self.nodes.where("kind = 'text'").select("pos", F.col("parent").alias("idx"), F.col("idx").alias("t_idx"), F.col("text").alias("t_text"))
        said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("t_idx", "t_text"))), lambda x: x["t_text"]), "")
        return rows.join(t.groupBy("pos", "idx").agg(said.alias(column)), ["pos", "idx"], "left")

    def ancestors(self, rows: DataFrame) -> DataFrame:
        """(pos, idx, ancestor rows' idx, tag, label, depth) of every element around each row."""
        a = self.nodes.where("kind = 'element'").select(
            F.col("pos").alias("a_pos"), F.col("idx").alias("a_idx"), F.col("end_idx").alias("a_end"), F.col("tag").alias("a_tag"), F.col("depth").alias("a_depth"), label().alias("a_label")
        )
        inside = (F.col("pos") == F.col("a_pos")) & (F.col("a_idx") < F.col("idx")) & (F.col("idx") < F.col("a_end"))
        return rows.select("pos", "idx").join(a, inside).select("pos", "idx", "a_idx", "a_tag", "a_label", "a_depth")

    def css_paths(self, rows: DataFrame) -> DataFrame:
        """rows with css_path: labels from the top element down."""
        above = self.ancestors(rows).groupBy("pos", "idx").agg(F.sort_array(F.collect_list(F.struct("a_idx", "a_label"))).alias("_above"))
        names = F.transform(F.coalesce("_above", F.array().cast("array<struct<a_idx:int,a_label:string>>")), lambda x: x["a_label"])
        return rows.join(above, ["pos", "idx"], "left").withColumn("css_path", F.array_join(F.concat(names, F.array(label())), " > ")).drop("_above")

    def markup(self, rows: DataFrame, pretty: bool = False) -> DataFrame:
        """(pos, key, idx, html) of each row's subtree; nodes outside of these go nowhere."""
        own = rows.select("pos", "idx").join(self.nodes.select("pos", "idx", "end_idx"), ["pos", "idx"])
        wanted = own.groupBy("pos").agg(F.sort_array(F.collect_list(F.struct("idx", "end_idx"))).alias("_all"))
        inside = self.nodes.join(wanted, "pos").where(F.exists("_all", lambda w: (F.col("idx") >= w["idx"]) & (F.col("idx") < w["end_idx"])))
        return self._per_page(inside.withColumn("_wanted", F.transform("_all", lambda w: w["idx"])), pretty)

    def html(self, pretty: bool = False) -> DataFrame:
        """(pos, key, html) of each page."""
        return self._per_page(self.nodes.withColumn("_wanted", F.array(F.lit(0))), pretty).drop("idx")

    def _per_page(self, nodes: DataFrame, pretty: bool) -> DataFrame:
        write = serialize.pretty if pretty else serialize.raw

        def run(batches):
            import pyarrow as pa

            out = []
            for rows in pages_of(batches):
                own = [None] * (rows[-1]["idx"] + 1)  # by idx; what no wanted subtree has is left out
                for r in rows:
                    own[r["idx"]] = as_node(r)
                out += [(rows[0]["pos"], rows[0]["key"], i, write(own, i)) for i in rows[0]["_wanted"]]
                if sum(len(x[3]) for x in out[-1:]) > 1 << 20 or len(out) >= 1000:
                    yield _batch(pa, out)
                    out = []
            yield _batch(pa, out)

        columns = ["pos", "key", "idx", "end_idx", "parent", "depth", "kind", "tag", "id", "classes", "attrs", "text", "raw", "_wanted"]
        return by_page(nodes, columns).mapInArrow(run, "pos long, key string, idx int, html string")

    # -- questions of the whole corpus

    def matching(self, what: Sel | Filter, ordered: bool = True) -> DataFrame:
        """(pos, key) of pages with a match, or of those that a filter keeps, in order unless that isn't asked for."""
        if isinstance(what, Filter):
            kept = what.apply(self.docs.select("pos", "key"), self.nodes)
        else:
            kept = select(self.nodes, what).select("pos", "key").distinct()  # nodes carry keys: no join
        return _ordered(kept.select("pos", "key"), ordered)

    def select_first(self, selector: Sel) -> DataFrame:
        """The first match of each page that has one, as rows of nodes."""
        found = select(self.nodes, selector)
        return found.join(found.groupBy("pos").agg(F.min("idx").alias("idx")), ["pos", "idx"], "left_semi")

    def bodies(self) -> DataFrame:
        return self.select_first("body")

    def select_children(self, rows: DataFrame, selector: Sel) -> DataFrame:
        k = rows.select(F.col("pos").alias("k_pos"), F.col("idx").alias("k_idx"))
        return select(self.nodes, selector).join(k, (F.col("pos") == F.col("k_pos")) & (F.col("parent") == F.col("k_idx")), "left_semi")

    def select_counts(self, selector: Sel, attr: str | None = None) -> DataFrame:
        """(pos, key, n) of pages with a match; attr: only elements that have it count."""
        found = select(self.nodes, selector)
        if attr:
            found = found.where(has_attribute(attr))
        return found.groupBy("pos", "key").agg(F.count("*").alias("n"))

    def counted(self, selector: Sel, attr: str | None = None) -> DataFrame:
        """One row: n, of all matches."""
        found = select(self.nodes, selector)
        return (found.where(has_attribute(attr)) if attr else found).agg(F.count("*").alias("n"))

    def scan_count(self, selector: Sel, attr: str | None = None) -> int:
        return self.counted(selector, attr).first()["n"]

    def exactly(self, selector: Sel, least: int, most: int | None = None) -> DataFrame:
        """(pos, key, n) of every page; running it fails on a page with fewer or more matches."""
        most = least if most is None else most
        n = F.coalesce("n", F.lit(0))
        counts = self.docs.select("pos", "key").join(self.select_counts(selector).drop("key"), "pos", "left").select("pos", "key", n.alias("n"))
        wrong = F.raise_error(F.concat(F.col("key"), F.lit(": "), F.col("n"), F.lit(f" matches, not {least} to {most}")))
        return counts.withColumn("n", F.when(F.col("n").between(least, most), F.col("n")).otherwise(wrong.cast("long")))

    def scan_text(self, selector: Sel, ordered: bool = True) -> DataFrame:
        """(pos, key, values) of pages with a match: the matches' texts in order."""
        return self._listed(self.texts(select(self.nodes, selector).select("pos", "key", "idx", "end_idx", "tag"), "value"), ordered)

    def scan_attr(self, selector: Sel, name: str, skip_missing: bool = False, ordered: bool = True) -> DataFrame:
        """(pos, key, values): an attribute of each match, null where it is missing, or only those that have it."""
        found = select(self.nodes, selector).select("pos", "key", "idx", attribute_value(name).alias("value"))
        return self._listed(found.where("value is not null") if skip_missing else found, ordered)

    def scan_html(self, selector: Sel, pretty: bool = False, ordered: bool = True) -> DataFrame:
        return self._listed(self.markup(select(self.nodes, selector), pretty).withColumnRenamed("html", "value"), ordered)

    def _listed(self, rows: DataFrame, ordered: bool) -> DataFrame:
        own = F.transform(F.sort_array(F.collect_list(F.struct("idx", "value"))), lambda x: x["value"])
        return _ordered(rows.groupBy("pos", "key").agg(own.alias("values")), ordered)

    def scan_table(self, selector: Sel, text: bool = False, attrs: Iterable[str] | None = None, meta: Iterable[str] | None = None, ordered: bool = True) -> DataFrame:
        """A row a match: pos, idx, key, text if asked for, attributes, metadata; ordered by page and place unless that isn't asked for."""
        attrs, meta = list(attrs or ()), list(meta or ())
        names = ["pos", "idx", "key", *(["text"] if text else []), *attrs, *meta]
        low = [n.lower() for n in names]
        if len(set(low)) < len(low):
            raise ValueError(f"column names collide: {names}")
        if unknown := [m for m in meta if m not in (self.meta_schema() or {})]:
            raise ValueError(f"no metadata {unknown}")
        out = select(self.nodes, selector).select("pos", "idx", "key", "end_idx", "tag", *(attribute_value(a).alias(f"_a{i}") for i, a in enumerate(attrs)))
        if text:
            out = self.texts(out, "_text")
        if meta:
            out = out.join(self.docs.select("pos", *(F.col(m).alias(f"_m{i}") for i, m in enumerate(meta))), "pos")
        columns = [*([F.col("_text").alias("text")] if text else []), *(F.col(f"_a{i}").alias(a) for i, a in enumerate(attrs)), *(F.col(f"_m{i}").alias(m) for i, m in enumerate(meta))]
        return _ordered(out.select("pos", "idx", "key", *columns), ordered, "pos", "idx")

    def diff(self, other: Corpus, ordered: bool = True) -> DataFrame:
        """(pos, key) of other's pages that this corpus has with other content, in other's order unless that isn't asked for: the sort computes them twice."""
        mine = self.docs.select("key", F.col("checksum").alias("_was"))
        return _ordered(other.docs.join(mine, "key").where("NOT checksum <=> _was").select("pos", "key"), ordered)

    def snapshot_diff(self, other: Corpus, selector: Sel = "title") -> DataFrame:
        """(key, change, old, new) of pages added, removed, or with another first text of a selector."""

        def first(c: Corpus, name: str) -> DataFrame:
            said = c.texts(c.select_first(selector).select("pos", "idx", "end_idx", "tag"), name).select("pos", name)
            return c.docs.select("pos", "key").join(said, "pos", "left").select("key", name, F.lit(True).alias(f"has_{name}"))

        both = first(self, "old").join(first(other, "new"), "key", "full")
        change = F.when(F.col("has_old").isNull(), "added").when(F.col("has_new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
        return both.select("key", change.alias("change"), "old", "new").where("change is not null")

    def listing(self, keep: Filter | None = None, first: int | None = None) -> DataFrame:
        """(pos, key) that a filter keeps, in order, the first so many."""
        own = self.matching(keep or Filter())
        return own.limit(first) if first is not None else own


def _ordered(rows: DataFrame, wanted: bool, *by: str) -> DataFrame:
    return rows.orderBy(*(by or ("pos",))) if wanted else rows


def by_page(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """Some columns of nodes, each page's rows together in one task and in order, so that a map over batches can take page after page.

    The row number is there for the distribution and the order that it asks for: in a bucketed corpus both are there already.
    """
    return nodes.withColumn("_row", F.row_number().over(Window.partitionBy("pos").orderBy("idx"))).select(*columns, "_row")


def pages_of(batches) -> Iterator[list[dict]]:
    """The rows of each page, from batches of rows in order of page and place."""
    own: list[dict] = []
    for batch in batches:
        for r in batch.to_pylist():
            if own and r["pos"] != own[0]["pos"]:
                yield own
                own = []
            own.append(r)
    if own:
        yield own


def _batch(pa, rows: list[tuple]):
    columns = list(zip(*rows, strict=True)) if rows else [()] * 4
    types = (pa.int64(), pa.string(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["pos", "key", "idx", "html"])


def changed_rows(nodes: DataFrame, change) -> DataFrame:
    def run(batches):
        from .mutate import Tree

        parsed, size = [], 0
        for rows in pages_of(batches):
            error = rows[0]["parse_error"]
            tree = Tree(linked([as_node(r) for r in rows]))
            if error is None:
                change(tree)
            parsed.append((rows[0]["pos"], rows[0]["key"], rows_of(tree.rebuilt()), error))
            size += len(rows)
            if size >= 20_000:
                yield as_batch(parsed)
                parsed, size = [], 0
        if parsed:
            yield as_batch(parsed)

    columns = [c for c in nodes.columns if c not in ("is_std", "n_child_el", "checksum")]
    return by_page(nodes, columns).mapInArrow(run, NODES)


def label():
    """tag#id.class.class of a node."""
    return F.concat(F.col("tag"), F.coalesce(F.concat(F.lit("#"), F.col("id")), F.lit("")), F.coalesce(F.array_join(F.transform("classes", lambda c: F.concat(F.lit("."), c)), ""), F.lit("")))


def docs_of(nodes: DataFrame) -> DataFrame:
    return nodes.where("idx = 0").select("pos", "key", "checksum", F.col("end_idx").alias("n_nodes"), "parse_error")


def as_node(r: Mapping) -> Node:
    r = r if isinstance(r, dict) else r.asDict()
    attrs = r["attrs"]
    out = Node(r["idx"], r["kind"], r["tag"], r["parent"], r["depth"], None if attrs is None else [(a["name"], a["value"]) for a in attrs], r["classes"] and list(r["classes"]), r["text"], bool(r["raw"]), r["end_idx"])
    for name in ("prev_el", "next_el", "sib_ord", "sib_rev", "type_ord", "type_rev"):
        setattr(out, name, r.get(name))
    return out


def linked(nodes: list[Node]) -> list[Node]:
    """Nodes from rows, with their lists of children."""
    for x in nodes:
        if x.kind == "element":
            nodes[x.parent].children.append(x.idx)
    return nodes


def parse_pages(pages: DataFrame, key: str = "key", html: str = "html", meta: Iterable[str] = (), order: str | None = None, base: int = 0, unique: bool = False, spread: int | None = None, **limits) -> Corpus:
    """Pages of any DataFrame. order: a column of distinct whole numbers that gives pos, plus base; else pages are numbered by key.

    Repeated keys: the first by order counts; unique=True promises that there are none. meta: columns to carry, of type string, long, double or
    boolean. spread: deal the bodies out into so many parts before they are parsed, for inputs in fewer files than there are cores.
    """
    meta = list(meta)
    if bad := [m for m in meta if m in SYSTEM or pages.schema[m].dataType not in META_TYPES.values()]:
        raise ValueError(f"not usable as metadata: {bad}")
    rows = pages.select(F.col(key).cast("string").alias("key"), F.col(html).alias("html"), *meta, *([F.col(order).cast("long").alias("_order")] if order else []))
    if order:
        own = rows.withColumn("pos", F.col("_order") + base).drop("_order")
        own = own if unique else first_by_key(own)
    else:
        own = first_of_each(rows.withColumn("_h", F.xxhash64("html")), "_h").drop("_h")
        own = own.join(_numbered(rows.where("key is not null").select("key").distinct(), base), "key")  # bodies are dealt by key already
    bodies = own.repartition(spread) if spread else own
    nodes = parse_rows(bodies, **limits)
    docs, extra = parse_docs(bodies, **limits), own.select("pos", *meta)
    return Corpus(docs.join(extra, "pos") if meta else docs, nodes, lambda n: parse_rows(own.repartition(n, "pos").sortWithinPartitions("pos"), **limits), extra)


def _numbered(keys: DataFrame, base: int) -> DataFrame:
    """keys(key), distinct -> (key, pos): pos = rank, plus base. Keys alone are sorted, in ranges, and written with their places in those."""
    sorted_ = keys.repartitionByRange("key").sortWithinPartitions("key").select("key", F.monotonically_increasing_id().alias("_at"))
    placed = written(sorted_).withColumn("_part", F.shiftright("_at", 33))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a range, so one task may order them
    before = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_from"))
    rank = F.col("_from") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(starts), "_part").select("key", (rank + base).alias("pos"))


# -- versions on any file system Spark reads


@contextmanager
def _set(spark: SparkSession, conf: dict[str, str]) -> Iterator[None]:
    """conf holds meanwhile."""
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def _qualified(spark: SparkSession, path: str) -> str:
    fs, at = _fs(spark, path)
    return fs.makeQualified(at).toString()


def _current(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """Number of buckets and segments of the current version."""
    buckets, *segments = spark.read.text(f"{path}/CURRENT", wholetext=True).first()[0].split()
    return int(buckets), segments


def _bucketed(spark: SparkSession, path: str, buckets: int, segments: list[str]) -> DataFrame:
    """The nodes of some segments as a catalog table, named by what it holds: only those have their buckets made use of."""
    name = f"tagloom_{xxhash.xxh3_128_hexdigest(repr((path, buckets, segments)))}"
    if not spark.catalog.tableExists(name):
        place = path.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({NODES}, segment string) USING parquet PARTITIONED BY (segment) CLUSTERED BY (pos) INTO {buckets} BUCKETS LOCATION '{place}/nodes'")
        for s in segments:
            spark.sql(f"ALTER TABLE {name} ADD IF NOT EXISTS PARTITION (segment = '{s}') LOCATION '{place}/nodes/segment={s}'")
    return spark.table(name).drop("segment")


def _point(spark: SparkSession, path: str, buckets: int, segments: list[str]) -> None:
    """Name what the current version holds: a file written aside, then one rename."""
    fs, temp = _fs(spark, f"{path}/CURRENT-{uuid.uuid4().hex}")
    out = fs.create(temp)
    out.write(bytearray("\n".join([str(buckets), *segments]).encode()))
    out.close()
    to = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/CURRENT")
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), spark._jsparkSession.sessionState().newHadoopConf())
    overwrite = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = overwrite
    context.rename(temp, to, options)
