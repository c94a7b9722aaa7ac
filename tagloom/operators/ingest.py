"""Pages to the nodes table: one pass, one row a node, in preorder."""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tree import ELEMENT, KINDS, MAX_DEPTH, MAX_NODES, ROOT, CapacityError, Row, checksum, is_standard, parse_rows_of

NODES = (
    "pos long, key string, idx int, end_idx int, parent int, prev_el int, next_el int, depth int, kind string, tag string, is_std boolean, id string, "
    "classes array<string>, attrs array<struct<name:string,value:string>>, sib_ord int, sib_rev int, type_ord int, type_rev int, n_child_el int, "
    "text string, raw boolean, checksum long, parse_error string"
)
_PAIR = pa.struct([("name", pa.string()), ("value", pa.string())])
_COLUMNS = [c.split()[0] for c in NODES.replace("struct<name:string,value:string>", "struct").split(", ")]


def _lists(values: list[list | None], kind: pa.DataType, flat: pa.Array) -> pa.Array:
    """A list array of flat cut into the lengths of values, null where a value is None."""
    lengths = [len(x) if x else 0 for x in values]
    offsets = np.zeros(len(values) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), flat, pa.list_(kind), mask=pa.array([x is None for x in values], pa.bool_()))


def as_batch(pages: list[tuple[int, str, tuple[list[Row], list[int]], str | None]]) -> pa.RecordBatch:
    """(pos, key, rows and ends, parse_error) of pages as rows of the nodes table; places among siblings are computed for all pages at once."""
    sizes = np.array([len(rows) for _, _, (rows, _), _ in pages], np.int64)
    starts = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(pages)), sizes)
    kind, tag, parent, depth, attrs, classes, text, raw = zip(*(r for _, _, (rows, _), _ in pages for r in rows), strict=True) if pages else [()] * 8
    n, kind = len(kind), np.array(kind, np.int8)
    base = np.repeat(starts, sizes)

    def by_page(values: list, of_type: pa.DataType) -> pa.Array:
        return pa.array(values, of_type).take(pa.array(of))

    def at_root(values: list, of_type: pa.DataType) -> pa.Array:
        out: list = [None] * n
        for start, v in zip(starts.tolist(), values, strict=True):
            out[start] = v
        return pa.array(out, of_type)

    tags = pa.array(tag, pa.string())
    coded = tags.dictionary_encode()
    standard = pa.array([is_standard(t) for t in coded.dictionary.to_pylist()], pa.bool_()).take(coded.indices)
    own = np.nonzero(kind == ELEMENT)[0]
    above = np.array([parent[i] for i in own.tolist()], np.int64) + base[own]
    names = coded.indices.to_numpy(zero_copy_only=False)[own].astype(np.int64)

    def places(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of elements, grouped by keys in document order: place from the start, from the end, and the order itself."""
        order = np.lexsort((own, *keys))
        new = np.ones(len(order), bool)
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
        first = np.nonzero(new)[0]
        size = np.diff(np.append(first, len(order)))
        at = np.arange(len(order)) - np.repeat(first, size)
        forth, back = np.empty(len(order), np.int32), np.empty(len(order), np.int32)
        forth[order], back[order] = at + 1, np.repeat(size, size) - at
        return forth, back, order

    def spread(values: np.ndarray, missing: np.ndarray | None = None) -> pa.Array:
        """int32 at the elements, null elsewhere and where missing."""
        out, null = np.zeros(n, np.int32), np.ones(n, bool)
        out[own], null[own] = values, False if missing is None else missing
        return pa.array(out, pa.int32(), mask=null)

    forth, back, order = places(above)
    type_forth, type_back, _ = places(names, above)
    local = (own - base[own]).astype(np.int32)
    before, after = np.zeros(len(own), np.int32), np.zeros(len(own), np.int32)
    before[order[1:]], after[order[:-1]] = local[order[:-1]], local[order[1:]]

    pairs = [a for x in attrs if x for a in x]
    flat = pa.StructArray.from_arrays([pa.array([a for a, _ in pairs], pa.string()), pa.array([v for _, v in pairs], pa.string())], fields=list(_PAIR))
    columns = {
        "pos": by_page([p for p, _, _, _ in pages], pa.int64()),
        "key": by_page([k for _, k, _, _ in pages], pa.string()),
        "idx": pa.array((np.arange(n) - base).astype(np.int32)),
        "end_idx": pa.array([e for _, _, (_, ends), _ in pages for e in ends], pa.int32()),
        "parent": pa.array(parent, pa.int32()),
        "prev_el": spread(before, forth == 1),
        "next_el": spread(after, back == 1),
        "depth": pa.array(depth, pa.int32()),
        "kind": pa.array(KINDS).take(pa.array(kind)),
        "tag": tags,
        "is_std": pc.if_else(pa.array(kind == ELEMENT), standard, pa.scalar(None, pa.bool_())),
        "id": pa.array([next((v for a, v in x if a == "id"), None) if x else None for x in attrs], pa.string()),
        "classes": _lists(classes, pa.string(), pa.array([c for x in classes if x for c in x], pa.string())),
        "attrs": _lists(attrs, _PAIR, flat),
        "sib_ord": spread(forth),
        "sib_rev": spread(back),
        "type_ord": spread(type_forth),
        "type_rev": spread(type_back),
        "n_child_el": pa.array(np.bincount(above, minlength=n).astype(np.int32)),
        "text": pa.array(text, pa.string()),
        "raw": pa.array(raw, pa.bool_()),
        "checksum": at_root([None if error else checksum(rows) for _, _, (rows, _), error in pages], pa.int64()),
        "parse_error": at_root([error for _, _, _, error in pages], pa.string()),
    }
    return pa.RecordBatch.from_arrays([columns[c] for c in _COLUMNS], names=_COLUMNS)


def _page(source: str | None, *limits) -> tuple[tuple[list[Row], list[int]], str | None]:
    """The rows of a page, or its root's alone and why it can't be parsed."""
    try:
        if source is None:
            raise ValueError("no html")
        return parse_rows_of(source, *limits), None
    except (CapacityError, ValueError) as e:
        return ([(ROOT, "[document]", None, 0, None, None, None, False)], [1]), str(e)


def parse_docs(pages: DataFrame, max_nodes: int = MAX_NODES, max_depth: int = MAX_DEPTH, strict_end: bool = False, bare_references: bool = True, chunk: int = 20_000) -> DataFrame:
    """(pos, key, checksum, n_nodes, parse_error): what the roots' rows of parse_rows say, for questions that need no nodes; these aren't laid out then."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = []
            for source in batch.column("html").to_pylist():
                (rows, _), error = _page(source, strict_end, max_nodes, max_depth, bare_references)
                said.append((None if error else checksum(rows), len(rows), error))
            sums, sizes, errors = zip(*said, strict=True) if said else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("pos"), batch.column("key"), pa.array(sums, pa.int64()), pa.array(sizes, pa.int32()), pa.array(errors, pa.string())], names=["pos", "key", "checksum", "n_nodes", "parse_error"])

    return pages.select("pos", "key", "html").mapInArrow(run, "pos long, key string, checksum long, n_nodes int, parse_error string")


def parse_rows(pages: DataFrame, max_nodes: int = MAX_NODES, max_depth: int = MAX_DEPTH, strict_end: bool = False, bare_references: bool = True, chunk: int = 20_000) -> DataFrame:
    """pages(pos long, key string, html string) -> the nodes table.

    A page that can't be parsed, null or over capacity, is its root row alone, with parse_error. The root's row carries the
    page's checksum; its end_idx is the number of nodes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsed, size = [], 0
        collects = gc.isenabled()
        gc.disable()  # rows are many small objects without cycles
        try:
            for batch in batches:
                for pos, key, source in zip(*(batch.column(c).to_pylist() for c in ("pos", "key", "html")), strict=True):
                    page, error = _page(source, strict_end, max_nodes, max_depth, bare_references)
                    parsed.append((pos, key, page, error))
                    size += len(page[0])
                    if size >= chunk:
                        yield as_batch(parsed)
                        parsed, size = [], 0
            if parsed:
                yield as_batch(parsed)
        finally:
            if collects:
                gc.enable()

    return pages.select("pos", "key", "html").mapInArrow(run, NODES)


REPEATS = 1_000_000  # rows with a repeated key: as many ids as a broadcast may hold


def first_by_key(pages: DataFrame, order: str = "pos") -> DataFrame:
    """Of rows with one key, the first by a column of distinct values; before the parse, so that repeats cost nothing. Null keys are dropped.

    Keys alone are dealt out to find the repeats. While those are few, their ids are broadcast and the bodies stay where they
    are; beyond REPEATS the bodies are dealt by key.
    """
    pages = pages.where("key is not null")
    ids = pages.select("key", order)
    firsts = ids.groupBy("key").agg(F.min(order).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    late = ids.join(firsts, "key").where(F.col(order) > F.col("_first")).select(order)
    if late.limit(REPEATS + 1).count() <= REPEATS:
        return pages.join(F.broadcast(late), order, "left_anti")
    return first_of_each(pages, order)


def without_keys(pages: DataFrame, known: DataFrame, order: str | None) -> DataFrame:
    """The pages whose key isn't in known(key). With an order, a column of distinct values, keys alone are dealt out and bodies stay, as in first_by_key."""
    known = known.select("key")
    if order is not None:
        old = pages.select("key", order).join(known, "key", "left_semi").select(order)
        if old.limit(REPEATS + 1).count() <= REPEATS:
            return pages.join(F.broadcast(old), order, "left_anti")
    return pages.join(known, "key", "left_anti")


def first_of_each(pages: DataFrame, order: str) -> DataFrame:
    own = Window.partitionBy("key").orderBy(order)
    return pages.where("key is not null").withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n")
