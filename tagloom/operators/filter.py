"""Document filters: included and excluded by selectors and keys."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from ..plans.compile import select
from ..plans.selector import Selector


def _css(x) -> tuple[Selector, ...]:
    return tuple(Selector.of(s) for s in ([] if x is None else [x] if isinstance(x, str | Selector) else x))


def _keys(x) -> list[str] | DataFrame | None:
    return x if x is None or isinstance(x, DataFrame) else sorted(set(x))


class Filter:
    """A document stays if the include side is empty or holds, and the exclude side is empty or doesn't.

    A side holds for a document that has a match of every selector and, where keys are given, one of the keys, an iterable or
    a DataFrame with a column key.
    """

    def __init__(self, *, include_css=None, include_keys: Iterable[str] | DataFrame | None = None, exclude_css=None, exclude_keys: Iterable[str] | DataFrame | None = None):
        self.include_css, self.exclude_css = _css(include_css), _css(exclude_css)
        self.include_keys, self.exclude_keys = _keys(include_keys), _keys(exclude_keys)

    @staticmethod
    def rules(spark: SparkSession, include: Iterable[str] = (), exclude: Iterable[str] = ()) -> Filter:
        """From rules as on a command line: css:SELECTOR, words:a,b, or the path of a .tsv file with a key a line."""
        sides = {}
        for name, rules in (("include", include), ("exclude", exclude)):
            css, words, keys = [], set(), None
            for r in rules:
                if r.startswith("css:"):
                    css.append(r[4:])
                elif r.startswith("words:"):
                    words |= {w.strip() for w in r[6:].split(",")}
                elif r.endswith(".tsv"):
                    own = spark.read.text(r).toDF("key")  # read where it is used, never brought to the driver
                    keys = own if keys is None else keys.union(own)
                else:
                    raise ValueError(f"not a rule: {r}")
            if words:
                keys = words if keys is None else keys.union(spark.createDataFrame([(w,) for w in words], "key string"))
            sides |= {f"{name}_css": css, f"{name}_keys": keys}
        return Filter(**sides)

    def apply(self, docs: DataFrame, nodes: DataFrame) -> DataFrame:
        """The rows of docs that stay. A filter of keys alone never reads nodes."""
        spark = docs.sparkSession

        def side(rows: DataFrame, css, keys) -> DataFrame:
            if keys is not None:
                if isinstance(keys, DataFrame):
                    rows = rows.join(keys.select("key").distinct(), "key", "left_semi")
                elif len(keys) <= 1000:
                    rows = rows.where(rows.key.isin(keys))
                else:
                    rows = rows.join(spark.createDataFrame([(k,) for k in keys], "key string"), "key", "left_semi")
            for s in css:
                rows = rows.join(select(nodes, s).select("pos"), "pos", "left_semi")
            return rows

        if self.include_css or self.include_keys is not None:
            docs = side(docs, self.include_css, self.include_keys)
        if self.exclude_css or self.exclude_keys is not None:
            docs = docs.join(side(docs, self.exclude_css, self.exclude_keys).select("pos"), "pos", "left_anti")
        return docs
