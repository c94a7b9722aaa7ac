"""python -m tagloom.cli VERB ...: questions of corpora and their making, from a shell."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession

from .operators import probe as probing
from .operators import stats
from .operators.corpus import Corpus, parse_pages
from .operators.filter import Filter
from .session import session
from .sources import readers, sinks


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tagloom")
    verbs = top.add_subparsers(dest="verb", required=True)

    def verb(name: str, *positional: str, kept: bool = False, written: bool = False) -> argparse.ArgumentParser:
        p = verbs.add_parser(name)
        for x in positional:
            p.add_argument(x)
        if kept:
            p.add_argument("-i", "--include", action="append", default=[], help="css:SELECTOR, words:a,b or FILE.tsv")
            p.add_argument("-x", "--exclude", action="append", default=[])
        if written:
            p.add_argument("--raw-html", action="store_true")
            p.add_argument("--to-folder")
        return p

    verb("list", "source", kept=True, written=True).add_argument("-c", "--count", type=int)
    verb("probe", "source", kept=True).add_argument("-p", "--probe", action="append", required=True, help="'css => Format[attribute]@words'")
    verb("diff", "source", "other", written=True)
    verb("pack", "source").add_argument("-o", "--output", required=True)
    for name, more in (("sources", ()), ("extract", ("key",)), ("convert", ("output",)), ("stats", ())):
        p = verb(name, "input", *more)
        p.add_argument("--format", choices=["dir", "warc", "zim"])
        if name in ("convert", "stats"):
            p.add_argument("--limit", type=int)
        if name == "convert":
            p.add_argument("--list")
    return top


def _lines(rows: DataFrame, column: str = "key"):
    for r in rows.toLocalIterator():
        print(r[column])


def _pages(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    return readers.source(spark, a.input, a.format, getattr(a, "list", None), getattr(a, "limit", None))


def _converted(pages: DataFrame) -> Corpus:
    ordered = "at" in pages.columns  # numbered by the source, repeats gone
    return parse_pages(pages, meta=[c for c in ("fetched", "status") if c in pages.columns], order="at" if ordered else None, unique=ordered)


def main(words: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = arguments().parse_args(words)
    spark = spark or session()
    if a.verb == "list":
        c = readers.open_any(spark, a.source)
        own = c.listing(Filter.rules(spark, a.include, a.exclude), a.count).persist()
        if a.to_folder:
            sinks.write_html(Corpus(c.docs, c.nodes.join(own.select("pos"), "pos", "left_semi")).html(pretty=not a.raw_html), a.to_folder)
        _lines(own)
        print(f"Found {own.count()} word(s):")
    elif a.verb == "probe":
        c = readers.open_any(spark, a.source)
        print(probing.rendered(probing.probe(c, a.probe, Filter.rules(spark, a.include, a.exclude))))
    elif a.verb == "diff":
        old, new = readers.open_any(spark, a.source), readers.open_any(spark, a.other)
        changed = old.diff(new).persist()
        if a.to_folder:
            for n, c in ((1, old), (2, new)):
                own = c.docs.join(changed.select("key"), "key", "left_semi").select("pos")
                sinks.write_html(Corpus(c.docs, c.nodes.join(own, "pos", "left_semi")).html(pretty=not a.raw_html), a.to_folder, suffix=f".{n}")
        _lines(changed)
    elif a.verb == "pack":
        readers.open_any(spark, a.source).write(a.output)
    elif a.verb == "sources":
        _lines(_pages(spark, a).select("key"))
    elif a.verb == "extract":
        row = _pages(spark, a).where(f"key = {_quoted(a.key)}").select("html").first()
        if row is None:
            print(f"no page {a.key}", file=sys.stderr)
            return 1
        print(row["html"])
    elif a.verb == "convert":
        made = _converted(_pages(spark, a)).write(a.output)
        bad = made.skipped().count()
        print(f"Prepared: {made.count()}\nConverted: {made.count() - bad}\nFailed: {bad}")
    else:
        stats.percentiles(stats.per_page(_converted(_pages(spark, a)))).orderBy("metric", "percentile").show(1000, truncate=False)
    return 0


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


if __name__ == "__main__":
    sys.exit(main())
