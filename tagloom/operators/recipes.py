"""Questions that corpora of web pages are asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.compile import attribute_value, select
from .corpus import Corpus

_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def link_domains(corpus: Corpus, first: int = 20, external_only: bool = True) -> DataFrame:
    """(host, links, pages): hosts that pages link to, by links; external_only: not a page's own host."""
    host = F.lower(F.regexp_extract(F.col("href"), _HOST, 1))
    own = F.lower(F.regexp_extract(F.col("key"), _HOST, 1))
    links = select(corpus.nodes, "a[href]").select("pos", "key", attribute_value("href").alias("href")).select("pos", host.alias("host"), own.alias("own")).where("host <> ''")
    links = links.where("host <> own") if external_only else links
    return links.groupBy("host").agg(F.count("*").alias("links"), F.count_distinct("pos").alias("pages")).orderBy(F.desc("links"), "host").limit(first)


def top_attribute(corpus: Corpus, selector: str, name: str, first: int = 20) -> DataFrame:
    """(value, n, pages): the most frequent values of an attribute."""
    rows = select(corpus.nodes, selector).select("pos", attribute_value(name).alias("value")).where("value is not null")
    return rows.groupBy("value").agg(F.count("*").alias("n"), F.count_distinct("pos").alias("pages")).orderBy(F.desc("n"), "value").limit(first)


def json_ld_types(corpus: Corpus) -> DataFrame:
    """(type, n, pages): @type of JSON-LD blocks, single, listed or in a graph; blocks that aren't JSON don't count."""
    blocks = corpus.texts(select(corpus.nodes, 'script[type="application/ld+json"]').select("pos", "idx", "end_idx", "tag"), "json")
    v = F.try_parse_json("json")
    listed, graph = F.try_variant_get(v, "$", "array<variant>"), F.try_variant_get(v, "$['@graph']", "array<variant>")
    each = blocks.where(v.isNotNull()).select("pos", F.explode(F.concat(F.coalesce(listed, F.array(v)), F.coalesce(graph, F.array().cast("array<variant>")))).alias("v"))
    one, many = F.try_variant_get("v", "$['@type']", "string"), F.try_variant_get("v", "$['@type']", "array<string>")
    kinds = each.select("pos", F.explode(F.coalesce(many, F.array(one))).alias("type")).where("type is not null")
    return kinds.groupBy("type").agg(F.count("*").alias("n"), F.count_distinct("pos").alias("pages"))


def json_ld_share(corpus: Corpus) -> DataFrame:
    """One row: pages, pages with a JSON-LD block, and their share."""
    having = select(corpus.nodes, 'script[type="application/ld+json"]').select("pos").distinct().select(F.lit(0).alias("page"), F.lit(1).alias("has"))
    n = corpus.docs.select(F.lit(1).alias("page"), F.lit(0).alias("has")).union(having).agg(F.coalesce(F.sum("page"), F.lit(0)).alias("pages"), F.coalesce(F.sum("has"), F.lit(0)).alias("with_json_ld"))
    return n.withColumn("share", F.col("with_json_ld") / F.nullif(F.col("pages"), F.lit(0)))


def totals(corpus: Corpus, selectors: dict[str, str]) -> DataFrame:
    """One row: matches of each selector, local ones counted in one pass."""
    from ..plans.compile import is_local, local_list
    from ..plans.selector import Selector

    own = {n: Selector(s) for n, s in selectors.items()}
    if all(is_local(s.alternatives) for s in own.values()):
        return corpus.nodes.agg(*(F.count_if(local_list(s.alternatives)).alias(n) for n, s in own.items()))
    rows = None
    for n, s in own.items():
        one = select(corpus.nodes, s).select(F.lit(n).alias("name"))
        rows = one if rows is None else rows.union(one)
    return rows.groupBy().pivot("name", list(own)).count().na.fill(0)


def page_audit(corpus: Corpus) -> DataFrame:
    """(pos, key, title, h1, links, paragraphs, images_without_alt) of every page, one pass for the counts and one for the texts."""
    n = corpus.nodes
    image = (F.col("tag") == "img") & ~F.exists(F.coalesce("attrs", F.array().cast("array<struct<name:string,value:string>>")), lambda a: a["name"] == "alt")
    counts = n.groupBy("pos", "key").agg(
        F.count_if((F.col("tag") == "a") & F.exists("attrs", lambda a: a["name"] == "href")).alias("links"),
        F.count_if(F.col("tag") == "p").alias("paragraphs"),
        F.count_if(image).alias("images_without_alt"),
    )
    heads = n.where(F.col("tag").isin("title", "h1")).groupBy("pos", "tag").agg(F.min_by(F.struct("idx", "end_idx"), "idx").alias("f")).select("pos", "tag", "f.idx", "f.end_idx")
    said = corpus.texts(heads, "said").groupBy("pos").agg(F.max(F.when(F.col("tag") == "title", F.col("said"))).alias("title"), F.max(F.when(F.col("tag") == "h1", F.col("said"))).alias("h1"))
    return counts.join(said, "pos", "left").select("pos", "key", "title", "h1", "links", "paragraphs", "images_without_alt")


def missing(corpus: Corpus, selector: str) -> DataFrame:
    """(pos, key) of pages without a match."""
    return corpus.docs.select("pos", "key").join(select(corpus.nodes, selector).select("pos"), "pos", "left_anti")


def duplicate_titles(corpus: Corpus) -> DataFrame:
    """(title, n): titles of more than one page."""
    first = corpus.select_first("title").select("pos", "idx", "end_idx", "tag")
    return corpus.texts(first, "title").groupBy("title").agg(F.count("*").alias("n")).where("n > 1")


_SKIP = ("nav", "footer", "aside", "header", "form", "script", "style", "noscript")
_BLOCK = ("p", "li", "pre", "blockquote", "td", "dd")
_HEADINGS = ("h1", "h2", "h3")


def stripped(c: Column) -> Column:
    """Without white space at its ends."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def chunks(corpus: Corpus, most: int = 1200, least: int = 80, root: str = "main, article, [role='main']", fallback: str = "body") -> DataFrame:
    """(pos, key, chunk, heading, text): passages under their h1 to h3, for retrieval.

    Of each page the first `root`, or the first `fallback`, is walked by its elements: navigation and the like are passed over, headings
    start a section, and the texts of blocks (p, li, pre, blockquote, td, dd), taken whole, make it up, joined by spaces. A section of
    `least` characters or fewer is dropped; longer ones are cut every `most` characters. Text outside of blocks doesn't count.
    """
    n = corpus.nodes
    roots = corpus.select_first(root).select("pos", "idx", "end_idx")
    rest = corpus.select_first(fallback).select("pos", "idx", "end_idx").join(roots.select("pos"), "pos", "left_anti")
    top = roots.union(rest).toDF("r_pos", "r_idx", "r_end")
    stops = n.where("kind = 'element'").where(F.col("tag").isin(*_SKIP, *_HEADINGS, *_BLOCK)).select("pos", "key", "idx", "end_idx", "tag")
    inside = stops.join(top, (F.col("pos") == F.col("r_pos")) & (F.col("idx") > F.col("r_idx")) & (F.col("idx") < F.col("r_end")))
    order = Window.partitionBy("pos").orderBy("idx")
    # The walk doesn't enter what it stops at: of nested intervals only the outermost are met.
    reach = F.max("end_idx").over(order.rowsBetween(Window.unboundedPreceding, -1))
    met = inside.withColumn("_reach", reach).where("_reach IS NULL OR idx >= _reach").where(~F.col("tag").isin(*_SKIP)).select("pos", "key", "idx", "end_idx", "tag")
    said = corpus.texts(met, "said").withColumn("said", stripped(F.col("said"))).withColumn("is_heading", F.col("tag").isin(*_HEADINGS))
    marked = said.withColumn("section", F.sum(F.col("is_heading").cast("int")).over(order))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("is_heading") & (F.col("said") != ""), F.struct("idx", "said")))), lambda x: x["said"]), " ")
    made = marked.groupBy("pos", "key", "section").agg(F.coalesce(F.max(F.when(F.col("is_heading"), F.col("said"))), F.lit("")).alias("heading"), text.alias("whole")).where(F.length("whole") > least)
    cut = made.select("pos", "key", "section", "heading", "whole", F.explode(F.sequence(F.lit(0), F.floor((F.length("whole") - 1) / most).cast("int"))).alias("part"))
    place = F.row_number().over(Window.partitionBy("pos").orderBy("section", "part")) - 1
    return cut.select("pos", "key", place.alias("chunk"), "heading", F.substr("whole", F.col("part") * most + 1, F.lit(most)).alias("text"))


def paragraphs(corpus: Corpus, inside: str = "article p, main p", fallback: str = "p", least: int = 40) -> DataFrame:
    """(pos, key, text): paragraphs longer than `least` of the main part, or of the whole page where that has none."""
    main = select(corpus.nodes, inside).select("pos", "key", "idx", "end_idx", "tag")
    rest = select(corpus.nodes, fallback).select("pos", "key", "idx", "end_idx", "tag").join(main.select("pos"), "pos", "left_anti")
    said = corpus.texts(main.union(rest), "said").where(F.length(F.trim("said")) > least)
    return said.groupBy("pos", "key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", F.trim("said").alias("said")))), lambda x: x["said"]), "\n").alias("text"))


def first_texts(corpus: Corpus, selector: str = "ol li", first: int = 3) -> DataFrame:
    """(pos, key, values): the first texts of a selector on each page."""
    return corpus.scan_text(selector, ordered=False).withColumn("values", F.slice("values", 1, first))
