"""Named queries over pages made of the customer and orders tables, in a corpus that was stored, appended to and compacted.

A page lists a customer's orders, so the SQL that says the same is about the tables alone and knows nothing of markup.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mutate, recipes, stats
from ..operators.corpus import Corpus, label, parse_pages
from ..operators.filter import Filter
from ..session import shared_place
from .catalog import stored
from .compile import is_local, local_list
from .selector import Selector

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}

# o: orders, the i-th of n of a customer; c: customers with their number of orders and of distinct values.
_WITH = """
WITH o AS (
  SELECT o_custkey AS ck, o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS p, row_number() OVER w AS i, count(*) OVER (PARTITION BY o_custkey) AS n,
    lag(o_orderstatus) OVER w AS before, lead(o_orderstatus) OVER w AS after, bool_or(o_orderstatus = 'F') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f_before
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)
), c AS (
  SELECT c_custkey AS ck, 'cust/' || c_custkey AS key, c_name AS name, lower(c_mktsegment) AS seg, c_nationkey AS nation, coalesce(n, 0) AS n, coalesce(ds, 0) AS ds, coalesce(dp, 0) AS dp,
    coalesce(dk, 0) AS dk, coalesce(dl, 0) AS dl, said, CASE WHEN c_custkey % 5 <> 0 THEN c_custkey ELSE (SELECT max(c_custkey) FILTER (c_custkey % 5 <> 0) FROM customer) + 1 + c_custkey END AS pos
  FROM customer LEFT JOIN (
    SELECT ck, count(*) AS n, count(DISTINCT s) AS ds, count(DISTINCT p) AS dp, count(DISTINCT k % 1000) AS dk, count(DISTINCT k % 3) AS dl, string_agg(k || ' ' || p || ' ' || s, ' ' ORDER BY k) AS said
    FROM o GROUP BY ck) ON c_custkey = ck
)
"""


def _query(sql: str):
    def add(f: Callable) -> Callable:
        _QUERIES[f.__name__] = f
        _SQL[f.__name__] = _WITH + sql
        return f

    return add


def buckets(spark: SparkSession, sf_dir: str) -> int:
    """So many that a bucket has about half a million nodes, which a task can sort in memory: some 36 a customer and 9 an order; the session's number at least."""
    customers, orders = (spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("customer", "orders"))
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(36 * customers + 9 * orders) // 500_000))


def pages(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """(ck, key, html, name, nation, half, even) of every customer, in as many parts by hash of ck as nodes take buckets, or in so many.

    Orders meet their customer as figures, and become markup a page at a time. So few bytes move that Spark would otherwise put them into a few tasks.
    """
    parts = parts or buckets(spark, sf_dir)

    def row(o: Column) -> Column:
        k, status, priority = o["o_orderkey"], o["o_orderstatus"], o["o_orderpriority"]
        third = (k % 3).cast("int")
        return F.concat(
            F.lit('<tr id="o'), k, F.lit('" class="row s-'), status, F.lit('" data-p="'), priority, F.lit('" lang="'), F.element_at(F.array(*map(F.lit, ("en-US", "en", "de"))), third + 1),
            F.lit('" align="'), F.element_at(F.array(*map(F.lit, ("Left", "LEFT", "right"))), third + 1), F.lit('"><td>'), k, F.lit('</td><td><b title="&lt;'), status, F.lit('&gt;">'),
            priority, F.lit("</b> "), status, F.lit('</td><td><price-tag cents="'), k % 1000, F.lit('"></price-tag></td></tr>'),
        )

    orders, customers = spark.read.parquet(f"{sf_dir}/orders.parquet"), spark.read.parquet(f"{sf_dir}/customer.parquet")
    orders, customers = orders.repartition(parts, "o_custkey"), customers.repartition(parts, "c_custkey")
    own = orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", "o_orderstatus", "o_orderpriority"))).alias("orders"))
    rows = F.coalesce(F.array_join(F.transform("orders", row), ""), F.lit(""))
    ck = F.col("c_custkey")
    kind = F.when(ck % 3 == 0, "text/plain").otherwise("application/ld+json")
    html = F.concat(
        F.lit("<!DOCTYPE html><html><head><title>"), F.col("c_name"), F.lit("</title></head><body><header><img src=i.png"), F.when(ck % 2 == 0, " alt='x'").otherwise(""), F.lit("><h1>"), F.col("c_name"),
        F.lit('</h1></header><main id="c'), ck, F.lit('" class="customer '), F.lower("c_mktsegment"), F.lit(" "), F.lower("c_mktsegment"), F.lit("  n"), F.col("c_nationkey"), F.lit('" DATA-NATION='), F.col("c_nationkey"),
        F.lit("><h2>Orders</h2><table><tbody>"), rows, F.lit("</tbody></table><h2>Notes</h2><ul><li>alpha"), ck, F.lit("<li>beta</ul><p>"), F.repeat(F.concat(F.lit("word"), ck % 7, F.lit(" ")), (ck % 40 * 10).cast("int")),
        F.lit('</p><svg viewBox="0 0 1 1"><path d="M'), ck, F.lit('"/><![CDATA[a<b]]></svg><!--c'), ck, F.lit('--><div/>tail</main><script type="'), kind, F.lit('">{"@type": "T'), ck % 3, F.lit('"}</script></body></html>'),
    )
    joined = customers.join(own, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select(ck.alias("ck"), F.concat(F.lit("cust/"), ck).alias("key"), html.alias("html"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("long").alias("nation"), (ck / 2).alias("half"), (ck % 2 == 0).alias("even"))


META = ["name", "nation", "half", "even"]


def written_ledger(spark: SparkSession, sf_dir: str, path: str) -> Corpus:
    """Four of five customers stored, then all appended, of which the new ones count, in two segments that are made one; the old ones are deleted."""
    n = buckets(spark, sf_dir)
    every = pages(spark, sf_dir, n)
    first = parse_pages(every.where("ck % 5 <> 0"), meta=META, order="ck").write(path, n)
    first.append(path, every, meta=META, order="ck")
    out = Corpus.compact(spark, path)
    Corpus.vacuum(spark, path)
    return out


def ledger(spark: SparkSession, sf_dir: str) -> Corpus:
    return stored(spark, sf_dir, written_ledger)


def _counts(name: str, what: str, **selectors: str | tuple[str, str]) -> None:
    """A query of (selector, n): the matches of each selector, given as name=(selector, SQL of its number)."""
    own = list(selectors.values())

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = ledger(spark, sf_dir)
        plans = {css: Selector.of(css).alternatives for css, _ in own}
        local = {css: F.count_if(local_list(x)) for css, x in plans.items() if is_local(x)}  # counted in one pass
        rows = [c.counted(css).select(F.lit(css).alias("selector"), "n") for css in plans if css not in local]
        if local:
            counts = c.nodes.agg(*(n.alias(f"n{i}") for i, n in enumerate(local.values())))
            each = F.explode(F.array(*(F.struct(F.lit(css).alias("selector"), F.col(f"n{i}").alias("n")) for i, css in enumerate(local))))
            rows.append(counts.select(each.alias("x")).select("x.selector", "x.n"))
        return reduce(DataFrame.union, rows)

    query.__name__, query.__doc__ = name, what
    _QUERIES[name] = query
    quoted = [(css.replace("'", "''"), sql) for css, sql in own]
    _SQL[name] = _WITH + " UNION ALL ".join(f"SELECT '{css}' AS selector, CAST(({sql}) AS BIGINT) AS n" for css, sql in quoted)


def _o(where: str = "true") -> str:
    return f"SELECT count(*) FROM o WHERE {where}"


def _c(where: str = "true", times: str = "1") -> str:
    return f"SELECT coalesce(sum({times}), 0) FROM c WHERE {where}"


_counts(
    "ledger_types", "Types, custom ones too, the universal selector, ids, classes, lists.",
    a=("tr", _o()), b=("price-tag", _o()), c=("PRICE-tag", _o()), d=("*", _c(times="20 + 6 * n")), e=("main *", _c(times="11 + 6 * n")), f=("#c7", _c("ck = 7")), g=("tr#o12", _o("k = 12")),
    h=(".customer.building", _c("seg = 'building'")), i=("main.n3", _c("nation = 3")), j=("tr.s-F, tr[data-p='1-URGENT'], h1", _o("s = 'F' OR p = '1-URGENT'") + " ) + (" + _c()), k=("svg > path", _c()), l=("main > div", _c()),
    m=("h1, h2, li", _c(times="5")),
)
_counts(
    "ledger_attributes", "All operators on attributes, their flags, default case and literals.",
    a=("tr[data-p]", _o()), b=("tr[data-p='2-HIGH']", _o("p = '2-HIGH'")), c=("[data-p^='1']", _o("p LIKE '1%'")), d=("[data-p$='M']", _o("p LIKE '%M'")), e=("[data-p*='NOT']", _o("p LIKE '%NOT%'")),
    f=("[data-p~='SPECIFIED']", _o("p LIKE '% SPECIFIED'")), g=("tr[lang|='en']", _o("k % 3 < 2")), h=("tr[lang='EN']", _o("k % 3 = 1")), i=("tr[lang='EN' s]", _o("k % 3 = 9")), j=("tr[data-p='2-high' i]", _o("lower(p) = '2-high'")),
    k=("tr[data-p='2-high']", _o("p = '2-high'")), l=("tr[align='left']", _o("k % 3 < 2")), m=("tr[data-p^='']", _o("p = ''")), n=("b[title='&lt;F&gt;']", _o("s = 'F'")), o=("main[data-nation='3']", _c("nation = 3")),
)
_counts(
    "ledger_class_patterns", "Attribute operators on class: its tokens, repeats dropped, joined by single spaces.",
    a=("[class='customer building n3']", _c("seg = 'building' AND nation = 3")), b=("main[class^='customer b']", _c("seg LIKE 'b%'")), c=("[class$='s-F']", _o("s = 'F'")), d=("[class~='s-O']", _o("s = 'O'")),
    e=("[class*='w s-P']", _o("s = 'P'")), f=("[class|='row s']", _o()), g=("[class='ROW S-F' i]", _o("s = 'F'")),
)
_counts(
    "ledger_texts_tested", "The text pseudo-attribute: all text below an element, scripts included.",
    a=("b[text='2-HIGH']", _o("p = '2-HIGH'")), b=("td[text*='high' i]", _o("p = '2-HIGH'")), c=("td[text~='F']", _o("s = 'F'")), d=("td[text$=' O']", _o("s = 'O'")), e=("script[text*='T1']", _c("ck % 3 = 1")), f=("td[text]", _o() + " ) * 2 + (SELECT 0"),
    g=("td[text^='']", _o() + " ) * 3 + (SELECT 0"),
)
_counts(
    "ledger_places", "Structural pseudo-classes.",
    a=(":root", _c()), b=("td:empty", _o()), c=("tbody:empty", _c("n = 0")), d=("tr:first-child", _o("i = 1")), e=("tr:last-child", _o("i = n")), f=("tr:only-child", _o("n = 1")), g=("tr:nth-child(3n+2)", _o("i % 3 = 2")),
    h=("tr:nth-child(even)", _o("i % 2 = 0")), i=("tr:nth-child(-n+2)", _o("i <= 2")), j=("tr:nth-last-child(2)", _o("i = n - 1")), k=("tr:nth-last-child(odd)", _o("(n - i) % 2 = 0")),
)
_counts(
    "ledger_places_of_type", "Structural pseudo-classes among elements of one name.",
    a=("h2:first-of-type", _c()), b=("h2:last-of-type", _c()), c=("main > :only-of-type", _c(times="5")), d=("main > :nth-of-type(2)", _c()), e=("td:nth-last-of-type(1)", _o()), f=("tr:nth-of-type(2n)", _o("i % 2 = 0")), g=("main > h2:nth-of-type(1)", _c()),
    h=("tr:nth-last-of-type(3)", _o("i = n - 2")),
)
_counts(
    "ledger_combinators", "Combinators, :not, :is and :has with complex arguments.",
    a=("main tr b", _o()), b=("tbody > tr", _o()), c=("tr + tr", _o("i > 1")), d=("tr.s-F + tr.s-F", _o("s = 'F' AND before = 'F'")), e=("tr.s-F ~ tr", _o("f_before")), f=("tr:not(.s-F, .s-O)", _o("s NOT IN ('F', 'O')")),
    g=("tr:not(.s-F ~ tr)", _o("NOT coalesce(f_before, false)")), h=("main:has(tr.s-F)", "SELECT count(DISTINCT ck) FROM o WHERE s = 'F'"), i=("tr:has(+ tr.s-O)", _o("after = 'O'")), j=("main:has(> h2 + table)", _c()),
    k=("tr:is(.s-F, [data-p^='5'])", _o("s = 'F' OR p LIKE '5%'")), l=("main:has(tr.s-F):has(tr.s-P)", "SELECT count(*) FROM (SELECT ck FROM o GROUP BY ck HAVING bool_or(s = 'F') AND bool_or(s = 'P'))"), m=("ul > li + li", _c()),
    n=("tr:is(tbody > tr:first-child, #o12)", _o("i = 1 OR k = 12")), o=("header ~ main h2:not(table ~ h2)", _c()),
)


@_query("SELECT pos, key FROM c")
def ledger_keys(spark, sf_dir):
    """Places after an append: new pages follow the old ones, and of a key the first counts."""
    return ledger(spark, sf_dir).keys()


@_query("SELECT key, name, CAST(nation AS BIGINT) AS nation, ck / 2 AS half, ck % 2 = 0 AS even FROM c")
def ledger_meta(spark, sf_dir):
    return ledger(spark, sf_dir).meta_table().drop("pos")


@_query("SELECT * FROM (VALUES (0, 'name', 'str'), (1, 'nation', 'int'), (2, 'half', 'float'), (3, 'even', 'bool')) AS t(place, field, type)")
def ledger_meta_schema(spark, sf_dir):
    own = ledger(spark, sf_dir).meta_schema()
    return spark.createDataFrame([(i, n, t.__name__) for i, (n, t) in enumerate(own.items())], "place int, field string, type string")


@_query("""SELECT c.key, k || p || ' ' || s AS text, 'o' || k AS id, 'row s-' || s AS class, p AS "data-p", CAST(nation AS BIGINT) AS nation FROM o JOIN c USING (ck)""")
def ledger_rows(spark, sf_dir):
    out = ledger(spark, sf_dir).scan_table("tbody > tr", text=True, attrs=["id", "class", "data-p"], meta=["nation"], ordered=False)
    return out.drop("pos", "idx")


@_query("SELECT c.key, 'tr' AS tag, 'o' || k AS id, 'row|s-' || s AS classes, 'tr#o' || k || '.row.s-' || s AS label, 6 AS depth, 'tbody' AS parent FROM o JOIN c USING (ck)")
def ledger_elements(spark, sf_dir):
    c = ledger(spark, sf_dir)
    up = c.nodes.select("pos", F.col("idx").alias("parent"), F.col("tag").alias("p_tag"))
    rows = c.select("tr").join(up, ["pos", "parent"])
    return rows.select("key", "tag", "id", F.array_join("classes", "|").alias("classes"), label().alias("label"), "depth", F.col("p_tag").alias("parent"))


@_query("SELECT c.key, 'o' || k AS id, CASE WHEN i > 1 THEN 's-' || before END AS before, CASE WHEN i < o.n THEN 's-' || after END AS after FROM o JOIN c USING (ck)")
def ledger_siblings(spark, sf_dir):
    c = ledger(spark, sf_dir)
    other = c.nodes.select("pos", F.col("idx").alias("at"), F.element_at("classes", 2).alias("status"))
    rows = c.select("tr").select("pos", "key", "id", "prev_el", "next_el")
    rows = rows.join(other.toDF("pos", "prev_el", "before"), ["pos", "prev_el"], "left").join(other.toDF("pos", "next_el", "after"), ["pos", "next_el"], "left")
    return rows.select("key", "id", "before", "after")


@_query("SELECT c.key, j AS place, CASE j WHEN 1 THEN CAST(k AS VARCHAR) WHEN 2 THEN ' ' || s END AS own, 'o' || k AS id FROM o JOIN c USING (ck), (VALUES (1), (2), (3)) AS t(j)")
def ledger_own_texts(spark, sf_dir):
    """Text directly in the children of each row."""
    c = ledger(spark, sf_dir)
    rows = c.select("tr").select("pos", "idx", F.col("id").alias("row_id"))
    cells = c.select_children(rows, "td")
    return c.own_texts(cells, "own").join(rows.toDF("pos", "parent", "row_id"), ["pos", "parent"]).select("key", F.col("type_ord").alias("place"), "own", F.col("row_id").alias("id"))


@_query("SELECT key, k || p || ' ' || s AS text FROM o JOIN c USING (ck) WHERE i = 1")
def ledger_first_rows(spark, sf_dir):
    c = ledger(spark, sf_dir)
    return c.texts(c.select_first("tr").select("pos", "key", "idx", "end_idx", "tag"), "text").select("key", "text")


@_query("""
SELECT key, name || name || 'Orders' || coalesce(replace(rows, '#', ''), '') || 'Notes' || 'alpha' || ck || 'beta' || repeat('word' || ck % 7 || ' ', CAST(ck % 40 * 10 AS INTEGER)) || 'a<b' || 'tail' AS text
FROM c LEFT JOIN (SELECT ck, string_agg(k || p || ' ' || s, '#' ORDER BY k) AS rows FROM o GROUP BY ck) USING (ck)
""")
def ledger_page_texts(spark, sf_dir):
    """All text of each page, scripts aside, from its root."""
    c = ledger(spark, sf_dir)
    return c.texts(c.nodes.where("idx = 0").select("pos", "key", "idx", "end_idx", "tag"), "text").select("key", "text")


@_query("SELECT key, n AS rows, CAST(ck % 2 = 0 AS BIGINT) AS alts FROM c WHERE n > 0")
def ledger_counts(spark, sf_dir):
    """Matches a page, all and those with an attribute."""
    c = ledger(spark, sf_dir)
    rows = c.select_counts("tr").select("key", F.col("n").alias("rows"))
    return rows.join(c.select_counts("img", attr="ALT").select("key", "n"), "key", "left").select("key", "rows", F.coalesce("n", F.lit(0)).cast("long").alias("alts"))


@_query("SELECT key, CAST(2 AS BIGINT) AS n FROM c")
def ledger_exactly(spark, sf_dir):
    """Every page must have exactly two items."""
    return ledger(spark, sf_dir).exactly("main > ul > li", 2).select("key", "n")


@_query("""
SELECT key, string_agg('<tr class="row s-' || s || '" id="o' || k || '" data-p="' || p || '" lang="' || ['en-US', 'en', 'de'][k % 3 + 1] || '" align="' || ['Left', 'LEFT', 'right'][k % 3 + 1] || '"><td>' || k
  || '</td><td><b title="<' || s || '>">' || p || '</b> ' || s || '</td><td><price-tag cents="' || k % 1000 || '"></price-tag></td></tr>', chr(10) ORDER BY k) AS html
FROM o JOIN c USING (ck) GROUP BY key
""")
def ledger_row_html(spark, sf_dir):
    return ledger(spark, sf_dir).scan_html("tr", ordered=False).select("key", F.array_join("values", "\n").alias("html"))


@_query("""SELECT key, '<svg viewBox="0 0 1 1"><path d="M' || ck || '"></path>a&lt;b</svg>' AS svg, '<img src="i.png"' || CASE WHEN ck % 2 = 0 THEN ' alt="x"' ELSE '' END || ' />' AS img, '<div>tail</div>' AS div FROM c""")
def ledger_markup(spark, sf_dir):
    """Foreign content, void elements and a slash that means nothing, written again."""
    c = ledger(spark, sf_dir)
    own = c.markup(c.select("svg, img, div").select("pos", "idx"))
    tag = F.regexp_extract("html", "^<([a-z]+)", 1)
    return own.groupBy("key").agg(*(F.max(F.when(tag == t, F.col("html"))).alias(t) for t in ("svg", "img", "div")))


@_query("SELECT key, '<li>alpha' || ck || '</li>' AS first, 'c' || ck AS said FROM c")
def ledger_items_and_comments(spark, sf_dir):
    """An item that the next one closes, and the comment of a page."""
    c = ledger(spark, sf_dir)
    first = c.markup(c.select("li:first-child").select("pos", "idx")).select("pos", "key", F.col("html").alias("first"))
    return first.join(c.nodes.where("kind = 'comment'").select("pos", F.col("text").alias("said")), "pos").select("key", "first", "said")


@_query("SELECT key, '<ul>' || chr(10) || chr(9) || '<li>alpha' || ck || '</li>' || chr(10) || chr(9) || '<li>beta</li>' || chr(10) || '</ul>' AS html FROM c")
def ledger_pretty(spark, sf_dir):
    """Blocks on lines of their own, indented by tabs."""
    c = ledger(spark, sf_dir)
    return c.markup(c.select("ul").select("pos", "idx"), pretty=True).select("key", F.rtrim(F.col("html"), F.lit("\n")).alias("html"))


@_query("""
SELECT 'two selectors' AS rule, key FROM c WHERE ck IN (SELECT ck FROM o WHERE s = 'F') AND ck IN (SELECT ck FROM o WHERE p = '1-URGENT')
UNION ALL SELECT 'selector and keys', key FROM c WHERE ck % 100 = 3 AND ck IN (SELECT ck FROM o WHERE s = 'F')
UNION ALL SELECT 'excluded with both', key FROM c WHERE NOT (ck % 2 = 1 AND ck IN (SELECT ck FROM o WHERE s = 'P')) AND ck < 300
UNION ALL SELECT 'rules', key FROM c WHERE (ck IN (1, 2, 4) OR ck % 50 = 7) AND ck IN (SELECT ck FROM o WHERE s = 'F') AND seg <> 'building'
""")
def ledger_filters(spark, sf_dir):
    """Several selectors of a side, selectors with keys, an exclude side with both, and rules as on a command line."""
    c = ledger(spark, sf_dir)
    keys = c.docs.select("key", F.regexp_extract("key", "([0-9]+)$", 1).cast("long").alias("ck"))
    file = f"{shared_place(spark)}.tsv"
    keys.where("ck % 50 = 7").select("key").write.text(file)
    kept = {
        "two selectors": Filter(include_css=["tr.s-F", "tr[data-p='1-URGENT']"]),
        "selector and keys": Filter(include_css="tr.s-F", include_keys=keys.where("ck % 100 = 3")),
        "excluded with both": Filter(include_keys=keys.where("ck < 300"), exclude_css="tr.s-P", exclude_keys=keys.where("ck % 2 = 1")),
        "rules": Filter.rules(spark, ["css:tr.s-F", "words: cust/1,cust/2, cust/4", file], ["css:main.building"]),
    }
    return reduce(DataFrame.union, (c.matching(f, ordered=False).select(F.lit(name).alias("rule"), "key") for name, f in kept.items()))


@_query("""
SELECT 'key' AS by, key, pos FROM c WHERE ck = 5 UNION ALL SELECT 'place', key, pos FROM c WHERE pos = 3 UNION ALL SELECT 'last', key, pos FROM c WHERE pos = (SELECT max(pos) FROM c)
UNION ALL SELECT 'listed', key, pos FROM (SELECT * FROM c WHERE ck IN (SELECT ck FROM o WHERE s = 'F') ORDER BY pos LIMIT 10)
""")
def ledger_lookups(spark, sf_dir):
    """Pages by key, by place and from the end; the first ten that a filter keeps."""
    c = ledger(spark, sf_dir)
    own = {"key": c.lookup("cust/5"), "place": c.lookup(pos=3), "last": c.lookup(pos=-1), "listed": c.listing(Filter(include_css="tr.s-F"), 10)}
    return reduce(DataFrame.union, (rows.select(F.lit(by).alias("by"), "key", "pos") for by, rows in own.items()))


@_query("""
SELECT key, 11 + 6 * n AS descendants, CAST(24 + 12 * n AS BIGINT) AS events, 'c' || ck AS comments, 1 AS script_after, 'html > body > main#c' || ck || '.customer.' || seg || '.n' || nation AS css_path,
  CAST(nation AS VARCHAR) AS nation, 'customer ' || seg || ' n' || nation AS class, 7 AS children, 'alpha' || ck AS item, seg = 'building' AS building, 4 AS before FROM c WHERE ck IN (1, 2, 5, 10)
""")
def ledger_documents(spark, sf_dir):
    """Pages as objects: walks, events, characters, paths, attributes, children, tests; a page at a time."""
    c = ledger(spark, sf_dir)
    out = []
    for k in (1, 2, 5, 10):
        doc = c[f"cust/{k}"]
        main = doc.select_first("main")
        assert main == doc.select_first("body").first_child("main") and main.parent.tag == "body" and main.prev_sibling.tag == "header" and "id" in main and [e.tag for e in main.ancestors[:2]] == ["body", "html"]
        out.append((
            doc.key, len(list(main.walk())), len(list(main.events())), main.characters(("comment",)), len([e for e in main.walk("forwards") if e.tag == "script"]), main.css_path, main["data-nation"],
            main.attrs["class"], len(main.children), main.child_path("ul", "li").text, main.matches("main.building"), len([e for e in main.walk("reverse") if e.tag in ("header", "img", "h1", "title")]),
        ))
    return spark.createDataFrame(out, "key string, descendants long, events long, comments string, script_after int, css_path string, nation string, class string, children int, item string, building boolean, before int")


_PER_PAGE = """, m AS (
SELECT pos, key, 32 + 9 * n + CAST(ck % 40 > 0 AS INTEGER) AS n_nodes, CASE WHEN n > 0 THEN 9 ELSE 6 END AS max_depth, 10 + CAST(ck % 2 = 0 AS INTEGER) + 8 * n AS list_entries,
  6 + CAST(ck % 2 = 0 AS INTEGER) + n + dp + 2 * dl + ds + dk AS distinct_pairs, 1 + CAST(n > 0 AS INTEGER) AS ext_tag_names, 1 + CAST(n > 0 AS INTEGER) AS ext_attr_names,
  4 + CASE WHEN n > 0 THEN 2 + ds ELSE 0 END AS symbols FROM c
), l AS (UNPIVOT m ON n_nodes, max_depth, list_entries, distinct_pairs, ext_tag_names, ext_attr_names, symbols INTO NAME metric VALUE value)
"""


@_query(_PER_PAGE + "SELECT key, metric, CAST(value AS BIGINT) AS value FROM l")
def ledger_page_figures(spark, sf_dir):
    return stats.per_page(ledger(spark, sf_dir)).unpivot(["key"], stats.METRICS, "metric", "value")


@_query(_PER_PAGE + """
SELECT metric, CASE WHEN value <= 0 THEN 0 ELSE CAST(floor(log2(value)) AS INTEGER) + 1 END AS bucket, count(*) AS n, any_value(most) AS max_value, any_value(over_cap) AS over_cap
FROM l JOIN (SELECT metric, CAST(max(value) AS BIGINT) AS most, count(*) FILTER (value > 100) AS over_cap FROM l GROUP BY metric) USING (metric) GROUP BY 1, 2
""")
def ledger_histogram(spark, sf_dir):
    return stats.histogram(stats.per_page(ledger(spark, sf_dir)), cap=100).drop("max_key")


@_query(_PER_PAGE + """
, h AS (SELECT metric, CASE WHEN value <= 0 THEN 0 ELSE CAST(floor(log2(value)) AS INTEGER) + 1 END AS bucket, count(*) AS n FROM l GROUP BY 1, 2
), u AS (SELECT *, sum(n) OVER (PARTITION BY metric ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY metric) AS total FROM h)
SELECT metric, CAST(percentile AS DOUBLE) AS percentile, CAST(min(least(power(2, bucket) - 1, most)) AS BIGINT) AS bound
FROM u JOIN (SELECT metric, max(value) AS most FROM l GROUP BY metric) USING (metric), (VALUES (50.0), (99.0), (99.9), (99.99), (99.999)) AS t(percentile)
WHERE upto >= ceil(total * CAST(percentile AS DOUBLE) / 100) GROUP BY 1, 2
""")
def ledger_percentiles(spark, sf_dir):
    return stats.percentiles(stats.per_page(ledger(spark, sf_dir)))


@_query(_PER_PAGE + "SELECT count(*) AS pages, count(*) FILTER (n_nodes > 64) AS over_2_6, count(*) FILTER (n_nodes > 128) AS over_2_7 FROM m")
def ledger_coverage(spark, sf_dir):
    return stats.coverage(stats.per_page(ledger(spark, sf_dir)), bits=(6, 7))


@_query("""
, t AS (
  SELECT ck, key, 0 AS section, 'Orders' AS heading, coalesce(said, '') AS whole FROM c
  UNION ALL SELECT ck, key, 1, 'Notes', trim('alpha' || ck || ' beta ' || repeat('word' || ck % 7 || ' ', CAST(ck % 40 * 10 AS INTEGER))) FROM c
), s AS (SELECT *, unnest(range(CAST((length(whole) + 1199) // 1200 AS BIGINT))) AS part FROM t WHERE length(whole) > 80)
SELECT key, CAST(row_number() OVER (PARTITION BY key ORDER BY section, part) - 1 AS INTEGER) AS chunk, heading, substr(whole, part * 1200 + 1, 1200) AS text FROM s
""")
def ledger_chunks(spark, sf_dir):
    return recipes.chunks(ledger(spark, sf_dir)).drop("pos")


@_query("SELECT key, trim(repeat('word' || ck % 7 || ' ', CAST(ck % 40 * 10 AS INTEGER))) AS text FROM c WHERE ck % 40 > 0")
def ledger_paragraphs(spark, sf_dir):
    return recipes.paragraphs(ledger(spark, sf_dir)).drop("pos")


@_query("SELECT count(*) AS pages, count(*) FILTER (ck % 3 > 0) AS with_json_ld, count(*) FILTER (ck % 3 > 0) / count(*) AS share FROM c")
def ledger_json_ld_share(spark, sf_dir):
    return recipes.json_ld_share(ledger(spark, sf_dir))


@_query("SELECT pos, key, name AS title, name AS h1, CAST(0 AS BIGINT) AS links, CAST(1 AS BIGINT) AS paragraphs, CAST(ck % 2 AS BIGINT) AS images_without_alt FROM c")
def ledger_audit(spark, sf_dir):
    return recipes.page_audit(ledger(spark, sf_dir))


@_query("SELECT key FROM c WHERE ck NOT IN (SELECT ck FROM o WHERE s = 'F')")
def ledger_missing(spark, sf_dir):
    return recipes.missing(ledger(spark, sf_dir), "tr.s-F").select("key")


@_query("SELECT key, string_agg(CAST(k AS VARCHAR), '|' ORDER BY k) AS texts FROM o JOIN c USING (ck) WHERE i <= 3 GROUP BY key")
def ledger_first_cells(spark, sf_dir):
    return recipes.first_texts(ledger(spark, sf_dir), "tr td:first-child", 3).select("key", F.array_join("values", "|").alias("texts"))


@_query(_PER_PAGE + "SELECT key, 'more than 60 nodes' AS parse_error FROM m WHERE n_nodes > 61")
def ledger_skipped(spark, sf_dir):
    """Pages over a capacity, and why they are left out."""
    return parse_pages(pages(spark, sf_dir), order="ck", max_nodes=60).skipped().select("key", "parse_error")


@_query("SELECT key FROM c WHERE ck % 4 = 1")
def ledger_diff(spark, sf_dir):
    """Pages whose content isn't that of the stored corpus."""
    later = pages(spark, sf_dir).withColumn("html", F.when(F.col("ck") % 4 == 1, F.replace("html", F.lit("beta"), F.lit("gamma"))).otherwise(F.col("html")))
    return ledger(spark, sf_dir).diff(parse_pages(later, order="ck"), ordered=False).select("key")


def revised(tree: mutate.Tree) -> None:
    """Rows of status F go, other rows are marked; bold text is unwrapped; the title, list and notes are rewritten."""
    for x in tree.select("tr.s-F"):
        tree.remove(x)
    for x in tree.select("tr"):
        tree.remove_attributes(x, lambda name, value: name in ("lang", "align"))
        tree.remove_classes(x, lambda name: name == "row")
        tree.add_class(x, "left")
        tree.set_attribute(x, "data-left", "1")
    for x in tree.select("tr b"):
        tree.unwrap(x)
    for x in tree.select("h1"):
        tree.replace_text(x, "New")
    for x in tree.select("ul"):
        tree.insert(x, "first", *tree.fragment("<li>first</li>"))
        tree.insert(x, "last", *tree.fragment("<li>last</li>"))
    for x in tree.select("svg"):
        tree.replace_with(x, tree.fragment("<em>drawn</em>")[0])
    for x in tree.select("main > div"):
        tree.append_text(x, " end")
        tree.append_comment(x, "note")


@_query("""
SELECT key, 'New' AS h1, count(k) FILTER (s <> 'F') AS left, count(k) FILTER (s <> 'F') AS marked, CAST(0 AS BIGINT) AS bold, 'firstalpha' || ck || 'betalast' AS items, 'drawn' AS em, 'tail end' AS div,
  count(k) FILTER (s <> 'F') = 0 AS pruned FROM c LEFT JOIN o USING (ck) GROUP BY key, ck
""")
def ledger_revised(spark, sf_dir):
    """What a change of every page leaves; a table without rows is pruned."""
    c = ledger(spark, sf_dir).changed(revised)
    n = c.nodes
    counts = n.where("kind = 'element'").groupBy("key").agg(
        F.count_if((F.col("tag") == "tr") & F.array_contains("classes", "left") & ~F.array_contains("classes", "row")).alias("left"),
        F.count_if(F.exists("attrs", lambda a: a["name"] == "data-left") & ~F.exists("attrs", lambda a: a["name"] == "lang")).alias("marked"),
        F.count_if(F.col("tag") == "b").alias("bold"), (F.count_if(F.col("tag") == "table") == 0).alias("pruned"),
    )
    said = c.texts(c.select("h1, ul, em, div").select("pos", "key", "idx", "end_idx", "tag"), "said")
    texts = said.groupBy("key").agg(*(F.max(F.when(F.col("tag") == t, F.col("said"))).alias(name) for t, name in (("h1", "h1"), ("ul", "items"), ("em", "em"), ("div", "div"))))
    return counts.join(texts, "key").select("key", "h1", "left", "marked", "bold", "items", "em", "div", "pruned")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
