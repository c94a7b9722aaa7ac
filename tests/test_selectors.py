import random

import pytest

from tagloom.functions.tree import label
from tagloom.operators.corpus import parse_pages
from tagloom.operators.document import parse
from tagloom.plans.compile import select
from tagloom.plans.selector import Selector, SelectorError
from tagloom.plans.selector import parse as parse_selector

PAGE = """<div id=a class="x y"><p class=x>one<b lang=EN type=Radio>two</b></p><p id=q>three</p><h1 title="a-b c">H</h1><my-el></my-el>
<ul><li>1<li class=k>2<li>3<li>4</ul><span></span><a href="/u?x=1">L</a><script>var z</script></div><p data-v="&lt;">out</p>"""

CASES = [
    ("p", ["p.x", "p#q", "p"]),
    ("P.x", ["p.x"]),
    ("my-el", ["my-el"]),
    ("*", None),
    ("#a", ["div#a.x.y"]),
    (".x", ["div#a.x.y", "p.x"]),
    (".x.y", ["div#a.x.y"]),
    ("[title]", ["h1"]),
    ('[title="a-b c"]', ["h1"]),
    ('[title^="a-"]', ["h1"]),
    ('[title$=" c"]', ["h1"]),
    ('[title*="b"]', ["h1"]),
    ('[title*=""]', []),
    ('[title~="c"]', ["h1"]),
    ('[title|="a"]', ["h1"]),
    ('[TITLE="A-B C" i]', ["h1"]),
    ('[lang="en"]', ["b"]),
    ('[lang="en" s]', []),
    ('[type="radio"]', ["b"]),
    ("[type=Radio]", ["b"]),
    ('[class~="x"]', ["div#a.x.y", "p.x"]),
    ('[class="x y"]', ["div#a.x.y"]),
    ('[class^="x"]', ["div#a.x.y", "p.x"]),
    ('[data-v="&lt;"]', ["p"]),
    ("div p", ["p.x", "p#q"]),
    ("div > b", []),
    ("div > p > b", ["b"]),
    ("p + p", ["p#q"]),
    ("p ~ h1", ["h1"]),
    ("h1 ~ p", []),
    (":root", ["div#a.x.y", "p"]),
    ("span:empty", ["span"]),
    ("p:empty", ["p#q", "p"]),
    ("li:first-child", ["li"]),
    ("li:last-child", ["li"]),
    ("b:only-child", ["b"]),
    ("li:nth-child(2n)", ["li.k", "li"]),
    ("li:nth-child(odd)", ["li", "li"]),
    ("li:nth-child(-n+2)", ["li", "li.k"]),
    ("li:nth-child(2)", ["li.k"]),
    ("li:nth-child(0n+2)", ["li.k"]),
    ("li:nth-last-child(1)", ["li"]),
    ("p:nth-of-type(2)", ["p#q"]),
    ("p:last-of-type", ["p#q", "p"]),
    ("h1:only-of-type", ["h1"]),
    ("p:nth-last-of-type(2)", ["p.x"]),
    ("p:not(.x)", ["p#q", "p"]),
    ("p:not(#q)", ["p.x", "p"]),
    ('p:not([class="x"])', ["p#q", "p"]),
    ("p:not(div > p)", ["p"]),
    ("p:is(.x, #q)", ["p.x", "p#q"]),
    ("p:is(div *)", ["p.x", "p#q"]),
    ("div:has(li)", ["div#a.x.y"]),
    ("p:has(> b)", ["p.x"]),
    ("p:has(+ h1)", ["p#q"]),
    ("p:has(~ ul)", ["p.x", "p#q"]),
    ("ul:has(li + .k ~ li)", ["ul"]),
    ("p:not(:has(b))", ["p#q", "p"]),
    ("h1, b, h1", ["b", "h1"]),
    ("div > p, ul li.k", ["p.x", "p#q", "li.k"]),
    ('[text="three"]', ["p#q"]),
    ('p[text*="TWO" i]', ["p.x"]),
    ("span[text]", []),
    ('script[text^="var"]', ["script"]),
    ('p:not([text~="three"])', ["p.x", "p"]),
]


@pytest.mark.parametrize(("css", "want"), CASES)
def test_one_document(css, want):
    found = parse(PAGE).select(css)
    if want is not None:
        assert [e.label for e in found] == want
    else:
        assert all(e.node.kind == "element" for e in found) and len(found) == 15


def test_plans_on_the_same_page(spark):
    c = parse_pages(spark.createDataFrame([("k", PAGE)], "key string, html string")).persist()
    nodes = parse(PAGE).nodes
    for css, want in CASES:
        got = [label(nodes[r["idx"]]) for r in select(c.nodes, css).select("idx").orderBy("idx").collect()]
        assert want is None or got == want, css


def test_chains_that_a_shared_iterator_would_miss():
    d = parse("<a><x><b><b><c>")
    assert len(d.select("a > x > b c")) == 1 and len(d.select("a x > b > b c")) == 1


def _random_page(rng: random.Random) -> str:
    out = []
    for _ in range(rng.randrange(4, 30)):
        tag = rng.choice("abcd")
        out.append(rng.choice([f"<{tag} class='{rng.choice('mn')}' id={rng.choice('xyz')}>", f"<{tag}>", f"</{tag}>", "t", f"<{tag} k={rng.choice('12')}></{tag}>"]))
    return "".join(out)


def _random_selector(rng: random.Random, depth: int = 2) -> str:
    def compound() -> str:
        own = rng.choice(["a", "b", "c", "*", ".m", ".n", "#x", "[k]", '[k="1"]', ":first-child", ":last-of-type", ":nth-child(2n+1)", ":empty", '[text*="t"]', "d"])
        if depth and rng.random() < 0.35:
            inner = ", ".join(_random_selector(rng, depth - 1) for _ in range(rng.randrange(1, 3)))
            kind = rng.choice(["not", "is", "has"])
            own += f":{kind}({rng.choice(['> ', '+ ', '~ ', '']) if kind == 'has' else ''}{inner})"
        return own

    return rng.choice([" ", " > ", " + ", " ~ "]).join(compound() for _ in range(rng.randrange(1, 4)))


def test_random_trees_and_selectors(spark):
    """The plans against the backtracking matcher."""
    rng = random.Random(11)
    pages = [(f"p{i}", _random_page(rng)) for i in range(40)]
    c = parse_pages(spark.createDataFrame(pages, "key string, html string")).persist()
    documents = {k: parse(h) for k, h in pages}
    for _ in range(25):
        css = _random_selector(rng)
        got = {(r["key"], r["idx"]) for r in select(c.nodes, css).select("key", "idx").collect()}
        assert got == {(k, e.index) for k, d in documents.items() for e in d.select(css)}, css


BAD = ["", "a,,b", "h1)", "p:where(a)", "p::before", "#a#b", "[a", "[a=]", "a >", "> a", ":nth-child(x)", ":nth-child(2n+)", "p:lang(en)", "*p", "a:not()", "[a='b]", "a..b", "ns|a"]


@pytest.mark.parametrize("css", BAD)
def test_errors_say_where(css):
    with pytest.raises(SelectorError) as e:
        Selector(css)
    assert "^" in str(e.value)


def test_strict_and_source():
    with pytest.raises(SelectorError):
        parse_selector("[a=b]", strict=True)
    assert Selector("a  >  b").source == "a  >  b" and parse_selector("a>b") == parse_selector("a > b")
    assert parse_selector("#a#a") == parse_selector("#a#a")


def _pushed(spark, nodes, selector):
    from tagloom.plans.compile import select

    plan = select(nodes, selector)._jdf.queryExecution().executedPlan().toString()
    return plan[plan.index("PushedFilters") :].split("\n")[0]


def test_types_and_lists_reach_the_scan(spark, tmp_path):
    from tagloom.operators.corpus import Corpus, parse_pages

    parse_pages(spark.createDataFrame([("a", "<h1 id=x>b</h1><p>c")], "key string, html string")).write(str(tmp_path / "c"))
    nodes = Corpus.open(spark, str(tmp_path / "c")).nodes
    assert "In(tag, [h1,h2,h3])" in _pushed(spark, nodes, "h1, h2, h3") and "EqualTo(kind,element)" in _pushed(spark, nodes, "h1, h2, h3")
    assert "IsNotNull(id)" in _pushed(spark, nodes, "h1#x") and "EqualTo(tag,h1), EqualTo(" in _pushed(spark, nodes, "h1#x")
    assert "Or(" in _pushed(spark, nodes, "h1, #x")
