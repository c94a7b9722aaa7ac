import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tagloom.functions import charset, serialize
from tagloom.functions.tree import CapacityError, build, checksum, parse_rows_of
from tagloom.operators.document import parse

ROUND = [
    ("<p>a<p>b", "<p>a<p>b</p></p>"),
    ("<ul><li>a<li>b</ul>x", "<ul><li>a</li><li>b</li></ul>x"),
    ("<select><option>a<option>b</select>", "<select><option>a</option><option>b</option></select>"),
    ("<dl><dt>a<dd>b<dt>c</dl>", "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>"),
    ("<tr><td>a<th>b<tr>", "<tr><td>a</td><th>b<tr></tr></th></tr>"),
    ("</div>x</p><br></br>", "x<br />"),
    ("<b><i>x</b>y</i>z", "<b><i>x</i></b>yz"),
    ("<DIV ID=A Class='x  y x'>", '<div class="x y" id="A"></div>'),
    ("<a href>t</a>", "<a href>t</a>"),
    ("<script>if(a<b && c)</script>", "<script>if(a<b && c)</script>"),
    ("<title>a<b>&amp;c</title>", "<title>a&lt;b&gt;&amp;c</title>"),
    ("<textarea></p></textarea>", "<textarea>&lt;/p&gt;</textarea>"),
    ("<svg viewBox=1><path d=x /><lineargradient/></svg>t", '<svg viewBox="1"><path d="x"></path><linearGradient></linearGradient></svg>t'),
    ("<div/>in", "<div>in</div>"),
    ("<!DOCTYPE HTML PUBLIC 'x'><!--a--><!bogus><?pi?>", "<!DOCTYPE html><!--a--><!--bogus--><!--?pi?-->"),
    ("a < b & c &lt;d&gt; &copy &notit;", "a &lt; b &amp; c &lt;d&gt; © ¬it;"),
    ('<a href="?a=1&copy=2&amp;x">', '<a href="?a=1&amp;copy=2&amp;x"></a>'),
    ("<my-el data-x=1>z</my-el>", '<my-el data-x="1">z</my-el>'),
    ("x<div", "x"),
    ('<p class="">', "<p class></p>"),
    ("<meta charset=latin1><meta http-equiv=Content-Type content='text/html; charset=x'>", '<meta charset="utf-8"><meta http-equiv="Content-Type" content="text/html; charset=utf-8">'),
    ("<svg><![CDATA[a<b]]></svg><![CDATA[c]]>", "<svg>a&lt;b</svg><!--[CDATA[c]]-->"),
]


@pytest.mark.parametrize(("source", "want"), ROUND)
def test_round_trips(source, want):
    assert serialize.raw(build(source)) == want
    assert serialize.raw(build(want)) == want


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<b>", "</b>", "<li>", "<ul>", "</ul>", "<br>", "x", " ", "&amp;", "<td a=1>", "<tr>", "<svg>", "</svg>", "<script>", "</script>", "<!--c-->", "<option>", "<", "</x>", "<p class='a b' id=c>"]), max_size=25).map("".join))
def test_serializing_is_a_fixed_point_and_trees_are_sound(source):
    nodes = build(source)
    once = serialize.raw(nodes)
    assert serialize.raw(build(once)) == once
    for x in nodes[1:]:
        parent = nodes[x.parent]
        assert parent.idx < x.idx < x.end <= parent.end and x.depth == parent.depth + 1
        if x.kind == "element":
            assert parent.children[x.sib_ord - 1] == x.idx and x.sib_ord + x.sib_rev == len(parent.children) + 1
    assert serialize.pretty(nodes) is not None


def test_strict_end_closes_the_child_only():
    assert serialize.raw(build("<ul><li>a</ul>x", strict_end=True)) == "<ul><li>a</li>x</ul>"


def test_limits_and_checksums():
    with pytest.raises(CapacityError):
        build("<b>" * 50, max_depth=40)
    with pytest.raises(CapacityError):
        build("<i>x</i>" * 50, max_nodes=60)
    assert len(build("<p>" * 8000)) == 8001
    sums = [checksum(parse_rows_of(x)[0]) for x in ("<p>a", "<p>a</p>", "<p>b", "<p id=a>a", "<p class=a>a", "<b>a")]
    assert sums[0] == sums[1] and len(set(sums)) == 5


def test_elements_of_one_page():
    d = parse("<body><div id=main class='content wide'><h1 class=title data-rank=1>T</h1><p>a <b>bold</b> c<p>d</div><script>s</script>")
    h1 = d.select_first("h1")
    assert h1.tag == "h1" and h1.get("DATA-RANK") == "1" and h1["class"] == "title" and "x" not in h1 and h1.parent.id == "main"
    assert h1.css_path == "body > div#main.content.wide > h1.title" and h1.next_sibling.tag == "p" and h1.prev_sibling is None
    assert d.select_first("p").own_text == "a  c" and d.select_first("p").text == "a bold cd" and d.text == "Ta bold cd"
    assert d.select_first("script").text == "s" and d.body.children[0].attrs["class"] == "content wide" and h1.depth == 3
    assert [e.tag for e in d.body.walk()] == ["div", "h1", "p", "b", "p", "script"] and [w for w, _ in h1.events()] == ["open", "close"]
    assert d.select_count("p") == 2 and d.select_count("h1, p", "class") == 1 and d.select_attr("h1, p", "class") == ["title", None, None]
    assert h1.select("p") == [] and len(h1.select("p", scope="forward")) == 2 and d.child_path("body", "div", "h1") == h1
    with pytest.raises(KeyError):
        h1["nope"]
    with pytest.raises(ValueError):
        d.exactly("p", 1)


def test_changes_prune_and_keep_words_apart():
    def after(source, change):
        return parse(source).changed(change).to_html()

    assert after("a<div>b</div>c", lambda t: t.remove(t.select("div")[0])) == "a c"
    assert after("<div><p><b>x</b></p></div>y", lambda t: t.remove(t.select("b")[0])) == "y"
    assert after("a<div><i>b</i></div>c", lambda t: t.unwrap(t.select("div")[0])) == "a <i>b</i> c"
    assert after("<details><summary>s</summary>b</details>", lambda t: t.unwrap(t.select("details")[0])) == "b"
    assert after("<div>x</div><p><b>y</b></p>", lambda t: t.replace_with(t.select("div")[0], t.select("b")[0])) == "<b>y</b>"
    assert after("<p class='a b' id=i>", lambda t: (t.remove_classes(t.select("p")[0], lambda c: c == "a"), t.set_attribute(t.select("p")[0], "id", "j"), t.append_text(t.select("p")[0], "z"))) == '<p class="b" id="j">z</p>'
    assert after("<p>x</p>", lambda t: t.insert(t.select("p")[0], "before", *t.fragment("<h1>n</h1>"))) == "<h1>n</h1><p>x</p>"
    assert after("<ul>\n\t<li>a\n b</li>\n</ul>", lambda t: t.strip_formatting()) == "<ul><li>a  b</li></ul>"
    assert after("<p>x</p>", lambda t: (t.append_comment(t.select("p")[0], "c"), t.clear(t.select("p")[0]), t.replace_text(t.select("p")[0], "y"))) == "<p>y</p>"


CASES = [
    (b"\xef\xbb\xbfcaf\xc3\xa9", None, None, "café"),
    ("café".encode(), "text/html; charset=iso-8859-1", None, "café"),
    (b"caf\xe9", "text/html; charset=ISO-8859-1", None, "café"),
    (b"<meta charset=windows-1251>\xcf\xf0\xe8\xe2\xe5\xf2", None, None, "<meta charset=windows-1251>Привет"),
    (b"<!-- <meta charset=utf-8> --><meta http-equiv=x content='a; charset=koi8-r'>\xf0", None, None, "<!-- <meta charset=utf-8> --><meta http-equiv=x content='a; charset=koi8-r'>П"),
    ("ééééé".encode() + b"\xff", None, None, "ééééé�"),
    (b"caf\xe9", "text/html; charset=utf-16", "http://a.example/", None),
    (b"\xcf\xf0\xe8\xe2\xe5\xf2", None, "http://site.ru/x", "Привет"),
    ("hi".encode("utf-16"), None, None, "hi"),
]


@pytest.mark.parametrize(("raw", "kind", "url", "want"), CASES)
def test_charsets(raw, kind, url, want):
    got = charset.decode_html(raw, kind, url)
    assert got == want if want is not None else "caf" in got
