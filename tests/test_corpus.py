import gzip

import pytest
from pyspark.sql import functions as F

import tagloom
from tagloom.operators import probe, recipes, stats
from tagloom.operators.builder import CorpusBuilder
from tagloom.operators.corpus import Corpus, parse_pages
from tagloom.operators.document import parse
from tagloom.operators.filter import Filter


def pages(spark, rows, more=""):
    return spark.createDataFrame(rows, f"at long, key string, html string{more}")


@pytest.fixture(scope="module")
def scan(spark):
    """20 pages, every third with a heading and a link."""
    rows = [(i, f"page-{i:02}", f"<h1 class=t>Doc {i}</h1><a href='/l{i}'>go</a><a>no</a>" if i % 3 == 0 else f"<p>plain {i}</p>") for i in range(20)]
    return parse_pages(pages(spark, rows), order="at").persist()


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_scans(scan):
    hit = [i for i in range(20) if i % 3 == 0]
    assert rows_of(scan.matching("h1.t")) == [(i, f"page-{i:02}") for i in hit]
    assert rows_of(scan.scan_text("h1")) == [(i, f"page-{i:02}", [f"Doc {i}"]) for i in hit]
    assert rows_of(scan.scan_attr("a", "href")) == [(i, f"page-{i:02}", [f"/l{i}", None]) for i in hit]
    assert rows_of(scan.scan_attr("a", "HREF", skip_missing=True)) == [(i, f"page-{i:02}", [f"/l{i}"]) for i in hit]
    assert rows_of(scan.scan_attr("p", "href", skip_missing=True)) == [] and len(rows_of(scan.scan_attr("p", "href"))) == 13
    assert scan.scan_count("a") == 14 and scan.scan_count("a", "href") == 7 and scan.scan_count("nope") == 0
    table = scan.scan_table("a", text=True, attrs=["href"])
    assert table.columns == ["pos", "idx", "key", "text", "href"] and [tuple(r)[2:] for r in table.collect()][:2] == [("page-00", "go", "/l0"), ("page-00", "no", None)]
    with pytest.raises(ValueError):
        scan.scan_table("a", text=True, attrs=["TEXT"])
    with pytest.raises(ValueError):
        scan.scan_table("a", meta=["nope"])
    assert rows_of(scan.exactly("h1, p", 1).select("n").distinct()) == [(1,)]
    with pytest.raises(Exception, match="matches, not 1 to 1"):
        scan.exactly("a", 1).collect()


def test_keys_and_single_pages(scan):
    assert scan.count() == 20 and "page-03" in scan and "x" not in scan and rows_of(scan.keys())[-1] == (19, "page-19")
    assert scan.doc("page-03").select_text("a") == ["go", "no"] and scan.doc(pos=-1).key == "page-19" and scan.doc("x") is None
    assert scan["page-03"].key == scan[3].key == "page-03" and scan.get("x") is None and len(scan) == 20
    with pytest.raises(KeyError):
        scan["x"]
    with pytest.raises(IndexError):
        scan[20]
    assert [(d.key, d.select_count("h1")) for d in scan][:2] == [("page-00", 1), ("page-01", 0)]
    with pytest.raises(ValueError):
        scan.meta_table()
    assert scan.doc(pos=0).to_html() == parse('<h1 class=t>Doc 0</h1><a href="/l0">go</a><a>no</a>').to_html() and scan.meta_schema() is None


def test_rows_of_nodes(scan):
    a = scan.select("a")
    assert {tuple(r) for r in scan.css_paths(scan.select("h1")).select("css_path").collect()} == {("h1.t",)}
    assert rows_of(scan.markup(a).orderBy("pos", "idx").select("html"))[0] == ('<a href="/l0">go</a>',)
    assert scan.select_first("a").count() == 7 and rows_of(scan.own_texts(a).orderBy("pos", "idx").select("own_text"))[:2] == [("go",), ("no",)]
    assert scan.scan_html("h1").first()["values"] == ['<h1 class="t">Doc 0</h1>'] and scan.html(pretty=True).count() == 20


def test_filters(spark, tmp_path):
    rows = [(i, f"k,{i}", "<table class=data></table><b></b>" if i % 2 == 0 else "<p>") for i in range(10)]
    c = parse_pages(pages(spark, rows), order="at").persist()

    def kept(**sides):
        return [r["pos"] for r in c.matching(Filter(**sides)).collect()]

    assert kept() == list(range(10)) and kept(include_css="table.data") == [0, 2, 4, 6, 8] and kept(exclude_css=["table.data"]) == [1, 3, 5, 7, 9]
    assert kept(include_css=["table", "p"]) == [] and kept(include_keys=["k,1", "k,2"]) == [1, 2] and kept(include_css="b", include_keys=["k,1", "k,2"]) == [2]
    assert kept(exclude_css="b", exclude_keys=["k,1", "k,2"]) == [0, 1, 3, 4, 5, 6, 7, 8, 9] and kept(include_keys=[]) == []
    (tmp_path / "f.tsv").write_text("k,3\nk,5")
    f = Filter.rules(spark, ["words: a ,k", "css:p"], [str(tmp_path / "f.tsv")])
    assert f.include_keys == ["a", "k"] and [r.key for r in f.exclude_keys.collect()] == ["k,3", "k,5"]
    with pytest.raises(ValueError):
        Filter.rules(spark, ["nope"])


def test_write_open_append_with_metadata(spark, tmp_path):
    path = str(tmp_path / "c")
    schema = {"url": str, "status": int, "score": float, "ok": bool}
    with CorpusBuilder(spark, path, meta_schema=schema) as b:
        b.add("a", "<p>1", meta={"url": "u", "status": 200, "score": 1, "ok": True})
        b.add("b", "<p>2", meta={"status": 404})
        b.add("a", "<p>again")
        b.add_document("c", parse("<p>3"))
        with pytest.raises(ValueError):
            b.add("d", "x", meta={"nope": 1})
        with pytest.raises(TypeError):
            b.add("d", "x", meta={"status": True})
    c = Corpus.open(spark, path)
    assert c.meta_schema() == schema and rows_of(c.meta_table()) == [(0, "a", "u", 200, 1.0, True), (1, "b", None, 404, None, None), (2, "c", None, None, None, None)]
    assert rows_of(c.scan_table("p", text=True, meta=["status"]).drop("idx")) == [(0, "a", "1", 200), (1, "b", "2", 404), (2, "c", "3", None)]
    more = spark.createDataFrame([("b", "<p>old", 1), ("e", "<p>5", 500), ("d", "<p>4", None)], "key string, html string, status long")
    after = c.append(path, more, meta=["status"])
    assert rows_of(after.keys()) == [(0, "a"), (1, "b"), (2, "c"), (3, "d"), (4, "e")] and after.doc("b").text == "2" and after.doc("e").meta["status"] == 500
    with pytest.raises(ValueError):
        after.append(path, spark.createDataFrame([("z", None)], "key string, html string"))
    assert Corpus.open(spark, path).count() == 5
    skipped = after.append(path, spark.createDataFrame([("z", None), ("y", "ok")], "key string, html string"), on_error="skip")
    assert rows_of(skipped.keys())[-1][1] == "y"
    with pytest.raises(ValueError):
        CorpusBuilder(spark, path, meta_schema={"key": str})
    with tagloom.append(spark, path, on_error="skip") as b:
        b.add("a", "<p>late")
        b.add("new", "<p>n", meta={"ok": False})
        b.add("deep", "<b>" * 9000)
    c = tagloom.open(spark, path)
    assert b.skipped == ["deep"] and c["new"].meta["ok"] is False and c["a"].text == "1" and [d.key for d in c][-1] == "new"
    with pytest.raises(TypeError):
        tagloom.append(spark, path).add_document("x", c["a"])
    with pytest.raises(ValueError):
        tagloom.append(spark, path).write(str(tmp_path / "elsewhere"))


def test_stored_pages_stay_together(spark, tmp_path):
    """Nodes are bucketed by page: texts and combinators need no exchange, and an append adds files and changes none."""
    path = str(tmp_path / "it's")
    c = parse_pages(pages(spark, [(i, f"k{i}", f"<ul><li>{i}<li>x</ul>" if i % 2 else "<p>no") for i in range(12)]), order="at").write(path, buckets=3)
    own = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold",)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for rows in (c.texts(c.select("li")), c.select("ul li"), c.select("ul > li + li"), c.markup(c.select("li"))):
            assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
            assert rows.count() in (6, 12)
    finally:
        for k, v in own.items():
            spark.conf.set(k, v)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "it's").rglob("*.parquet")}
    after = c.append(path, spark.createDataFrame([("k1", "<li>late"), ("new", "<ul><li>n</ul>")], "key string, html string"))
    assert before.items() <= {p: p.stat().st_mtime_ns for p in (tmp_path / "it's").rglob("*.parquet")}.items()
    assert c.count() == 12 and after.count() == 13 and after.scan_count("li") == 13 and after["new"].text == "n" and Corpus.open(spark, path)[1].text == "1x"
    assert after.changed(lambda t: t.remove(t.select("li")[0]) if t.select("li") else None).write(path).scan_count("li") == 6
    assert Corpus.vacuum(spark, path) == 2 and Corpus.vacuum(spark, path) == 0 and Corpus.open(spark, path).scan_count("li") == 6


def test_failures_duplicates_and_diff(spark):
    rows = [(0, "a", "<p>1"), (1, "b", "<b>" * 30), (2, "a", "<p>other"), (3, "c", None), (4, "d", "x"), (5, None, "y")]
    c = parse_pages(pages(spark, rows), order="at", max_depth=20)
    assert [(r["key"], r["pos"]) for r in c.skipped().collect()] == [("b", 1), ("c", 3)] and c.count() == 4 and c.scan_text("p").first()["values"] == ["1"]
    new = parse_pages(pages(spark, [(0, "d", "x!"), (1, "a", "<p>1</p>"), (2, "n", "z")]), order="at")
    assert rows_of(c.diff(new)) == [(0, "d")]
    by_key = parse_pages(spark.createDataFrame([("z", "1"), ("ab", "2"), ("a", "3")], "key string, html string"))
    assert rows_of(by_key.keys()) == [(0, "a"), (1, "ab"), (2, "z")]


def test_probe(spark):
    rows = [(0, "foo", "<section class='s t'><div><h1 id=i>A</h1><p>x</p></div><a href=/1>l</a></section>"), (1, "bar", "<section class=s><h1>B</h1><h1>A</h1></section>")]
    c = parse_pages(pages(spark, rows), order="at").persist()
    got = {tuple(r["path"]): (r["n"], r["keys"]) for r in probe.probe(c, ["section => HtmlFmt[class^=s]@words", "section > div > h1 => CssFmt[id][text]", "h1 => CssTerse[text='A']", "a => CssTerse[href]"]).collect()}
    assert got == {
        ("<section class='s'>",): (2, ["foo", "bar"]), ("<section class='s'>", "h1#i[text='A']"): (1, []), ("<section class='s'>", "a['/1']"): (1, []),
        ("<section class='s'>", "h1"): (1, []), ("<section class='s'>", "h1['A']"): (1, []),
    }
    assert probe.rendered(probe.probe(c, ["section => CssFmt", "h1 => CssFmt"])) == "ᵃsection²\n  ᵇh1³"
    shown = probe.rendered(probe.probe(c, ["section => CssFmt@words", "section > div, section > a => CssFmt", "h1 => CssFmt[id]"]))
    assert shown == "ᵃsection²[foo,bar]\n  ᵇdiv¹\n    ᶜh1#i¹\n  ᵇa¹\n  ᵇh1²"
    for bad in ("section", "p => Nope", "p => CssFmt[", "p => CssFmt@x"):
        with pytest.raises(ValueError):
            probe.Expression(bad)


def test_statistics_and_recipes(spark):
    ld = '<script type="application/ld+json">{"@graph": [{"@type": "A"}, {"@type": ["B", "C"]}]}</script><script type="application/ld+json">nope</script>'
    rows = [
        (0, "http://a.example/1", f"<title>T</title><h1>One</h1><p>{'word ' * 60}</p><h2>Two</h2><p>{'more ' * 300}</p><nav>skip {'x ' * 80}</nav><img src=x><img alt=''><a href='http://b.example/z'>b</a><a href='http://A.example/y'>own</a>{ld}"),
        (1, "http://a.example/2", "<title>T</title><main><p>" + "text " * 20 + "</p></main><p>" + "out " * 20 + "</p><ol><li>1<li>2<li>3<li>4</ol><a href='http://b.example/'>b</a><x-y></x-y>"),
    ]
    c = parse_pages(pages(spark, rows), order="at").persist()
    assert rows_of(recipes.link_domains(c)) == [("b.example", 2, 2)]
    assert sorted(rows_of(recipes.json_ld_types(c))) == [("A", 1, 1), ("B", 1, 1), ("C", 1, 1)] and rows_of(recipes.json_ld_share(c)) == [(2, 1, 0.5)]
    assert rows_of(recipes.duplicate_titles(c)) == [("T", 2)] and [r["key"] for r in recipes.missing(c, "h1").collect()] == ["http://a.example/2"]
    audit = {r["pos"]: r for r in recipes.page_audit(c).collect()}
    assert (audit[0]["h1"], audit[0]["links"], audit[0]["images_without_alt"], audit[1]["h1"]) == ("One", 2, 1, None)
    assert rows_of(recipes.totals(c, {"a": "a", "li": "ol li"})) == [(3, 4)] and recipes.first_texts(c).first()["values"] == ["1", "2", "3"]
    assert {r["pos"] for r in recipes.chunks(c).collect()} == {1}  # the first has no main part and no body
    assert [r["text"].split()[0] for r in recipes.paragraphs(c).orderBy("pos").collect()] == ["word", "text"]
    per = {r["pos"]: r for r in stats.per_page(c).collect()}
    assert per[1]["ext_tag_names"] == 1 and per[0]["n_nodes"] == c.docs.where("pos = 0").first()["n_nodes"]
    assert stats.histogram(stats.per_page(c)).where("metric = 'n_nodes'").agg(F.sum("n")).first()[0] == 2
    assert stats.percentiles(stats.per_page(c)).where("metric = 'n_nodes' AND percentile = 99.999").first()["bound"] == max(per[0]["n_nodes"], per[1]["n_nodes"])
    assert rows_of(stats.coverage(stats.per_page(c))) == [(2, 0, 0, 0)] and stats.shared_symbols(c).count() == 1
    diff = c.snapshot_diff(parse_pages(pages(spark, [(0, "http://a.example/1", "<title>New</title>"), (1, "n", "x")]), order="at"))
    assert {(r["key"][-1], r["change"]) for r in diff.collect()} == {("1", "changed"), ("2", "removed"), ("n", "added")}


def _record(uri: str, body: bytes, kind: str = "text/html", warc_type: str = "response") -> bytes:
    block = b"HTTP/1.1 200 OK\r\nContent-Type: " + kind.encode() + b"\r\n\r\n" + body
    head = f"WARC/1.0\r\nWARC-Type: {warc_type}\r\nWARC-Target-URI: {uri}\r\nWARC-Date: 2020-01-02T03:04:05Z\r\nContent-Length: {len(block)}\r\n\r\n".encode()
    return gzip.compress(head + block + b"\r\n\r\n")


def test_sources_sinks_cli_and_stream(spark, tmp_path, capsys):
    from tagloom import cli
    from tagloom.sources import readers, sinks
    from tagloom.streaming.ingest import append_stream

    folder = tmp_path / "html"
    (folder / "sub").mkdir(parents=True)
    (folder / "b.HTML").write_bytes("<p>caf\xe9".encode("latin-1"))
    (folder / "a.htm").write_text("<h1>a</h1>")
    (folder / "sub" / "c.html").write_text("<p>c")
    (folder / "note.txt").write_text("no")
    assert sorted(rows_of(readers.folder(spark, str(folder)))) == [("a", "<h1>a</h1>"), ("b", "<p>café")]
    assert sorted(r["key"] for r in readers.folder(spark, str(folder), "relpath").collect()) == ["a.htm", "b.HTML", "sub/c.html"]
    warc = tmp_path / "x.warc.gz"
    warc.write_bytes(_record("http://e/1", "<p>é".encode()) + _record("http://e/1", b"<p>late") + _record("http://e/2", b"x", "image/png") + _record("http://e/3", b"<p>caf\xe9", "text/html; charset=latin1") + _record("http://e/4", b"", warc_type="request") + _record("http://e/5", b"<p>5")[:-30])
    got = readers.warc(spark, str(warc)).orderBy("ordinal").collect()
    assert [(r["key"], r["html"], r["status"], r["fetched"]) for r in got] == [("http://e/1", "<p>é", 200, "2020-01-02T03:04:05Z"), ("http://e/3", "<p>café", 200, "2020-01-02T03:04:05Z")]
    assert [r["key"] for r in readers.warc(spark, str(warc), keys=["http://e/3", "no"]).collect()] == ["http://e/3"] and readers.warc(spark, str(warc), limit=1).count() == 1
    seen = spark.createDataFrame([("a",), ("a",), ("b",)], "key string")
    assert rows_of(readers.tally(seen.where("key = 'b'"), seen)) == [(3, 1, 2, 1)]
    out = str(tmp_path / "packed")
    assert cli.main(["pack", str(folder), "-o", out], spark) == 0 and cli.main(["list", out, "-i", "css:h1", "--to-folder", str(tmp_path / "files")], spark) == 0
    assert capsys.readouterr().out == "a\nFound 1 word(s):\n" and (tmp_path / "files" / "a.html").read_text() == "<h1>a</h1>"
    assert cli.main(["convert", str(warc), str(tmp_path / "w")], spark) == 0 and "Converted: 2" in capsys.readouterr().out
    assert cli.main(["probe", str(tmp_path / "w"), "-p", "p => CssFmt[text]"], spark) == 0 and "ᵃp[text='café']¹" in capsys.readouterr().out
    assert cli.main(["extract", str(warc), "http://e/3"], spark) == 0 and capsys.readouterr().out == "<p>café\n" and cli.main(["extract", str(warc), "no"], spark) == 1
    (folder / "a.htm").write_text("<h1>changed</h1>")
    capsys.readouterr()
    assert cli.main(["diff", out, str(folder)], spark) == 0 and capsys.readouterr().out == "a\n"
    assert cli.main(["sources", str(warc)], spark) == 0 and cli.main(["stats", str(folder), "--limit", "1"], spark) == 0
    assert sinks.to_arrow(readers.folder(spark, str(folder))).num_rows == 2

    source, target = tmp_path / "in", str(tmp_path / "streamed")
    source.mkdir()
    for n, rows in enumerate(([("a", "<p>1"), ("b", None)], [("a", "<p>2"), ("c", "<p>3")])):
        spark.createDataFrame(rows, "key string, html string").coalesce(1).write.mode("append").json(str(source))
        stream = spark.readStream.schema("key string, html string").json(str(source))
        append_stream(stream, target, str(tmp_path / "checkpoint")).awaitTermination(120)
        assert n == 1 or Corpus.open(spark, target).doc("a").text == "1"
    assert {(r["key"], tuple(r["values"])) for r in Corpus.open(spark, target).scan_text("p").collect()} == {("a", ("1",)), ("c", ("3",))}


def test_files_of_keys_that_look_alike(tmp_path, spark):
    from tagloom.sources import sinks

    keys = ["a/b", "a:b", "a_b", "x" * 300, "x" * 300 + "y", "", sinks.file_name("a/b")]
    assert len({sinks.file_name(k) for k in keys}) == len(keys) and all(0 < len(sinks.file_name(k)) <= 200 for k in keys) and sinks.file_name("a_b") == "a_b"
    assert sinks.write_html(spark.createDataFrame([(k, k) for k in keys], "key string, html string"), str(tmp_path / "f")) == len(keys)
    assert sorted(p.read_text() for p in (tmp_path / "f").iterdir()) == sorted(keys)


def test_segments_are_made_one(spark, tmp_path):
    path = str(tmp_path / "c")
    for k in range(3):
        pages = spark.createDataFrame([(f"k{k}{i}", f"<p>{k}{i}") for i in range(5)], "key string, html string")
        c = parse_pages(pages).write(path) if not k else c.append(path, pages)
    before = [tuple(r) for r in c.scan_table("p", text=True).collect()]
    assert Corpus.segments(spark, path) == 3
    one = Corpus.compact(spark, path)
    assert Corpus.segments(spark, path) == 1 and [tuple(r) for r in one.scan_table("p", text=True).collect()] == before
    assert [tuple(r) for r in c.scan_table("p", text=True).collect()] == before  # a reader of the old version isn't disturbed
    assert Corpus.vacuum(spark, path) == 3 and [r["text"] for r in Corpus.open(spark, path).scan_table("p", text=True).collect()] == [r[3] for r in before]


def test_chunks_follow_the_walk(spark):
    long, x = "y" * 5000, "x" * 81
    rows = [
        (0, "a", f"<body><p>out {x}</p><article><p>{x}</p><h1> One </h1><p>short</p><h2>Two</h2><div>loose<p>{long}</p></div><nav><h2>N</h2><p>{x}</p></nav><ul><li>{x}<p>in</p></ul><h4>{x}</h4></article><main><p>{x}</p></main>"),
        (1, "b", f"<body><blockquote>{'z' * 80}</blockquote>"), (2, "c", f"<div role=main><pre>{x}</pre></div><body>{x}"), (3, "d", f"<p>{x}"),
    ]
    got = [(r["pos"], r["chunk"], r["heading"], r["text"]) for r in recipes.chunks(parse_pages(pages(spark, rows), order="at")).orderBy("pos", "chunk").collect()]
    whole = f"{long} {x}in"
    assert got == [(0, 0, "", x), *((0, i + 1, "Two", whole[i * 1200 : i * 1200 + 1200]) for i in range(5)), (2, 0, "", x)]
