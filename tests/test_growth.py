"""What keeps the cost of stored corpora in proportion to their pages: nodes aren't sorted or moved to be written, and only wanted ones reach Python."""

from tagloom.functions.tree import build, parse_rows_of
from tagloom.operators.corpus import Corpus, docs_of, parse_pages
from tagloom.plans import catalog, ledger


def stored_plans(spark):
    """The plans of writes into tables so far: the trees of their operators."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    every = spark._jsparkSession.sharedState().statusStore().executionsList()
    said = [every.apply(i).physicalPlanDescription() for i in range(every.size())]
    trees = [x.split("\n\n\n")[0].split("== Initial Plan ==")[0] for x in said]
    return [x for x in trees if "InsertIntoHadoopFsRelationCommand" in x and "CreateDataSourceTableAsSelect" not in x]


def pages(spark, n=40):
    return spark.createDataFrame([(i, f"k{i}", f"<title>{i}</title><ul><li>a<b>{i}</b><li>b</ul>") for i in range(n)], "at long, key string, html string")


def test_nodes_are_written_as_they_come(spark, tmp_path):
    path = str(tmp_path / "c")
    c = parse_pages(pages(spark), order="at").write(path, buckets=3)
    nodes = [x for x in stored_plans(spark) if "MapInArrow" in x][-1]
    assert "Sort" not in nodes.split("MapInArrow")[0] and "Exchange" not in nodes.split("MapInArrow")[0]
    before = [tuple(r) for r in c.nodes.drop("checksum", "attrs", "classes").orderBy("pos", "idx").collect()]
    c.append(path, pages(spark, 50), order="at")
    seen = len(stored_plans(spark))
    one = Corpus.compact(spark, path)
    nodes = stored_plans(spark)[seen]  # its docs follow
    assert "MapInArrow" not in nodes and "Sort" not in nodes and "Exchange" not in nodes
    assert [tuple(r) for r in one.nodes.where("pos < 40").drop("checksum", "attrs", "classes").orderBy("pos", "idx").collect()] == before
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


def test_only_wanted_subtrees_are_written_as_markup(spark, monkeypatch):
    c = parse_pages(pages(spark), order="at")
    seen = []
    own = Corpus._per_page
    monkeypatch.setattr(Corpus, "_per_page", lambda self, nodes, pretty: seen.append(nodes.count()) or own(self, nodes, pretty))
    rows = c.markup(c.select("li:first-child, b").select("pos", "idx")).orderBy("pos", "idx").collect()
    assert seen == [40 * 4] and [r["html"] for r in rows[:2]] == ["<li>a<b>0</b></li>", "<b>0</b>"] and len(rows) == 80


def test_pages_of_orders_are_made_in_many_parts(spark, sf_dir):
    n = ledger.buckets(spark, sf_dir)
    assert n >= int(spark.conf.get("spark.sql.shuffle.partitions")) and ledger.pages(spark, sf_dir, 7).rdd.getNumPartitions() == 7
    rows = ledger.pages(spark, sf_dir)
    rows.collect()
    assert "coalesced" not in rows._jdf.queryExecution().executedPlan().toString() and rows.rdd.getNumPartitions() == n


def test_queries_join_by_page_and_place_without_a_shuffle(spark, sf_dir):
    before = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "true")  # a session that isn't tagloom's
    try:
        out = ledger.queries()["ledger_elements"](spark, sf_dir)
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
        assert catalog.queries()["link_count"](spark, sf_dir).first()["n"]
    finally:
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", before)


def test_tags_met_before_are_not_shared():
    a = build('<b title="&amp x" class="q">')
    a[1].attrs.append(("y", "z"))
    a[1].classes.append("r")
    again = build('<b title="&amp x" class="q">')[1]
    assert again.attrs == [("title", "&amp x".replace("&amp", "&"))] and again.classes == ["q"]
    assert parse_rows_of('<b title="&amp x" class="q">', bare_references=False)[0][1][4] == [("title", "&amp x")]


def test_local_selectors_are_counted_in_one_pass(spark, sf_dir):
    out = ledger.queries()["ledger_attributes"](spark, sf_dir)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation ") == 1 and out.count() == 15


def test_docs_are_told_without_nodes(spark):
    c = parse_pages(pages(spark), order="at", max_nodes=6)
    assert "end_idx" not in c.docs._jdf.queryExecution().optimizedPlan().toString()
    c = parse_pages(pages(spark).union(spark.createDataFrame([(40, "n", None)], "at long, key string, html string")), order="at", max_nodes=8)
    assert sorted(map(tuple, c.docs.collect()), key=str) == sorted(map(tuple, docs_of(c.nodes).collect()), key=str)
    assert "rangepartitioning" not in c.diff(c, ordered=False)._jdf.queryExecution().executedPlan().toString()
