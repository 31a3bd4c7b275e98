"""Queries without SQL work on every arc, and routes on every hop."""

from stratograph.operators import graph
from stratograph.plans import base, catalogue


def test_every_arc_is_in_the_graph(spark):
    """On sf0.01 one arc in fifty is taken 10 times."""
    sf = "/root/testdata/sf0.01"
    linked = base.undirected(spark, sf)
    nodes = {r[0] for r in linked.select("a").union(linked.select("b")).distinct().collect()}
    assert {r["node"] for r in catalogue.QUERIES["betweenness"](spark, sf).collect()} == nodes
    assert catalogue.QUERIES["map_document"](spark, sf).first()["edges"] == base.arcs(spark, sf).count()


def test_the_sparse_graph_is_there_at_every_size(spark):
    """Of every source with imports one to three arcs, on the smallest tables and on larger ones."""
    for sf in ("sf0.001", "sf0.1"):
        d = f"/root/testdata/{sf}"
        every, heavy = base.arcs(spark, d), base.heavy_arcs(spark, d)
        assert heavy.select("src").distinct().count() == every.select("src").distinct().count()
        assert heavy.groupBy("src").count().agg({"count": "max"}).first()[0] <= 3


def test_communities_and_routes_are_found_at_scale(spark):
    d = "/root/testdata/sf0.1"
    per = catalogue.QUERIES["leiden_partition"](spark, d).groupBy("community").count().collect()
    assert 1 < len(per) < 1000
    assert catalogue.QUERIES["suggest_entry_routes"](spark, d).count() > 0


def test_long_routes_are_found(spark):
    chain = spark.createDataFrame([(i, i + 1, 0) for i in range(70)], "src long, dst long, pos long").coalesce(1)
    tree = {r["node"]: r["depth"] for r in graph.bfs_tree(chain, 0).collect()}
    assert tree == {i: i for i in range(71)}


def test_every_file_with_imports_is_an_entry(spark):
    sf = "/root/testdata/sf0.01"
    starts = {r["src"] for r in base.arcs(spark, sf).select("src").distinct().collect()}
    assert {r["entry"] for r in catalogue.QUERIES["suggest_entry_routes"](spark, sf).select("entry").distinct().collect()} == starts
