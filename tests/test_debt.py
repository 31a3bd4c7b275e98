"""Structural debt over a small harbour: port and ship import each other, and the crew's stray works for the port."""

import pytest

from stratograph.operators import check, debt, graph, lookup, partition

PORT, SHIP, CREW = 0, 1, 2
# (path, district, complexity, churn, fan-in); ids are places in the list
HARBOUR = [
    ("lib/port/quay.py", PORT, 3, 1, 1.0), ("lib/port/crane.py", PORT, 4, 1, 3.0), ("lib/port/rope.py", PORT, 2, 1, 2.0),
    ("lib/ship/hull.py", SHIP, 40, 4, 8.0), ("lib/ship/mast.py", SHIP, 5, 1, 1.0), ("lib/ship/keel.py", SHIP, 2, 1, 1.0),
    ("lib/crew/cook.py", CREW, 3, 1, 1.0), ("lib/crew/mate.py", CREW, 5, 1, 1.0), ("lib/crew/sail.py", CREW, 25, 30, 2.0),
    ("lib/crew/stray.py", CREW, 4, 1, 1.0), ("lib/crew/drift.py", CREW, 2, 1, 0.0), ("lib/crew/alone.py", CREW, 1, 1, 0.0),
]
FILES = [(i, *row) for i, row in enumerate(HARBOUR)]
INSIDE = [(0, 1), (1, 2), (3, 4), (4, 5), (6, 7), (7, 8), (9, 6), (7, 9), (10, 8)]
BETWEEN = [(0, 3), (3, 1), (9, 0), (9, 1), (9, 2)]
ARCS = INSIDE + BETWEEN


@pytest.fixture(scope="module")
def harbour(spark):
    files = spark.createDataFrame(FILES, "file_id long, path string, district long, complexity long, churn long, fanin double")
    return files, spark.createDataFrame(ARCS, "src long, dst long")


def test_the_crew_is_in_no_cycle(harbour):
    rows = debt.district_cycles(*harbour).collect()
    assert [r["districts"] for r in rows] == ["0,1"]


def test_misplaced(harbour):
    row = debt.misplaced(*harbour).collect()
    assert [(r["path"], r["edges"], r["to_district"], r["share"]) for r in row] == [("lib/crew/stray.py", 5, PORT, 0.6)]


def test_god_and_hotspot(harbour):
    files, _ = harbour
    assert [r["path"] for r in debt.god_files(files).collect()] == ["lib/ship/hull.py"]
    hot = debt.hotspots(files).orderBy("rank").collect()
    assert [(r["path"], r["score"]) for r in hot] == [("lib/crew/sail.py", 750), ("lib/ship/hull.py", 160)]


def test_only_what_imports_and_is_not_imported_is_unreached(harbour):
    assert [r["path"] for r in debt.unreached(*harbour).collect()] == ["lib/crew/drift.py"]


def test_pinned_to_itself_is_unpinned(harbour):
    files, arcs = harbour
    out = debt.pinned_districts(files, files, arcs)
    assert out.where("status <> 'kept'").count() == 0
    assert {(r["file_id"], r["district"]) for r in out.collect()} == {(f[0], f[2]) for f in FILES}


def test_pinned_places_and_leaves(spark, harbour):
    files, arcs = harbour
    head = files.select("file_id").union(spark.createDataFrame([(12,), (13,)], "file_id long"))
    more = arcs.union(spark.createDataFrame([(1, 12)], "src long, dst long"))
    out = {r["file_id"]: (r["district"], r["status"]) for r in debt.pinned_districts(head, files, more).collect()}
    assert out[12] == (PORT, "placed") and out[13] == (3, "unplaced")


def test_route_and_overview(harbour):
    files, arcs = harbour
    ordered = arcs.selectExpr("src", "dst", "dst as pos")
    assert [r["node"] for r in graph.route(ordered, 9, 5).orderBy("step").collect()] == [9, 0, 3, 4, 5]
    assert graph.route(ordered, 5, 9).first()["kind"] == "imported-by"
    assert graph.route(ordered, 11, 0).count() == 0
    names = files.selectExpr("district", "concat('d', district) as name").distinct()
    rows = {r["district"]: (r["files"], r["imports_in"], r["imports_out"]) for r in lookup.overview(files, arcs, names).collect()}
    assert rows == {PORT: (3, 4, 1), SHIP: (3, 1, 1), CREW: (6, 0, 3)}


def test_modularity_of_two_cliques(spark):
    edges = [(a, b, 1.0) for g in (range(4), range(4, 8)) for a in g for b in g if a < b] + [(0, 4, 1.0)]
    e = spark.createDataFrame(edges, "a long, b long, weight double")
    files = spark.createDataFrame([(i, i // 4) for i in range(8)], "file_id long, district long")
    assert graph.modularity(e, files, 1.0).first()["q"] == pytest.approx(12 / 13 - 2 * 0.25, abs=1e-6)
    assert graph.modularity(e.where("false"), files).first()["q"] == 0.0
    label = partition.leiden(edges, list(range(8)))
    assert len(set(label.values())) == 2 and len({label[i] for i in range(4)}) == 1
    assert partition.leiden([], [3, 1]) == {1: 0, 3: 0}
    assert partition.leiden(edges, list(range(8))) == label


def test_betweenness_of_a_path(spark):
    e = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0)], "a long, b long, weight double")
    out = {r["node"]: round(r["betweenness"], 6) for r in graph.betweenness(e).collect()}
    assert out == {0: 0.0, 1: round(2 / 3, 6), 2: round(2 / 3, 6), 3: 0.0}


def test_feedback_cut_leaves_no_cycle():
    arcs = [(0, 1, 5), (1, 2, 5), (2, 0, 1), (2, 3, 2), (3, 2, 1)]
    cut = graph.feedback_cut(arcs)
    assert cut == [(2, 0), (3, 2)]


def test_merge_tiny_takes_the_strongest_neighbour():
    member = {i: 0 for i in range(5)} | {i: 1 for i in range(5, 10)} | {10: 2}
    paths = {i: f"p{member[i]}/f{i}" for i in member}
    out = partition.merge_tiny(member, paths, [(10, 0, 1.0), (10, 6, 3.0)])
    assert out[10] == out[5] != out[0]


def test_merge_tiny_asks_the_directory_then_the_parent():
    big = {i: 0 for i in range(4)} | {i: 1 for i in range(4, 9)}
    paths = {i: f"a/b/f{i}" for i in range(4)} | {i: f"x/y/f{i}" for i in range(4, 9)} | {9: "x/y/new", 10: "a/c/new", 11: "other/place/new"}
    out = partition.merge_tiny(big | {9: 2, 10: 3, 11: 4}, paths, [])
    assert out[9] == out[4] and out[10] == out[0] and out[11] not in (out[0], out[4])


def test_verdict():
    assert check.verdict(5, 0.0)["exit_code"] == 1
    assert check.verdict(4, -0.00005)["exit_code"] == 0
    assert check.verdict(9, -1.0, None, None)["failed"] == []
