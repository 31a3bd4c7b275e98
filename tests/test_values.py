"""Queries that SQL does not express, against plain Python over the same rows, or the laws that their results keep."""

from collections import Counter, defaultdict, deque
from itertools import pairwise

import pytest

from stratograph.functions.text import path_hash
from stratograph.operators import graph
from stratograph.operators.debt import bundles
from stratograph.plans import base, catalogue

CHECKED = {
    "betweenness", "class_orders", "cycle_report", "cycle_routes", "feedback_cut", "file_places", "landmarks", "leiden_partition", "neighbourhoods",
    "path_hash", "suggest_entry_routes", "symbol_cards", "treemap", "unique_names",
}


def run(name, spark, sf):
    return catalogue.QUERIES[name](spark, sf).collect()


@pytest.fixture(scope="module")
def town(spark, sf):
    """(files, arcs, undirected weights) as plain Python."""
    files = {r["file_id"]: r for r in base.sup(spark, sf).collect()}
    arcs = {(r["src"], r["dst"]): r["n"] for r in base.arcs(spark, sf).collect()}
    near = {(r["a"], r["b"]): r["weight"] for r in base.undirected(spark, sf).collect()}
    return files, arcs, near


def test_every_query_has_sql_or_a_check_here():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLES) == CHECKED


def shortest(near, start):
    """(distance, number of shortest paths) from a node to all."""
    far, ways, todo = {start: 0}, Counter({start: 1}), deque([start])
    while todo:
        v = todo.popleft()
        for u in near[v]:
            if u not in far:
                far[u] = far[v] + 1
                todo.append(u)
            if far[u] == far[v] + 1:
                ways[u] += ways[v]
    return far, ways


def test_betweenness_counts_shortest_paths(spark, sf, town):
    near = defaultdict(set)
    for a, b in town[2]:
        near[a].add(b)
        near[b].add(a)
    nodes = sorted(near)
    paths = {v: shortest(near, v) for v in nodes}
    n, want = len(nodes), {}
    for v in nodes:
        total = 0.0
        for i, s in enumerate(nodes):
            for t in nodes[i + 1 :]:
                if v not in (s, t) and t in paths[s][0] and paths[s][0].get(v, 99) + paths[v][0].get(t, 99) == paths[s][0][t]:
                    total += paths[s][1][v] * paths[v][1][t] / paths[s][1][t]
        want[v] = total / ((n - 1) * (n - 2) / 2)
    assert {r["node"]: r["betweenness"] for r in run("betweenness", spark, sf)} == pytest.approx(want, abs=1e-6)


def acyclic(arcs):
    arcs = set(arcs)
    while free := {(a, b) for a, b in arcs if all(d != a for _, d in arcs)}:
        arcs -= free
    return not arcs


def test_feedback_cut_breaks_all_cycles(spark, sf, town):
    files, arcs, _ = town
    between = {(files[a]["district"], files[b]["district"]) for a, b in arcs} - {(f["district"], f["district"]) for f in files.values()}
    cut = {(r["src"], r["dst"]) for r in run("feedback_cut", spark, sf)}
    assert cut <= between and not acyclic(between) and acyclic(between - cut)
    # no arc of the cut could have stayed
    assert all(not acyclic((between - cut) | {c}) for c in cut)


def test_cycles(spark, sf):
    heavy = base.heavy_arcs(spark, sf)
    between = {(r["src"], r["dst"]) for r in bundles(base.sup(spark, sf), heavy).collect()}
    routes = defaultdict(list)
    for r in sorted(run("cycle_routes", spark, sf), key=lambda r: r["step"]):
        routes[r["component"]].append(r["district"])
    report = {r["component"]: r for r in run("cycle_report", spark, sf)}
    assert set(routes) == set(report) and routes
    for c, way in routes.items():
        assert way[0] == way[-1] and len(set(way)) == len(way) - 1 and all(step in between for step in pairwise(way))
        assert report[c]["cut"] >= 1 and report[c]["imports"] >= report[c]["bundles"] >= len(way) - 1


def test_leiden_beats_the_nations(spark, sf, town):
    out = {r["file_id"]: r["community"] for r in run("leiden_partition", spark, sf)}
    assert set(out) == set(town[0]) and set(out.values()) == set(range(len(set(out.values()))))
    edges = base.undirected(spark, sf)
    q = lambda label: graph.modularity(edges, spark.createDataFrame(list(label.items()), "file_id long, district long")).first()["q"]
    found = q(out)
    assert found >= q({f: r["district"] for f, r in town[0].items()}) and found >= q(dict.fromkeys(out, 0))
    # no file would rather be in another community
    for f in out:
        for c in set(out.values()):
            assert q(out | {f: c}) <= found + 1e-6


def test_neighbourhoods_part_every_district(spark, sf, town):
    rows = run("neighbourhoods", spark, sf)
    assert Counter(r["file_id"] for r in rows) == Counter(town[0].keys())
    by = defaultdict(Counter)
    for r in rows:
        by[r["district"]][r["neighbourhood"]] += 1
        assert r["district"] == town[0][r["file_id"]]["lang"]
    for sizes in by.values():
        assert set(sizes) == set(range(len(sizes))) and (sum(sizes.values()) > 40 or len(sizes) == 1)


def test_landmarks(spark, sf, town):
    files, arcs, near = town
    got = {r["file_id"]: r for r in run("landmarks", spark, sf)}
    assert sorted(r["rank"] for r in got.values()) == list(range(1, len(got) + 1))
    why = Counter(r["why"] for r in got.values())
    assert why["bridge"] == 2 and why["hub"] <= 2 and why["hazard"] <= 2
    fanin = Counter(b for _, b in arcs)
    hubs = [f for f, r in got.items() if r["why"] == "hub"]
    bridges = [f for f, r in got.items() if r["why"] == "bridge"]
    assert all(fanin[h] >= fanin[f] for h in hubs for f in files if f not in hubs + bridges)
    degree = Counter()
    for (a, b), w in near.items():
        degree[a] += w
        degree[b] += w
    earlier = {f for f, r in got.items() if r["why"] in ("entry", "bridge", "hub")}
    for f in (f for f, r in got.items() if r["why"] == "capital"):
        mates = [m for m in files if files[m]["district"] == files[f]["district"] and m not in earlier]
        assert degree[f] == max(degree[m] for m in mates)


def test_entry_routes_follow_imports(spark, sf, town):
    files, arcs, _ = town
    routes = defaultdict(list)
    for r in sorted(run("suggest_entry_routes", spark, sf), key=lambda r: r["step"]):
        routes[r["entry"]].append(r["file_id"])
    assert set(routes) == {a for a, _ in arcs}
    for entry, way in routes.items():
        home = [files[f]["district"] == files[entry]["district"] for f in way]
        assert way[0] == entry and 2 <= len(way) <= 5 and len(set(way)) == len(way) and all(step in arcs for step in pairwise(way))
        assert all(home[:-1])  # a route ends where it leaves home


def test_path_hashes(spark, sf, town):
    groups = defaultdict(list)
    for f in town[0].values():
        groups[f["district"]].append(f["path"])
    assert {r["district"]: r["hash"] for r in run("path_hash", spark, sf)} == {d: path_hash(p) for d, p in groups.items()}


def test_names_are_unique(spark, sf):
    names = [r["name"] for r in run("unique_names", spark, sf)]
    assert names and len(set(names)) == len(names) and all(names)


def test_treemap_areas(spark, sf):
    parts = {r["file_id"]: r for r in base.part_files(spark, sf).collect()}
    rows = run("treemap", spark, sf)
    total = sum(p["complexity"] for p in parts.values())
    assert Counter(r["file_id"] for r in rows) == Counter(parts.keys())
    by = defaultdict(list)
    for r in rows:
        assert r["w"] * r["h"] == pytest.approx(0.62**2 * parts[r["file_id"]]["complexity"] / total, rel=0.02, abs=1e-6)
        by[r["district"]].append(r)
    for own in by.values():  # no two overlap
        for i, p in enumerate(own):
            for q in own[:i]:
                assert min(p["x"] + p["w"], q["x"] + q["w"]) - max(p["x"], q["x"]) < 1e-4 or min(p["y"] + p["h"], q["y"] + q["h"]) - max(p["y"], q["y"]) < 1e-4


def test_file_places(spark, sf, town):
    rows = run("file_places", spark, sf)
    assert Counter(r["file_id"] for r in rows) == Counter(town[0].keys()) and all(0 <= r["x"] <= 1 and 0 <= r["y"] <= 1 for r in rows)


def test_symbol_cards(spark, sf):
    rows = run("symbol_cards", spark, sf)
    assert sorted(r["sym"] for r in rows) == sorted(r["file_id"] for r in base.part_files(spark, sf).collect()) and {r["numbers"] for r in rows} == {8}


def test_class_orders_are_monotonic(spark, sf):
    bases = {}
    for r in base.part_files(spark, sf).collect():
        k = r["file_id"]
        if own := [b for b in dict.fromkeys((k // 2, k // 3)) if b not in (0, k)]:
            bases[k] = own
    orders = defaultdict(list)
    for r in sorted(run("class_orders", spark, sf), key=lambda r: r["pos"]):
        orders[r["cls"]].append(r["base"])
    assert orders and set(orders) <= set(bases)
    for c, order in orders.items():
        assert order[0] == c and len(set(order)) == len(order)
        lines = [bases[c], *(orders[b] for b in bases[c] if b in orders)]
        assert all([x for x in order if x in line] == line for line in lines)
