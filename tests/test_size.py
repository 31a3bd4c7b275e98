"""Operators on tables larger than a test: what they put together, and that it stays whole."""

import random
import re

from stratograph.operators import graph, partition, resolve, signals
from stratograph.plans import catalogue
from stratograph.sources import document

FILES = "file_id long, path string, district long, x double, y double, loc long, complexity long, churn long, fanin double, rx double, ry double, rw double, rh double, code_lines long"


def test_uses_are_counted_before_they_meet_definitions(spark, monkeypatch):
    """A symbol used often by one file makes one row with each of its definitions, whether these are broadcast or not."""
    definitions = spark.createDataFrame([("s", f) for f in range(20)] * 2 + [("local 1", 0)], "symbol string, file_id long")
    references = spark.createDataFrame([("s", f % 3) for f in range(300)] + [("t", 1), ("local 1", 2)], "symbol string, file_id long")
    want = {(a, b, 1, 100) for a in range(3) for b in range(20) if a != b}
    for most in (resolve.MAX_BROADCAST_DEFINITIONS, 0):
        monkeypatch.setattr(resolve, "MAX_BROADCAST_DEFINITIONS", most)
        out = resolve.symbol_references(definitions, references)
        assert {tuple(r) for r in out.collect()} == want
        met = re.search(r"\bJoin\b(.*)", out._jdf.queryExecution().optimizedPlan().toString(), re.DOTALL)
        assert "count(1) AS n" in met[1]


def test_scored_files_and_arcs_are_made_once(spark, sf):
    """What landmarks reads many times is written before: none of its plan goes back to the tables of orders."""
    plan = catalogue.QUERIES["landmarks"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_suppkey" not in plan


def test_levels_beyond_the_broadcast(spark, monkeypatch):
    edges = spark.createDataFrame([(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0), (3, 0, 1.0), (3, 4, 1.0)], "a long, b long, weight double")
    want = sorted(map(tuple, graph.betweenness(edges).collect()))
    monkeypatch.setattr(graph, "MAX_BROADCAST_LEVEL", 0)
    assert sorted(map(tuple, graph.betweenness(edges).collect())) == want and want[3][1] > want[0][1] > want[4][1] == 0


def test_a_map_goes_on_in_further_parts(spark, tmp_path):
    """Seven files and nine pairs in parts of three: what is read back is the map of one part."""
    files = spark.createDataFrame([(i, f"p/{i}.py", i % 2, 0.1, 0.2, i, 2, 1, 1.0, 0.0, 0.0, 0.5, 0.5, 7) for i in range(7)], FILES)
    arcs = spark.createDataFrame([(i, (i * 3 + j) % 7) for i in range(5) for j in (1, 2) if (i, j) != (4, 2)] * 2, "src long, dst long")
    names = spark.createDataFrame([(0, "zero"), (1, "one")], "district long, name string")
    for part in (3, 100):
        doc = document.document(files, arcs, names, "r", "c", "py", 0.5, part=part)
        sizes = [(len(r["F"]), len(r["E"])) for r in doc.collect()]
        assert max(max(s) for s in sizes) <= part and len(sizes) == (3 if part == 3 else 1)
        document.write(doc, str(tmp_path / str(part)))
        got = document.load(spark, str(tmp_path / str(part)))
        assert {(r["file_id"], r["path"], r["loc"]) for r in got["files"].collect()} == {(i, f"p/{i}.py", float(i)) for i in range(7)}
        assert [(r["src"], r["dst"]) for r in got["arcs"].orderBy("pos").collect()] == sorted({tuple(r) for r in arcs.collect()})
        assert got["head"].count() == 1 and {r["name"] for r in got["districts"].collect()} == {"zero", "one"}


def test_components_run_apart(spark):
    """Two repositories with the same ids, of two components, a lone file each, and one without weight."""
    ring = lambda k: [(k + i, k + j, 1.0) for i in range(5) for j in range(i)]
    links = [(r, *e) for r in "pq" for e in ring(0) + ring(10) + [(20, 21, 1.0), (21, 22, 1.0)]]
    edges = spark.createDataFrame(links + [("z", 1, 2, 0.0)], "repo string, a long, b long, weight double")
    nodes = spark.createDataFrame([(r, v) for r in "pq" for v in [*range(5), *range(10, 15), 20, 21, 22, 99]] + [("z", 1), ("z", 2), ("z", 3)], "repo string, file_id long")
    got = {(r["repo"], r["file_id"]): r["community"] for r in partition.partition(edges, nodes).collect()}
    want = dict.fromkeys(range(5), 0) | dict.fromkeys(range(10, 15), 1)
    for r in "pq":
        assert {v: got[r, v] for v in want} == want and got[r, 99] == max(c for (x, _), c in got.items() if x == r)
    assert [got["z", v] for v in (1, 2, 3)] == [0, 0, 0] and len(got) == 31
    chain = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(70, 60), (60, 80)], "a long, b long")
    assert {r["node"]: r["component"] for r in partition.components(chain).collect()} == dict.fromkeys(range(51), 0) | dict.fromkeys((60, 70, 80), 60)


def test_cosines_over_chunks(spark, monkeypatch):
    """Blocks of one chunk and of many give the pairs that plain Python finds; only vectors are written, no pair's terms."""
    monkeypatch.setattr(signals, "CHUNK", 7)
    draw = random.Random(3)
    vectors = {}
    for i in range(40):
        words = {f"t{draw.randrange(30)}": draw.random() for _ in range(4)}
        norm = sum(w * w for w in words.values()) ** 0.5
        vectors[i] = {t: w / norm for t, w in words.items()}
    rows = [(i, t, w, "x" if i % 5 else "y") for i, v in vectors.items() for t, w in v.items()]
    df = spark.createDataFrame(rows, "id long, term string, w double, source string")
    dot = lambda a, b: sum(w * vectors[b].get(t, 0.0) for t, w in vectors[a].items())
    pairs = {(a, b) for a in vectors for b in vectors if a < b and dot(a, b) > 0.28}
    for block in (None, "source"):
        out = signals.cosine_pairs(df, block)
        got = {(r["a"], r["b"]): r["cosine"] for r in out.collect()}
        assert set(got) == {(a, b) for a, b in pairs if not block or bool(a % 5) == bool(b % 5)} and got
        assert all(abs(c - dot(*p)) < 1e-9 for p, c in got.items())
        assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 1


def test_whole_packages_are_dealt_out(spark, monkeypatch):
    """Rows of whole packages, as arrays or by a join, with a name that no file declares; arrays put no exchange over the rows."""
    declared = [("big", f, f"n{f % 10}") for f in range(40)] + [("big", 40, "alone"), ("big", None, "n1"), ("one", 7, "x"), ("one", 7, "y"), ("one", 8, "z"), (None, 9, "x")]
    selected = [(s, "big", f"n{s % 10}") for s in range(30)] + [(50, "big", "alone"), (51, "big", "alone"), (51, "big", "none"), (1, "one", "x"), (1, "one", "y"), (2, "one", "x"), (2, "one", "z"), (3, "lost", "x"), (4, None, "x")]
    want = {(s, "big", f) for s in [*range(30), 51] for f in [*range(41), None]} | {(50, "big", 40), (1, "one", 7), (2, "one", 7), (2, "one", 8)}
    have, names = spark.createDataFrame(declared, "package string, file long, name string"), spark.createDataFrame(selected, "src long, package string, name string")
    for most, at_once, rows in ((2_000_000, 10_000, 10_000_000), (2_000_000, 7, 100), (0, 7, 100)):
        for name, value in (("MAX_BROADCAST_FILES", most), ("FILES_AT_ONCE", at_once), ("ROWS_AT_ONCE", rows)):
            monkeypatch.setattr(resolve, name, value)
        out = resolve.narrowed_packages(names, have)
        got = list(map(tuple, out.collect()))
        assert set(got) == want and len(got) == len(want)
        if most:
            plan = out._jdf.queryExecution().optimizedPlan().toString()
            above = plan[: plan.index("Repartition")]
            assert "explode(files" in above and "rightHint=(strategy=broadcast)" in above
