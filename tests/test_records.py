"""Caches, commits, jobs, registries, comparisons and places, on small cases."""

import json
import math
import subprocess

import numpy as np
import pytest

from stratograph.operators import compare, debt, graph, naming, overlay, placement, resolve, runs, search, symbols
from stratograph.sources import publish


@pytest.fixture(scope="module")
def checkout(tmp_path_factory):
    at = tmp_path_factory.mktemp("code") / "one"
    at.mkdir()
    git = lambda *a: subprocess.run(["git", "-C", str(at), *a], check=True, capture_output=True, text=True).stdout.strip()
    git("init", "-q")
    git("config", "user.email", "a@example.org")
    git("config", "user.name", "a")
    (at / "x.py").write_text("first = 1\n")
    git("add", ".")
    git("commit", "-qm", "one")
    first = git("rev-parse", "HEAD")
    (at / "x.py").write_text("second = 2\n")
    git("commit", "-qam", "two")
    return str(at), first


def test_blob_and_worktree(checkout, tmp_path):
    repo, first = checkout
    assert publish.blob(repo, first, "x.py") == "first = 1\n"
    for commit, path in ((first[:10], "x.py"), (first, "../x.py"), (first, "/x.py"), (first, "")):
        with pytest.raises(ValueError):
            publish.blob(repo, commit, path)
    with pytest.raises(ValueError, match="over"):
        publish.blob(repo, first, "x.py", limit=3)
    with publish.Worktree(repo, first, str(tmp_path / "w")) as at:
        assert open(f"{at}/x.py").read() == "first = 1\n"
    assert not (tmp_path / "w").exists()


def test_checkouts(tmp_path):
    for p in ("b/.git", "a/deep/.git", "a/deep/inner/.git", ".hidden/c/.git", "none"):
        (tmp_path / p).mkdir(parents=True)
    (tmp_path / "link").symlink_to(tmp_path / "b")
    assert publish.checkouts(str(tmp_path)) == [str(tmp_path / "a/deep"), str(tmp_path / "b")]


def test_organization():
    good = 'version = 1\nname = "o"\n[[members]]\nrepo = "a/b"\ncommit = "%s"\n[[members]]\nrepo = "a/c"\ncommit = "%s"\npath = "sub"\n' % ("1" * 40, "2" * 40)
    assert publish.organization(good) == {"name": "o", "members": [("a/b", "1" * 40, None), ("a/c", "2" * 40, "sub")]}
    for bad in (good.replace("version = 1", "version = 2"), good.replace("a/c", "A/B"), good.replace("2" * 40, "2" * 9)):
        with pytest.raises(ValueError):
            publish.organization(bad)


def test_organization_document(spark):
    members = publish.member_table(spark, 'version = 1\nname = "o"\n[[members]]\nrepo = "a/b"\ncommit = "%s"\n' % ("1" * 40))
    edges = spark.createDataFrame([("a/b", "a/c", 2)], "source string, target string, evidence int")
    got = json.loads(publish.organization_document("o", members, edges))
    assert got["members"] == [{"repo": "a/b", "commit": "1" * 40}] and got["edges"][0]["evidence"] == 2


def test_published_once(spark, tmp_path):
    row = spark.createDataFrame([("b", "h", 1)], "base string, head string, n int")
    one = publish.publish_once(row, str(tmp_path), ["base", "head"])
    two = publish.publish_once(row.selectExpr("base", "head", "2 as n"), str(tmp_path), ["base", "head"])
    assert one == two and spark.read.json(one).first()["n"] == 1


def test_extraction_cache(spark, tmp_path):
    at = str(tmp_path / "cache")
    assert publish.extractions(spark, at, "c").count() == 0
    rows = spark.createDataFrame([("c", "p", "d", "{}"), ("other", "p", "d", "{}")], "context string, path string, digest string, payload string")
    publish.append_extractions(rows, at)
    publish.append_extractions(rows, at)
    assert [tuple(r) for r in publish.extractions(spark, at, "c").collect()] == [("c", "p", "d", "{}")]
    spark.createDataFrame([("q", "d", "{}", "wrong", "c")], "path string, digest string, payload string, payload_digest string, context string").write.mode("append").partitionBy("context").parquet(at)
    assert [r["path"] for r in publish.extractions(spark, at, "c").collect()] == ["p"]


def test_symbols_beside_the_map(spark, tmp_path):
    compact = spark.createDataFrame([(1, "a")], "sym long, name string")
    assert publish.load_symbols(spark, str(tmp_path / "none"), compact) is compact
    spark.createDataFrame([(1, "a"), (2, "b")], "sym long, name string").write.json(str(tmp_path / "s"))
    assert publish.load_symbols(spark, str(tmp_path / "s"), compact).count() == 2


def test_summary(spark):
    rows = spark.createDataFrame([("small", float(i)) for i in range(11)], "band string, s double")
    summary = publish.band_summary(rows, "band", ["s"])
    assert publish.summary_markdown(summary, "band").splitlines()[-1] == "| s | 5 [1-9] |"


def test_jobs():
    job = publish.Job("a/b", "c", [("src", "python")])
    assert publish.Job.read(job.text()) == job
    for bad in ('{"repo": "a"}', '{"repo": "a", "commit": "c", "shell": "x"}'):
        with pytest.raises(ValueError):
            publish.Job.read(bad)


def test_execution(spark):
    seen = []
    job, events = runs.execute(spark, [("one", lambda: seen.append(spark.range(3).count())), ("two", lambda: 1 / 0), ("three", lambda: seen.append(0))])
    assert seen == [3] and [(e[2], e[3]) for e in events] == [("one", "running"), ("one", "done"), ("two", "running"), ("two", "failed")]
    assert runs.event_table(spark, events).where("state = 'failed'").first()["detail"] == "division by zero"
    _, events = runs.execute(spark, [("one", lambda: 1)], cancelled=lambda: True)
    assert [e[3] for e in events] == ["cancelled"]


def test_adoption(spark):
    reported = spark.createDataFrame([("map", 2), ("symbols", 5)], "name string, rows long")
    done = []
    runs.adopt(reported, reported, ["name"], ["rows"], lambda: done.append(1))
    with pytest.raises(runs.Refused, match="count"):
        runs.adopt(reported, reported.selectExpr("name", "rows + 1 as rows"), ["name"], ["rows"], lambda: done.append(2))
    assert done == [1]


def test_refresh_uses_an_equal_snapshot(spark):
    old = spark.createDataFrame([("r", "c1", "auto", 1, 10)], "repo string, commit_sha string, selection string, sequence long, files int")
    build = lambda: spark.createDataFrame([(11,)], "files int")
    same, built = runs.refresh(old, "r", "c1", "auto", build)
    assert not built and same.first()["files"] == 10
    new, built = runs.refresh(old, "r", "c2", "auto", build)
    assert built and (new.first()["sequence"], new.first()["files"]) == (2, 11)


def test_migrations(spark):
    jobs = spark.createDataFrame([("j",)], "job_id string")
    got = runs.migrated(jobs, "jobs", 3).first()
    assert got.asDict() == {"job_id": "j", "state": "queued", "epoch": 0, "spec_json": "{}"}
    assert runs.schema("maps", 1).names == ["slug", "commit_sha", "indexed_at"] and runs.schema("maps").names[-1] == "branch"
    with pytest.raises(ValueError):
        runs.migrated(jobs, "jobs", 99)
    both = runs.registered(spark.createDataFrame([("a", "1"), ("b", "2")], "slug string, path string"), spark.createDataFrame([("a", "3")], "slug string, path string"))
    assert sorted(tuple(r) for r in both.collect()) == [("a", "3"), ("b", "2")]


def test_policy():
    assert runs.Policy().enforce("read", lambda: 5) == 5
    for policy in (runs.Policy(allow=["write"]), runs.Policy(deny=["read"])):
        with pytest.raises(runs.Refused):
            policy.enforce("read", lambda: 5)


def test_parity_of_a_map_with_itself(spark):
    files = spark.createDataFrame([(i, f"p{i}", i // 4) for i in range(8)], "file_id long, path string, district long")
    edges = spark.createDataFrame([(0, 1, 1.0), (4, 5, 1.0), (1, 4, 1.0)], "a long, b long, weight double")
    row = compare.parity(files, files, edges, edges).first()
    assert row.asDict() == {"files": 8, "placed_alike": 1.0, "dq": 0.0, "edges_lost": 0, "edges_new": 0, "passed": True}
    assert not compare.parity(files, files, edges, edges.where("a <> 0")).first()["passed"]


# districts 1 -> 2 -> 3 -> 1 and 3 <-> 4, files ten times their district
WAYS = [(10, 20), (20, 30), (21, 30), (30, 10), (30, 40), (40, 30), (41, 30), (50, 10)]


@pytest.fixture(scope="module")
def ring(spark):
    nodes = sorted({n for w in WAYS for n in w})
    return spark.createDataFrame([(n, f"f{n}", n // 10) for n in nodes], "file_id long, path string, district long"), spark.createDataFrame(WAYS, "src long, dst long")


def test_cycle_routes(ring):
    got = debt.cycle_routes(*ring).orderBy("step").collect()
    assert [(r["component"], r["district"]) for r in got] == [(1, 1), (1, 2), (1, 3), (1, 1)]


def test_cycle_report(ring):
    row = debt.cycle_report(*ring).first()
    assert (row["districts"], row["bundles"], row["imports"], row["mutual"]) == ("1,2,3,4", 5, 7, ["3>4"])
    cut = {tuple(map(int, c.split(">"))) for c in row["cut"]}
    left = {(a // 10, b // 10) for a, b in WAYS} - cut
    while gone := {(a, b) for a, b in left if not any(c == b for c, _ in left)}:
        left -= gone
    assert not left and debt.compact_evidence(debt.cycle_report(*ring)).first()["mutual"] == 1


def test_streets(spark):
    files = spark.createDataFrame([(1, "d", "x"), (2, "d", "y"), (3, "d", "y"), (4, "e", "z")], "file_id long, district string, neighbourhood string")
    arcs = spark.createDataFrame([(1, 2), (1, 3), (2, 1), (2, 3), (1, 4), (4, 2)], "src long, dst long")
    assert [tuple(r) for r in search.street_flows(arcs, files, "d").orderBy("rank").collect()] == [("x", "y", 2, 1), ("y", "x", 1, 2)]
    assert [tuple(r)[:4] for r in search.cross_flows(arcs, files, "d").orderBy("rank").collect()] == [("x", "e", True, 1), ("y", "e", False, 1)]


def test_palette(spark):
    files = spark.createDataFrame([(1, "p/road.py", 3), (2, "p/broad.py", 9), (3, "q/x.py", 1)], "file_id long, path string, fanin long")
    districts = spark.createDataFrame([(0, "Roads", 2, "mainland"), (1, "Hall", 1, "unconnected")], "district long, name string, size long, class string")
    got = sorted((r["kind"], r["name"], r["rank"]) for r in search.grouped_results(files, None, districts, "road").collect())
    assert got == [("district", "Roads", 1), ("file", "p/broad.py", 2), ("file", "p/road.py", 1)]
    assert [r["name"] for r in search.grouped_results(files, None, districts, "").collect()] == ["Roads"]


def test_places():
    at = placement.apart(np.zeros((5, 2)), 0.1, 100)
    gaps = [math.dist(at[i], at[j]) for i in range(5) for j in range(i)]
    assert min(gaps) > 0.099
    groups = ["a"] * 20 + ["b"] * 20
    xy = placement.place_files(groups, [1.0] * 40, [(0, 1, 1.0), (0, 20, 0.1)])
    assert xy.shape == (40, 2) and (xy >= 0).all() and (xy <= 1).all() and len({tuple(p) for p in xy.tolist()}) == 40
    a, b = xy[:20].mean(0), xy[20:].mean(0)
    spread = np.sqrt(((xy[:20] - a) ** 2).sum(1)).mean()
    assert math.dist(a, b) > spread
    assert len(placement.place_files([], [], [])) == 0 and placement.place_files(["a"], [0.0], []).tolist() == [[0.5, 0.5]]
    towns = placement.organization_places(["x", "y", "z"], [("x", "y", 9)])
    assert len(set(towns.values())) == 3 and towns == placement.organization_places(["z", "y", "x"], [("x", "y", 9)])


def test_file_places(spark):
    files = spark.createDataFrame([(i, i % 2, i % 4) for i in range(12)], "file_id long, district long, neighbourhood long")
    edges = spark.createDataFrame([(0, 2, 1.0), (1, 3, 1.0), (0, 1, 1.0)], "a long, b long, weight double")
    got = placement.file_places(files, edges).collect()
    assert len(got) == 12 and all(0 <= r["x"] <= 1 and 0 <= r["y"] <= 1 for r in got)


def ring_area(ring):
    at = np.cumsum(np.array(ring, dtype=float).reshape(-1, 2), axis=0) / placement.CARD_SCALE
    x, y = at[:, 0], at[:, 1]
    return abs((x * np.roll(y, -1) - y * np.roll(x, -1)).sum()) / 2


def test_symbol_cards(spark):
    spans = [(0, None, 30), (1, None, 10), (2, 0, 5), (3, 0, 15), (4, 3, 1)]
    area = {s: ring_area(r) for s, r in placement.symbol_cards(spans)}
    assert area == pytest.approx({0: 0.75, 1: 0.25, 2: 0.1875, 3: 0.5625, 4: 0.5625}, rel=0.02)
    rows = spark.createDataFrame([(7, s, p, n) for s, p, n in spans], "file_id long, sym long, parent long, lines long")
    assert {r["sym"]: ring_area(r["ring"]) for r in placement.cards(rows).collect()} == pytest.approx(area)


def test_polygons(spark):
    notch = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.5, 0.2), (0.0, 1.0)]
    polygons = spark.createDataFrame([("n", [{"x": x, "y": y} for x, y in notch])], "polygon string, ring array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(1, 0.1, 0.5), (2, 0.5, 0.5), (3, 0.9, 0.5), (4, 0.5, 0.1), (5, 1.5, 0.5)], "point int, x double, y double")
    assert sorted(r["point"] for r in placement.inside_polygons(points, polygons, 0.3).collect()) == [1, 3, 4]


def test_linearizations(spark):
    # the textbook diamond, a class whose order does not exist, and one with an unknown base
    rows = [("B", 0, "A"), ("C", 0, "A"), ("D", 0, "B"), ("D", 1, "C"), ("X", 0, "A"), ("X", 1, "B"), ("E", 0, "ext")]
    got = {}
    for r in resolve.linearizations(spark.createDataFrame(rows, "cls string, pos int, base string")).orderBy("cls", "pos").collect():
        got.setdefault(r["cls"], []).append((r["base"], r["known"]))
    assert [b for b, _ in got["D"]] == ["D", "B", "C", "A"] and "X" not in got and got["E"] == [("E", True), ("ext", False)]


def test_references_up_the_hierarchy(spark):
    orders = spark.createDataFrame([(1, 0, 1, True), (1, 1, 2, True), (1, 2, 3, True), (4, 0, 4, True), (4, 1, 9, False), (4, 2, 3, True)], "cls long, pos int, base long, known boolean")
    members = spark.createDataFrame([(2, "walk", 20), (3, "walk", 30), (3, "stop", 31), (1, "own", 10)], "cls long, name string, sym_id long")
    rows = [(1, 1, "self", "walk", "call", 1), (2, 1, "super", "stop", "call", 1), (3, 1, "self", "own", "call", 1), (4, 1, "self", "none", "call", 1), (5, 1, "Walker", "stop", "call", None), (6, 1, "self", "stop", "call", 4)]
    candidates = spark.createDataFrame(rows, "owner long, file_id long, head string, attr string, kind string, cls long")
    bound = spark.createDataFrame([(1, "Walker", 1)], "file_id long, name string, sym_id long")
    none = spark.createDataFrame([], "owner long, name string"), spark.createDataFrame([], "name string, attr string, sym_id long")
    got = {r["owner"]: (r["target"], r["reason"]) for r in symbols.resolved_in_hierarchy(candidates, bound, members, *none, orders).collect()}
    up = "parent_class_method"
    assert got == {1: (20, up), 2: (31, up), 3: (10, "resolved"), 4: (None, "unresolved_attribute"), 5: (31, up), 6: (None, "unresolved_attribute")}


def test_topological_levels(spark):
    arcs = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (4, 5), (5, 4), (5, 6)], "src long, dst long")
    assert {r["node"]: r["level"] for r in graph.topological_levels(arcs).collect()} == {1: 0, 2: 1, 3: 2}


def test_routes_between_stops(ring):
    files, arcs = ring
    spark = files.sparkSession
    specs = overlay.table(spark, [("stop", "w", 0, "f10", None), ("stop", "w", 1, "f30", None), ("stop", "w", 2, "f50", None), ("stop", "w", 3, "gone", None), ("stop", "w", 4, "f41", "by hand")])
    got = [(r["kind"], r["steps"]) for r in overlay.hop_routes(specs, files, arcs).orderBy("pos").collect()]
    assert got == [("imports", 2), ("imported-by", 3), ("no_route", None), ("declared", None)]
    steps = graph.route_steps(arcs.selectExpr("src", "dst", "dst as pos"), files, 10, 30).orderBy("step").collect()
    assert [(r["path"], r["district"]) for r in steps] == [("f10", 1), ("f20", 2), ("f30", 3)]
    assert graph.route_steps(arcs.selectExpr("src", "dst", "dst as pos"), files, 10, 999).count() == 0


def test_reports_that_mean_other_things():
    debt.comparable({"version": 10, "pinned": "a"}, {"version": 10, "pinned": "a"})
    for other in ({"version": 9, "pinned": "a"}, {"version": 10}):
        with pytest.raises(ValueError):
            debt.comparable({"version": 10, "pinned": "a"}, other)


def test_names_are_unique_and_held(spark):
    ranked = spark.createDataFrame([(d, t, s, r) for d in (0, 1, 2) for r, (t, s) in enumerate([("road", 2.0), (f"t{d}", 0.5)], 1)], "district long, segment string, score double, rank int")
    sizes = spark.createDataFrame([(0, 5), (1, 9), (2, 3)], "district long, size long")
    names = {r["district"]: r["name"] for r in naming.unique_names(ranked, sizes).collect()}
    assert names == {1: "road", 0: "road / t0", 2: "road / t2"}
    held = spark.createDataFrame([(2, "road")], "district long, name string")
    assert {r["district"]: r["name"] for r in naming.unique_names(ranked, sizes, held).collect()} == {2: "road", 1: "road / t1", 0: "road / t0"}
