"""Pairs of consecutive files in arrays, and what walks over them."""

import random
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

from stratograph.operators import graph, pairs, partition, resolve
from stratograph.plans import base
from stratograph.sources import tables


def consecutive(rows):
    """The same in plain Python."""
    out, commits, held = defaultdict(lambda: [0, 0]), defaultdict(set), defaultdict(list)
    for sha, *rest in rows:
        held[sha].append(rest)
        commits[rest[-1]].add(sha)
    for lines in held.values():
        files = [r[-1] for r in sorted(lines, key=lambda r: [(x is not None, x or 0) for x in r])]
        for x, y in zip(files, files[1:]):
            if x is not None and y is not None and x != y:
                out[min(x, y), max(x, y)][x > y] += 1
    return {(a, b, *n) for (a, b), n in out.items()} | {(f, f, len(s), 0) for f, s in commits.items() if f is not None}


def test_pairs_with_ties_and_nulls(spark, monkeypatch):
    draw = random.Random(5)
    some = lambda n: None if draw.random() < 0.1 else draw.randrange(n)
    rows = [(some(60), some(3), some(4), some(12)) for _ in range(900)]
    rows += [(2**62, 2**61, -(2**61), f) for f in (3, 4, 3)]  # no room for the keys in one number
    df = spark.createDataFrame(rows, "o long, n long, p long, f long")
    assert set(map(tuple, pairs.consecutive(df, "o", ["n", "p"], "f").collect())) == consecutive(rows)
    # the same in many pieces, none of which parts a commit
    monkeypatch.setattr(pairs, "AT_ONCE", 20)
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0))
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows[i : i + 7])], names=["o", "n", "p", "f"]) for i in range(0, len(rows), 7)]
    walked = [r for out in pairs._walked(iter(batches)) for r in zip(*(c.to_pylist() for c in out.columns))]
    total = defaultdict(lambda: [0, 0])
    for a, b, ahead, back in walked:
        total[a, b][0] += ahead
        total[a, b][1] += back
    assert {(*k, *n) for k, n in total.items()} == consecutive(rows)


def test_one_pass_gives_arcs_edges_and_churn(spark):
    d = "/root/testdata/sf0.01"
    rows = tables.checkpointed(base.pairs(spark, d))
    same = lambda x, y: Counter(map(tuple, x.collect())) == Counter(map(tuple, y.collect()))
    assert same(base.directed(rows), base.arcs(spark, d)) and same(base.linked(rows), base.undirected(spark, d))
    assert same(rows.where("a = b").select("a", "ahead"), base.commit_files(spark, d).groupBy("f").count())


def test_sources_walk_over_arrays(spark, monkeypatch):
    """Sources all at once, one by one or by joins: equal shares.  Levels in arrays write nothing."""
    draw = random.Random(2)
    links = [(i, i + 1, 1.0) for i in range(6)] + [(draw.randrange(10, 20), draw.randrange(10, 20), 1.0) for _ in range(20)] + [(5, 4, 2.0), (7, 7, 1.0)]
    edges = spark.createDataFrame(links, "a long, b long, weight double")
    cuts, write = [], tables.checkpointed
    monkeypatch.setattr(tables, "checkpointed", lambda df: (cuts.append(df), write(df))[1])
    got = []
    for cells, sample in ((4_000_000, 9), (40, 9), (0, 9), (4_000_000, 120)):
        cuts.clear()
        monkeypatch.setattr(graph, "MAX_CELLS", cells)
        got.append({r["node"]: round(r["betweenness"], 9) for r in graph.betweenness(edges, sample=sample).collect()})
        assert len(cuts) <= 3 if cells else len(cuts) > 8
    assert got[0] == got[1] == got[2] and max(got[2].values()) > 0 and got[3][3] > got[3][0] == 0


def test_a_component_is_dealt_by_one_number(spark, monkeypatch):
    """Rows in any order give what one run over the sorted graph gives; no sort of all arcs has more than one key."""
    draw = random.Random(11)
    links = sorted({(min(a, b), max(a, b)) for a, b in ((draw.randrange(40), draw.randrange(40)) for _ in range(160)) if a != b} | {(i, i + 1) for i in range(39)})
    rows = [("r", b, a, float(1 + (a * b) % 3)) if draw.random() < 0.5 else ("r", a, b, float(1 + (a * b) % 3)) for a, b in links]
    draw.shuffle(rows)
    nodes = list(range(40))
    want = partition.leiden([(min(a, b), max(a, b), w) for _, a, b, w in sorted(rows, key=lambda r: sorted(r[1:3]))], nodes)
    draw.shuffle(nodes)
    kind, keys = type(spark.range(0)), []
    sort = kind.sortWithinPartitions
    monkeypatch.setattr(kind, "sortWithinPartitions", lambda self, *c, **k: (keys.append(len(c)), sort(self, *c, **k))[1])
    edges, files = spark.createDataFrame(rows, "repo string, a long, b long, weight double"), spark.createDataFrame([("r", v) for v in nodes], "repo string, file_id long")
    assert {r["file_id"]: r["community"] for r in partition.partition(edges, files).collect()} == want
    assert keys == [1]


def test_whole_packages_take_little_room(spark, tmp_path):
    """A package's files are returned for one source after the other, so that equal arrays stand next to each other."""
    files = spark.range(2712).selectExpr("if(id < 1203, 'x', 'y') as package", "id * 7919 % 100003 as file", "'n' as name")
    names = spark.range(200).selectExpr("id as src", "explode(array('x', 'y')) as package", "'n' as name")
    resolve.narrowed_packages(names, files).write.parquet(str(tmp_path / "out"))
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == out.distinct().count() == 200 * 2712
    assert out.groupBy("package").agg({"file": "sum"}).exceptAll(files.groupBy("package").agg((F.sum("file") * 200).alias("s"))).count() == 0
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 0.6 * 200 * 2712
