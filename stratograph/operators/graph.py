"""Graph operators: degrees, district aggregates, modularity, routes, reachability, components, centrality."""

from __future__ import annotations

import itertools
import random
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import round_even
from .blend import ends
from .pairs import whole_runs

RESOLUTION = 1.1
ROAD_FLOOR = 0.18
SAMPLE = 120
SEED = 7
JACCARD = 0.35
#: Most pairs of a source and a node that are sent to every executor: some 30 MB.
MAX_BROADCAST_LEVEL = 400_000
#: Most pairs of a source and a node that the driver holds, and sends to every executor: 12 bytes each.
MAX_CELLS = 4_000_000


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, neighbours): sorted distinct neighbours."""
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("n")).union(edges.select("b", "a"))
    return both.where("node <> n").groupBy("node").agg(F.array_sort(F.collect_set("n")).alias("neighbours"))


def weighted_degree(edges: DataFrame) -> DataFrame:
    return ends(edges).groupBy("node").agg(F.sum("weight").alias("degree"))


def placed(edges: DataFrame, files: DataFrame, a: str = "a", b: str = "b", how: str = "inner") -> DataFrame:
    """Edges with the districts of both ends (d_a, d_b)."""
    at = lambda end: files.select(F.col("file_id").alias(end), F.col("district").alias(f"d_{end}"))
    return edges.join(at(a), a, how).join(at(b), b, how)


def district_edges(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(da, db, weight), da < db: weight between two districts."""
    cross = placed(edges, files).where("d_a <> d_b")
    return cross.groupBy(F.least("d_a", "d_b").alias("da"), F.greatest("d_a", "d_b").alias("db")).agg(F.sum("weight").alias("weight"))


def roads(edges: DataFrame, files: DataFrame, floor: float = ROAD_FLOOR) -> DataFrame:
    """(da, db, strength): district pairs with more than ``floor`` of the heaviest pair's weight."""
    between = district_edges(edges, files)
    top = between.agg(F.max("weight").alias("top"))
    out = between.crossJoin(F.broadcast(top)).withColumn("s", F.col("weight") / F.col("top"))
    return out.where(F.col("s") > floor).select("da", "db", round_even(F.col("s"), 3).alias("strength"))


def classify(files: DataFrame, arcs: DataFrame, percent: int = 1) -> DataFrame:
    """(district, size, class): mainland with ``percent`` of all files, else an island if any file has an arc."""
    linked = arcs.select(F.explode(F.array("src", "dst")).alias("file_id")).distinct().withColumn("hit", F.lit(True))
    per = files.join(linked, "file_id", "left").groupBy("district").agg(F.count("*").alias("size"), F.coalesce(F.bool_or("hit"), F.lit(False)).alias("linked"))
    total = files.agg(F.count("*").alias("n"))
    kind = F.when(F.col("size") * 100 >= F.col("n") * percent, "mainland").when(F.col("linked"), "island").otherwise("unconnected")
    return per.crossJoin(F.broadcast(total)).select("district", "size", kind.alias("class"))


def modularity(edges: DataFrame, files: DataFrame, resolution: float = RESOLUTION) -> DataFrame:
    """One row ``q``: modularity of a fixed partition; edges with an unplaced end are ignored, no weight gives 0."""
    inner = placed(edges, files)
    sides = inner.select(
        F.explode(
            F.array(
                F.struct(F.col("d_a").alias("d"), F.col("weight").alias("k"), F.when(F.col("d_a") == F.col("d_b"), F.col("weight")).otherwise(0.0).alias("w")),
                F.struct(F.col("d_b").alias("d"), F.col("weight").alias("k"), F.lit(0.0).alias("w")),
            )
        ).alias("x")
    )
    per = sides.groupBy("x.d").agg(F.sum("x.k").alias("k"), F.sum("x.w").alias("w"))
    m = inner.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("m"))
    share = lambda x, y: F.try_divide(F.col(x), y)
    each = share("w", F.col("m")) - F.lit(resolution) * F.pow(share("k", 2 * F.col("m")), F.lit(2.0))
    return per.crossJoin(F.broadcast(m)).agg(round_even(F.coalesce(F.sum(each), F.lit(0.0)), 6).alias("q"))


def place_by_plurality(weights: DataFrame) -> DataFrame:
    """(file_id, district): the district with the largest positive weight, the smaller id on ties."""
    order = Window.partitionBy("file_id").orderBy(F.desc("weight"), "district")
    ranked = weights.where((F.col("weight") > 0) & ~F.isnan("weight")).withColumn("rn", F.row_number().over(order))
    return ranked.where("rn = 1").select("file_id", "district", "weight")


def mutual_pairs(bundles: DataFrame) -> DataFrame:
    """(a, b, lighter_src, n_ab, n_ba) of districts that import each other; the lighter direction, or the smaller id."""
    back = bundles.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("n").alias("n_ba"))
    both = bundles.where("src < dst").join(back, ["src", "dst"])
    lighter = F.when(F.col("n") <= F.col("n_ba"), F.col("src")).otherwise(F.col("dst"))
    return both.select(F.col("src").alias("a"), F.col("dst").alias("b"), lighter.alias("lighter_src"), F.col("n").alias("n_ab"), "n_ba")


def bfs_tree(arcs: DataFrame, start, goal=None, max_depth: int | None = None) -> DataFrame:
    """(node, depth, parent): breadth-first arrivals.  ``arcs``: src, dst, pos; of several arrivals at one depth, the
    first in the order of the frontier and then of ``pos`` counts.  Each round joins the frontier only, until it is empty
    or, where the caller asks for that, at ``max_depth``."""
    from ..sources.tables import checkpointed

    spark = arcs.sparkSession
    kind = arcs.schema["src"].dataType.simpleString()
    seen = spark.createDataFrame([(start, 0, None, 0)], f"node {kind}, depth int, parent {kind}, place long")
    frontier = seen
    for depth in itertools.count(1) if max_depth is None else range(1, max_depth + 1):
        step = frontier.select(F.col("node").alias("src"), "place").join(arcs, "src")
        first = Window.partitionBy("dst").orderBy("place", "pos")
        fresh = step.withColumn("rn", F.row_number().over(first)).where("rn = 1").join(seen.select(F.col("node").alias("dst")), "dst", "left_anti")
        fresh = fresh.select(
            F.col("dst").alias("node"), F.lit(depth).alias("depth"), F.col("src").alias("parent"),
            F.row_number().over(Window.orderBy("place", "pos")).cast("long").alias("place"),
        )
        frontier = checkpointed(fresh)
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)
        if depth % 16 == 0:  # else the plan grows with the depth
            seen = checkpointed(seen)
        if goal is not None and frontier.where(F.col("node") == F.lit(goal)).limit(1).count():
            break
    return seen.select("node", "depth", "parent")


def route(arcs: DataFrame, start, goal, max_depth: int | None = None) -> DataFrame:
    """(step, node, kind): a shortest path along arcs (imports), else against them (imported-by), else in any direction
    (undirected); no rows without one."""
    spark = arcs.sparkSession
    node = arcs.schema["src"].dataType.simpleString()
    if start == goal:
        return spark.createDataFrame([(0, start, "same-file")], f"step int, node {node}, kind string")
    back = arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "pos")
    for kind, graph in (("imports", arcs), ("imported-by", back), ("undirected", arcs.unionByName(back))):
        tree = bfs_tree(graph, start, goal, max_depth)
        path, at = [], goal
        while at is not None:  # one row for each step of the path
            row = tree.where(F.col("node") == F.lit(at)).first()
            if row is None:
                break
            path.append(at)
            at = row["parent"]
        if path and path[-1] == start:
            return spark.createDataFrame([(i, n, kind) for i, n in enumerate(reversed(path))], f"step int, node {node}, kind string")
    return spark.createDataFrame([], f"step int, node {node}, kind string")


def reachable(arcs: DataFrame) -> DataFrame:
    """(src, dst): pairs with a path of one arc or more, by doubling; meant for district graphs."""
    from ..sources.tables import checkpointed

    closure = checkpointed(arcs.select("src", "dst").distinct())
    size = closure.count()
    while True:
        longer = closure.alias("x").join(closure.alias("y"), F.col("x.dst") == F.col("y.src")).select(F.col("x.src"), F.col("y.dst"))
        closure = checkpointed(closure.union(longer).distinct())
        if (now := closure.count()) == size:
            break
        size = now
    return closure


def strong_components(arcs: DataFrame) -> DataFrame:
    """(node, component): cycles of two nodes or more, named by their smallest node."""
    pairs = reachable(arcs.where("src <> dst"))
    back = pairs.select(F.col("src").alias("dst"), F.col("dst").alias("src"))
    mutual = pairs.join(back, ["src", "dst"])
    per = mutual.groupBy(F.col("src").alias("node")).agg(F.min("dst").alias("least"), F.count_if(F.col("src") != F.col("dst")).alias("others"))
    return per.where("others > 0").select("node", F.least("node", "least").alias("component"))


def has_cycle(arcs: DataFrame) -> bool:
    return bool(reachable(arcs).where("src = dst").limit(1).count())


def topological_levels(arcs: DataFrame) -> DataFrame:
    """(node, level): the longest way down to a node from one that nothing points at; nodes on a cycle, or behind one, have
    none.  Each round takes away the nodes that nothing left points at."""
    from ..sources.tables import checkpointed

    left = checkpointed(arcs.select("src", "dst").distinct())
    nodes = checkpointed(left.select(F.col("src").alias("node")).union(left.select("dst")).distinct())
    out = None
    for level in itertools.count():
        free = checkpointed(nodes.join(left.select(F.col("dst").alias("node")).distinct(), "node", "left_anti"))
        if not free.limit(1).count():
            return out if out is not None else free.withColumn("level", F.lit(0))
        ranked = free.withColumn("level", F.lit(level))
        out = ranked if out is None else out.union(ranked)
        nodes = checkpointed(nodes.join(free, "node", "left_anti"))
        left = checkpointed(left.join(free.withColumnRenamed("node", "src"), "src", "left_anti"))


def route_steps(arcs: DataFrame, files: DataFrame, start, goal) -> DataFrame:
    """(step, node, path, district, kind) of :func:`route`; no rows where an end is no file."""
    known = files.where(F.col("file_id").isin(start, goal)).select("file_id").distinct().count()
    steps = route(arcs, start, goal) if known == len({start, goal}) else route(arcs.where("false"), start, goal).where("false")
    return steps.join(files.select(F.col("file_id").alias("node"), "path", "district"), "node").select("step", "node", "path", "district", "kind")


def feedback_cut(bundles: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Arcs (src, dst) whose removal leaves no cycle: a greedy order of a district graph (sinks last, sources first, then
    the node that sends most beyond what it gets), the arcs against it, and of those the heavy ones put back that close
    no cycle.  A district graph is small: one row for each pair of districts."""
    arcs = {(a, b): w for a, b, w in bundles if a != b}
    left, first, last = {n for ab in arcs for n in ab}, [], []
    while left:
        sends = {n: sum(w for (a, b), w in arcs.items() if a == n and b in left) for n in left}
        gets = {n: sum(w for (a, b), w in arcs.items() if b == n and a in left) for n in left}
        sinks = sorted(n for n in left if not sends[n])
        roots = sorted(n for n in left if not gets[n] and sends[n])
        if sinks:
            last = sinks + last
            left -= set(sinks)
        elif roots:
            first += roots
            left -= set(roots)
        else:
            best = min(left, key=lambda n: (gets[n] - sends[n], n))
            first.append(best)
            left.remove(best)
    place = {n: i for i, n in enumerate(first + last)}
    kept = {n: {b for (a, b) in arcs if a == n and place[a] < place[b]} for n in place}

    def reaches(a, b):
        todo, seen = deque([a]), {a}
        while todo:
            n = todo.popleft()
            if n == b:
                return True
            todo.extend(kept[n] - seen)
            seen |= kept[n]
        return False

    cut = []
    for a, b in sorted((ab for ab in arcs if place[ab[0]] > place[ab[1]]), key=lambda ab: (-arcs[ab], ab)):
        if reaches(b, a):
            cut.append((a, b))
        else:
            kept[a].add(b)
    return sorted(cut)


def sampled_sources(nodes: list, sample: int = SAMPLE, seed: int = SEED) -> list:
    """All nodes, or the interpreter's own random sample of the sorted list."""
    return nodes if len(nodes) <= sample else random.Random(seed).sample(nodes, sample)


def betweenness(edges: DataFrame, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """(node, betweenness): share of shortest paths through a node, from all nodes or a sample of sources.

    The arcs lie as arrays, a node's together.  As many sources walk at once as ``MAX_CELLS`` pairs of a source and a node
    allow: each round sends the pairs that were reached last to the arcs, and gets those next to them; the way back adds up,
    level by level, what lies behind a node.  Graphs with more nodes than that walk in joins (:func:`_behind_by_joins`).
    ``edges`` is read twice: give a written table.
    """
    from ..sources.tables import checkpointed, numbered

    ends_ = edges.select("a", "b").where("a <> b")
    nodes = checkpointed(numbered(ends_.select(F.col("a").alias("node")).union(ends_.select("b")).distinct(), "node"))
    n = nodes.count()
    places = sampled_sources(range(n), sample, seed)
    k = len(places)
    chosen = edges.sparkSession.createDataFrame([(p,) for p in places], "place long")
    # at most ``sample`` rows
    listed = nodes.join(F.broadcast(chosen.withColumn("source", F.lit(True))), "place", "left").select("node", "place", F.coalesce("source", F.lit(False)).alias("source"))
    if n <= 2:
        return listed.select("node", F.lit(0.0).alias("betweenness"))
    parts = _behind(ends_, nodes, n, list(places)) if n <= MAX_CELLS else _behind_by_joins(ends_, listed, k)
    # a sampled source sees k - 1 other sources, any other node k
    rivals = F.when(F.col("source"), F.lit(max(k - 1, 1))).otherwise(F.lit(k)) if k < n else F.lit(n - 1)
    value = F.coalesce("part", F.lit(0.0)) / (rivals * F.lit(float(n - 2)))
    return listed.join(parts, "node", "left").select("node", value.alias("betweenness"))


def _packed(n: int):
    """Rows (v, w) in order of v as arrays: nodes, where each one's arcs start, and their distinct ends."""

    def run(batches):
        for rows in whole_runs(batches):
            key = np.unique(rows.column(0).to_numpy() * np.int64(n) + rows.column(1).to_numpy())
            nodes, at = np.unique(key // n, return_index=True)
            arrays = [pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in (nodes, at, key % n)]
            yield pa.RecordBatch.from_arrays(arrays, names=["nodes", "starts", "ends"])

    return run


def _stepped(sent, k: int, n: int):
    """Cells next to those sent, of the wanted ones: the sums of their neighbours' values.  A cell is source * n + node."""

    def run(batches):
        cells, values, bits = sent.value
        held = np.zeros(k * n)
        held[cells] = values
        held = held.reshape(k, n)
        wanted = np.unpackbits(bits, count=k * n).view(bool).reshape(k, n)
        here = held != 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                nodes, starts, ends = (np.frombuffer(x, np.int32) for x in row)
                near = np.zeros(n, bool)
                near[ends] = True
                found, sums = [np.zeros(0, np.int32)], [np.zeros(0)]
                # of all sources only those that have reached a neighbour
                for c in np.flatnonzero(here[:, np.flatnonzero(near)].any(axis=1)):
                    want = wanted[c][nodes]
                    if want.any():
                        got = np.add.reduceat(held[c][ends], starts)
                        want &= got > 0
                        found.append((c * n + nodes[want]).astype(np.int32))
                        sums.append(got[want])
                arrays = [pa.array([np.concatenate(x).tobytes()], pa.binary()) for x in (found, sums)]
                yield pa.RecordBatch.from_arrays(arrays, names=["cells", "sums"])

    return run


def _behind(ends_: DataFrame, nodes: DataFrame, n: int, places: list) -> DataFrame:
    """(node, part): the sum, over the sources, of the shares of shortest paths through a node."""
    from ..sources.tables import checkpointed, importable

    context = ends_.sparkSession.sparkContext
    importable(ends_.sparkSession)
    known = F.broadcast(nodes) if n <= MAX_BROADCAST_LEVEL else nodes
    at = lambda end: known.select(F.col("node").alias(end), F.col("place").cast("int").alias(f"p_{end}"))
    way = lambda v, w: F.struct(F.col(f"p_{v}").alias("v"), F.col(f"p_{w}").alias("w"))
    both = ends_.join(at("a"), "a").join(at("b"), "b").select(F.explode(F.array(way("a", "b"), way("b", "a"))).alias("way")).select("way.*")
    # near nodes stand together, as a rule in one component
    dealt = both.repartition(F.floor(F.col("v") / max(1, n // 256))).sortWithinPartitions("v")
    arcs = checkpointed(dealt.mapInArrow(_packed(n), "nodes binary, starts binary, ends binary"))

    def step(k, cells, values, wanted):
        sent = context.broadcast((cells, values, np.packbits(wanted)))
        rows = arcs.mapInArrow(_stepped(sent, k, n), "cells binary, sums binary").collect()
        sent.destroy()
        found = np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(r["cells"], np.int32) for r in rows)])
        sums = np.concatenate([np.zeros(0), *(np.frombuffer(r["sums"]) for r in rows)])
        order = np.argsort(found)
        return found[order], sums[order]

    total, at_once = np.zeros(n), max(1, MAX_CELLS // n)
    for lo in range(0, len(places), at_once):
        some = np.array(places[lo : lo + at_once])
        k = len(some)
        cells, paths = (np.arange(k) * n + some).astype(np.int32), np.ones(k)
        levels, open_ = [], np.ones(k * n, bool)
        while len(cells):
            levels.append((cells, paths))
            open_[cells] = False
            if not open_.any():
                break
            cells, paths = step(k, cells, paths, open_)
        share = None
        for cells, paths in reversed(levels[1:]):
            part = np.zeros(len(cells))
            if share is not None:
                wanted = np.zeros(k * n, bool)
                wanted[cells] = True
                found, sums = step(k, *share, wanted)
                at_ = np.searchsorted(cells, found)
                part[at_] = paths[at_] * sums
                total += np.bincount(cells % n, part, n)
            share = cells, (1 + part) / paths
    # a number for each node
    sent = context.broadcast(total)

    def parts(batches):
        for batch in batches:
            place = batch.column(0)
            yield pa.RecordBatch.from_arrays([place, pa.array(sent.value[place.to_numpy()])], names=["place", "part"])

    return nodes.join(nodes.select("place").mapInArrow(parts, "place long, part double"), "place").select("node", "part")


def _behind_by_joins(ends_: DataFrame, listed: DataFrame, k: int) -> DataFrame:
    """The same for graphs of any number of nodes: no task and no driver holds a value for each of them.  All sources walk at
    once, and a round's rows are at most the sources times the nodes."""
    from ..sources.tables import checkpointed

    both = checkpointed(ends_.select(F.col("a").alias("v"), F.col("b").alias("w")).union(ends_.select("b", "a")).distinct())
    # the arcs, by far the larger side, move only where a level is too large to be sent to them
    near = lambda level, rows: F.broadcast(level) if rows <= MAX_BROADCAST_LEVEL else level
    frontier = checkpointed(listed.where("source").select(F.col("node").alias("s"), F.col("node").alias("v"), F.lit(1.0).alias("paths")))
    seen, levels, rows = frontier.select("s", "v"), [frontier], [k]
    while True:
        step = both.join(near(frontier, rows[-1]), "v").groupBy("s", "w").agg(F.sum("paths").alias("paths"))
        frontier = checkpointed(step.select("s", F.col("w").alias("v"), "paths").join(seen, ["s", "v"], "left_anti"))
        if not (found := frontier.count()):
            break
        levels.append(frontier)
        rows.append(found)
        seen = seen.union(frontier.select("s", "v"))
    behind, sums = None, None
    for i, level in reversed(list(enumerate(levels))):
        if behind is None:
            got = level.withColumn("part", F.lit(0.0))
        else:
            share = both.join(near(behind, rows[i + 1]), "w").groupBy("s", "v").agg(F.sum("share").alias("share"))
            got = checkpointed(level.join(share, ["s", "v"], "left").withColumn("part", F.col("paths") * F.coalesce("share", F.lit(0.0))).drop("share"))
        behind = got.select("s", F.col("v").alias("w"), ((1 + F.col("part")) / F.col("paths")).alias("share"))
        own = got.where("s <> v").select(F.col("v").alias("node"), "part")
        sums = own if sums is None else sums.union(own)
    return sums.groupBy("node").agg(F.sum("part").alias("part"))


def capitals(files: DataFrame, degree: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """(district, file_id): the file of largest degree in each district that is no landmark yet (ties by id)."""
    free = files if taken is None else files.join(taken, "file_id", "left_anti")
    free = free.join(degree.withColumnRenamed("node", "file_id"), "file_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0.0)))
    order = Window.partitionBy("district").orderBy(F.desc("degree"), "file_id")
    return free.withColumn("rn", F.row_number().over(order)).where("rn = 1").select("district", "file_id", "degree")


# Fixed values.
ENTRY_HINTS = ["__init__.py", "cmdline.py", "app.py", "main.py", "cli.py", "crawler.py", "__main__.py"]
NOT_STRUCTURAL = ["__init__.py", "exceptions.py", "errors.py"]


def landmarks(files: DataFrame, edges: DataFrame, central: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """(file_id, why, rank): entries, bridges, hubs, capitals, hazards, in that order; a file stands there once.

    ``files``: file_id, path, district, loc, complexity, churn, fanin.  ``entries``: path, reason.
    """
    base = F.element_at(F.split("path", "/"), -1)
    structural = ~base.isin(NOT_STRUCTURAL)
    # the first rows of every task, then the first of those
    top = lambda df, key, n, why, turn: (
        (df.orderBy(*key).limit(n) if n else df).withColumn("place", F.row_number().over(Window.orderBy(*key))).select(
            "file_id", F.lit(why).alias("why"), F.lit(turn).alias("turn"), F.col("place").cast("long").alias("place")
        )
    )
    scored = files.join(central.withColumnRenamed("node", "file_id"), "file_id", "left").withColumn("betweenness", F.coalesce("betweenness", F.lit(0.0)))
    picks = top(files.where(base.isin(ENTRY_HINTS) & (F.col("loc") > 40)), [F.desc("fanin"), "file_id"], 2, "entry", 0)
    if entries is not None:
        named = files.join(entries.select("path"), "path", "left_semi")
        picks = picks.union(top(named, ["path"], None, "entry", 1))
    picks = picks.union(top(scored.where(structural), [F.desc("betweenness"), "file_id"], 2, "bridge", 2))
    picks = picks.union(top(files.where(structural), [F.desc("fanin"), "file_id"], 2, "hub", 3))
    first = Window.partitionBy("file_id").orderBy("turn", "place")
    picks = picks.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")
    sizes = files.groupBy("district").agg(F.count("*").alias("size"))
    centre = capitals(files.where(structural), weighted_degree(edges), picks).join(sizes, "district")
    centre = centre.select(
        "file_id", F.lit("capital").alias("why"), F.lit(4).alias("turn"),
        F.row_number().over(Window.orderBy(F.desc("size"), "district")).cast("long").alias("place"),
    )
    hazard = top(files, [F.desc(F.col("churn") * F.col("complexity")), "file_id"], 2, "hazard", 5)
    every = picks.union(centre).union(hazard).withColumn("rn", F.row_number().over(first)).where("rn = 1")
    return every.select("file_id", "why", F.row_number().over(Window.orderBy("turn", "place")).alias("rank"))


def jaccard_pairs(before: DataFrame, after: DataFrame) -> DataFrame:
    """(da, db, common, jaccard) of districts with a common file; ``before`` and ``after``: file_id, district."""
    both = before.select("file_id", F.col("district").alias("da")).join(after.select("file_id", F.col("district").alias("db")), "file_id")
    common = both.groupBy("da", "db").agg(F.count("*").alias("common"))
    na, nb = both.groupBy("da").agg(F.count("*").alias("na")), both.groupBy("db").agg(F.count("*").alias("nb"))
    out = common.join(na, "da").join(nb, "db")
    return out.select("da", "db", "common", (F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("jaccard"))


def match_districts(before: DataFrame, after: DataFrame, least: float = JACCARD) -> list[tuple]:
    """One-to-one matches (db, da, jaccard), best first, larger ids first on ties.  One row for each pair of districts."""
    rows = jaccard_pairs(before, after).where(F.col("jaccard") >= least).collect()
    used_a, used_b, out = set(), set(), []
    for r in sorted(rows, key=lambda r: (r["jaccard"], r["db"], r["da"]), reverse=True):
        if r["da"] not in used_a and r["db"] not in used_b:
            used_a.add(r["da"])
            used_b.add(r["db"])
            out.append((r["db"], r["da"], r["jaccard"]))
    return out


def retention(before: DataFrame, after: DataFrame) -> float:
    """Share of common files whose matched district is the same."""
    matched = dict((b, a) for b, a, _ in match_districts(before, after))
    both = before.select("file_id", F.col("district").alias("da")).join(after.select("file_id", F.col("district").alias("db")), "file_id")
    rows = both.groupBy("da", "db").count().collect()
    total = sum(r["count"] for r in rows)
    return sum(r["count"] for r in rows if matched.get(r["db"]) == r["da"]) / total if total else 1.0


def agreement(labels: DataFrame, a: str, b: str) -> DataFrame:
    """One row: normalised mutual information (arithmetic mean) and adjusted Rand index of two labellings."""
    cells = labels.groupBy(a, b).agg(F.count("*").alias("n"))
    rows = cells.groupBy(a).agg(F.sum("n").alias("n"))
    cols = cells.groupBy(b).agg(F.sum("n").alias("n"))
    total = cells.agg(F.sum("n").cast("double").alias("t"))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    entropy = lambda t: -F.sum(F.col("n") / F.col("t") * F.log(F.col("n") / F.col("t")))
    with_t = lambda df: df.crossJoin(F.broadcast(total))
    h_a = with_t(rows).agg(entropy("t").alias("ha"), pairs("n").alias("pa"))
    h_b = with_t(cols).agg(entropy("t").alias("hb"), pairs("n").alias("pb"))
    joint = with_t(cells.join(rows.withColumnRenamed("n", "na"), a).join(cols.withColumnRenamed("n", "nb"), b))
    mutual = joint.agg(
        F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("na") * F.col("nb")))).alias("mi"),
        pairs("n").alias("pc"),
        F.max("t").alias("t"),
    )
    out = mutual.crossJoin(h_a).crossJoin(h_b)
    mean = (F.col("ha") + F.col("hb")) / 2
    expected = F.col("pa") * F.col("pb") / (F.col("t") * (F.col("t") - 1) / 2)
    best = (F.col("pa") + F.col("pb")) / 2
    return out.select(
        F.when(mean == 0, F.lit(1.0)).otherwise(round_even(F.col("mi") / mean, 6)).alias("nmi"),
        F.when(best == expected, F.lit(1.0)).otherwise(round_even((F.col("pc") - expected) / (best - expected), 6)).alias("ari"),
    )
