"""Structural-debt findings over a map, and the difference of two reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import (
    dirname,
    filter_match,
    is_entry_path,
    is_non_production_path,
    is_test_path,
    language_of,
    round_away,
    round_even,
)
from .graph import feedback_cut, mutual_pairs, place_by_plurality, strong_components

MIN_EDGES, MIN_SHARE = 5, 0.5
TOP_FRACTION = 0.05
GOD_MIN, HOTSPOT_MIN = 1, 2
COUPLING_COUNT, COUPLING_WEIGHT = 3, 0.35


def district_tallies(files: DataFrame, arcs: DataFrame, extra_pairs: DataFrame | None = None) -> DataFrame:
    """(file_id, other, n): edges of a file by the district at the other end.

    ``extra_pairs`` (parent, child) count once where no arc links the two.
    """
    at = lambda end: files.select(F.col("file_id").alias(end), F.col("district").alias(f"d_{end}"))
    edges = arcs.where("src <> dst").select("src", "dst")
    if extra_pairs is not None:
        known = edges.select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).distinct()
        new = extra_pairs.where("parent <> child").select(F.col("parent").alias("src"), F.col("child").alias("dst"))
        new = new.withColumns({"x": F.least("src", "dst"), "y": F.greatest("src", "dst")}).join(known, ["x", "y"], "left_anti")
        edges = edges.union(new.select("src", "dst"))
    sides = edges.join(at("src"), "src").join(at("dst"), "dst").where("d_src is not null and d_dst is not null")
    both = F.explode(F.array(F.struct(F.col("src").alias("f"), F.col("d_dst").alias("o")), F.struct(F.col("dst").alias("f"), F.col("d_src").alias("o"))))
    return sides.select(both.alias("x")).groupBy(F.col("x.f").alias("file_id"), F.col("x.o").alias("other")).agg(F.count("*").alias("n"))


def misplaced(files: DataFrame, arcs: DataFrame, min_edges: int = MIN_EDGES, min_share: float = MIN_SHARE, generated: DataFrame | None = None, extra_pairs: DataFrame | None = None) -> DataFrame:
    """(path, district, edges, to_district, share): most of a file's edges end in one foreign district."""
    tally = district_tallies(files, arcs, extra_pairs).join(files.select("file_id", "path", "district"), "file_id").where(~is_test_path(F.col("path")))
    own = Window.partitionBy("file_id")
    total = tally.withColumn("edges", F.sum("n").over(own)).where((F.col("other") != F.col("district")) & (F.col("edges") >= min_edges))
    best = total.withColumn("rn", F.row_number().over(own.orderBy(F.desc("n"), "other"))).where("rn = 1")
    out = best.where(F.col("n") / F.col("edges") > min_share)
    if generated is not None:
        out = out.join(generated.select("file_id"), "file_id", "left_anti")
    return out.select("path", "district", "edges", F.col("other").alias("to_district"), round_even(F.col("n") / F.col("edges"), 4).alias("share"))


def top_cut(values: DataFrame, column: str, fraction: float = TOP_FRACTION, least: int = 1) -> DataFrame:
    """One row ``cut``: the k-th largest value, k = max(ceil(fraction * n), least); null unless it is positive."""
    n = values.count()
    if not n:
        return values.sparkSession.range(1).select(F.lit(None).cast(values.schema[column].dataType).alias("cut"))
    k = min(max(-int(-(fraction * n) // 1), least, 1), n)
    top = values.select(column).orderBy(F.desc(column)).limit(k).agg(F.min(column).alias("cut"))
    return top.select(F.when(F.col("cut") > 0, F.col("cut")).alias("cut"))


def god_fan_in(files: DataFrame, descendant: DataFrame | None) -> DataFrame:
    """``files`` with fan-in less the mass from their own subtree, not below 0, to two digits."""
    if descendant is None:
        return files
    mass = descendant.select(F.col("dst").alias("file_id"), F.col("fanin").alias("mass"))
    less = F.when(F.col("mass").isNotNull(), round_away(F.greatest(F.col("fanin") - F.col("mass"), F.lit(0.0)), 2)).otherwise(F.col("fanin"))
    return files.join(mass, "file_id", "left").withColumn("fanin", less).drop("mass")


def god_files(files: DataFrame, descendant: DataFrame | None = None, fraction: float = TOP_FRACTION) -> DataFrame:
    """(path, fanin, fanin_rank, complexity, complexity_rank) of files in the top share of both."""
    scored = god_fan_in(files, descendant)
    cuts = top_cut(scored, "fanin", fraction, GOD_MIN).withColumnRenamed("cut", "cut_f").crossJoin(
        top_cut(scored, "complexity", fraction, GOD_MIN).withColumnRenamed("cut", "cut_c")
    )
    # ranks are counted for the few files above both cuts
    both = scored.crossJoin(F.broadcast(cuts)).where((F.col("fanin") >= F.col("cut_f")) & (F.col("complexity") >= F.col("cut_c")))
    above = lambda c, cut: scored.select(F.col(c).alias("v")).crossJoin(F.broadcast(cuts.select(F.col(cut).alias("k")))).where("v >= k").groupBy("v").agg(F.count("*").alias("c"))
    rank = lambda c, cut: above(c, cut).select(F.col("v").alias(c), (1 + F.coalesce(F.sum("c").over(Window.orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias(f"{c}_rank"))
    out = both.join(rank("fanin", "cut_f"), "fanin").join(rank("complexity", "cut_c"), "complexity")
    return out.select("path", "fanin", "fanin_rank", "complexity", "complexity_rank")


def hotspots(files: DataFrame, fraction: float = TOP_FRACTION, least: int = HOTSPOT_MIN) -> DataFrame:
    """(path, churn, complexity, score, rank) of production files in the top share of churn * complexity."""
    production = files.where(~is_test_path(F.col("path")) & ~is_non_production_path(F.col("path")))
    scored = production.withColumn("score", F.col("churn") * F.col("complexity"))
    cut = top_cut(scored, "score", fraction, least)
    hot = scored.crossJoin(F.broadcast(cut)).where(F.col("score") >= F.col("cut"))
    return hot.select("path", "churn", "complexity", "score", F.row_number().over(Window.orderBy(F.desc("score"), "file_id")).alias("rank"))


def unreached(files: DataFrame, arcs: DataFrame, entries: DataFrame | None = None, generated: DataFrame | None = None, declared: DataFrame | None = None) -> DataFrame:
    """(path, district, out_edges): files that import, are imported by none, and are no entry."""
    real = arcs.where("src <> dst")
    out = real.groupBy(F.col("src").alias("file_id")).agg(F.count("*").alias("out_edges"))
    found = out.join(files.select("file_id", "path", "district"), "file_id").where(~is_entry_path(F.col("path")))
    found = found.join(real.select(F.col("dst").alias("file_id")).distinct(), "file_id", "left_anti")
    for some in (entries, generated):
        if some is not None:
            found = found.join(some.select("file_id"), "file_id", "left_anti")
    if declared is not None:
        rust = declared.select(F.col("child").alias("file_id")).distinct().withColumn("known", F.lit(True))
        found = found.join(rust, "file_id", "left").where(~(F.col("path").endswith(".rs") & F.coalesce("known", F.lit(False))))
    return found.select("path", "district", "out_edges")


def undeclared_rust(files: DataFrame, tree: DataFrame, roots: DataFrame) -> DataFrame:
    """(path, district): Rust files below a crate root (file_id) that no ``mod`` declares."""
    path = F.col("path")
    target = path.rlike(r"(^|/)build\.rs$|^src/bin/|/examples/|/tests/|/benches/")
    loose = files.where(path.endswith(".rs") & ~target)
    loose = loose.join(tree.select(F.col("child").alias("file_id")), "file_id", "left_anti").join(roots.select("file_id"), "file_id", "left_anti")
    top = files.join(roots.select("file_id"), "file_id").where(~path.rlike(r"(^|/)build\.rs$"))
    cut = F.when(F.instr("path", "src/") > 0, F.expr("substring(path, 1, instr(path, 'src/') + 2)")).otherwise(dirname(path))
    top = top.where(path.contains("/")).select(cut.alias("base")).distinct()
    return loose.join(F.broadcast(top), path.startswith(F.col("base")), "left_semi").select("path", "district")


def hidden_coupling(files: DataFrame, cochange: DataFrame, arcs: DataFrame, uses: DataFrame | None = None, min_count: int = COUPLING_COUNT, min_weight: float = COUPLING_WEIGHT, generated: DataFrame | None = None, tree: DataFrame | None = None) -> DataFrame:
    """(left_path, right_path, cnt, weight, rank): files that change together without any static link; pairs across
    languages, folders and districts first."""
    linked = arcs.select("src", "dst")
    for some, a, b in ((uses, "src", "dst"), (tree, "parent", "child")):
        if some is not None:
            linked = linked.union(some.select(a, b))
    linked = linked.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    loose = cochange.where((F.col("cnt") >= min_count) & (F.col("weight") >= min_weight)).join(linked, ["a", "b"], "left_anti")
    if generated is not None:
        for end in ("a", "b"):
            loose = loose.join(generated.select(F.col("file_id").alias(end)), end, "left_anti")
    at = lambda end, name: files.select(F.col("file_id").alias(end), F.col("path").alias(f"{name}_path"), F.col("district").alias(f"{name}_district"))
    out = loose.join(at("a", "left"), "a").join(at("b", "right"), "b")
    left, right = F.col("left_path"), F.col("right_path")
    out = out.where(~is_test_path(left) & ~is_test_path(right))
    order = Window.orderBy(
        language_of(left) == language_of(right), dirname(left) == dirname(right), F.col("left_district") == F.col("right_district"),
        F.desc("weight"), F.desc("cnt"), "left_path", "right_path",
    )
    return out.select("left_path", "right_path", "cnt", round_even(F.col("weight"), 6).alias("weight"), F.row_number().over(order).alias("rank"))


def bundles(files: DataFrame, arcs: DataFrame) -> DataFrame:
    """(src, dst, n): arcs between two districts."""
    at = lambda end: files.select(F.col("file_id").alias(end), F.col("district").alias(f"d_{end}"))
    cross = arcs.join(at("src"), "src").join(at("dst"), "dst").where("d_src <> d_dst")
    return cross.groupBy(F.col("d_src").alias("src"), F.col("d_dst").alias("dst")).agg(F.count("*").alias("n"))


def district_cycles(files: DataFrame, arcs: DataFrame) -> DataFrame:
    """(component, districts, bundles, imports): districts that reach each other."""
    between = bundles(files, arcs)
    member = strong_components(between)
    inside = between.join(member.withColumnRenamed("node", "src").withColumnRenamed("component", "c1"), "src").join(
        member.withColumnRenamed("node", "dst").withColumnRenamed("component", "c2"), "dst"
    )
    flows = inside.where("c1 = c2").groupBy(F.col("c1").alias("component")).agg(F.count("*").alias("bundles"), F.sum("n").alias("imports"))
    sizes = member.groupBy("component").agg(F.array_join(F.array_sort(F.collect_list(F.col("node").cast("long"))), ",").alias("districts"))
    return sizes.join(flows, "component")


def cycle_actions(files: DataFrame, arcs: DataFrame) -> DataFrame:
    """Mutual bundles between districts, the lighter direction named."""
    return mutual_pairs(bundles(files, arcs))


def cycle_routes(files: DataFrame, arcs: DataFrame) -> DataFrame:
    """(component, step, district): of every cycle of districts a shortest way round from its first bundle (src, dst) and
    back.  A district graph is small: one row for each bundle."""
    between = bundles(files, arcs)
    inside = _cyclic(between, strong_components(between)).collect()
    out = []
    for c in sorted({r["component"] for r in inside}):
        near: dict = {}
        for r in sorted((r for r in inside if r["component"] == c), key=lambda r: (r["src"], r["dst"])):
            near.setdefault(r["src"], []).append(r["dst"])
        start = min(near)
        way, came = [near[start][0]], {near[start][0]: None}
        for node in way:  # grows as it is walked: breadth first
            for other in near[node]:
                if other not in came:
                    came[other] = node
                    way.append(other)
        back, node = [], start
        while node is not None:
            back.append(node)
            node = came[node]
        out += [(c, i, d) for i, d in enumerate([start, *reversed(back)])]
    kind = files.schema["district"].dataType.simpleString()
    return files.sparkSession.createDataFrame(out, f"component {kind}, step int, district {kind}")


def _cyclic(between: DataFrame, member: DataFrame) -> DataFrame:
    """Bundles inside a component, with it."""
    at = lambda end: member.select(F.col("node").alias(end), F.col("component").alias(f"c_{end}"))
    return between.join(at("src"), "src").join(at("dst"), "dst").where("c_src = c_dst").select(F.col("c_src").alias("component"), "src", "dst", "n")


def cycle_report(files: DataFrame, arcs: DataFrame) -> DataFrame:
    """(component, districts, bundles, imports, mutual, cut): cycles with their mutual pairs and the bundles whose removal
    leaves no cycle, each as ``a>b`` in order."""
    between = bundles(files, arcs)
    member = strong_components(between)
    inside = _cyclic(between, member)
    text = lambda a, b: F.concat_ws(">", F.col(a).cast("string"), F.col(b).cast("string"))
    listed = lambda rows, name: rows.groupBy("component").agg(F.array_sort(F.collect_list("t")).alias(name))
    pairs = mutual_pairs(inside.select("src", "dst", "n")).join(member.select(F.col("node").alias("a"), "component"), "a")
    cut = feedback_cut([(r["src"], r["dst"], r["n"]) for r in inside.collect()])  # one row for each pair of districts
    kind = files.schema["district"].dataType.simpleString()
    cuts = files.sparkSession.createDataFrame(cut, f"src {kind}, dst {kind}").join(member.select(F.col("node").alias("src"), "component"), "src")
    out = district_cycles(files, arcs).join(listed(pairs.select("component", text("a", "b").alias("t")), "mutual"), "component", "left")
    out = out.join(listed(cuts.select("component", text("src", "dst").alias("t")), "cut"), "component", "left")
    none = F.array().cast("array<string>")
    return out.withColumns({"mutual": F.coalesce("mutual", none), "cut": F.coalesce("cut", none)})


def compact_evidence(report: DataFrame) -> DataFrame:
    """A cycle report for a summary: without the bundles' numbers and lists."""
    return report.select("component", "districts", F.size("mutual").alias("mutual"), F.size("cut").alias("cut"))


def pinned_districts(head: DataFrame, base: DataFrame, arcs: DataFrame) -> DataFrame:
    """(file_id, district, status): districts of the base map; new files by the edges to placed ones; the rest in one
    district past the last."""
    kept = head.select("file_id").join(base.select("file_id", "district"), "file_id", "left")
    new = kept.where("district is null").select("file_id")
    sides = arcs.select("src", "dst").union(arcs.select(F.col("dst"), F.col("src"))).where("src <> dst")
    weights = (
        sides.join(new.withColumnRenamed("file_id", "src"), "src")
        .join(kept.where("district is not null").withColumnRenamed("file_id", "dst"), "dst")
        .groupBy(F.col("src").alias("file_id"), "district")
        .agg(F.count("*").cast("double").alias("weight"))
    )
    found = place_by_plurality(weights).select("file_id", F.col("district").alias("near"))
    last = base.agg((F.max("district") + 1).alias("last"))
    out = kept.join(found, "file_id", "left").crossJoin(F.broadcast(last))
    status = F.when(F.col("district").isNotNull(), "kept").when(F.col("near").isNotNull(), "placed").otherwise("unplaced")
    return out.select("file_id", F.coalesce("district", "near", "last").alias("district"), status.alias("status"))


def filtered(findings: DataFrame, kinds: list[str] | None = None, path: str | None = None, district=None, top: int | None = None) -> DataFrame:
    """Findings (kind, path, district, rank) by kind, path filter, district, and the first ``top`` of each kind."""
    out = findings
    if kinds:
        out = out.where(F.col("kind").isin(kinds))
    if path is not None:
        out = out.where(filter_match(F.col("path"), path))
    if district is not None:
        out = out.where(F.col("district") == district)
    if top is not None:
        order = Window.partitionBy("kind").orderBy("rank", "path")
        limited = F.col("kind").isin("cycle", "hotspot", "god")
        out = out.withColumn("__rn", F.row_number().over(order)).where(~limited | (F.col("__rn") <= top)).drop("__rn")
    return out


def comparable(before: dict, after: dict) -> None:
    """Refuse to compare reports (version, pinned: the base whose districts they use, or None) that mean other things."""
    if before["version"] != after["version"]:
        raise ValueError(f"reports of versions {before['version']} and {after['version']}")
    if before.get("pinned") != after.get("pinned"):
        raise ValueError("the reports' districts come from different maps")


def report_diff(before: DataFrame, after: DataFrame, keys: list[str], numbers: list[str]) -> DataFrame:
    """Keys, status (shared, added, removed) and the change of each number where both reports have the finding."""
    left = before.select(*keys, *[F.col(c).alias(f"{c}_before") for c in numbers], F.lit(1).alias("in_before"))
    right = after.select(*keys, *[F.col(c).alias(f"{c}_after") for c in numbers], F.lit(1).alias("in_after"))
    out = left.join(right, keys, "full_outer")
    status: Column = F.when(F.col("in_before").isNull(), "added").when(F.col("in_after").isNull(), "removed").otherwise("shared")
    return out.select(*keys, status.alias("status"), *[(F.col(f"{c}_after") - F.col(f"{c}_before")).alias(f"{c}_delta") for c in numbers])


def to_lens(findings: DataFrame, most_paths: int = 20) -> DataFrame:
    """Findings (kind, path, other, detail, rank) as overlay rows (section, label, pos, spec): one area for each kind;
    cycles and hidden couplings, which link two files, as paths too, the first ``most_paths`` of each; notes."""
    areas = findings.select(F.lit("area").alias("section"), F.col("kind").alias("label"), F.col("rank").alias("pos"), F.col("path").alias("spec"))
    linked = findings.where(F.col("kind").isin("cycle", "hidden_coupling") & F.col("other").isNotNull() & (F.col("rank") <= most_paths))
    name = F.concat_ws(" ", "kind", "rank")
    stops = linked.select(F.lit("path").alias("section"), name.alias("label"), F.posexplode(F.array("path", "other")).alias("pos", "spec"))
    notes = findings.where("detail is not null").select(F.lit("note").alias("section"), F.col("detail").alias("label"), F.col("rank").alias("pos"), F.col("path").alias("spec"))
    return areas.unionByName(stops).unionByName(notes)


def package_projection(files: DataFrame, arcs: DataFrame, roots: DataFrame) -> DataFrame:
    """(src, dst, n, crosses): arcs between packages, the longest root (root) above each end, and whether the package
    graph has a cycle."""
    from .graph import strong_components
    from .resolve import longest_prefix

    placed = longest_prefix(files.select("file_id", "path"), "path", roots, "root").select("file_id", "root")
    at = lambda end: placed.select(F.col("file_id").alias(end), F.col("root").alias(f"r_{end}"))
    between = arcs.join(at("src"), "src").join(at("dst"), "dst").where("r_src <> r_dst").groupBy(F.col("r_src").alias("src"), F.col("r_dst").alias("dst")).agg(F.count("*").alias("n"))
    cyclic = strong_components(between).agg((F.count("*") > 0).alias("crosses"))
    return between.crossJoin(F.broadcast(cyclic))
