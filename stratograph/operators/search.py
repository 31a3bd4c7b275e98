"""Searches and overviews of a map's viewer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HIT_LIMIT, DISTRICT_LIMIT, HUB_FANIN = 14, 5, 30


def _tier(name: Column, q: str) -> Column:
    low = F.lower(name)
    return (
        F.when(low == q, 0)
        .when(low.startswith(q), 1)
        .when(low.rlike(rf"(^|[^a-z0-9]){_escaped(q)}"), 2)
        .when(low.contains(q), 3)
    )


def _escaped(q: str) -> str:
    return "".join("\\" + c if not c.isalnum() else c for c in q)


def search_hits(files: DataFrame, symbols: DataFrame | None, query: str, limit: int = HIT_LIMIT) -> DataFrame:
    """(kind, name, id, score, rank): files whose stem is, starts with or holds the query, less their fan-in; symbols by
    exact name, references and span.  Lower scores first, then insertion order."""
    q = query.lower()
    stem = F.lower(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1))
    base = F.when(stem == q, -1000).when(stem.startswith(q), 0).when(F.lower("path").contains(q), 100)
    hits = files.withColumn("base", base).where("base is not null").select(
        F.lit("file").alias("kind"), F.col("path").alias("name"), F.col("file_id").alias("id"), (F.col("base") - F.col("fanin")).cast("double").alias("score")
    )
    if symbols is not None:
        low = F.lower("name")
        score = F.when(low == q, -2000).when(low.contains(q), 0) - 2 * F.col("refs") - (F.col("end") - F.col("start")) / 20
        found = symbols.where(low.contains(q)).select(F.lit("symbol").alias("kind"), "name", F.col("sym_id").alias("id"), score.cast("double").alias("score"))
        hits = hits.union(found)
    order = ["score", "kind", "id"]
    return hits.orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def district_hits(districts: DataFrame, query: str, limit: int = DISTRICT_LIMIT) -> DataFrame:
    """(district, name, tier): exact, prefix, word start, substring; larger districts first; the unconnected left out."""
    tiered = districts.withColumn("tier", _tier(F.col("name"), query.lower()))
    if "class" in districts.columns:
        tiered = tiered.where("class <> 'unconnected'")
    return tiered.where("tier is not null").orderBy("tier", F.desc("size"), "district").limit(limit).select("district", "name", "tier")


def grouped_results(files: DataFrame, symbols: DataFrame | None, districts: DataFrame, query: str, each: int = HIT_LIMIT) -> DataFrame:
    """(kind, name, id, rank): results of a palette by kind, ``each`` of a kind at most; without a query the six largest
    districts that are connected."""
    if not query.strip():
        named = districts.where("class <> 'unconnected'") if "class" in districts.columns else districts
        rows = named.select(F.lit("district").alias("kind"), "name", F.col("district").cast("long").alias("id"), (-F.col("size")).cast("double").alias("score"))
        each = 6
    else:
        hits = search_hits(files, symbols, query.strip(), 2 * each).select("kind", "name", F.col("id").cast("long").alias("id"), "score")
        found = district_hits(districts, query.strip()).select(F.lit("district").alias("kind"), "name", F.col("district").cast("long").alias("id"), F.col("tier").cast("double").alias("score"))
        rows = hits.union(found)
    order = Window.partitionBy("kind").orderBy("score", "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= each).select("kind", "name", "id", "rank")


def street_flows(arcs: DataFrame, files: DataFrame, district, most: int = 20) -> DataFrame:
    """(src, dst, n, rank): the largest directed flows between two neighbourhoods of a district (files: file_id, district,
    neighbourhood)."""
    own = files.where(F.col("district") == district).select("file_id", "neighbourhood")
    at = lambda end: own.select(F.col("file_id").alias(end), F.col("neighbourhood").alias(f"n_{end}"))
    flows = arcs.join(at("src"), "src").join(at("dst"), "dst").where("n_src <> n_dst")
    flows = flows.groupBy(F.col("n_src").alias("src"), F.col("n_dst").alias("dst")).agg(F.count("*").alias("n"))
    return _largest(flows, ["src", "dst"], most)


def cross_flows(arcs: DataFrame, files: DataFrame, district, most: int = 12) -> DataFrame:
    """(neighbourhood, other, outward, n, rank): the largest flows between a district's neighbourhoods and other districts."""
    at = lambda end: files.select(F.col("file_id").alias(end), F.col("district").alias(f"d_{end}"), F.col("neighbourhood").alias(f"n_{end}"))
    both = arcs.join(at("src"), "src").join(at("dst"), "dst").where("d_src <> d_dst")
    out = both.where(F.col("d_src") == district).select(F.col("n_src").alias("neighbourhood"), F.col("d_dst").alias("other"), F.lit(True).alias("outward"))
    back = both.where(F.col("d_dst") == district).select(F.col("n_dst").alias("neighbourhood"), F.col("d_src").alias("other"), F.lit(False).alias("outward"))
    flows = out.union(back).groupBy("neighbourhood", "other", "outward").agg(F.count("*").alias("n"))
    return _largest(flows, ["neighbourhood", "other", "outward"], most)


def _largest(flows: DataFrame, keys: list[str], most: int) -> DataFrame:
    order = [F.desc("n"), *keys]
    return flows.orderBy(*order).limit(most).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def ranked_neighbours(arcs: DataFrame, files: DataFrame, focus, cap: int) -> DataFrame:
    """(file_id, fanin, rank): files linked with the focus either way, by fan-in."""
    near = arcs.where(F.col("src") == focus).select(F.col("dst").alias("file_id")).union(arcs.where(F.col("dst") == focus).select("src"))
    out = near.where(F.col("file_id") != focus).distinct().join(files.select("file_id", "fanin"), "file_id")
    order = [F.desc("fanin"), "file_id"]
    return out.orderBy(*order).limit(cap).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def selected_flows(flows: DataFrame, overall: int = 12, each: int = 2) -> DataFrame:
    """Of directed district flows (src, dst, n), the largest overall and the largest of every district."""
    order = [F.desc("n"), "src", "dst"]
    top = flows.orderBy(*order).limit(overall)
    sides = flows.select("*", F.explode(F.array("src", "dst")).alias("d"))
    own = sides.withColumn("rn", F.row_number().over(Window.partitionBy("d").orderBy(*order))).where(F.col("rn") <= each)
    return top.select("src", "dst", "n").union(own.select("src", "dst", "n")).distinct()


def layer_overview(files: DataFrame, least: int = 10) -> DataFrame:
    """(district, files, churn, churn_per_file, median_complexity, packages) of districts with ``least`` files or more."""
    return (
        files.groupBy("district")
        .agg(
            F.count("*").alias("files"),
            F.sum("churn").alias("churn"),
            (F.sum("churn") / F.count("*")).alias("churn_per_file"),
            F.median("complexity").alias("median_complexity"),
            F.count_distinct("package").alias("packages"),
        )
        .where(F.col("files") >= least)
    )


def hubs(files: DataFrame, least: float = HUB_FANIN) -> DataFrame:
    """(file_id, fanin, rank, shown): files of large fan-in; a base name that several hubs share is shown with its parent."""
    base = F.element_at(F.split("path", "/"), -1)
    found = files.where(F.col("fanin") >= least).withColumn("base", base)
    shared = F.count("*").over(Window.partitionBy("base")) > 1
    parent = F.element_at(F.split("path", "/"), -2)
    shown = F.when(shared & F.col("path").contains("/"), F.concat_ws("/", parent, "base")).otherwise(F.col("base"))
    return found.select("file_id", "fanin", F.row_number().over(Window.orderBy(F.desc("fanin"), "file_id")).alias("rank"), shown.alias("shown"))


def blast_radius(uses: DataFrame, files: DataFrame) -> DataFrame:
    """(sym_id, users, districts): who uses a symbol, and from how many districts.  ``uses``: sym_id, file_id."""
    placed = uses.distinct().join(files.select("file_id", "district"), "file_id")
    return placed.groupBy("sym_id").agg(F.count_distinct("file_id").alias("users"), F.count_distinct("district").alias("districts"))


def district_index(files: DataFrame, share: float = 0.4) -> DataFrame:
    """(district, files, top_file, directory): the most imported file and the directory with ``share`` of the files."""
    own = Window.partitionBy("district")
    top = files.withColumn("rn", F.row_number().over(own.orderBy(F.desc("fanin"), "file_id"))).where("rn = 1").select("district", F.col("path").alias("top_file"))
    dirs = files.groupBy("district", F.regexp_extract("path", "^(.*)/", 1).alias("directory")).agg(F.count("*").alias("n"))
    dirs = dirs.withColumns({"files": F.sum("n").over(own), "rn": F.row_number().over(own.orderBy(F.desc("n"), "directory"))}).where("rn = 1")
    named = dirs.select("district", "files", F.when(F.col("n") >= share * F.col("files"), F.col("directory")).alias("directory"))
    return named.join(top, "district").select("district", "files", "top_file", "directory")


def package_groups(files: DataFrame, least: int = 3, most: int = 10, max_depth: int = 8) -> DataFrame:
    """(package, files): directory prefixes at the first depth that gives ``least`` groups; the largest ``most`` groups
    and one of the rest."""
    parts = F.split("path", "/")
    for depth in range(1, max_depth + 1):
        prefix = F.array_join(F.slice(parts, F.lit(1), F.least(F.lit(depth), F.size(parts) - 1)), "/")
        groups = files.groupBy(prefix.alias("package")).agg(F.count("*").alias("files"))
        if groups.count() >= least:
            break
    ranked = groups.withColumn("rn", F.row_number().over(Window.orderBy(F.desc("files"), "package")))
    name = F.when(F.col("rn") <= most, F.col("package")).otherwise("other")
    return ranked.groupBy(name.alias("package")).agg(F.sum("files").alias("files"))


def reference_status(rows: DataFrame) -> DataFrame:
    """One row ``status``: heuristic, partial or exact, from ``exact`` (boolean) of every language."""
    return rows.agg(
        F.when(F.count("*") == 0, "heuristic").when(F.bool_and("exact"), "exact").when(F.bool_or("exact"), "partial").otherwise("heuristic").alias("status")
    )


def greedy_shades(nodes: list[tuple], near: set[tuple], shades: int = 3) -> dict:
    """Shade of each (id, size), larger first, no two near ones alike while shades last, else the one used least."""
    out, used = {}, [0] * shades
    for node, _ in sorted(nodes, key=lambda x: (-x[1], x[0])):
        taken = {out[m] for m in out if (node, m) in near or (m, node) in near}
        free = [s for s in range(shades) if s not in taken]
        pick = free[0] if free else min(range(shades), key=lambda s: (used[s], s))
        out[node] = pick
        used[pick] += 1
    return out


def place_labels(ranked: list[tuple], boxes: list[tuple] = ()) -> list:
    """Ids of (id, x0, y0, x1, y1), in order, whose boxes overlap none that was taken before."""
    taken, out = list(boxes), []
    for node, x0, y0, x1, y1 in ranked:
        if all(x1 <= a or c <= x0 or y1 <= b or d <= y0 for a, b, c, d in taken):
            taken.append((x0, y0, x1, y1))
            out.append(node)
    return out
