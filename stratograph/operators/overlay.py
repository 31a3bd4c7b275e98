"""Curated overlays (lenses): specs resolved against a map, hops between stops, differences of two resolutions."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import glob_regex

SPECS = "section string, label string, pos int, spec string, reason string"
VERSION = 1


def parse(text: str) -> list[tuple]:
    """Rows of SPECS from an overlay's TOML; unknown keys and other versions are refused."""
    doc = tomllib.loads(text)
    if doc.get("version") != VERSION:
        raise ValueError("unsupported overlay version")
    if extra := set(doc) - {"version", "title", "areas", "paths", "notes"}:
        raise ValueError(f"unknown keys: {sorted(extra)}")
    rows = []
    for area in doc.get("areas", []):
        rows += [("area", area["label"], i, spec, None) for i, spec in enumerate(area["members"])]
    for path in doc.get("paths", []):
        rows += [("stop", path["name"], i, s["at"], s.get("reason")) for i, s in enumerate(path["stops"])]
    rows += [("note", n["text"], i, n["anchor"], None) for i, n in enumerate(doc.get("notes", []))]
    return rows


def table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, SPECS)


def parsed_specs(specs: DataFrame) -> DataFrame:
    """``kind`` (district, symbol, glob, file), ``file``, ``symbol`` and ``line`` of every spec."""
    spec = F.col("spec")
    kind = (
        F.when(spec.startswith("district:") & (F.col("section") == "note"), "district")
        .when(spec.contains("#"), "symbol")
        .when(spec.rlike(r"[*?]") & (F.col("section") == "area"), "glob")
        .otherwise("file")
    )
    after = F.regexp_extract(spec, r"#(.*)$", 1)
    line = F.regexp_extract(after, r"@(\d+)$", 1)
    return specs.select(
        "*",
        kind.alias("kind"),
        F.regexp_extract(spec, r"^([^#]*)", 1).alias("file"),
        F.regexp_replace(after, r"@\d+$", "").alias("symbol"),
        F.when(line != "", line.cast("int")).alias("line"),
    )


def resolve(specs: DataFrame, files: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """(section, label, pos, spec, targets, status): how many files or symbols a spec means, and why not one.

    Statuses: resolved, missing_path, empty_glob, unknown_symbol, ambiguous, unknown_district.
    """
    parsed = parsed_specs(specs)
    keys = ["section", "label", "pos", "spec"]
    exact = parsed.where("kind = 'file'").join(files.select(F.col("path").alias("file")), "file").select(*keys)
    # an overlay is written by hand: its globs are few, and one pass over the files tries them all
    globs = parsed.where("kind = 'glob'").select(*keys, F.udf(lambda s: glob_regex(s), "string")("spec").alias("pattern"))
    hits = exact.union(files.select("path").join(F.broadcast(globs), F.expr("path rlike pattern")).select(*keys))
    if symbols is not None:
        named = symbols.join(files.select("file_id", "path"), "file_id").select(F.col("path").alias("file"), F.col("name").alias("symbol"), "start")
        met = parsed.where("kind = 'symbol'").join(named, ["file", "symbol"]).where("line is null or line = start")
        hits = hits.union(met.select(*keys))
    names = files.select(F.concat(F.lit("district:"), F.col("district_name")).alias("spec")).distinct() if "district_name" in files.columns else None
    if names is not None:
        hits = hits.union(parsed.where("kind = 'district'").join(names, "spec").select(*keys))
    counts = hits.groupBy(*keys).agg(F.count("*").alias("targets"))
    out = parsed.select(*keys, "kind").join(counts, keys, "left").withColumn("targets", F.coalesce("targets", F.lit(0)))
    none = F.when(F.col("kind") == "glob", "empty_glob").when(F.col("kind") == "symbol", "unknown_symbol").when(F.col("kind") == "district", "unknown_district").otherwise("missing_path")
    status = F.when(F.col("targets") == 0, none).when((F.col("targets") > 1) & (F.col("kind") != "glob"), "ambiguous").otherwise("resolved")
    return out.select(*keys, "targets", status.alias("status"))


def members(specs: DataFrame, files: DataFrame) -> DataFrame:
    """(label, path): the files of every area, each once."""
    parsed = parsed_specs(specs).where("section = 'area'")
    exact = parsed.where("kind = 'file'").select("label", F.col("file").alias("path")).join(files.select("path"), "path").select("label", "path")
    globs = parsed.where("kind = 'glob'").select("label", F.udf(lambda s: glob_regex(s), "string")("spec").alias("pattern"))
    # written by hand, so few
    return exact.union(files.select("path").join(F.broadcast(globs), F.expr("path rlike pattern")).select("label", "path")).distinct()


def hop_routes(specs: DataFrame, files: DataFrame, arcs: DataFrame) -> DataFrame:
    """(label, pos, from_spec, to_spec, kind, steps, reason): how one gets from stop to stop: ``declared`` where the stop
    gives a reason, else along a shortest route and its kind, else ``no_route``.  A path has a handful of stops, and each
    hop walks the graph breadth-first."""
    from .graph import route

    spark = specs.sparkSession
    ids = files.select("file_id", "path")
    ordered = arcs.select("src", "dst", F.col("dst").alias("pos"))
    why = specs.where("section = 'stop'").select("label", F.col("spec").alias("to_spec"), "reason")
    rows = []
    for h in hops(specs).join(why, ["label", "to_spec"], "left").orderBy("label", "pos").collect():
        ends = {r["path"]: r["file_id"] for r in ids.where(F.col("path").isin(h["from_spec"], h["to_spec"])).collect()}
        kind, steps = "no_route", None
        if h["reason"]:
            kind = "declared"
        elif {h["from_spec"], h["to_spec"]} <= set(ends):
            way = route(ordered, ends[h["from_spec"]], ends[h["to_spec"]]).collect()
            if way:
                kind, steps = way[0]["kind"], len(way) - 1
        rows.append((h["label"], h["pos"], h["from_spec"], h["to_spec"], kind, steps, h["reason"]))
    return spark.createDataFrame(rows, "label string, pos int, from_spec string, to_spec string, kind string, steps int, reason string")


def annotate_renames(resolved: DataFrame, renames: DataFrame) -> DataFrame:
    """Missing paths that a rename (from_path, to_path) explains are ``renamed_file``; they stay unresolved."""
    moved = renames.select(F.col("from_path").alias("spec"), "to_path")
    out = resolved.join(moved, "spec", "left")
    return out.withColumn("status", F.when((F.col("status") == "missing_path") & F.col("to_path").isNotNull(), "renamed_file").otherwise(F.col("status")))


def hops(specs: DataFrame) -> DataFrame:
    """(label, pos, from_spec, to_spec) of consecutive stops of every path."""
    order = Window.partitionBy("label").orderBy("pos")
    stops = specs.where("section = 'stop'").withColumn("to_spec", F.lead("spec").over(order))
    return stops.where("to_spec is not null").select("label", "pos", F.col("spec").alias("from_spec"), "to_spec")


def changes(before: DataFrame, after: DataFrame, renames: DataFrame | None = None) -> DataFrame:
    """(section, label, spec, change): shared, added, removed, broken, moved or renamed, by precedence.

    Both sides: section, label, spec, status, pos.  Renames carry a base spec to its new path.
    """
    left = before
    if renames is not None:
        left = left.join(renames.select(F.col("from_path").alias("spec"), "to_path"), "spec", "left")
        left = left.withColumn("key", F.coalesce("to_path", "spec"))
    else:
        left = left.withColumn("key", F.col("spec"))
    a = left.select("section", "label", "key", F.col("spec").alias("spec_a"), (F.col("status") == "resolved").alias("ok_a"), F.col("pos").alias("pos_a"))
    b = after.select("section", "label", F.col("spec").alias("key"), (F.col("status") == "resolved").alias("ok_b"), F.col("pos").alias("pos_b"))
    both = a.join(b, ["section", "label", "key"], "full_outer")
    change = (
        F.when(F.col("ok_a").isNull(), F.when(F.col("ok_b"), "added").otherwise("broken"))
        .when(F.col("ok_b").isNull(), "removed")
        .when(~F.col("ok_a") & F.col("ok_b"), "added")
        .when(F.col("ok_a") & ~F.col("ok_b"), "broken")
        .when(F.col("spec_a") != F.col("key"), "renamed")
        .when((F.col("section") == "stop") & F.col("ok_a") & F.col("ok_b") & (F.col("pos_a") != F.col("pos_b")), "moved")
        .otherwise("shared")
    )
    return both.select("section", "label", F.col("key").alias("spec"), change.alias("change"))


def to_toml(title: str, specs: DataFrame) -> str:
    """Canonical overlay text; an overlay is small."""
    quote = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
    rows = specs.orderBy("section", "label", "pos").collect()
    out = [f"version = {VERSION}", f"title = {quote(title)}"]
    for label in sorted({r["label"] for r in rows if r["section"] == "area"}):
        members = ", ".join(quote(r["spec"]) for r in rows if r["section"] == "area" and r["label"] == label)
        out += ["", "[[areas]]", f"label = {quote(label)}", f"members = [{members}]"]
    for label in sorted({r["label"] for r in rows if r["section"] == "stop"}):
        stops = ", ".join(f"{{ at = {quote(r['spec'])} }}" for r in rows if r["section"] == "stop" and r["label"] == label)
        out += ["", "[[paths]]", f"name = {quote(label)}", f"stops = [{stops}]"]
    for r in rows:
        if r["section"] == "note":
            out += ["", "[[notes]]", f"anchor = {quote(r['spec'])}", f"text = {quote(r['label'])}"]
    return "\n".join(out) + "\n"
