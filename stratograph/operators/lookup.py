"""Structural questions over a map: overview, where, deps, coverage, and the envelope around answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_LIMIT = 25


def overview(files: DataFrame, arcs: DataFrame, districts: DataFrame) -> DataFrame:
    """(district, name, files, imports_in, imports_out, rank); imports between districts only."""
    at = lambda end: files.select(F.col("file_id").alias(end), F.col("district").alias(f"d_{end}"))
    crossing = arcs.join(at("src"), "src").join(at("dst"), "dst").where("d_src <> d_dst")
    # both ends of an arc in one pass
    flows = crossing.select(
        F.explode(
            F.array(
                F.struct(F.col("d_src").alias("district"), F.lit(0).alias("i"), F.lit(1).alias("o")),
                F.struct(F.col("d_dst").alias("district"), F.lit(1).alias("i"), F.lit(0).alias("o")),
            )
        ).alias("x")
    ).groupBy("x.district").agg(F.sum("x.i").alias("i"), F.sum("x.o").alias("o"))
    sizes = files.groupBy("district").agg(F.count("*").alias("files"))
    out = sizes.join(flows, "district", "left").join(districts, "district", "left")
    order = Window.orderBy(F.desc("files"), "name", "district")
    return out.select(
        "district",
        "name",
        "files",
        F.coalesce("i", F.lit(0)).cast("long").alias("imports_in"),
        F.coalesce("o", F.lit(0)).cast("long").alias("imports_out"),
        F.row_number().over(order).alias("rank"),
    )


def deps(arcs: DataFrame, files: DataFrame, focus, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """(path, direction, total, omitted) of the files that ``focus`` imports (out) and that import it (in); the limit
    holds for each direction."""
    sides = arcs.where((F.col("src") == focus) & (F.col("dst") != focus)).select(F.col("dst").alias("file_id"), F.lit("out").alias("direction")).union(
        arcs.where((F.col("dst") == focus) & (F.col("src") != focus)).select("src", F.lit("in"))
    )
    named = sides.distinct().join(files.select("file_id", "path"), "file_id")
    side = Window.partitionBy("direction")
    named = named.withColumn("rn", F.row_number().over(side.orderBy("path"))).withColumn("total", F.count("*").over(side))
    return named.where(F.col("rn") <= limit).select(
        "path", "direction", "total", F.greatest(F.col("total") - limit, F.lit(0)).alias("omitted")
    )


def where_path(files: DataFrame, path: str) -> DataFrame:
    return files.where(F.col("path") == path)


def nearest_paths(files: DataFrame, path: str, most: int = 3) -> DataFrame:
    """(path, distance) of the nearest mapped paths by edits, then by path."""
    scored = files.select("path").distinct().withColumn("distance", F.levenshtein("path", F.lit(path)))
    return scored.orderBy("distance", "path").limit(most)


def qualified_symbols(symbols: DataFrame, separator: str = "::", max_depth: int = 32) -> DataFrame:
    """Symbols (sym_id, file_id, name, parent) with ``local``, their parents' names before their own.

    A parent in another file, or a chain that does not end, fails the job.
    """
    names = symbols.select(F.col("sym_id").alias("up"), F.col("file_id").alias("up_file"), F.col("name").alias("up_name"), F.col("parent").alias("up_parent"))
    done, open_ = None, symbols.withColumn("local", F.col("name")).withColumn("up", F.col("parent"))
    for _ in range(max_depth):
        ended = open_.where("up is null or up < 0").drop("up")
        done = ended if done is None else done.unionByName(ended)
        rest = open_.where("up >= 0")
        if not rest.limit(1).count():
            return done
        met = rest.join(names, "up")
        same = F.when(F.col("up_file") != F.col("file_id"), F.raise_error(F.lit("symbol parent belongs to another file"))).otherwise(
            F.concat_ws(separator, "up_name", "local")
        )
        open_ = met.withColumn("local", same).withColumn("up", F.col("up_parent")).drop("up_file", "up_name", "up_parent")
    raise ValueError("cycle in symbol parents")


def where_symbol(symbols: DataFrame, files: DataFrame, target: str) -> DataFrame:
    """Symbols that a name, a local or a full qualified name means: (path, qualified, start, end, ambiguous)."""
    full = qualified_symbols(symbols).join(files.select("file_id", "path"), "file_id").withColumn("qualified", F.concat_ws("::", "path", "local"))
    hits = full.where((F.col("name") == target) | (F.col("local") == target) | (F.col("qualified") == target))
    return hits.select("path", "qualified", "start", "end", (F.count("*").over(Window.partitionBy(F.lit(0))) > 1).alias("ambiguous"))


def envelope(results: DataFrame, order: list, limit: int | None = DEFAULT_LIMIT) -> tuple[DataFrame, dict]:
    """The first rows in a total order, and total, returned, omitted, truncated, next_limit."""
    total = results.count()
    returned = total if limit is None else min(limit, total)
    page = results.orderBy(*order) if limit is None else results.orderBy(*order).limit(limit)
    cut = returned < total
    return page, {"total": total, "returned": returned, "omitted": total - returned, "truncated": cut, "next_limit": total if cut else None}


def coverage_by_language(files: DataFrame, arcs: DataFrame) -> DataFrame:
    """(lang, total_files, zero_edge_files) and one row with a null lang for all."""
    incident = arcs.where("src <> dst").select(F.explode(F.array("src", "dst")).alias("file_id")).distinct().withColumn("hit", F.lit(1))
    marked = files.select("file_id", "lang").join(incident, "file_id", "left")
    return marked.rollup("lang").agg(F.count("*").alias("total_files"), F.count_if(F.col("hit").isNull()).alias("zero_edge_files"))
