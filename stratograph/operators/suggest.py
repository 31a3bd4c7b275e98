"""Proposed overlays: routes from entries, a tour of the districts, crossings between them.  Landmarks and districts are
few; only the rows that a proposal names come to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import checkpointed
from .graph import district_edges

ENTRY_HOPS, CROSSINGS = 4, 3


def entry_routes(arcs: DataFrame, files: DataFrame, entries: DataFrame, hops: int = ENTRY_HOPS) -> DataFrame:
    """(entry, step, file_id): from every entry, up to ``hops`` steps to the import of largest fan-in; a step leaves the
    home district where it is the last one, or where the greedy choice could not leave any more.

    Each round extends all routes at once: the frontier joins its own imports and their imports' districts.
    """
    info = files.select("file_id", "district", "fanin")
    out_districts = arcs.join(info.select(F.col("file_id").alias("dst"), F.col("district").alias("d_next")), "dst").select(F.col("src").alias("file_id"), "d_next").distinct()
    home = entries.select(F.col("file_id").alias("entry")).join(info.select(F.col("file_id").alias("entry"), F.col("district").alias("home")), "entry")
    at = home.select("entry", "home", F.col("entry").alias("file_id"), F.array("entry").alias("route"), F.lit(False).alias("ended"))
    for step in range(1, hops + 1):
        live = at.where("not ended")
        ahead = live.join(arcs.select(F.col("src").alias("file_id"), F.col("dst").alias("next")), "file_id")
        ahead = ahead.where(~F.array_contains("route", F.col("next"))).join(info.withColumnRenamed("file_id", "next"), "next")
        # whether the route can still leave after this step
        leaves = out_districts.select(F.col("file_id").alias("next"), "d_next")
        can = ahead.join(leaves, "next", "left").groupBy("entry", "next").agg(F.coalesce(F.bool_or(F.col("d_next") != F.col("home")), F.lit(False)).alias("can"))
        ranked = ahead.join(can, ["entry", "next"]).withColumn("away", F.col("district") != F.col("home"))
        w = Window.partitionBy("entry").orderBy(F.desc("fanin"), "next")
        best = ranked.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("entry", F.col("next").alias("b"), F.col("away").alias("b_away"), F.col("can").alias("b_can"))
        away = ranked.where("away").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("entry", F.col("next").alias("o"))
        pick = best.join(away, "entry", "left")
        leave = ~F.col("b_away") & F.col("o").isNotNull() & (F.lit(step == hops) | ~F.col("b_can"))
        pick = pick.select("entry", F.when(leave, F.col("o")).otherwise(F.col("b")).alias("to"), (leave | F.col("b_away")).alias("left"))
        new = at.join(pick, "entry", "left")
        go = ~F.col("ended") & F.col("to").isNotNull()
        at = new.select(
            "entry", "home", F.when(go, F.col("to")).otherwise(F.col("file_id")).alias("file_id"),
            F.when(go, F.concat("route", F.array("to"))).otherwise(F.col("route")).alias("route"),
            (F.col("ended") | ~go | F.coalesce("left", F.lit(False))).alias("ended"),
        )
        at = checkpointed(at)
    return at.where(F.size("route") > 1).select("entry", F.posexplode("route").alias("step", "file_id"))


def district_tour(files: DataFrame, capitals: DataFrame) -> DataFrame:
    """(district, pos, file_id): the districts by size, each with its capital."""
    sizes = files.groupBy("district").agg(F.count("*").alias("size"))
    order = Window.orderBy(F.desc("size"), "district")
    return sizes.join(capitals.select("district", "file_id"), "district").select("district", (F.row_number().over(order) - 1).alias("pos"), "file_id")


def crossings(edges: DataFrame, files: DataFrame, most: int = CROSSINGS) -> DataFrame:
    """(da, db, a, b, weight): of the heaviest roads, the heaviest edge."""
    top = district_edges(edges, files).orderBy(F.desc("weight"), "da", "db").limit(most).select("da", "db")
    at = lambda end: files.select(F.col("file_id").alias(end), F.col("district").alias(f"d_{end}"))
    cross = edges.join(at("a"), "a").join(at("b"), "b").withColumns({"da": F.least("d_a", "d_b"), "db": F.greatest("d_a", "d_b")}).join(F.broadcast(top), ["da", "db"])
    w = Window.partitionBy("da", "db").orderBy(F.desc("weight"), "a", "b")
    return cross.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("da", "db", "a", "b", "weight")
