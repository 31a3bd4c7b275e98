"""Mass-normalised blending of signals and pruning of the blended graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .signals import SHARES

KEEP_PER_NODE = 14
FLOOR = 0.02
PERCENTILE = 0.0004192890476807616
PRE_RESCALE = 0.00007752604982072655


def signal_masses(edges: DataFrame) -> DataFrame:
    """One row: the sum of each signal, 1 where it is 0."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    return edges.agg(*[F.when(total(c) == 0, F.lit(1.0)).otherwise(total(c)).alias(f"mass_{c}") for c in SHARES])


def blend(edges: DataFrame, rescale: bool = True) -> DataFrame:
    """(a, b, weight): each signal weighs its share of its own mass; the largest weight is 1 after ``rescale``."""
    weight = sum((F.lit(s) / F.col(f"mass_{c}") * F.col(c) for c, s in SHARES.items()), F.lit(0.0))
    # one row of four numbers
    out = edges.crossJoin(F.broadcast(signal_masses(edges))).select("a", "b", weight.alias("weight"))
    return rescaled(out) if rescale else out


def rescaled(edges: DataFrame) -> DataFrame:
    top = edges.agg(F.max("weight").alias("top"))
    return edges.crossJoin(F.broadcast(top)).withColumn("weight", F.col("weight") / F.col("top")).drop("top")


def ends(edges: DataFrame) -> DataFrame:
    """Every edge once for each of its ends."""
    return edges.select(F.explode(F.array("a", "b")).alias("node"), "a", "b", "weight")


def keep_top(edges: DataFrame, floor, relative: float | None = None, top: int = KEEP_PER_NODE) -> DataFrame:
    """Edges that one of their ends keeps: among its ``top`` heaviest (ties by a, b) and not under the floor."""
    node = Window.partitionBy("node")
    ranked = ends(edges).withColumn("rn", F.row_number().over(node.orderBy(F.desc("weight"), "a", "b")))
    if relative is not None:
        ranked = ranked.withColumn("least", F.lit(relative) * F.max("weight").over(node))
    else:
        ranked = ranked.withColumn("least", F.lit(floor))
    kept = ranked.where((F.col("rn") <= top) & (F.col("weight") >= F.col("least"))).select("a", "b").distinct()
    return edges.join(kept, ["a", "b"], "left_semi").select("a", "b", "weight")


def prune_absolute(blended: DataFrame, floor: float = FLOOR) -> DataFrame:
    return keep_top(blended, floor)


def prune_node_relative(blended: DataFrame, fraction: float = FLOOR) -> DataFrame:
    """The floor is a fraction of each node's heaviest edge."""
    return keep_top(blended, None, relative=fraction)


def prune_percentile(blended: DataFrame, p: float = PERCENTILE) -> DataFrame:
    """The floor is a type-7 quantile of all weights."""
    floor = blended.agg(F.percentile("weight", F.lit(p)).alias("q")).first()["q"]
    return keep_top(blended, floor if floor is not None else 0.0)


def prune_pre_rescale(edges: DataFrame, floor: float = PRE_RESCALE) -> DataFrame:
    """Pruned on weights before they are rescaled; the kept ones are rescaled after."""
    return rescaled(keep_top(blend(edges, rescale=False), floor))


def prune_stats(blended: DataFrame, floor: float = FLOOR) -> DataFrame:
    return blended.agg(
        F.count("*").alias("candidates"),
        F.count_if(F.col("weight") < floor).alias("below_floor"),
        F.sum("weight").alias("weight_sum"),
    )


def encoded(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Paths replaced by node ids (path, file_id); an unknown path fails the job."""
    at = lambda end: nodes.select(F.col("path").alias(end), F.col("file_id").alias(f"{end}_id"))
    out = edges.join(at("a"), "a", "left").join(at("b"), "b", "left")
    known = lambda end: F.when(F.col(f"{end}_id").isNull(), F.raise_error(F.concat(F.lit("unknown file "), F.col(end)))).otherwise(F.col(f"{end}_id"))
    return out.select(known("a").alias("a"), known("b").alias("b"), "weight")
