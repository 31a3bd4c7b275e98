"""Two maps side by side: parity, graph variants, heads in a base's frame, overlays and debt compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .check import head_districts, identities
from .graph import modularity, placed
from .overlay import changes
from .signals import cochange_pairs

PLACEMENT_SHARE, MODULARITY_GAP = 0.95, 0.02


def parity(reference: DataFrame, candidate: DataFrame, reference_edges: DataFrame, candidate_edges: DataFrame) -> DataFrame:
    """One row: files of both maps, the share placed alike, the modularity gap, edges that only one has, and whether the
    candidate passes.  Files: path, file_id, district; edges: a, b, weight (file ids of their own map).

    Districts are matched by their overlap first: a candidate's district stands for the reference's with most of its files.
    """
    both = reference.select("path", F.col("district").alias("dr")).join(candidate.select("path", F.col("district").alias("dc")), "path")
    cells = both.groupBy("dc", "dr").agg(F.count("*").alias("n"))
    order = Window.partitionBy("dc").orderBy(F.desc("n"), "dr")
    alike = cells.withColumn("rn", F.row_number().over(order)).agg(F.sum("n").alias("files"), F.sum(F.when(F.col("rn") == 1, F.col("n"))).alias("alike"))
    named = lambda edges, files: (
        edges.join(files.select(F.col("file_id").alias("a"), F.col("path").alias("x")), "a")
        .join(files.select(F.col("file_id").alias("b"), F.col("path").alias("y")), "b")
        .select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
        .distinct()
    )
    r, c = named(reference_edges, reference).withColumn("in_r", F.lit(1)), named(candidate_edges, candidate).withColumn("in_c", F.lit(1))
    lost = r.join(c, ["x", "y"], "full_outer").agg(F.count_if(F.col("in_c").isNull()).alias("edges_lost"), F.count_if(F.col("in_r").isNull()).alias("edges_new"))
    gap = modularity(reference_edges, reference).select(F.col("q").alias("qr")).crossJoin(modularity(candidate_edges, candidate).select(F.col("q").alias("qc")))
    out = alike.crossJoin(lost).crossJoin(gap)
    share, delta = F.try_divide(F.col("alike"), F.col("files")), F.rint((F.col("qc") - F.col("qr")) * 1e6) / 1e6
    good = (share >= PLACEMENT_SHARE) & (F.abs(delta) <= MODULARITY_GAP) & (F.col("edges_lost") == 0) & (F.col("edges_new") == 0)
    return out.select("files", (F.rint(share * 1e6) / 1e6).alias("placed_alike"), delta.alias("dq"), "edges_lost", "edges_new", F.coalesce(good, F.lit(False)).alias("passed"))


def variant_churn(variants: DataFrame, files: DataFrame) -> DataFrame:
    """(variant, edges, inside, q): of every variant of a graph (variant, a, b, weight) its size, the weight inside
    districts, and its modularity at resolution 1 on fixed districts."""
    inner = placed(variants, files)
    sides = inner.select("variant", F.explode(F.array(F.col("d_a"), F.col("d_b"))).alias("d"), "weight")
    m = inner.groupBy("variant").agg(F.count("*").alias("edges"), F.sum("weight").alias("m"), F.sum(F.when(F.col("d_a") == F.col("d_b"), F.col("weight")).otherwise(0.0)).alias("w"))
    k = sides.groupBy("variant", "d").agg(F.sum("weight").alias("k")).groupBy("variant").agg(F.sum(F.col("k") * F.col("k")).alias("k2"))
    share = F.col("w") / F.col("m")
    return m.join(k, "variant").select(
        "variant", "edges", (F.rint(share * 1e6) / 1e6).alias("inside"), (F.rint((share - F.col("k2") / (4 * F.col("m") * F.col("m"))) * 1e6) / 1e6).alias("q")
    )


def head_cochange(base_commits: DataFrame, renames: DataFrame) -> DataFrame:
    """Co-change pairs of a head: the base's commits (sha, f), files by their names in the head (from_path, to_path)."""
    moved = renames.select(F.col("from_path").alias("f"), "to_path").dropDuplicates(["f"])
    return cochange_pairs(base_commits.join(moved, "f", "left").select("sha", F.coalesce("to_path", "f").alias("f")).distinct())


def head_frame(head: DataFrame, base: DataFrame, renamed: DataFrame, imports: DataFrame, weights: DataFrame) -> DataFrame:
    """(path, identity, district): the head's files in the base's districts; files that nothing places go to one past the
    last.  ``renamed``: status, from_path, to_path; ``imports``: src, dst; ``weights``: a, b, weight."""
    placed_ = head_districts(identities(head, renamed), base, imports, weights)
    last = base.agg((F.max("district") + 1).alias("last"))
    return placed_.crossJoin(F.broadcast(last)).select("path", "identity", F.coalesce("district", "last").alias("district"))


def debt_changes(before: DataFrame, after: DataFrame, renames: DataFrame | None = None) -> DataFrame:
    """(kind, path, change) of findings (kind, path), kind by kind, so that a file of two kinds is not shared between them."""
    side = lambda f: f.select(F.lit("area").alias("section"), F.col("kind").alias("label"), F.col("path").alias("spec"), F.lit("resolved").alias("status"), F.lit(0).alias("pos")).distinct()
    out = changes(side(before), side(after), renames)
    return out.select(F.col("label").alias("kind"), F.col("spec").alias("path"), "change")


def comparison(base: DataFrame, head: DataFrame, provenance: dict[str, str]) -> DataFrame:
    """(path, change, base_district, head_district, ...): files of two commits, with the provenance of the comparison."""
    both = base.select("path", F.col("district").alias("base_district")).join(head.select("path", F.col("district").alias("head_district")), "path", "full_outer")
    change = (
        F.when(F.col("base_district").isNull(), "added").when(F.col("head_district").isNull(), "removed")
        .when(F.col("base_district") != F.col("head_district"), "moved").otherwise("kept")
    )
    return both.select("path", change.alias("change"), "base_district", "head_district", *[F.lit(v).alias(k) for k, v in sorted(provenance.items())])
