"""Change impact: head files on base districts, modularity change, cross-district edges gained and lost, verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import language_of
from .blend import blend, prune_node_relative
from .graph import modularity, place_by_plurality

MAX_DISTRICTS, MAX_DQ = 4, 0.0001
SOURCE_LANGUAGES = ["python", "go", "rust", "typescript"]
TOUCHED = ["bridge", "hazard"]


def side_edges(candidates: DataFrame) -> DataFrame:
    """The blended graph of one side, pruned against each node's heaviest edge."""
    return prune_node_relative(blend(candidates))


def identities(head: DataFrame, changes: DataFrame) -> DataFrame:
    """``head`` (path) with ``identity``: the path in the base, through renames (status, from_path, to_path)."""
    renamed = changes.where("status = 'renamed'").select(F.col("to_path").alias("path"), "from_path")
    return head.join(renamed, "path", "left").withColumn("identity", F.coalesce("from_path", "path")).drop("from_path")


def head_districts(head: DataFrame, base: DataFrame, imports: DataFrame, weights: DataFrame) -> DataFrame:
    """(path, identity, district, inherited): base districts by identity; new files go where the blended weight of their
    imports of inherited files is largest.  ``imports``: src, dst; ``weights``: a, b, weight (paths)."""
    kept = head.join(base.select(F.col("path").alias("identity"), "district"), "identity", "left")
    new = kept.where("district is null").select(F.col("path").alias("src"))
    blended = weights.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), "weight")
    arcs = imports.where("src <> dst").join(new, "src").join(
        kept.where("district is not null").select(F.col("path").alias("dst"), "district"), "dst"
    )
    arcs = arcs.withColumns({"x": F.least("src", "dst"), "y": F.greatest("src", "dst")}).join(blended, ["x", "y"], "left")
    found = place_by_plurality(
        arcs.groupBy(F.col("src").alias("file_id"), "district").agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("weight"))
    )
    found = found.select(F.col("file_id").alias("path"), F.col("district").alias("near"))
    return kept.join(found, "path", "left").select(
        "path", "identity", F.coalesce("district", "near").alias("district"), F.col("district").isNotNull().alias("inherited")
    )


def delta_q(base_edges: DataFrame, base: DataFrame, head_edges: DataFrame, head: DataFrame) -> DataFrame:
    """One row ``dq``: modularity of the head less that of the base, both on fixed districts (file_id, district)."""
    b, h = modularity(base_edges, base), modularity(head_edges, head)
    return h.select(F.col("q").alias("h")).crossJoin(b.select(F.col("q").alias("b"))).select(
        (F.rint((F.col("h") - F.col("b")) * 1e6) / 1e6 + 0.0).alias("dq")
    )


def cross_edges(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(a, b, weight): edges between two different districts."""
    at = lambda end: files.select(F.col("file_id").alias(end), F.col("district").alias(f"d_{end}"))
    return edges.join(at("a"), "a").join(at("b"), "b").where("d_a <> d_b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight")


def cross_edge_changes(base: DataFrame, head: DataFrame, base_candidates: DataFrame, head_candidates: DataFrame) -> DataFrame:
    """(a, b, weight, change, cause): cross edges of one side only; ``prune`` where the other side has the candidate."""

    def one(these, others, candidates, change):
        pairs = candidates.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().withColumn("was", F.lit(True))
        gone = these.join(others.select("a", "b"), ["a", "b"], "left_anti").join(pairs, ["a", "b"], "left")
        return gone.select("a", "b", "weight", F.lit(change).alias("change"), F.when(F.col("was"), "prune").otherwise("edge").alias("cause"))

    return one(head, base, base_candidates, "added").union(one(base, head, head_candidates, "removed"))


def changed_files(changes: DataFrame, base: DataFrame, head: DataFrame) -> DataFrame:
    """(path, base_path, status, district, placed, reason): every change with the district of its base file, else of the
    placed head file; ``reason`` is set for files in neither graph."""
    rows = changes.distinct().select(
        F.when(F.col("status") == "deleted", F.col("from_path")).otherwise(F.coalesce("to_path", "from_path")).alias("path"),
        F.when(F.col("status") == "added", F.lit(None)).otherwise(F.coalesce("from_path", "to_path")).alias("old"),
        F.when(F.col("status") == "renamed", F.col("from_path")).alias("base_path"),
        "status",
    )
    rows = rows.join(base.select(F.col("path").alias("old"), F.col("district").alias("d_old")), "old", "left")
    now = head.select("path", F.col("district").alias("d_new"), F.lit(True).alias("there"))
    rows = rows.join(now, "path", "left").withColumn("there", F.coalesce("there", F.lit(False)) & (F.col("status") != "deleted"))
    inside = F.col("d_old").isNotNull() | F.col("there")
    reason = F.when(~inside, F.when(language_of(F.col("path")).isin(SOURCE_LANGUAGES), "not_in_scope").otherwise("unsupported_language"))
    return rows.select(
        "path", "base_path", "status", F.coalesce("d_old", F.when(F.col("there"), F.col("d_new"))).alias("district"),
        (F.col("d_old").isNull() & F.col("there") & F.col("d_new").isNotNull()).alias("placed"), reason.alias("reason"),
    )


def districts_crossed(changed: DataFrame) -> DataFrame:
    return changed.where("reason is null and district is not null").groupBy("district").agg(F.count("*").alias("changed_files"))


def landmark_touches(changed: DataFrame, landmarks: DataFrame) -> DataFrame:
    """(path, why): changed files that are bridges or hazards of the base (landmarks: path, why)."""
    old = changed.where("status <> 'added'").select("path", F.coalesce("base_path", "path").alias("old"))
    marks = landmarks.where(F.col("why").isin(TOUCHED)).select(F.col("path").alias("old"), "why")
    return old.join(marks, "old").select("path", "why").distinct()


def verdict(districts: int, dq: float, max_districts: int | None = MAX_DISTRICTS, max_dq: float | None = MAX_DQ) -> dict:
    """Thresholds that fail, and the exit code: 0 pass, 1 fail.  A threshold of None is not asked for."""
    failed = [
        name
        for name, bad in (
            ("max_districts", max_districts is not None and districts > max_districts),
            ("max_dq", max_dq is not None and dq < -max_dq),
        )
        if bad
    ]
    return {"failed": failed, "exit_code": 1 if failed else 0}
