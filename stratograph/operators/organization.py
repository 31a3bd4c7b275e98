"""Dependencies between the repositories of an organization."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import go_pseudo_hash, package_key, satisfies


def providers(provided: DataFrame) -> DataFrame:
    """(ecosystem, key, member, version, file): one provider for each member and package."""
    keyed = provided.withColumn("key", package_key(F.col("ecosystem"), F.col("name")))
    return keyed.groupBy("ecosystem", "key", "member").agg(F.min(F.struct("file", "version")).alias("p")).select("ecosystem", "key", "member", "p.version", "p.file")


def resolve(declared: DataFrame, provided: DataFrame) -> DataFrame:
    """Declarations with ``target`` and ``outcome``: self, edge (one provider), external (none), ambiguous (several); a
    path or workspace spec without a provider is unresolved."""
    known = providers(provided).select("ecosystem", "key", F.col("member").alias("target"), F.col("version").alias("target_version"))
    counts = known.groupBy("ecosystem", "key").agg(F.count("*").alias("n"))
    keyed = declared.withColumn("key", package_key(F.col("ecosystem"), F.col("name")))
    own = known.select("ecosystem", "key", F.col("target").alias("member")).withColumn("own", F.lit(True))
    out = keyed.join(own, ["ecosystem", "key", "member"], "left").join(counts, ["ecosystem", "key"], "left")
    single = known.join(counts.where("n = 1").select("ecosystem", "key"), ["ecosystem", "key"])
    out = out.join(single, ["ecosystem", "key"], "left")
    outcome = (
        F.when(F.col("own"), "self")
        .when(F.col("n").isNull(), F.when(F.col("pin_kind").isin("path", "workspace"), "unresolved").otherwise("external"))
        .when(F.col("n") == 1, "edge")
        .otherwise("ambiguous")
    )
    return out.select(*declared.columns, "key", outcome.alias("outcome"), F.when(outcome == "edge", F.col("target")).alias("target"), "target_version")


def judged(edges: DataFrame, members: DataFrame, tags: DataFrame | None = None) -> DataFrame:
    """Edges with ``pin_status``: match, skew or unjudged.

    Revisions match by prefix of the member's commit, tags by the commit they name, versions by the requirement;
    branches, paths and workspaces are not judged.  ``members``: target, commit; ``tags``: target, pin_value, tag_commit.
    """
    out = edges.join(members.select("target", "commit"), "target", "left")
    if tags is not None:
        out = out.join(tags, ["target", "pin_value"], "left")
    else:
        out = out.withColumn("tag_commit", F.lit(None).cast("string"))
    verdict = lambda ok: F.when(ok.isNull(), "unjudged").when(ok, "match").otherwise("skew")
    kind, value = F.col("pin_kind"), F.col("pin_value")
    pseudo = go_pseudo_hash(value)
    status = (
        F.when(kind == "rev", verdict(F.col("commit").startswith(value)))
        .when(kind == "tag", verdict(F.col("tag_commit") == F.col("commit")))
        .when((kind == "version") & pseudo.isNotNull(), verdict(F.col("commit").startswith(pseudo)))
        .when((kind == "version") & F.col("tag_commit").isNotNull(), verdict(F.col("tag_commit") == F.col("commit")))
        .when(kind == "version", verdict(satisfies(value, F.col("target_version"), F.col("ecosystem"))))
        .otherwise("unjudged")
    )
    return out.withColumn("pin_status", status)


def repository_edges(edges: DataFrame) -> DataFrame:
    """(member, target, evidence): how many declarations link two repositories."""
    return edges.where("outcome = 'edge'").groupBy("member", "target").agg(F.count("*").alias("evidence"))


def external(edges: DataFrame) -> DataFrame:
    return edges.where("outcome = 'external'").groupBy("ecosystem", "name").agg(F.count_distinct("member").alias("members"))
