"""Snapshot catalogue, retention, provenance, caches, job timings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import numbered

TIMINGS = 256


def point_lookup(maps: DataFrame, slug: str, commit: str) -> DataFrame:
    return maps.where((F.col("slug") == slug) & (F.col("commit_sha") == commit))


def newest(rows: DataFrame, group: list[str], order: list[Column | str]) -> DataFrame:
    """The newest row of each group; ``order`` is total, newest first."""
    w = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def newest_by_absence(rows: DataFrame, group: str, time: str, tie: str) -> DataFrame:
    """The same by the absence of a newer row: ``max_by`` on (time, tie), joined back."""
    last = rows.groupBy(group).agg(F.max(F.struct(time, tie)).alias("__last")).select(F.col(group).alias("__g"), "__last")
    return rows.join(last, (F.col(group) == F.col("__g")) & (F.struct(time, tie) == F.col("__last")), "left_semi")


def history(maps: DataFrame, slug: str) -> DataFrame:
    return maps.where(F.col("slug") == slug).orderBy(F.desc("indexed_at"), F.desc("commit_sha"))


def warm_start_source(maps: DataFrame, slug: str, branch: str | None) -> DataFrame:
    """The newest map of the branch, else the newest."""
    order = [F.desc(F.coalesce(F.col("branch") == branch, F.lit(False)) if branch is not None else F.lit(False)), F.desc("indexed_at"), F.desc("commit_sha")]
    return maps.where(F.col("slug") == slug).orderBy(*order).limit(1)


def retained(maps: DataFrame, group: str, order: list, keep: int) -> DataFrame:
    """Rows to keep and to delete (``keep`` boolean): the newest max(keep, 1) of each group."""
    w = Window.partitionBy(group).orderBy(*order)
    return maps.withColumn("keep", F.row_number().over(w) <= max(keep, 1))


def upserted(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with ``rows``; the new row of a key replaces the old."""
    return table.join(rows, keys, "left_anti").unionByName(rows)


def inserted(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``table`` with those rows whose key it does not have."""
    return table.unionByName(rows.dropDuplicates(keys).join(table, keys, "left_anti"))


def fenced_update(jobs: DataFrame, updates: DataFrame) -> DataFrame:
    """Jobs (job_id, state, epoch, ...) updated by rows of an equal or later epoch; done and failed never change; null
    values leave the old ones."""
    terminal = F.col("state").isin("done", "failed")
    others = [c for c in jobs.columns if c not in ("job_id", "epoch")]
    new = updates.select("job_id", F.col("epoch").alias("__e"), *[F.col(c).alias(f"__{c}") for c in others if c in updates.columns])
    out = jobs.join(new, "job_id", "left")
    ok = F.col("__e").isNotNull() & (F.col("__e") >= F.col("epoch")) & ~terminal
    cols = [F.when(ok, F.coalesce(f"__{c}", c)).otherwise(F.col(c)).alias(c) if c in updates.columns else F.col(c) for c in others]
    return out.select("job_id", F.when(ok, F.col("__e")).otherwise(F.col("epoch")).alias("epoch"), *cols)


def attempts_after_begin(attempts: DataFrame, repository: str, attempt: str) -> DataFrame:
    """A new running attempt; older running ones of the repository fail."""
    spark = attempts.sparkSession
    old = attempts.withColumn("state", F.when((F.col("repository") == repository) & (F.col("state") == "running"), "failed").otherwise(F.col("state")))
    return old.unionByName(spark.createDataFrame([(repository, attempt, "running")], "repository string, attempt string, state string"))


def attempts_after_finish(attempts: DataFrame, attempt: str, state: str) -> DataFrame:
    return attempts.withColumn("state", F.when((F.col("attempt") == attempt) & (F.col("state") == "running"), state).otherwise(F.col("state")))


def json_jobs(jobs: DataFrame, prefix: str, key: str, value: str) -> DataFrame:
    return jobs.where(F.col("slug").startswith(prefix) & (F.get_json_object("spec_json", f"$.{key}") == value)).select("job_id")


def recent_timings(timings: DataFrame, most: int = TIMINGS) -> DataFrame:
    return timings.orderBy(F.desc("completed_at"), F.desc("job_id")).limit(most)


def provenance(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, change): added, deleted, changed, unchanged, or renamed where a deleted file's digest comes back."""
    both = before.select("path", F.col("digest").alias("old")).join(after.select("path", F.col("digest").alias("new")), "path", "full_outer")
    gone = both.where("new is null").select(F.col("old").alias("new")).distinct().withColumn("moved", F.lit(True))
    out = both.join(gone, "new", "left")
    change = (
        F.when(F.col("new").isNull(), "deleted")
        .when(F.col("old").isNull(), F.when(F.col("moved"), "renamed").otherwise("added"))
        .when(F.col("old") == F.col("new"), "unchanged")
        .otherwise("changed")
    )
    return out.select("path", change.alias("change"))


def cache_misses(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files (context, path, digest) that the extraction cache does not have."""
    return files.join(cache.select("context", "path", "digest").distinct(), ["context", "path", "digest"], "left_anti")


def evicted(entries: DataFrame, budget: int, keep: str | None = None) -> DataFrame:
    """(key, evict): oldest entries go until what is left, the protected one included, fits the budget.

    Prefix sums run over ranges of the age order first, so that no task holds all entries.
    """
    total = entries.agg(F.sum("size").alias("t"))
    free = entries if keep is None else entries.where(F.col("key") != keep)
    marked = numbered(free.select("key", "size", "last_used"), "last_used", "key", value="size").crossJoin(F.broadcast(total)).select("key", (F.col("t") - F.col("before") > budget).alias("evict"))
    return marked if keep is None else marked.union(entries.where(F.col("key") == keep).select("key", F.lit(False)))


def freshness(snapshots: DataFrame, heads: DataFrame) -> DataFrame:
    """(repo, state): missing (no checkout), none (no snapshot), fresh or stale; heads: repo, head, dirty."""
    last = newest(snapshots, ["repo"], [F.desc("sequence")]).select("repo", "commit_sha")
    out = heads.join(last, "repo", "left")
    state = (
        F.when(F.col("head").isNull(), "missing")
        .when(F.col("commit_sha").isNull(), "none")
        .when((F.col("commit_sha") == F.col("head")) & ~F.coalesce("dirty", F.lit(False)), "fresh")
        .otherwise("stale")
    )
    return out.select("repo", state.alias("state"))


def latest_stage(events: DataFrame) -> DataFrame:
    """(job, stage, events): the last stage of each job in time order, and how many events it sent."""
    return events.groupBy("job").agg(F.max_by("stage", F.struct("ts", "event_id")).alias("stage"), F.count("*").alias("events"))


def eta_factors(timings: DataFrame, prior: float = 3.0, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """(stage, factor): observed over predicted seconds of recent jobs, clamped, shrunk to 1 by a prior weight."""
    ratio = F.least(F.greatest(F.col("observed") / F.col("predicted"), F.lit(low)), F.lit(high))
    return timings.where("predicted > 0").groupBy("stage").agg(((F.sum(ratio) + prior) / (F.count("*") + prior)).alias("factor"))


def loglog_fit(points: DataFrame, y: str, x: str) -> DataFrame:
    """One row slope, intercept of ln y on ln x."""
    return points.agg(F.regr_slope(F.log(y), F.log(x)).alias("slope"), F.regr_intercept(F.log(y), F.log(x)).alias("intercept"))


def comparison_id(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with a content-addressed id of some columns."""
    return df.withColumn("id", F.sha2(F.to_json(F.struct(*columns)), 256))
