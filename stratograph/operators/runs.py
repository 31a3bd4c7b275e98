"""Runs of jobs: execution, checks before publication, refresh, replay of timelines, the registry and its schemas."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = "job string, seq long, stage string, state string, detail string"


class Refused(Exception):
    """A result that must not be published, or an operation that a policy does not allow."""


def execute(spark: SparkSession, stages: list[tuple[str, Callable[[], object]]], cancelled: Callable[[], bool] = lambda: False) -> tuple[str, list[tuple]]:
    """(job, events): stages one after the other under a Spark job group of their own; the first that fails ends the run,
    and once ``cancelled`` says so no further stage begins and the group's jobs are cancelled."""
    job, events, context = uuid.uuid4().hex, [], spark.sparkContext
    tell = lambda stage, state, detail="": events.append((job, len(events), stage, state, detail))
    context.setJobGroup(job, "build", interruptOnCancel=True)
    try:
        for name, stage in stages:
            if cancelled():
                context.cancelJobGroup(job)
                tell(name, "cancelled")
                break
            tell(name, "running")
            try:
                stage()
            except Exception as e:  # the worker reports what failed, and the run ends
                tell(name, "failed", str(e)[:500])
                break
            tell(name, "done")
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    return job, events


def event_table(spark: SparkSession, events: list[tuple]) -> DataFrame:
    return spark.createDataFrame(events, EVENTS)


def result_problems(reported: DataFrame, found: DataFrame, keys: list[str], counts: list[str]) -> DataFrame:
    """(keys, problem): ``missing`` and ``unexpected`` artifacts, and ``count`` where a reported number is not the found one."""
    left = reported.select(*keys, *[F.col(c).alias(f"r_{c}") for c in counts], F.lit(True).alias("in_r"))
    right = found.select(*keys, *[F.col(c).alias(f"f_{c}") for c in counts], F.lit(True).alias("in_f"))
    both = left.join(right, keys, "full_outer")
    differ = F.lit(False)
    for c in counts:
        differ = differ | ~F.col(f"r_{c}").eqNullSafe(F.col(f"f_{c}"))
    problem = F.when(F.col("in_f").isNull(), "missing").when(F.col("in_r").isNull(), "unexpected").when(differ, "count")
    return both.select(*keys, problem.alias("problem")).where("problem is not null")


def adopt(reported: DataFrame, found: DataFrame, keys: list[str], counts: list[str], publish: Callable[[], object]) -> None:
    """Publish a result whose artifacts are the reported ones."""
    bad = result_problems(reported, found, keys, counts).limit(5).collect()
    if bad:
        raise Refused(", ".join(f"{[r[k] for k in keys]}: {r['problem']}" for r in bad))
    publish()


def refresh(snapshots: DataFrame, repo: str, commit: str, selection: str, build: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """(the snapshot, whether it was built): one of an equal commit and selection is used again."""
    same = snapshots.where((F.col("repo") == repo) & (F.col("commit_sha") == commit) & (F.col("selection") == selection))
    if same.limit(1).count():
        return same.orderBy(F.desc("sequence")).limit(1), False
    last = snapshots.where(F.col("repo") == repo).agg(F.max("sequence")).first()[0] or 0
    head = [F.lit(v).alias(k) for k, v in (("repo", repo), ("commit_sha", commit), ("selection", selection))]
    return build().select(*head, F.lit(last + 1).cast("long").alias("sequence"), "*"), True


def replayed(events: DataFrame, predicted: DataFrame) -> DataFrame:
    """(job, seq, elapsed, estimate, remaining, error): at the start of every stage of a recorded timeline, how long the
    rest was predicted to take and how long it took.

    ``events``: job, seq, stage, at (seconds); the last event of a job is its end.  ``predicted``: stage, seconds.
    """
    own = Window.partitionBy("job").orderBy("seq")
    rest = own.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy("job")
    rows = events.join(predicted, "stage", "left").withColumn("seconds", F.coalesce("seconds", F.lit(0.0)))
    rows = rows.select(
        "job", "seq", (F.col("at") - F.min("at").over(whole)).alias("elapsed"), F.sum("seconds").over(rest).alias("estimate"),
        (F.max("at").over(whole) - F.col("at")).alias("remaining"), F.max("seq").over(whole).alias("last"),
    )
    return rows.where("seq < last").select("job", "seq", "elapsed", "estimate", "remaining", (F.col("estimate") - F.col("remaining")).alias("error"))


# ---- the registry

#: References between tables: (table, column) points at (table, column), and goes with it.
Cascade = list[tuple[str, str, str, str]]


def removed(tables: dict[str, DataFrame], table: str, gone: DataFrame, key: str, cascade: Cascade) -> dict[str, DataFrame]:
    """The tables without some rows (``key``) of one of them, and without what points at those, all the way down."""
    out, todo = dict(tables), [(table, key, gone.select(key).distinct())]
    while todo:
        name, column, keys = todo.pop()
        lost = out[name].join(keys, column, "left_semi")
        out[name] = out[name].join(keys, column, "left_anti")
        for child, at, parent, of in cascade:
            if parent == name:
                todo.append((child, at, lost.select(F.col(of).alias(at)).distinct()))
    return out


def registered(repositories: DataFrame, row: DataFrame) -> DataFrame:
    """The registry with a repository (slug, ...) added, or in place of the old one of its slug."""
    return repositories.join(row, "slug", "left_anti").unionByName(row)


#: Columns of the catalogue's tables, by the version that brought them.
MIGRATIONS: list[tuple[int, str, str, T.DataType, object]] = [
    (1, "maps", "slug", T.StringType(), None), (1, "maps", "commit_sha", T.StringType(), None), (1, "maps", "indexed_at", T.TimestampType(), None),
    (2, "district_names", "key", T.StringType(), None), (2, "district_names", "name", T.StringType(), None),
    (3, "job_timings", "job_id", T.StringType(), None), (3, "job_timings", "stage", T.StringType(), None), (3, "job_timings", "seconds", T.DoubleType(), None),
    (4, "jobs", "job_id", T.StringType(), None), (4, "jobs", "state", T.StringType(), "queued"), (4, "jobs", "epoch", T.LongType(), 0), (4, "jobs", "spec_json", T.StringType(), "{}"),
    (5, "repositories", "slug", T.StringType(), None), (5, "repositories", "path", T.StringType(), None),
    (6, "personal_snapshots", "repo", T.StringType(), None), (6, "personal_snapshots", "commit_sha", T.StringType(), None), (6, "personal_snapshots", "sequence", T.LongType(), None),
    (7, "personal_attempts", "repository", T.StringType(), None), (7, "personal_attempts", "attempt", T.StringType(), None), (7, "personal_attempts", "state", T.StringType(), None),
    (8, "maps", "branch", T.StringType(), None), (9, "personal_snapshots", "selection", T.StringType(), "auto"),
]
VERSION = max(m[0] for m in MIGRATIONS)


def schema(table: str, version: int = VERSION) -> T.StructType:
    """The columns of a table at a version."""
    return T.StructType([T.StructField(c, kind) for v, t, c, kind, _ in MIGRATIONS if t == table and v <= version])


def migrated(df: DataFrame, table: str, since: int) -> DataFrame:
    """A table of version ``since`` with the columns that came after, filled with their defaults; never backward."""
    if since > VERSION:
        raise ValueError(f"version {since} is later than {VERSION}")
    new = [(c, kind, value) for v, t, c, kind, value in MIGRATIONS if t == table and v > since]
    return df.withColumns({c: F.lit(value).cast(kind) for c, kind, value in new if c not in df.columns}) if new else df


# ---- access


class Policy:
    """What may be done: an operation is allowed if any rule allows it and none denies it; without rules all is."""

    def __init__(self, allow: list[str] | None = None, deny: list[str] = ()):
        self.allow, self.deny = allow, list(deny)

    def enforce(self, operation: str, action: Callable[[], object]):
        if operation in self.deny or self.allow is not None and operation not in self.allow:
            raise Refused(f"{operation} is not allowed")
        return action()


def allowed(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """Requests (principal, operation) with ``allowed``: some rule (principal, operation, allow) allows it, none denies."""
    met = rules.groupBy("principal", "operation").agg(F.bool_and("allow").alias("ok"))
    ok: Column = F.coalesce("ok", F.lit(False))
    return requests.join(met, ["principal", "operation"], "left").withColumn("allowed", ok).drop("ok")
