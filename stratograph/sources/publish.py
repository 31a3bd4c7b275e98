"""What a build publishes beside the map, and what it reads back: caches, dumps, reports, comparisons, commits."""

from __future__ import annotations

import json
import os
import re
import subprocess
import tomllib
from dataclasses import asdict, dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import round_even
from ..operators.blend import blend, prune_node_relative, signal_masses
from ..operators.signals import SHARES

SOURCE_LIMIT = 1 << 20


def members_key(path: Column) -> Column:
    """Cache key of a group's member paths, as an aggregate: 12 hex digits of the digest of the sorted paths."""
    return F.substring(F.sha1(F.array_join(F.array_sort(F.collect_list(path)), "\n").cast("binary")), 1, 12)


def name_cache(files: DataFrame, names: DataFrame) -> DataFrame:
    """(key, district, name): the names to store for files (path, district)."""
    return files.groupBy("district").agg(members_key(F.col("path")).alias("key")).join(names, "district").select("key", "district", "name")


def cached_names(files: DataFrame, cache: DataFrame) -> DataFrame:
    """(district, name) of the districts whose members the cache (key, name) knows; the first name of a key counts."""
    keys = files.groupBy("district").agg(members_key(F.col("path")).alias("key"))
    return keys.join(cache.groupBy("key").agg(F.min("name").alias("name")), "key").select("district", "name")


def graph_dump(files: DataFrame, edges: DataFrame, optional: list[str] = ()) -> DataFrame:
    """(line): edges (a, b, weight, ...) as JSON with paths for ids; optional columns are left out where they are null."""
    at = lambda end: files.select(F.col("file_id").alias(end), F.col("path").alias(f"p_{end}"))
    rows = edges.join(at("a"), "a").join(at("b"), "b")
    return rows.select(F.to_json(F.struct(F.col("p_a").alias("a"), F.col("p_b").alias("b"), "weight", *optional), {"ignoreNullFields": "true"}).alias("line"))


def blend_dump(candidates: DataFrame, floor: float = 0.02) -> DataFrame:
    """One row: the signals' masses, how many candidates there are, how many are kept, the share under the floor, and the
    largest and the summed weight after the blend."""
    blended = blend(candidates)
    masses = signal_masses(candidates).select(*[round_even(F.col(f"mass_{c}"), 10).alias(f"mass_{c}") for c in SHARES])
    counts = blended.agg(
        F.count("*").alias("candidates"), round_even(F.count_if(F.col("weight") < floor) / F.count("*"), 10).alias("below_floor"),
        round_even(F.max("weight"), 9).alias("largest"), round_even(F.sum("weight"), 6).alias("summed"),
    )
    kept = prune_node_relative(blended).agg(F.count("*").alias("kept"))
    return masses.crossJoin(counts).crossJoin(kept)


def publish_once(df: DataFrame, folder: str, inputs: list[str]) -> str:
    """Write one row's comparison under the digest of its ``inputs`` columns; what is there already stays.  The path."""
    row = df.select(F.sha2(F.to_json(F.struct(*inputs)), 256).alias("id")).first()
    path = f"{folder.rstrip('/')}/{row['id']}"
    df.coalesce(1).write.mode("ignore").json(path)
    return path


def append_extractions(rows: DataFrame, path: str) -> None:
    """Add (context, path, digest, payload) to the extraction cache, with the payload's own digest, one folder a context."""
    rows.withColumn("payload_digest", F.sha2(F.col("payload").cast("binary"), 256)).write.mode("append").partitionBy("context").parquet(path)


def extractions(spark: SparkSession, path: str, context: str) -> DataFrame:
    """The cache's sound rows of one context: a payload that does not have its digest is left out, as if it were a miss."""
    try:
        rows = spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "context string, path string, digest string, payload string")
    sound = F.sha2(F.col("payload").cast("binary"), 256) == F.col("payload_digest")
    return rows.where((F.col("context") == context) & sound).select("context", "path", "digest", "payload").dropDuplicates(["path", "digest"])


def load_symbols(spark: SparkSession, path: str, compact: DataFrame) -> DataFrame:
    """The symbols written beside a map; the map's own compact table where there are none."""
    try:
        return spark.read.json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return compact


def band_summary(rows: DataFrame, band: str, columns: list[str]) -> DataFrame:
    """(band, metric, median, p10, p90) of some columns of a corpus table."""
    long = rows.select(band, F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("x")) for c in columns])).alias("m"))
    at = lambda p: round_even(F.percentile("m.x", F.lit(p)), 4)
    return long.groupBy(band, F.col("m.metric").alias("metric")).agg(at(0.5).alias("median"), at(0.1).alias("p10"), at(0.9).alias("p90"))


def summary_markdown(summary: DataFrame, band: str) -> str:
    """The summary as a table: a row for each metric, a column for each band.  A handful of rows."""
    rows = summary.collect()
    bands, metrics = sorted({str(r[band]) for r in rows}), sorted({r["metric"] for r in rows})
    cell = {(r["metric"], str(r[band])): f"{r['median']:g} [{r['p10']:g}-{r['p90']:g}]" for r in rows}
    lines = ["| metric | " + " | ".join(bands) + " |", "| --- |" + " --- |" * len(bands)]
    return "\n".join([*lines, *("| " + " | ".join([m, *(cell.get((m, b), "") for b in bands)]) + " |" for m in metrics)]) + "\n"


# ---- commits and checkouts


def _git(repo: str, *args: str) -> bytes:
    return subprocess.run(["git", "-C", repo, *args], check=True, capture_output=True).stdout


def blob(repo: str, commit: str, path: str, limit: int = SOURCE_LIMIT) -> str:
    """One file at a full commit; paths that leave the tree and files over the limit are refused."""
    if not re.fullmatch(r"[0-9a-f]{40}|[0-9a-f]{64}", commit):
        raise ValueError("not a full commit id")
    if not path or path.startswith("/") or "\0" in path or any(p in ("", ".", "..") for p in path.split("/")):
        raise ValueError("not a path inside the repository")
    size = int(_git(repo, "cat-file", "-s", f"{commit}:{path}"))
    if size > limit:
        raise ValueError(f"{path} has {size} bytes, over {limit}")
    return _git(repo, "cat-file", "blob", f"{commit}:{path}").decode("utf-8", "replace")


def checkouts(folder: str) -> list[str]:
    """Repositories below a folder, in order; links are not followed, and nothing inside a repository is looked at."""
    found = []
    for at, dirs, files in os.walk(folder):
        if ".git" in dirs or ".git" in files:
            found.append(at)
            dirs[:] = []
        dirs[:] = sorted(d for d in dirs if not d.startswith(".") and not os.path.islink(os.path.join(at, d)))
    return sorted(found)


class Worktree:
    """A commit of a local repository in a folder of its own, for as long as the block lasts."""

    def __init__(self, repo: str, commit: str, folder: str):
        self.repo, self.commit, self.folder = repo, commit, folder

    def __enter__(self) -> str:
        _git(self.repo, "worktree", "add", "--detach", self.folder, self.commit)
        return self.folder

    def __exit__(self, *_) -> None:
        _git(self.repo, "worktree", "remove", "--force", self.folder)


def organization(text: str) -> dict:
    """An organization's manifest: version, name and members (repo, commit, path); repositories once, commits whole."""
    data = tomllib.loads(text)
    members = data.get("members") or []
    if data.get("version") != 1 or not isinstance(data.get("name"), str):
        raise ValueError("version 1 and a name are needed")
    repos = [m.get("repo") for m in members]
    if not all(isinstance(r, str) and re.fullmatch(r"[\w.-]+/[\w.-]+", r) for r in repos) or len({r.lower() for r in repos}) != len(repos):
        raise ValueError("members need a repo each, once")
    if not all(re.fullmatch(r"[0-9a-f]{40}", str(m.get("commit"))) for m in members):
        raise ValueError("members need full commit ids")
    return {"name": data["name"], "members": [(m["repo"], m["commit"], m.get("path")) for m in members]}


def member_table(spark: SparkSession, text: str) -> DataFrame:
    """(repo, commit, path) of a manifest's members."""
    return spark.createDataFrame(organization(text)["members"], "repo string, commit string, path string")


def organization_document(name: str, members: DataFrame, edges: DataFrame) -> str:
    """The composed organization as indented JSON, in order; one row for each repository and pair."""
    rows = lambda df, *order: [json.loads(r["j"]) for r in df.orderBy(*order).select(F.to_json(F.struct("*")).alias("j")).collect()]
    return json.dumps({"name": name, "members": rows(members, "repo"), "edges": rows(edges, "source", "target")}, indent=2) + "\n"


# ---- jobs


@dataclass
class Job:
    """A build as it is handed to a worker, one JSON object."""

    repo: str
    commit: str
    sources: list[tuple[str, str]] = field(default_factory=list)
    resolution: float = 1.1
    prune: str = "node-relative"

    @classmethod
    def read(cls, text: str) -> Job:
        data = json.loads(text)
        unknown = set(data) - set(cls.__dataclass_fields__)
        if unknown or not {"repo", "commit"} <= set(data):
            raise ValueError(f"not a job: {sorted(unknown) or 'repo and commit are needed'}")
        return cls(**{**data, "sources": [tuple(s) for s in data.get("sources", [])]})

    def text(self) -> str:
        return json.dumps(asdict(self))
