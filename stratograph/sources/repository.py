"""Repository scans: file trees, commit logs, diffs, manifests, language roots."""

from __future__ import annotations

import ast
import configparser
import json
import re
import subprocess
import tomllib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import importable, numbered

# Fixed values.
PYTHON_SKIP = ["__pycache__", ".git", "tests", "test", "templates", "vendor", "third_party", "migrations", "testdata", "node_modules"]
OTHER_SKIP = [
    "vendor", "node_modules", "dist", "testdata", "__tests__", "tests", "test", ".git", "docs", "documentation", "examples", "example",
    "third_party", "generated", "fixtures", "__pycache__",
]
RUST_SKIP = [*OTHER_SKIP, "target", "benches"]
ENDINGS = {
    "python": (r"\.py$", None, PYTHON_SKIP),
    "go": (r"\.go$", r"_test\.go$", OTHER_SKIP),
    "rust": (r"\.rs$", None, RUST_SKIP),
    "typescript": (r"\.tsx?$", r"\.d\.ts$|\.test\.|\.spec\.", OTHER_SKIP),
}
HISTORY = 4000
ALL_SOURCES_FILES, ALL_SOURCES_SHARE = 25, 0.05


def tree(spark: SparkSession, root: str, glob: str = "*.{py,go,rs,ts,tsx}") -> DataFrame:
    """(path, content) of the files under ``root``; the listing and the reads are Spark's."""
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(base)
    relative = F.regexp_replace(F.col("path"), "^.*?" + re.escape(base.split("://")[-1]) + "/", "")
    return raw.select(relative.alias("path"), F.decode("content", "UTF-8").alias("content"))


def is_source(path: Column, language: str, with_tests: bool = False) -> Column:
    """Whether a path is a source file of a language: its ending, and no skipped or hidden directory."""
    good, bad, skip = ENDINGS[language]
    if with_tests:
        skip = [s for s in skip if s not in ("tests", "test", "__tests__")]
    dirs = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    out = path.rlike(good) & ~F.exists(dirs, lambda s: s.isin(skip))
    if bad:
        out = out & ~path.rlike(bad)
    return out if language == "python" else out & ~F.exists(dirs, lambda s: s.startswith("."))


def source_files(paths: DataFrame, language: str, package: str = "", with_tests: bool = False) -> DataFrame:
    """(file_id, path): sources below ``package``, numbered in path order from 0."""
    below = paths.where(is_source(F.col("path"), language, with_tests))
    if package:
        below = below.where(F.col("path").startswith(package.rstrip("/") + "/"))
    return numbered(below.select("path"), "path").select(F.col("place").cast("long").alias("file_id"), "path")


def excluded_tests(paths: DataFrame, language: str) -> int:
    return source_files(paths, language, with_tests=True).select("path").exceptAll(source_files(paths, language).select("path")).count()


def detected_sources(paths: DataFrame) -> DataFrame:
    """(language, files, share, rank): languages by number of sources, then by name."""
    from pyspark.sql import Window

    names = F.array_compact(F.array(*[F.when(is_source(F.col("path"), k), F.lit(k)) for k in ENDINGS]))
    counts = paths.select(F.explode(names).alias("language")).groupBy("language").agg(F.count("*").alias("files"))
    share = F.col("files") / F.sum("files").over(Window.partitionBy())
    return counts.select("language", "files", share.alias("share"), F.row_number().over(Window.orderBy(F.desc("files"), "language")).alias("rank"))


def all_sources(paths: DataFrame) -> DataFrame:
    return detected_sources(paths).where((F.col("files") >= ALL_SOURCES_FILES) & (F.col("share") >= ALL_SOURCES_SHARE))


def _git(repo: str, *args: str) -> str:
    return subprocess.run(["git", "-C", repo, *args], check=True, capture_output=True, text=True).stdout


def parse_log(text: str) -> list[tuple]:
    """(commit_pos, sha, path) of a log whose commits start with ``@``."""
    rows, pos, sha = [], -1, None
    for line in text.splitlines():
        if line.startswith("@"):
            pos, sha = pos + 1, line[1:]
        elif line:
            rows.append((pos, sha, line))
    return rows


def commit_files(spark: SparkSession, repo: str, most: int = HISTORY, revision: str = "HEAD") -> DataFrame:
    """(commit_pos, sha, path) of the newest commits, merges left out, renames as they are."""
    text = _git(repo, "log", f"-n{most}", "--no-merges", "--pretty=format:@%H", "--name-only", "--no-renames", revision, "--")
    return spark.createDataFrame(parse_log(text), "commit_pos long, sha string, path string")


def kept_commit_files(log: DataFrame, files: DataFrame, renames: DataFrame | None = None) -> DataFrame:
    """The log on current files (path), old names (from_path) mapped to new ones (to_path)."""
    if renames is not None:
        log = log.join(renames.select(F.col("from_path").alias("path"), "to_path"), "path", "left").withColumn("path", F.coalesce("to_path", "path")).drop("to_path")
    return log.join(files.select("path"), "path", "left_semi").distinct()


def parse_changes(text: str) -> list[tuple]:
    """(status, from_path, to_path) of NUL-separated name-status records."""
    parts, rows, i = text.split("\0"), [], 0
    while i < len(parts) and parts[i]:
        kind = parts[i][0]
        if kind in "RC":
            rows.append(("renamed" if kind == "R" else "added", parts[i + 1] if kind == "R" else None, parts[i + 2]))
            i += 3
        else:
            path = parts[i + 1]
            rows.append({"A": ("added", None, path), "D": ("deleted", path, None)}.get(kind, ("modified", path, path)))
            i += 2
    return rows


def changes(spark: SparkSession, repo: str, base: str, head: str | None = None) -> DataFrame:
    """Changed files between two commits, or a commit and the working tree with its untracked files."""
    rows = parse_changes(_git(repo, "diff", "--name-status", "-M", "-z", base, *([head] if head else []), "--"))
    if head is None:
        rows += [("added", None, p) for p in _git(repo, "ls-files", "--others", "--exclude-standard", "-z").split("\0") if p]
    return spark.createDataFrame(rows, "status string, from_path string, to_path string")


# ---- manifests

DECLARED = "ecosystem string, file string, section string, name string, repo string, pin_kind string, pin_value string"
PROVIDED = "ecosystem string, name string, version string, file string"


def github_repo(url: str) -> str | None:
    """``owner/name`` in lower case of the forms in which manifests name a repository."""
    m = re.search(r"(?:^|://|://www\.|@)github\.com[/:]([\w.-]+)/([\w.-]+?)(?:\.git)?(?:[/#?@]|$)|^github:([\w.-]+)/([\w.-]+)", url.strip().removeprefix("git+"))
    if not m:
        return None
    owner, name = (m[1], m[2]) if m[1] else (m[3], m[4])
    return f"{owner}/{name}".lower()


def ref_pin(ref: str) -> tuple[str, str]:
    return ("rev", ref.lower()) if re.fullmatch(r"[0-9a-fA-F]{7,}", ref) else ("ref", ref)


def pep508(text: str) -> tuple | None:
    """(name, repo, pin_kind, pin_value) of a Python requirement."""
    m = re.match(r"\s*([A-Za-z0-9._-]+)\s*(?:\[[^\]]*\])?\s*(.*)$", text.strip(), re.S)
    if not m:
        return None
    name, rest = re.sub(r"[-_.]+", "-", m[1]).lower(), m[2].strip()
    if rest.startswith("@"):
        url = rest[1:].split(" ;")[0].strip()
        ref = re.search(r"@([^/#@]+)(?:#.*)?$", url.split("://", 1)[-1].partition("/")[2])
        kind, value = ref_pin(ref[1]) if ref and url.startswith("git+") else ("none", "")
        return name, github_repo(url), kind, value
    spec = rest.split(";")[0].strip().removeprefix("(").removesuffix(")").strip()
    return name, None, "version" if spec else "none", spec


def cargo_spec(key: str, spec) -> tuple:
    if isinstance(spec, str):
        return key, None, "version", spec
    name = spec.get("package", key)
    if "git" in spec:
        if "rev" in spec:
            pin = ref_pin(spec["rev"])
        else:
            pin = next(((k, spec[k]) for k in ("tag", "branch") if k in spec), ("none", ""))
        return name, github_repo(spec["git"]), *pin
    if "path" in spec:
        return name, None, "path", spec["path"]
    if spec.get("workspace"):
        return name, None, "workspace", ""
    return (name, None, "version", spec["version"]) if "version" in spec else (name, None, "none", "")


def npm_spec(name: str, spec: str) -> tuple:
    if spec.startswith("workspace:"):
        return name, None, "workspace", spec[10:]
    if re.match(r"(file|link|portal):", spec):
        return name, None, "path", spec.split(":", 1)[1]
    if repo := github_repo(spec) or (spec.lower() if re.fullmatch(r"[\w.-]+/[\w.-]+(#.*)?", spec) else None):
        ref = spec.partition("#")[2]
        return name, repo.partition("#")[0], *(ref_pin(ref) if ref else ("none", ""))
    return (name, None, "version", spec) if spec not in ("", "*", "latest") else (name, None, "none", "")


def setup_rows(path: str, text: str, ini: bool) -> tuple[list[tuple], list[tuple]]:
    """The same of a ``setup.cfg``, or of the literal arguments of a ``setup.py``, which is read and never run."""
    if ini:
        data = configparser.ConfigParser(interpolation=None)
        try:
            data.read_string(text)
        except configparser.Error as e:
            raise ValueError(f"unreadable manifest {path}") from e
        name, version = data.get("metadata", "name", fallback=None), data.get("metadata", "version", fallback=None)
        needs = data.get("options", "install_requires", fallback="").splitlines()
    else:
        try:
            calls = [n for n in ast.walk(ast.parse(text)) if isinstance(n, ast.Call) and getattr(n.func, "id", getattr(n.func, "attr", "")) == "setup"]
        except SyntaxError as e:
            raise ValueError(f"unreadable manifest {path}") from e
        given = {k.arg: k.value for c in calls for k in c.keywords}
        plain = lambda v: v.value if isinstance(v, ast.Constant) and isinstance(v.value, str) else None
        name, version = plain(given.get("name")), plain(given.get("version"))
        listed = given.get("install_requires")
        needs = [plain(e) or "" for e in listed.elts] if isinstance(listed, (ast.List, ast.Tuple)) else []
    provided = [("pypi", re.sub(r"[-_.]+", "-", name).lower(), version, path)] if name else []
    return provided, [("pypi", path, "install_requires", *p) for p in map(pep508, (n.strip() for n in needs if n.strip())) if p]


def manifest_rows(path: str, text: str) -> tuple[list[tuple], list[tuple]]:
    """(provided, declared) rows of one manifest; unreadable text raises ValueError."""
    base, provided, declared = path.rsplit("/", 1)[-1], [], []
    try:
        if base == "Cargo.toml":
            doc = tomllib.loads(text)
            if "package" in doc:
                version = doc["package"].get("version")
                provided.append(("cargo", doc["package"]["name"], version if isinstance(version, str) else None, path))
            for section in ("dependencies", "dev-dependencies", "build-dependencies"):
                declared += [("cargo", path, section, *cargo_spec(k, v)) for k, v in sorted(doc.get(section, {}).items())]
        elif base == "package.json":
            doc = json.loads(text)
            if doc.get("name"):
                provided.append(("npm", doc["name"], doc.get("version"), path))
            for section in ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies"):
                declared += [("npm", path, section, *npm_spec(k, v)) for k, v in sorted(doc.get(section, {}).items())]
        elif base == "go.mod":
            if m := re.search(r"^module\s+(\S+)", text, re.M):
                provided.append(("go", m[1], None, path))
            lines = [x for block in re.findall(r"^require\s*\(([^)]*)\)", text, re.M | re.S) for x in block.splitlines()] + re.findall(r"^require\s+(\S+\s+\S+)", text, re.M)
            for x in lines:
                if m := re.match(r"\s*(\S+)\s+(v\S+)", x.split("//")[0]):
                    declared.append(("go", path, "require", m[1], github_repo("https://" + m[1]), "version", m[2]))
        elif base == "pyproject.toml":
            project = tomllib.loads(text).get("project", {})
            if "name" in project:
                provided.append(("pypi", re.sub(r"[-_.]+", "-", project["name"]).lower(), project.get("version"), path))
            groups = {"dependencies": project.get("dependencies", []), **{f"optional.{k}": v for k, v in project.get("optional-dependencies", {}).items()}}
            for section, items in groups.items():
                declared += [("pypi", path, section, *p) for p in map(pep508, items) if p]
        elif base in ("setup.py", "setup.cfg"):
            p, d = setup_rows(path, text, base == "setup.cfg")
            provided, declared = provided + p, declared + d
        elif base.startswith("requirements") and base.endswith(".txt"):
            for line in text.splitlines():
                line = line.split(" #")[0].strip()
                if m := re.match(r"(?:-e|--editable)\s+(\S+)", line):
                    declared.append(("pypi", path, "requirements", m[1], github_repo(m[1]), "path", m[1]))
                elif line and line[0] not in "#-" and (p := pep508(line)):
                    declared.append(("pypi", path, "requirements", *p))
    except (tomllib.TOMLDecodeError, json.JSONDecodeError, KeyError, AttributeError) as e:
        raise ValueError(f"unreadable manifest {path}") from e
    return provided, declared


def manifests(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(provided, declared, unreadable) of manifest files (path, content), read on the executors."""
    import pandas as pd

    importable(files.sparkSession)

    def read(frames):
        for frame in frames:
            rows = []
            for path, text in frame.itertuples(index=False):
                try:
                    p, d = manifest_rows(path, text)
                    rows += [("provided", json.dumps(x)) for x in p] + [("declared", json.dumps(x)) for x in d]
                except ValueError:
                    rows.append(("unreadable", json.dumps([path])))
            yield pd.DataFrame(rows, columns=["kind", "row"])

    rows = files.select("path", "content").mapInPandas(read, "kind string, row string").distinct()

    def part(kind, schema):
        names = [x.strip().split(" ")[0] for x in schema.split(",")]
        array = F.from_json("row", "array<string>")
        return rows.where(F.col("kind") == kind).select(array.alias("a")).select(*[F.col("a")[i].alias(n) for i, n in enumerate(names)])

    return part("provided", PROVIDED), part("declared", DECLARED), part("unreadable", "path string")
