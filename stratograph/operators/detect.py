"""Source roots, manifest facts and entry points of a repository: manifests become one table of facts, and every rule is
a join of that table with the files."""

from __future__ import annotations

import posixpath
import re
import tomllib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import export_targets, jsonc, workspace_regex
from ..sources.repository import ENDINGS, is_source
from .imports import BUILD_FOLDERS
from .resolve import longest_prefix

FACTS = "kind string, folder string, name string, value string, pos int"
MANIFESTS = r"(^|/)(go\.mod|Cargo\.toml|package\.json|pyproject\.toml|setup\.py|setup\.cfg|pnpm-workspace\.yaml|tsconfig[^/]*\.json|index\.html|build\.m?js|[^/]*\.config\.[cm]?[jt]s)$"


def facts_of(path: str, text: str) -> list[tuple]:
    """(kind, folder, name, value, pos) that one manifest states; none where it cannot be read."""
    folder, base = posixpath.split(path)
    rows: list[tuple] = []
    put = lambda kind, name="", value="": rows.append((kind, folder, name, value, len(rows)))
    if base == "go.mod":
        if m := re.search(r'^\s*module\s+"?([^\s"]+)', text, re.M):
            put("go_module", m[1])
    elif base == "pnpm-workspace.yaml":
        for m in re.finditer(r"^\s*-\s*['\"]?([^'\"#\s]+)", text, re.M):
            put("workspace", "pnpm", m[1])
    elif base in ("Cargo.toml", "pyproject.toml"):
        try:
            data = tomllib.loads(text)
        except tomllib.TOMLDecodeError:
            return []
        _cargo(put, data) if base == "Cargo.toml" else _pyproject(put, data)
    elif base in ("setup.py", "setup.cfg"):
        if m := re.search(r"""^\s*name\s*=\s*['"]?([\w.-]+)""", text, re.M):
            put("python_project", m[1])
        if m := re.search(r"""where\s*=\s*['"]?([\w./-]+)|package_dir\s*=\s*\{\s*['"]{2}\s*:\s*['"]([\w./-]+)""", text):
            put("python_where", value=m[1] or m[2])
    elif base == "package.json":
        data = jsonc(text)
        if isinstance(data, dict):
            _package(put, data)
    elif base.startswith("tsconfig"):
        data = jsonc(text)
        options = data.get("compilerOptions") if isinstance(data, dict) else None
        put("tsconfig", base)
        for key, targets in ((options or {}).get("paths") or {}).items():
            for t in targets if isinstance(targets, list) else []:
                if isinstance(t, str) and key.count("*") <= 1:
                    put("alias", key.split("*")[0], posixpath.normpath(posixpath.join(folder, options.get("baseUrl") or ".", t.split("*")[0] or ".")) + ("/" if "*" in t else ""))
    elif base == "index.html":
        for m in re.finditer(r"""<script\b(?=[^>]*\btype=["']module["'])[^>]*\bsrc=["']/?([^"']+)["']""", text):
            put("entry", "vite", m[1])
    else:
        for m in re.finditer(r"entryPoints\s*:\s*\[([^\]]*)\]", text):
            for e in re.finditer(r"""["']([^"']+)["']""", m[1]):
                put("entry", "build", e[1])
    return rows


def _cargo(put, data: dict) -> None:
    package, lib = data.get("package") or {}, data.get("lib") or {}
    if package.get("name"):
        name = str(package["name"])
        put("crate", name)
        put("crate_root", f"{name}:lib", lib.get("path", "src/lib.rs"))
        put("crate_root", f"{name}:bin", "src/main.rs")
        for b in data.get("bin") or []:
            put("crate_root", f"{name}:bin", b.get("path") or f"src/bin/{b.get('name')}.rs")
        if package.get("build") is not False:
            put("crate_root", f"{name}:build", package.get("build") if isinstance(package.get("build"), str) else "build.rs")
    for m in (data.get("workspace") or {}).get("members") or []:
        put("workspace", "cargo", m)


def _pyproject(put, data: dict) -> None:
    name = (data.get("project") or {}).get("name") or ((data.get("tool") or {}).get("poetry") or {}).get("name")
    if name:
        put("python_project", str(name))
    find = (((data.get("tool") or {}).get("setuptools") or {}).get("packages") or {})
    for where in (find.get("find") or {}).get("where") or [] if isinstance(find, dict) else []:
        put("python_where", value=where)


def _package(put, data: dict) -> None:
    put("package", str(data.get("name") or ""))
    stated = [*export_targets(data["exports"])] if data.get("exports") is not None else []
    stated += [data[k] for k in ("source", "module", "main", "types") if isinstance(data.get(k), str)]
    for e in dict.fromkeys(stated):
        put("package_entry", str(data.get("name") or ""), posixpath.normpath(e))
    bins = data.get("bin")
    for e in [bins] if isinstance(bins, str) else (bins or {}).values() if isinstance(bins, dict) else []:
        put("entry", "bin", e)
    for e in dict.fromkeys(stated):
        put("entry", "package", e)
    spaces = data.get("workspaces")
    for w in spaces.get("packages", []) if isinstance(spaces, dict) else spaces or []:
        put("workspace", "npm", w)


def manifest_facts(files: DataFrame) -> DataFrame:
    """Facts of all manifests among files (path, content)."""

    def run(parts):
        for part in parts:
            rows = [r for p, c in zip(part["path"], part["content"]) for r in facts_of(p, c or "")]
            yield pd.DataFrame(rows, columns=["kind", "folder", "name", "value", "pos"])

    return files.where(F.col("path").rlike(MANIFESTS)).select("path", "content").mapInPandas(run, FACTS)


def in_folder(folder: str, path: str):
    """The column ``path`` below the column ``folder``, without ``./``."""
    p = F.regexp_replace(path, r"^(\./)+", "")
    return F.when(F.col(folder) == "", p).otherwise(F.concat_ws("/", folder, p))


def root_candidates(facts: DataFrame, files: DataFrame) -> DataFrame:
    """(language, pkg, files, confidence, evidence, rank): of every language with sources its root.

    A manifest in the repository's root gives ``.`` and high confidence.  Otherwise the outermost folder with one that has
    the most files, then the first by name, counts: high where there is one such folder (medium for TypeScript), else
    medium.  Without any, ``.`` and low.  A Python project's root is its declared package, below the folders it names.
    """
    names = F.array_compact(F.array(*[F.when(is_source(F.col("path"), k), F.lit(k)) for k in ENDINGS]))
    sources = files.select("path", F.explode(names).alias("language"))
    total = sources.groupBy("language").agg(F.count("*").alias("files"))
    kinds = F.when(F.col("kind") == "go_module", "go").when(F.col("kind") == "crate", "rust").when(F.col("kind") == "package", "typescript")
    roots = facts.select(kinds.alias("language"), "folder").where("language is not null")
    both = facts.where("kind = 'tsconfig'").select("folder").distinct()
    roots = roots.join(both.withColumn("ts", F.lit(True)), "folder", "left").where("language <> 'typescript' or ts").select("language", "folder").distinct()
    roots = roots.unionByName(python_packages(facts, files).select(F.lit("python").alias("language"), F.col("package").alias("folder")))
    # folders below another root of the language belong to it
    keyed = lambda c: F.concat_ws("/", F.lit("."), "language", F.when(F.col(c) != "", F.col(c)))
    tops = roots.withColumn("key", keyed("folder"))
    upper = tops.withColumn("above", F.regexp_replace("key", r"/[^/]*$", ""))
    inner = longest_prefix(upper, "above", tops.select(F.col("key").alias("root")), "root").where("root is null").select("language", "folder", "key")
    held = longest_prefix(sources.withColumn("at", keyed("path")), "at", inner.select("key"), "key").where("key is not null")
    counts = held.groupBy("key").agg(F.count("*").alias("n"))
    many = Window.partitionBy("language")
    ranked = inner.join(counts, "key").withColumns({"rn": F.row_number().over(many.orderBy(F.desc("n"), "folder")), "roots": F.count("*").over(many)})
    best = ranked.where("rn = 1").select("language", "folder", "roots", "n")
    out = total.join(best, "language", "left")
    sure = F.when(F.col("folder").isNull(), "low").when((F.col("folder") != "") & ((F.col("roots") > 1) | (F.col("language") == "typescript")), "medium").otherwise("high")
    why = F.when(F.col("folder").isNull(), "no manifest").when(F.col("folder") == "", "manifest in the root").otherwise(F.concat(F.col("roots").cast("string"), F.lit(" roots")))
    pkg = F.when(F.coalesce("folder", F.lit("")) == "", ".").otherwise(F.col("folder"))
    count = F.coalesce("n", "files")
    return out.select(
        "language", pkg.alias("pkg"), count.alias("files"), sure.alias("confidence"), why.alias("evidence"),
        F.row_number().over(Window.orderBy(F.desc(count), "language", pkg)).cast("int").alias("rank"),
    )


def python_packages(facts: DataFrame, files: DataFrame) -> DataFrame:
    """(project folder, package): the folder of a declared project that carries its name (``-`` and ``.`` as ``_``) and an
    ``__init__.py``, below the folders that the project names, ``src`` or its own."""
    named = facts.where("kind = 'python_project'").select("folder", F.regexp_replace(F.lower("name"), r"[-_.]+", "_").alias("wanted")).distinct()
    where = facts.where("kind = 'python_where'").select("folder", F.col("value").alias("sub"), F.lit(0).alias("order"))
    usual = named.select("folder").distinct().withColumn("u", F.explode(F.array(F.struct(F.lit("src").alias("sub"), F.lit(1).alias("order")), F.struct(F.lit(".").alias("sub"), F.lit(2).alias("order")))))
    bases = where.unionByName(usual.select("folder", "u.sub", "u.order"))
    inits = files.where(F.col("path").rlike(r"(^|/)__init__\.py$")).select(F.regexp_replace("path", r"/?__init__\.py$", "").alias("package"))
    inits = inits.where("package <> ''").select(
        "package", F.regexp_replace("package", r"/?[^/]*$", "").alias("base"), F.regexp_replace(F.lower(F.element_at(F.split("package", "/"), -1)), r"[-_.]+", "_").alias("wanted")
    )
    sub = F.when(F.col("sub").isin(".", ""), F.lit(None)).otherwise(F.regexp_replace("sub", r"^(\./)+|/+$", ""))
    at = bases.withColumn("base", F.concat_ws("/", F.when(F.col("folder") != "", F.col("folder")), sub)).join(named, "folder")
    met = at.join(inits, ["base", "wanted"])
    first = Window.partitionBy("folder").orderBy("order", "package")
    return met.withColumn("rn", F.row_number().over(first)).where("rn = 1").select("folder", "package")


def workspace_folders(facts: DataFrame) -> DataFrame:
    """(folder, name): packages that a workspace of the repository's root takes in; its own patterns with ``!`` leave out."""
    patterns = facts.where("kind = 'workspace' and folder = ''").select("name", "value").distinct().collect()  # written by hand in one manifest
    packages = facts.where("kind in ('package', 'crate')").select("folder", "name").distinct()
    regexes = lambda out: [workspace_regex(p["value"].lstrip("!")) for p in patterns if p["value"].startswith("!") == out]
    hit = lambda ps: F.lit(False) if not ps else F.col("folder").rlike("|".join(ps))
    return packages.where(hit(regexes(False)) & ~hit(regexes(True)))


def config_entries(facts: DataFrame, files: DataFrame) -> DataFrame:
    """Files (path) that literal entry points of build configurations name."""
    stated = facts.where("kind = 'entry' and name = 'build'").select(in_folder("folder", "value").alias("path"))
    return stated.distinct().join(files.select("path"), "path")


def entry_points(facts: DataFrame, files: DataFrame) -> DataFrame:
    """(path, reason): files that something outside imports or runs.

    Crate binaries and libraries, ``src/main.rs`` and ``src/bin``; what a package's manifest states, or the one source of
    the same stem where that is a built file; module scripts of an ``index.html``; Go files of ``package main`` with a
    ``func main``.  ``files``: path, content.
    """
    paths = files.select("path")
    rust = facts.where("kind = 'crate_root'").select(in_folder("folder", "value").alias("path"), F.concat(F.lit("cargo "), F.split("name", ":")[1]).alias("reason"))
    bins = paths.where(F.col("path").rlike(r"(^|/)src/bin/[^/]+\.rs$")).select("path", F.lit("cargo bin").alias("reason"))
    stated = facts.where("kind = 'entry' and name <> 'build'").withColumn("target", in_folder("folder", "value"))
    direct = stated.select(F.col("target").alias("path"), F.concat(F.lit("manifest "), "name").alias("reason"))
    # a built file: the one source below the package with its stem
    stem = F.regexp_extract("target", r"([^/]+?)(?:\.d)?\.[cm]?[jt]sx?$", 1)
    built = stated.where(F.regexp_replace("value", r"^(\./)+", "").rlike(rf"^({'|'.join(BUILD_FOLDERS)})/")).select("folder", stem.alias("stem"), "name").distinct()
    sources = paths.where(F.col("path").rlike(r"(^|/)src/.*\.tsx?$") & ~F.col("path").rlike(r"\.d\.ts$"))
    sources = sources.select("path", F.regexp_extract("path", r"^(?:(.*?)/)?src/", 1).alias("folder"), F.regexp_extract("path", r"([^/]+)\.tsx?$", 1).alias("stem"))
    alone = sources.groupBy("folder", "stem").agg(F.min("path").alias("path"), F.count("*").alias("n")).where("n = 1")
    mirrored = built.join(alone, ["folder", "stem"]).select("path", F.concat(F.lit("manifest "), "name", F.lit(" by its stem")).alias("reason"))
    go = files.where(F.col("path").endswith(".go") & F.col("content").rlike(r"(?m)^package main\b") & F.col("content").rlike(r"(?m)^func main\(\)"))
    found = rust.unionByName(bins).unionByName(direct).unionByName(mirrored).unionByName(go.select("path", F.lit("go main").alias("reason")))
    return found.join(paths, "path").groupBy("path").agg(F.min("reason").alias("reason"))


def go_imports(imports: DataFrame, facts: DataFrame, files: DataFrame) -> DataFrame:
    """(src, specifier, folder): the folder of an imported Go package: the longest module that is a ``/``-bounded prefix
    gives its folder, and the rest of the specifier goes below it."""
    modules = facts.where("kind = 'go_module'").select(F.col("name").alias("root"), F.col("folder").alias("at")).dropDuplicates(["root"])
    met = longest_prefix(imports, "specifier", modules, "root").where("root is not null").join(modules, "root")
    rest = F.expr("substring(specifier, length(root) + 2)")
    out = met.select("src", "specifier", F.concat_ws("/", F.when(F.col("at") != "", F.col("at")), F.when(rest != "", rest)).alias("folder"))
    packages = files.where(F.col("path").endswith(".go")).select(F.regexp_replace("path", r"/?[^/]*$", "").alias("folder")).distinct()
    return out.join(packages, "folder")


def crate_targets(facts: DataFrame, files: DataFrame) -> DataFrame:
    """(crate, kind, path): crate roots (lib, bin, build) that are files."""
    stated = facts.where("kind = 'crate_root'").select(
        F.split("name", ":")[0].alias("crate"), F.split("name", ":")[1].alias("kind"), in_folder("folder", "value").alias("path")
    )
    return stated.distinct().join(files.select("path"), "path").select("crate", "kind", "path")


def stated_packages(facts: DataFrame, excluded: DataFrame | None = None) -> DataFrame:
    """(name, dir, entries, excluded): packages as :func:`imports.package_entries` takes them."""
    entries = facts.where("kind = 'package_entry'").groupBy("folder").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("entries"))
    out = facts.where("kind = 'package' and name <> ''").select("name", "folder").distinct().join(entries, "folder", "left")
    out = out.select("name", F.col("folder").alias("dir"), F.coalesce("entries", F.array().cast("array<string>")).alias("entries"))
    if excluded is None:
        return out.withColumn("excluded", F.lit(False))
    return out.join(excluded.select(F.col("folder").alias("dir"), F.lit(True).alias("excluded")), "dir", "left").withColumn("excluded", F.coalesce("excluded", F.lit(False)))

