"""Resolution of stated imports to files, language by language: every lookup is an equi-join on a path's or a name's own
prefixes, so it grows with their depth and never with the number of projects, aliases or packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .resolve import ancestors, first_candidate, import_mass, longest_prefix

#: Build folders whose files mirror those of ``src``.
BUILD_FOLDERS = ("dist", "build", "lib", "out")


# ---- Python


def project_modules(files: DataFrame, projects: DataFrame) -> DataFrame:
    """(project, module, path) of Python files, each in the nearest of the ``projects`` (root) above it; ``''`` is the
    repository's own.  A file under the project's ``src`` folder has its module name without it too."""
    roots = projects.select("root").union(projects.sparkSession.createDataFrame([("",)], "root string")).distinct()
    placed = longest_prefix(files.select("path"), "path", roots, "root")
    inner = F.when(F.col("root") == "", F.col("path")).otherwise(F.expr("substring(path, length(root) + 2)"))
    dotted = lambda p: F.replace(F.regexp_replace(F.regexp_replace(p, r"\.py$", ""), r"(^|/)__init__$", ""), F.lit("/"), F.lit("."))
    names = F.when(inner.startswith("src/"), F.array(dotted(F.expr("substring(inner, 5)")), dotted(F.col("inner")))).otherwise(F.array(dotted(F.col("inner"))))
    rows = placed.withColumn("inner", inner).select(F.col("root").alias("project"), F.explode(names).alias("module"), "path")
    return rows.where("module <> ''").groupBy("project", "module").agg(F.min("path").alias("path"))


def scoped_imports(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """(src, project, hit, dst, via): the file of an imported module: in the importer's own project (``own``), in the
    repository's (``root``), or in the one project that alone has the first segment (``other``); null where none has it.

    ``imports``: src, project, hit; ``modules``: project, module, path.
    """
    asked = imports.select("src", "project", "hit").distinct()
    own = modules.select("project", F.col("module").alias("hit"), F.col("path").alias("p_own"))
    root = modules.where("project = ''").select(F.col("module").alias("hit"), F.col("path").alias("p_root"))
    top = F.split(F.col("module"), r"\.")[0]
    owners = modules.where("project <> ''").select(top.alias("top"), "project").distinct().groupBy("top").agg(F.min("project").alias("owner"), F.count("*").alias("n"))
    owners = owners.where("n = 1").select("top", "owner")
    other = modules.select(F.col("project").alias("owner"), F.col("module").alias("hit"), F.col("path").alias("p_other"))
    met = asked.join(own, ["project", "hit"], "left").join(root, "hit", "left")
    met = met.withColumn("top", F.split("hit", r"\.")[0]).join(owners, "top", "left").join(other, ["owner", "hit"], "left")
    elsewhere = F.col("owner") != F.col("project")
    via = F.when(F.col("p_own").isNotNull(), "own").when(F.col("p_root").isNotNull(), "root").when(elsewhere & F.col("p_other").isNotNull(), "other")
    dst = F.coalesce("p_own", "p_root", F.when(elsewhere, F.col("p_other")))
    return met.select("src", "project", "hit", dst.alias("dst"), via.alias("via"))


def symbol_uses(candidates: DataFrame, bindings: DataFrame) -> DataFrame:
    """(src, dst, name): names of another module that a file uses.

    ``candidates``: src, head, attr (null: a bare name); ``bindings``: src, local, module, name (null: the module itself).
    A bare name counts where it is bound to a name, ``head.attr`` where the head is bound to a module.
    """
    met = candidates.join(bindings.select("src", F.col("local").alias("head"), "module", "name"), ["src", "head"])
    used = F.when(F.col("name").isNotNull(), F.col("name")).when(F.col("attr").isNotNull(), F.col("attr"))
    return met.select("src", F.col("module").alias("dst"), used.alias("name")).where("name is not null and src <> dst").distinct()


# ---- every language


def projections(targets: DataFrame) -> DataFrame:
    """(kind, a, b, weight): what resolved imports (src, stmt, dst) give: ``directed`` mass of src and dst, ``static`` mass
    of the unordered pair, ``fanin`` of dst (b null).  Every statement has mass 1, shared by its targets; loops go."""
    each = import_mass(targets).select("src", "dst", "share")
    kinds = F.array(
        F.struct(F.lit("directed").alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b")),
        F.struct(F.lit("static").alias("kind"), F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")),
        F.struct(F.lit("fanin").alias("kind"), F.col("dst").alias("a"), F.lit(None).cast(targets.schema["dst"].dataType).alias("b")),
    )
    return each.select(F.explode(kinds).alias("k"), "share").groupBy("k.kind", "k.a", "k.b").agg(F.sum("share").alias("weight"))


# ---- TypeScript


def alias_targets(imports: DataFrame, aliases: DataFrame) -> DataFrame:
    """(src, specifier, path): where a path alias leads.

    ``imports``: src, specifier; ``aliases``: scope (folder of the configuration), prefix, target.  A configuration governs
    the files below its folder; of several aliases that match, the deepest scope counts, then the longest prefix, then
    prefix and target in order.
    """
    asked = imports.select("src", "specifier").distinct()
    scopes = asked.select("*", F.explode(ancestors(F.regexp_replace("src", r"/?[^/]*$", ""))).alias("scope"))
    # the specifier's own prefixes, with and without the slash that ends them, and all of it
    parts = F.split("specifier", "/")
    cuts = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    prefixes = F.array_distinct(F.concat(cuts, F.transform(cuts, lambda p: F.concat(p, F.lit("/")))))
    spread = scopes.select("*", F.explode(prefixes).alias("prefix")).where(F.col("specifier").startswith(F.col("prefix")))
    met = spread.join(aliases, ["scope", "prefix"])
    order = Window.partitionBy("src", "specifier").orderBy(F.desc(F.length("scope")), F.desc(F.length("prefix")), "prefix", "target")
    best = met.withColumn("rn", F.row_number().over(order)).where("rn = 1")
    rest = F.expr("substring(specifier, length(prefix) + 1)")
    return best.select("src", "specifier", F.concat(F.col("target"), rest).alias("path"))


def package_entries(imports: DataFrame, packages: DataFrame, files: DataFrame) -> DataFrame:
    """(src, name, subpath, dst, via): the file that an import of a workspace package means.

    ``imports``: src, name, subpath (``''``: the package itself); ``packages``: name, dir, entries (array of stated files,
    relative to dir, in order), excluded; ``files``: path.  In order: a stated entry or the subpath that is a file
    (``entry``); the source that a file in a build folder mirrors (``mirror``); and for a package that is left out of the
    map, its first file of least depth (``redirect``).
    """
    asked = imports.join(packages, "name")
    stated = F.when(F.col("subpath") == "", F.concat("entries", F.array(F.lit("index.ts"), F.lit("src/index.ts")))).otherwise(
        F.array(F.col("subpath"), F.concat("subpath", F.lit(".ts")), F.concat("subpath", F.lit(".tsx")), F.concat("subpath", F.lit("/index.ts")))
    )
    asked = asked.withColumn("stated", stated).withColumn("key", F.concat_ws("\0", "src", "name", "subpath"))
    under = lambda p: F.concat_ws("/", F.col("dir"), p)
    entry = first_candidate(asked.withColumn("c", F.transform("stated", under)), "key", "c", files).withColumnRenamed("path", "p_entry")
    mirror = first_candidate(asked.withColumn("c", F.transform(F.flatten(F.transform("stated", mirrored)), under)), "key", "c", files)
    mirror = mirror.withColumnRenamed("path", "p_mirror")
    inside = longest_prefix(files.select("path"), "path", packages.where("excluded").select("dir"), "dir").where("dir is not null")
    order = Window.partitionBy("dir").orderBy(F.size(F.split("path", "/")), "path")
    first = inside.withColumn("rn", F.row_number().over(order)).where("rn = 1").select("dir", F.col("path").alias("p_first"))
    out = asked.join(entry, "key", "left").join(mirror, "key", "left").join(first, "dir", "left")
    via = F.when(F.col("p_entry").isNotNull(), "entry").when(F.col("p_mirror").isNotNull(), "mirror").when(F.col("excluded") & F.col("p_first").isNotNull(), "redirect")
    return out.select("src", "name", "subpath", F.coalesce("p_entry", "p_mirror", F.when(F.col("excluded"), F.col("p_first"))).alias("dst"), via.alias("via"))


def mirrored(path: Column) -> Column:
    """Sources that a built file may come from: the build folder's ``src``, with the suffixes of sources."""
    stem = F.regexp_replace(F.regexp_replace(path, rf"^(\./)?({'|'.join(BUILD_FOLDERS)})/((esm|cjs|types)/)?", "src/"), r"(\.d)?\.[mc]?[jt]sx?$", "")
    built = path.rlike(rf"^(\./)?({'|'.join(BUILD_FOLDERS)})/")
    return F.when(built, F.array(F.concat(stem, F.lit(".ts")), F.concat(stem, F.lit(".tsx")), F.concat(stem, F.lit("/index.ts")))).otherwise(
        F.array().cast("array<string>")
    )


# ---- Rust


def module_files(declared: DataFrame, files: DataFrame) -> DataFrame:
    """(src, name, dst): the file of every ``mod name;`` (src, name): ``name.rs`` beside it, else ``name/mod.rs``; a file
    that is no ``mod.rs``, ``lib.rs`` or ``main.rs`` has its modules in the folder of its own name."""
    folder = F.regexp_replace("src", r"/?[^/]*$", "")
    own = F.regexp_extract("src", r"([^/]*)\.rs$", 1)
    home = F.when(own.isin("mod", "lib", "main"), folder).when(folder == "", own).otherwise(F.concat_ws("/", folder, own))
    stem = F.when(home == "", F.col("name")).otherwise(F.concat_ws("/", home, "name"))
    asked = declared.select("src", "name").distinct().withColumn("key", F.concat_ws("\0", "src", "name"))
    asked = asked.withColumn("c", F.array(F.concat(stem, F.lit(".rs")), F.concat(stem, F.lit("/mod.rs"))))
    met = first_candidate(asked, "key", "c", files)
    return asked.join(met, "key").select("src", "name", F.col("path").alias("dst"))


def module_paths(tree: DataFrame, roots: DataFrame) -> DataFrame:
    """(module, path): every module of the tree by its full path (``crate::a::b``).  ``tree``: src, name, dst; ``roots``:
    path, crate.  A file that two declarations name has both paths; a file names itself at most once on the way down."""
    from ..sources.tables import checkpointed

    found = step = roots.select(F.col("crate").alias("module"), "path", F.array("path").alias("way"))
    down = tree.select(F.col("src").alias("path"), "name", "dst")
    while True:
        step = checkpointed(
            step.join(down, "path").where(~F.array_contains("way", F.col("dst"))).select(
                F.concat_ws("::", "module", "name").alias("module"), F.col("dst").alias("path"), F.concat("way", F.array("dst")).alias("way")
            )
        )
        if not step.limit(1).count():
            return found.select("module", "path").distinct()
        found = found.union(step)


def rust_uses(uses: DataFrame, modules: DataFrame) -> DataFrame:
    """(src, dst, share): each ``use`` (src, stmt, path) has mass 1, shared by the files of its leaves, the user's own
    included and then left out.  A leaf means the module with the longest ``::``-bounded prefix of its path."""
    slashed = F.replace("path", F.lit("::"), F.lit("/"))
    leaves = uses.select("src", "stmt", slashed.alias("leaf")).distinct()
    roots = modules.select(F.replace("module", F.lit("::"), F.lit("/")).alias("root"), F.col("path").alias("dst"))
    met = longest_prefix(leaves, "leaf", roots, "root").where("root is not null").join(roots, "root")
    each = met.select("src", "stmt", "dst").distinct()
    share = each.withColumn("share", F.lit(1.0) / F.count("*").over(Window.partitionBy("src", "stmt")))
    return share.where("src <> dst").groupBy("src", "dst").agg(F.sum("share").alias("share"))


# ---- what is left


def coverage_causes(files: DataFrame, edges: DataFrame, stated: DataFrame, resolved: DataFrame) -> DataFrame:
    """(lang, cause, files): files without an edge by cause: ``no_imports`` states none, ``unresolved`` has none that leads
    to a file, ``dropped`` has some, but no edge was kept.

    ``files``: path, lang; ``edges``: src, dst; ``stated``: src; ``resolved``: src, dst.
    """
    linked = edges.select(F.col("src").alias("path")).union(edges.select("dst"))
    alone = files.join(linked, "path", "left_anti")
    has = lambda rows, name: rows.select(F.col("src").alias("path")).distinct().withColumn(name, F.lit(True))
    out = alone.join(has(stated, "stated"), "path", "left").join(has(resolved, "resolved"), "path", "left")
    cause = F.when(F.col("stated").isNull(), "no_imports").when(F.col("resolved").isNull(), "unresolved").otherwise("dropped")
    return out.groupBy("lang", cause.alias("cause")).agg(F.count("*").alias("files"))


def import_outcomes(entries: DataFrame) -> DataFrame:
    """(via, imports): workspace imports by how they were resolved; ``unresolved`` and, without a package, ``external``."""
    return entries.groupBy(F.coalesce("via", F.lit("unresolved")).alias("via")).agg(F.count("*").alias("imports"))
