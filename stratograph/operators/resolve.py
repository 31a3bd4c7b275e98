"""Resolution joins: imports to files, names to definitions, lines to symbols, files to packages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOPS = 4
#: Most definitions that are sent to every executor: some 30 MB.
MAX_BROADCAST_DEFINITIONS = 200_000
#: Most files of packages that are sent to every executor as arrays: 16 MB of numbers.
MAX_BROADCAST_FILES = 2_000_000
#: Files in one array, and rows of whole packages that one task returns on average.
FILES_AT_ONCE, ROWS_AT_ONCE = 2_000, 10_000_000


def module_name(path: Column, package_root: str = "") -> Column:
    """Dotted module of a Python file; a package's ``__init__`` is the package."""
    p = F.regexp_replace(path, r"\.py$", "")
    if package_root:
        p = F.regexp_replace(p, "^" + package_root.rstrip("/") + "/", "")
    return F.replace(F.regexp_replace(p, r"(^|/)__init__$", ""), F.lit("/"), F.lit("."))


def import_head(level: Column, module: Column, current: Column, is_package: Column) -> Column:
    """Where a relative import starts: the containing package, less one segment for each level past the first."""
    parts = F.split(current, r"\.")
    size = F.size(parts) - F.when(is_package, 0).otherwise(1)
    keep = F.greatest(size - (level - 1), F.lit(0))
    prefix = F.array_join(F.slice(parts, F.lit(1), keep), ".")
    joined = F.when(module == "", prefix).when(prefix == "", module).otherwise(F.concat_ws(".", prefix, module))
    return F.when(level == 0, module).otherwise(joined)


def python_imports(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """(src, dst): modules that an import names, itself or through its parent.

    ``imports``: src (module), is_package, level, module, from_, names; ``modules``: module.
    """
    head = import_head(F.col("level"), F.col("module"), F.col("src"), F.col("is_package"))
    named = F.transform("names", lambda n: F.when(head == "", n).otherwise(F.concat_ws(".", head, n)))
    hits = F.when(F.col("from_"), F.concat(F.array(head), named)).otherwise(F.col("names"))
    wanted = imports.select("src", F.explode(hits).alias("hit")).where("hit <> ''").distinct()
    own = modules.select(F.col("module").alias("hit"), F.col("module").alias("exact"))
    out = wanted.join(own, "hit", "left").withColumn("parent", F.regexp_extract("hit", r"^(.*)\.[^.]*$", 1))
    up = modules.select(F.col("module").alias("parent"), F.col("module").alias("near"))
    out = out.join(up, "parent", "left").select("src", F.coalesce("exact", "near").alias("dst"))
    return out.where("dst is not null and dst <> src").distinct()


def import_mass(targets: DataFrame, statement: str = "stmt") -> DataFrame:
    """(src, dst, share): every statement has mass 1, shared by the files that it reaches."""
    each = targets.select("src", "dst", statement).distinct()
    per = each.withColumn("share", F.lit(1.0) / F.count("*").over(Window.partitionBy("src", statement)))
    return per.where("src <> dst").groupBy("src", "dst").agg(F.sum("share").alias("share"))


def followed(starts: DataFrame, bindings: DataFrame, hops: int = HOPS) -> DataFrame:
    """(module, name, target, target_name): definitions behind re-exports.

    ``starts``: module, name; ``bindings``: module, name, to_module, to_name.  At most ``hops`` steps; a name that a module
    binds in several ways, or a chain that goes on past the last step, stays where it started.
    """
    single = bindings.groupBy("module", "name").agg(
        F.count_distinct("to_module", "to_name").alias("ways"), F.min("to_module").alias("to_module"), F.min("to_name").alias("to_name")
    )
    step = single.select(F.col("module").alias("t"), F.col("name").alias("tn"), "ways", "to_module", "to_name")
    at = starts.select("module", "name", F.col("module").alias("t"), F.col("name").alias("tn"), F.lit(False).alias("lost"), F.lit(False).alias("done"))
    for _ in range(hops):
        at = at.join(step, ["t", "tn"], "left")
        go = ~F.col("done") & ~F.col("lost") & F.col("ways").isNotNull()
        at = at.select(
            "module", "name",
            F.when(go & (F.col("ways") == 1), F.col("to_module")).otherwise(F.col("t")).alias("t"),
            F.when(go & (F.col("ways") == 1), F.col("to_name")).otherwise(F.col("tn")).alias("tn"),
            (F.col("lost") | (go & (F.col("ways") > 1))).alias("lost"),
            (F.col("done") | F.col("ways").isNull()).alias("done"),
        )
    more = at.join(step.select("t", "tn", F.lit(True).alias("more")), ["t", "tn"], "left")
    certain = ~F.col("lost") & F.coalesce(~F.col("more"), F.lit(True))
    return more.select(
        "module", "name", F.when(certain, F.col("t")).otherwise(F.col("module")).alias("target"), F.when(certain, F.col("tn")).otherwise(F.col("name")).alias("target_name")
    )


def ancestors(path: Column) -> Column:
    """A path and all its ``/``-bounded prefixes, longest first, the empty one last."""
    parts = F.split(path, "/")
    cut = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    return F.concat(cut, F.array(F.lit("")))


def longest_prefix(items: DataFrame, key: str, roots: DataFrame, root: str) -> DataFrame:
    """``items`` with the longest root that is a ``/``-bounded prefix of ``key``: an equi-join on a path's own prefixes,
    so that it grows with path depth and not with the number of roots."""
    steps = items.select(F.col(key).alias("__k")).distinct().select("__k", F.posexplode(ancestors(F.col("__k"))).alias("__i", root))
    met = steps.join(roots.select(root).distinct(), root)
    best = met.groupBy("__k").agg(F.min(F.struct("__i", root)).alias("__b")).select("__k", F.col(f"__b.{root}").alias(root))
    return items.join(best, F.col(key) == F.col("__k"), "left").drop("__k")


def first_candidate(rows: DataFrame, key: str, candidates: str, files: DataFrame) -> DataFrame:
    """(key, path): of an array of candidate paths, the first that is a file."""
    each = rows.select(key, F.posexplode(candidates).alias("pos", "path"))
    met = each.join(files.select("path"), "path")
    return met.groupBy(key).agg(F.min(F.struct("pos", "path")).alias("b")).select(key, F.col("b.path").alias("path"))


def typescript_candidates(base: Column) -> Column:
    """Files that a relative specifier may mean, in order."""
    stem = F.regexp_replace(base, r"\.jsx?$", "")
    tail = lambda b: F.array(F.concat(b, F.lit(".ts")), F.concat(b, F.lit("/index.ts")), F.concat(b, F.lit(".tsx")), F.concat(b, F.lit("/index.tsx")), F.concat(b, F.lit("/src/index.ts")), b)
    return (
        F.when(base.rlike(r"\.[mc]js$"), F.array(base))
        .when(base.endswith(".jsx"), F.array(F.concat(stem, F.lit(".tsx"))))
        .when(base.endswith(".js"), F.array(F.concat(stem, F.lit(".ts")), F.concat(stem, F.lit(".tsx"))))
        .otherwise(tail(base))
    )


def narrowed_packages(selected: DataFrame, declared: DataFrame) -> DataFrame:
    """(src, package, file): the files of an imported package that alone declare each selected name; the whole package
    where any name is declared by none or several.  ``selected``: src, package, name; ``declared``: package, file, name.

    The pairs of a source and a package are written and dealt out by the rows that they are to return; a package's files
    come to them as arrays, so that no task gets a whole package's rows and none of them is shuffled.  A task returns the
    same array over and over, one source after the other, which files of columns hold in a small part of a byte for a row.
    """
    from ..sources.tables import checkpointed

    owners = declared.groupBy("package", "name").agg(F.count_distinct("file").alias("owners"), F.min("file").alias("file"))
    met = selected.join(owners, ["package", "name"], "left").withColumn("sure", F.coalesce(F.col("owners") == 1, F.lit(False)))
    verdict = checkpointed(met.groupBy("src", "package").agg(F.bool_and("sure").alias("sure")))
    narrow = met.join(verdict.where("sure").select("src", "package"), ["src", "package"]).select("src", "package", "file").distinct()
    files = declared.select("package", "file").distinct()
    sizes = files.groupBy("package").agg(F.count("*").alias("files"))
    open_ = verdict.where("not sure").groupBy("package").agg(F.count("*").alias("pairs")).join(sizes, "package", "right")
    known, rows = open_.agg(F.coalesce(F.sum("files"), F.lit(0)), F.coalesce(F.sum(F.col("files") * F.col("pairs")), F.lit(0))).first()
    pairs = verdict.where("not sure").select("src", "package")
    if known <= MAX_BROADCAST_FILES:
        some, null = F.collect_list("file"), F.lit(None).cast(files.schema["file"].dataType)
        files_of = F.when(F.count("*") > F.count("file"), F.array_append(some, null)).otherwise(some)
        many = F.broadcast(sizes.select("package", F.ceil(F.col("files") / FILES_AT_ONCE).alias("parts")))
        parts = files.join(many, "package").groupBy("package", F.pmod(F.xxhash64("file"), "parts").alias("part")).agg(files_of.alias("files"))
        # by eights, as columns are packed: equal arrays are then equal bytes, wherever they begin; the rest is a part of its own
        even = (F.size("files") - F.size("files") % 8).cast("int")
        halves = F.array(F.struct(2 * F.col("part"), F.slice("files", F.lit(1), even)), F.struct(2 * F.col("part") + 1, F.slice("files", even + 1, F.lit(7))))
        parts = parts.select("package", F.inline(halves).alias("part", "files"))
        tasks = max(selected.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_AT_ONCE))
        each = pairs.join(many, "package").select("src", "package", F.explode(F.sequence(F.lit(0).cast("long"), 2 * F.col("parts") - 1)).alias("part"))
        dealt = each.repartitionByRange(tasks, "package", "part", "src").sortWithinPartitions("package", "part", "src")
        # Spark drops a sort that stands right below a join; it does not look through a generator
        dealt = dealt.select("package", "part", F.explode(F.array("src")).alias("src"))
        whole = dealt.join(F.broadcast(parts), ["package", "part"]).select("src", "package", F.explode("files").alias("file"))
    else:
        whole = pairs.join(files, "package").select("src", "package", "file")
    return narrow.union(whole) if verdict.where("sure").limit(1).count() else whole


def innermost(points: DataFrame, spans: DataFrame, bucket: int = 64) -> DataFrame:
    """(point columns, sym_id): the smallest span (file_id, sym_id, start, end, depth) that holds a line (file_id, line);
    spans are cut into line buckets, so that the range join is an equi-join."""
    tiles = spans.select("*", F.explode(F.sequence(F.floor(F.col("start") / bucket), F.floor(F.col("end") / bucket))).alias("__b"))
    at = points.withColumns({"__p": F.monotonically_increasing_id(), "__b": F.floor(F.col("line") / bucket)})
    met = at.join(tiles, ["file_id", "__b"]).where("line between start and end")
    order = Window.partitionBy("__p").orderBy(F.col("end") - F.col("start"), F.desc("depth"), F.desc("sym_id"))
    return met.withColumn("__rn", F.row_number().over(order)).where("__rn = 1").select(*points.columns, "sym_id")


def implements(required: DataFrame, provided: DataFrame) -> DataFrame:
    """(owner, interface): owners that have every method of an interface with the same signature.

    ``required``: interface, method, sig; ``provided``: owner, method, sig.
    """
    need = required.distinct().groupBy("interface").agg(F.count("*").alias("need"))
    have = required.distinct().join(provided.distinct(), ["method", "sig"]).groupBy("owner", "interface").agg(F.count("*").alias("have"))
    return have.join(need, "interface").where("have = need").select("owner", "interface")


def collapsed(edges: DataFrame, redirects: DataFrame) -> DataFrame:
    """(a, b, weight, cochange): edges with generated files (file_id) replaced by their generators (target, null: dropped);
    masses add up, co-change is the largest, loops go."""
    at = lambda end: redirects.select(F.col("file_id").alias(end), F.col("target").alias(f"t_{end}"), F.lit(True).alias(f"g_{end}"))
    out = edges.join(at("a"), "a", "left").join(at("b"), "b", "left")
    new = lambda end: F.when(F.col(f"g_{end}"), F.col(f"t_{end}")).otherwise(F.col(end))
    out = out.withColumns({"x": new("a"), "y": new("b")}).where("x is not null and y is not null and x <> y")
    return out.groupBy(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).agg(F.sum("weight").alias("weight"), F.max("cochange").alias("cochange"))


def union_sources(*sources: DataFrame) -> DataFrame:
    """Files (path, lang, pkg) of several sources; the first in (lang, pkg) order owns a path."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    w = Window.partitionBy("path").orderBy("lang", "pkg")
    return out.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def symbol_references(definitions: DataFrame, references: DataFrame) -> DataFrame:
    """(src, dst, symbols, occurrences): file edges of a symbol index; local symbols and loops are left out.

    ``definitions``: symbol, file_id; ``references``: symbol, file_id.  The references of a file to a symbol are counted
    before they meet its definitions: a pair of files then has one row for each symbol, however often that is used.
    """
    d = definitions.where(~F.col("symbol").startswith("local ")).select("symbol", F.col("file_id").alias("dst")).distinct()
    r = references.where(~F.col("symbol").startswith("local ")).groupBy("symbol", F.col("file_id").alias("src")).agg(F.count("*").alias("n"))
    # a file's symbols stand together, so that its edges are summed where they are made
    if d.count() <= MAX_BROADCAST_DEFINITIONS:
        met = r.repartition("src").join(F.broadcast(d), "symbol")
    else:
        met = r.join(d, "symbol")
    return met.where("src <> dst").groupBy("src", "dst").agg(F.count("*").alias("symbols"), F.sum("n").alias("occurrences"))


def symbol_category(symbol: Column) -> Column:
    """What an index symbol's ending says it is."""
    return (
        F.when(symbol.endswith(")."), "callable").when(symbol.endswith("#"), "type").when(symbol.endswith("."), "term").when(symbol.endswith("/"), "namespace")
        .when(symbol.endswith(":"), "meta").when(symbol.endswith(")"), "parameter").when(symbol.endswith("]"), "type_parameter").otherwise("other")
    )


def replaced_languages(hand: DataFrame, indexed: DataFrame, admitted: DataFrame) -> DataFrame:
    """Edges (lang, src, dst, share): those of admitted languages (lang) from the index, the others by hand."""
    return hand.join(admitted, "lang", "left_anti").unionByName(indexed.join(admitted, "lang", "left_semi"))


def linearized(bases: dict) -> dict:
    """C3 order of every class: bases {class: [base, ...]}; inconsistent or circular hierarchies give None; bases that are
    not in the map stand for themselves."""
    done: dict = {}

    def order(c, path):
        if c not in bases:
            return [c]
        if c in done:
            return done[c]
        if c in path:
            return None
        lines = [order(b, path | {c}) for b in bases[c]]
        if any(x is None for x in lines):
            done[c] = None
            return None
        rest, out = [list(x) for x in [*lines, bases[c]] if x], [c]
        while rest:
            head = next((x[0] for x in rest if not any(x[0] in y[1:] for y in rest)), None)
            if head is None:
                done[c] = None
                return None
            out.append(head)
            rest = [[v for v in x if v != head] for x in rest]
            rest = [x for x in rest if x]
        done[c] = out
        return out

    return {c: order(c, frozenset()) for c in bases}


def ancestors_of(bases: DataFrame) -> DataFrame:
    """(cls, base): every class above a class, itself included.  ``bases``: cls, pos, base."""
    from ..sources.tables import checkpointed

    step = found = checkpointed(bases.select("cls").distinct().select("cls", F.col("cls").alias("base")))
    up = bases.select(F.col("cls").alias("base"), F.col("base").alias("above")).distinct()
    while True:
        step = checkpointed(step.join(up, "base").select("cls", F.col("above").alias("base")).distinct().join(found, ["cls", "base"], "left_anti"))
        if not step.limit(1).count():
            return found
        found = found.union(step)


def linearizations(bases: DataFrame) -> DataFrame:
    """(cls, pos, base, known): the C3 order of every class, itself first; classes without one have no rows.

    ``bases``: cls, pos, base.  A class's task gets the bases of the classes above it, nothing else, so that hierarchies
    of any number run side by side; ``known`` tells whether the base's own bases are in the table.
    """
    from ..sources.tables import importable

    importable(bases.sparkSession)
    kind = bases.schema["cls"].dataType.simpleString()
    above = ancestors_of(bases).select(F.col("cls").alias("of"), F.col("base").alias("cls")).join(bases.select("cls", "pos", "base"), "cls")

    def run(frame):
        import pandas as pd

        of, rows = frame["of"].iloc[0], {}
        for c, _, b in sorted(zip(frame["cls"], frame["pos"], frame["base"]), key=lambda r: (str(r[0]), r[1])):
            rows.setdefault(c, []).append(b)
        order = linearized(rows).get(of) or []
        return pd.DataFrame({"cls": [of] * len(order), "pos": range(len(order)), "base": order, "known": [b in rows for b in order]}, dtype=object)

    return above.groupBy("of").applyInPandas(run, f"cls {kind}, pos int, base {kind}, known boolean")


def inherited_member(orders: DataFrame, members: DataFrame) -> DataFrame:
    """(cls, name, owner): the first class after ``cls`` in its order that has a member; an unknown class ends the search.

    ``orders``: cls, pos, base, known; ``members``: cls, name.
    """
    wall = orders.where("not known").groupBy("cls").agg(F.min("pos").alias("wall"))
    open_ = orders.join(wall, "cls", "left").where("pos > 0 and (wall is null or pos < wall)")
    met = open_.join(members.select(F.col("cls").alias("base"), "name"), "base")
    return met.groupBy("cls", "name").agg(F.min(F.struct("pos", "base")).alias("b")).select("cls", "name", F.col("b.base").alias("owner"))


def symbol_edges(resolved: DataFrame) -> DataFrame:
    """(a, b, kind, cnt): references between symbols; those to one's own ancestors (ancestor) are left out."""
    return resolved.where("not ancestor and a <> b").groupBy("a", "b", "kind").agg(F.count("*").alias("cnt"))


def district_slice(edges: DataFrame, symbols: DataFrame, district) -> DataFrame:
    """Symbols of one district and the other ends of their edges.  ``symbols``: sym_id, district."""
    own = symbols.where(F.col("district") == district).select("sym_id")
    near = edges.join(own.withColumnRenamed("sym_id", "a"), "a", "left_semi").select(F.col("b").alias("sym_id")).union(
        edges.join(own.withColumnRenamed("sym_id", "b"), "b", "left_semi").select("a")
    )
    return own.union(near).distinct()
