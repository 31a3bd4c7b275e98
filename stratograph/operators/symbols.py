"""Symbol references: binding lookup, chain resolution, edges, and how much stays unresolved."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REASONS = ["resolved", "dynamic", "local_or_builtin", "external", "unresolved_attribute", "module_only", "instance_or_untyped", "parent_class_method"]


def bindings(tops: DataFrame, package_tops: DataFrame, imports: DataFrame) -> DataFrame:
    """(file_id, name, sym_id, source): what a name means in a file: its own top-level symbol, else one that its package
    alone has, else an import.

    ``tops``: file_id, name, sym_id; ``package_tops``: file_id, package, name, sym_id (files see their package);
    ``imports``: file_id, name, sym_id.
    """
    own = tops.select("file_id", "name", "sym_id", F.lit(0).alias("turn"), F.lit("local").alias("source"))
    single = package_tops.groupBy("package", "name").agg(F.count_distinct("sym_id").alias("n"), F.min("sym_id").alias("sym_id")).where("n = 1")
    seen = package_tops.select("file_id", "package").distinct().join(single.select("package", "name", "sym_id"), "package")
    shared = seen.select("file_id", "name", "sym_id", F.lit(1).alias("turn"), F.lit("package").alias("source"))
    taken = imports.select("file_id", "name", "sym_id", F.lit(2).alias("turn"), F.lit("import").alias("source"))
    order = Window.partitionBy("file_id", "name").orderBy("turn", "sym_id")
    every = own.unionByName(shared).unionByName(taken).withColumn("rn", F.row_number().over(order))
    return every.where("rn = 1").select("file_id", "name", "sym_id", "source")


def resolved(candidates: DataFrame, bound: DataFrame, members: DataFrame, shadowed: DataFrame, modules: DataFrame) -> DataFrame:
    """Candidates (owner, file_id, head, attr, kind, cls) with ``target`` and ``reason``.

    A head that the owner shadows is local; ``self`` and ``cls`` look in the class (members: cls, name, sym_id); a bound
    head with an attribute looks in that symbol's members, or in a module (modules: name, attr, sym_id); a head that
    nothing binds is external or a builtin.
    """
    out = candidates.join(shadowed.select("owner", F.col("name").alias("head"), F.lit(True).alias("shadow")), ["owner", "head"], "left")
    out = out.join(bound.select("file_id", F.col("name").alias("head"), F.col("sym_id").alias("b")), ["file_id", "head"], "left")
    own = members.select("cls", F.col("name").alias("attr"), F.col("sym_id").alias("m_own"))
    out = out.join(own, ["cls", "attr"], "left")
    of = members.select(F.col("cls").alias("b"), F.col("name").alias("attr"), F.col("sym_id").alias("m_of"))
    out = out.join(of, ["b", "attr"], "left")
    mod = modules.select(F.col("name").alias("head"), "attr", F.col("sym_id").alias("m_mod"))
    out = out.join(mod, ["head", "attr"], "left").join(modules.select(F.col("name").alias("head"), F.lit(True).alias("is_mod")).distinct(), "head", "left")
    self_head = F.col("head").isin("self", "cls")
    target = (
        F.when(F.col("head").isNull(), F.lit(None))
        .when(self_head, F.col("m_own"))
        .when(F.col("shadow"), F.lit(None))
        .when(F.col("attr").isNull(), F.col("b"))
        .otherwise(F.coalesce("m_of", "m_mod"))
    )
    reason = (
        F.when(target.isNotNull(), "resolved")
        .when(F.col("head").isNull(), "dynamic")
        .when(self_head, "unresolved_attribute")
        .when(F.col("shadow"), F.when(F.col("attr").isNull(), "local_or_builtin").otherwise("instance_or_untyped"))
        .when(F.col("b").isNotNull(), "unresolved_attribute")
        .when(F.col("is_mod"), F.when(F.col("attr").isNull(), "module_only").otherwise("unresolved_attribute"))
        .otherwise("external")
    )
    return out.select(*candidates.columns, target.alias("target"), reason.alias("reason"))


def resolved_in_hierarchy(candidates: DataFrame, bound: DataFrame, members: DataFrame, shadowed: DataFrame, modules: DataFrame, orders: DataFrame) -> DataFrame:
    """As :func:`resolved`, and where that ends at a class, on along its order (cls, pos, base, known).

    ``self.x`` and ``cls.x`` take the first class after the own one that has ``x``; ``super().x`` (head ``super``) leaves the
    own class out from the start; ``Name.x`` of a bound class takes the first above that.  A class whose bases are unknown
    ends the search: what lies above it cannot be told.  Such a target's reason is ``parent_class_method``.
    """
    out = resolved(candidates, bound, members, shadowed, modules)
    wall = orders.where("not known").groupBy("cls").agg(F.min("pos").alias("wall"))
    reach = orders.join(wall, "cls", "left").where("pos > 0 and (wall is null or pos <= wall)")
    met = reach.join(members.select(F.col("cls").alias("base"), "name", "sym_id"), "base")
    first = met.groupBy("cls", "name").agg(F.min(F.struct("pos", "sym_id")).alias("b")).select("cls", "name", F.col("b.sym_id").alias("above"))
    own = first.select("cls", F.col("name").alias("attr"), F.col("above").alias("above_own"))
    of = first.select(F.col("cls").alias("of"), F.col("name").alias("attr"), F.col("above").alias("above_of"))
    heads = bound.select("file_id", F.col("name").alias("head"), F.col("sym_id").alias("of"))
    out = out.join(own, ["cls", "attr"], "left").join(heads, ["file_id", "head"], "left").join(of, ["of", "attr"], "left")
    upward = F.when(F.col("head") == "super", F.col("above_own")).when(F.col("head").isin("self", "cls"), F.col("above_own"))
    upward = upward.when(F.col("reason") == "unresolved_attribute", F.col("above_of"))
    found = F.col("target").isNull() & upward.isNotNull()
    return out.select(
        *candidates.columns, F.when(found, upward).otherwise(F.col("target")).alias("target"),
        F.when(found, "parent_class_method").when((F.col("head") == "super") & upward.isNull(), "unresolved_attribute").otherwise(F.col("reason")).alias("reason"),
    )


def reason_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("reason").agg(F.count("*").alias("n"))


def overrides(methods: DataFrame, inherited: DataFrame) -> DataFrame:
    """(sym_id, base_sym): methods (cls, name, sym_id) whose class inherits one of that name (cls, name, owner)."""
    base = methods.select(F.col("cls").alias("owner"), "name", F.col("sym_id").alias("base_sym"))
    return methods.join(inherited, ["cls", "name"]).join(base, ["owner", "name"]).select("sym_id", "base_sym")


def receivers(methods: DataFrame, types: DataFrame) -> DataFrame:
    """(sym_id, parent): methods (sym_id, dir, file_id, receiver) hang on the one type of that name in their file, else in
    their directory; two or none leave them alone."""
    def only(keys):
        return types.groupBy(*keys, "name").agg(F.count("*").alias("n"), F.min("sym_id").alias("parent")).where("n = 1").select(*keys, F.col("name").alias("receiver"), "parent")

    near = methods.join(only(["file_id"]), ["file_id", "receiver"], "left").withColumnRenamed("parent", "p_file")
    wide = near.join(only(["dir"]), ["dir", "receiver"], "left")
    return wide.select("sym_id", F.coalesce("p_file", "parent").alias("parent")).where("parent is not null")
