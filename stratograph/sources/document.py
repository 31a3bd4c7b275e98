"""The published map document: written from tables, read back and checked.

A document of up to ``PART`` files and as many import pairs is one JSON row.  A larger one goes on in further rows of at most
so many each, so that no task holds it whole: ``start`` tells how many files, and how many pairs, stand in the rows before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import round_even
from .tables import numbered

NAME_LENGTH = 44
PART = 50_000
MAP = (
    "repo string, `commit` string, start bigint, F array<string>, N array<array<double>>, C array<bigint>, E array<array<bigint>>, "
    "names map<string,string>, lang string, q double, roads array<array<double>>"
)


def document(files: DataFrame, arcs: DataFrame, districts: DataFrame, repo: str, commit: str, language: str, q: float, roads: DataFrame | None = None, part: int = PART) -> DataFrame:
    """One row for each part: file paths F, node rows N (district, x, y, loc, complexity, churn, fan-in, rectangle), code lines
    C, import pairs E, in order over the parts; the first has the district names and roads too, and no ``start``."""
    node = F.array(
        F.col("district").cast("double"), *[round_even(F.col(c), 4) for c in ("x", "y")], *[F.col(c).cast("double") for c in ("loc", "complexity", "churn")],
        round_even(F.col("fanin"), 2), *[round_even(F.col(c), 5) for c in ("rx", "ry", "rw", "rh")],
    )
    start = (F.floor(F.col("place") / part) * part).alias("start")
    nodes = numbered(files.select(F.col("file_id").alias("i"), F.col("path").alias("p"), node.alias("n"), F.col("code_lines").alias("c")), "i", "p", "n", "c")
    pairs = numbered(arcs.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).distinct(), "src", "dst")
    rows = nodes.select(start, F.struct("place", "p", "n", "c").alias("r")).unionByName(pairs.select(start, F.struct("place", F.array("src", "dst").alias("e")).alias("e")), allowMissingColumns=True)
    rows = rows.unionByName(files.sparkSession.range(1).select(F.col("id").alias("start")), allowMissingColumns=True)  # there is a first part
    rows = rows.groupBy("start").agg(F.array_sort(F.collect_list("r")).alias("r"), F.array_sort(F.collect_list("e")).alias("e"))
    names = districts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("district").cast("string"), "name")))).alias("names"))
    if roads is None:
        way = files.sparkSession.range(1).select(F.array().cast("array<array<double>>").alias("roads"))
    else:
        way = roads.agg(F.array_sort(F.collect_list(F.array(F.col("da").cast("double"), F.col("db").cast("double"), F.col("strength")))).alias("roads"))
    first = lambda c: F.when(F.col("start") == 0, c)
    out = rows.crossJoin(F.broadcast(names.crossJoin(way)))
    return out.select(
        F.lit(repo).alias("repo"), F.lit(commit).alias("commit"), F.when(F.col("start") > 0, F.col("start")).alias("start"), F.col("r.p").alias("F"), F.col("r.n").alias("N"), F.col("r.c").alias("C"), F.col("e.e").alias("E"),
        first(F.col("names")).alias("names"), F.lit(language).alias("lang"), F.lit(q).alias("q"), first(F.col("roads")).alias("roads"),
    )


def write(doc: DataFrame, path: str) -> None:
    """One JSON file; the writer's commit makes it appear whole or not at all."""
    doc.coalesce(1).write.mode("overwrite").option("ignoreNullFields", True).json(path)


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables files, arcs, districts, head of a written map; a document whose parts do not fit fails."""
    doc = spark.read.schema(MAP).json(path).withColumn("start", F.coalesce("start", F.lit(0).cast("long")))
    # one row of totals, and the names of the first part
    total = doc.agg(F.sum(F.size("F")).alias("total"), F.first("names", ignorenulls=True).alias("known"))
    size = F.size("F")
    problem = (
        F.when(size != F.size("N"), "F and N differ in length")
        .when(F.exists("E", lambda e: (e[0] < 0) | (e[1] < 0) | (e[0] >= F.col("total")) | (e[1] >= F.col("total"))), "an edge leaves the map")
        .when(F.exists("N", lambda n: ~F.map_contains_key("known", n[0].cast("long").cast("string"))), "a district has no name")
    )
    bad = doc.crossJoin(F.broadcast(total)).select(problem.alias("p")).where("p is not null").first()
    if bad is not None:
        raise ValueError(bad["p"])
    if doc.select(F.explode("F").alias("path")).groupBy("path").count().where("count > 1").limit(1).count():
        raise ValueError("a path stands there twice")
    cells = ["district", "x", "y", "loc", "complexity", "churn", "fanin", "rx", "ry", "rw", "rh"]
    nodes = doc.select("start", F.posexplode(F.arrays_zip("F", "N")).alias("pos", "z")).withColumn("file_id", F.col("start") + F.col("pos"))
    files = nodes.select("file_id", F.col("z.F").alias("path"), *[F.col("z.N")[i].alias(c) for i, c in enumerate(cells)])
    arcs = doc.select("start", F.posexplode("E").alias("pos", "e")).select(F.col("e")[0].alias("src"), F.col("e")[1].alias("dst"), (F.col("start") + F.col("pos")).alias("pos"))
    names = doc.where("names is not null").select(F.explode("names").alias("district", "name"))
    # of one part its hash, of several that of theirs
    marks = doc.select("start", F.sha2(F.to_json(F.struct("F", "N", "E")), 256).alias("m")).agg(F.array_sort(F.collect_list(F.struct("start", "m"))).alias("m"))
    identity = marks.select(F.when(F.size("m") > 1, F.sha2(F.array_join("m.m", ","), 256)).otherwise(F.col("m.m")[0]).alias("identity"))
    head = doc.where("start = 0").select("repo", "commit", "lang", "q").crossJoin(F.broadcast(identity))
    return {"files": files, "arcs": arcs, "districts": names, "head": head}


def write_symbols(symbols: DataFrame, path: str) -> None:
    """Hierarchical symbols, one folder for each district."""
    symbols.withColumn("name", F.substring("name", 1, NAME_LENGTH)).write.mode("overwrite").partitionBy("district").json(path)


def compact_uses(uses: DataFrame, symbols: DataFrame) -> DataFrame:
    """(def_file, sym_idx, users): who uses a symbol, by the last part of its name; the first symbol of a name counts."""
    named = symbols.select(F.col("file_id").alias("def_file"), F.element_at(F.split("name", r"\."), -1).alias("base"), "sym_idx")
    first = named.groupBy("def_file", "base").agg(F.min("sym_idx").alias("sym_idx"))
    met = uses.select(F.col("dst").alias("def_file"), F.element_at(F.split("name", r"\."), -1).alias("base"), F.col("src").alias("user")).join(first, ["def_file", "base"])
    return met.groupBy("def_file", "sym_idx").agg(F.array_sort(F.collect_set("user")).alias("users"))


def render(rows: DataFrame, order: list, template: str, columns: list[str], limit: int = 20) -> str:
    """Human text of a report: one line a row, and how many were left out."""
    total = rows.count()
    lines = [r["t"] for r in rows.orderBy(*order).limit(limit).select(F.format_string(template, *columns).alias("t")).collect()]
    return "\n".join(lines + ([f"... {total - limit} more"] if total > limit else [])) + "\n"
