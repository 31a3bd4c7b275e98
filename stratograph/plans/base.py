"""Base tables of the catalogue, on both engines: files, arcs, commits and documents of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import pairs as N
from ..sources.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: Common table expressions in DuckDB SQL, each as the Spark function of the same name builds it.
CTES = {
    "sup": """sup as (
  select s_suppkey as file_id, r_name || '/' || n_name || '/' || s_name as path, s_nationkey as district, r_name as lang,
    n_name as district_name
  from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey)""",
    "e": """seq as (
  select l_suppkey as src, l_shipdate as ts, lead(l_suppkey) over (partition by l_orderkey
    order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) as dst from lineitem),
e as (select src, dst, count(*) as n from seq where dst is not null and src <> dst group by src, dst)""",
    "heavy": """heavy as (select src, dst, n from (
  select *, row_number() over (partition by src order by n desc, dst) as rn from e) where rn <= 3)""",
    "und": "und as (select least(src, dst) as a, greatest(src, dst) as b, sum(n)::double as weight from e group by all)",
    "cf": "cf as (select distinct l_orderkey as sha, l_suppkey as f from lineitem)",
    "part_files": """part_files as (
  select p_partkey as file_id, 'src/' || p_brand || '/' || p_name as path, p_size::bigint as complexity,
    coalesce(n, 0)::bigint as churn, coalesce(q, 0)::double as fanin
  from part left join (select l_partkey, count(*) as n, sum(l_quantity) as q from lineitem group by 1) on l_partkey = p_partkey)""",
}
NEEDS = {"heavy": ["e"], "und": ["e"]}


def with_(*names: str) -> str:
    done: list[str] = []
    for n in names:
        for m in [*NEEDS.get(n, []), n]:
            if m not in done:
                done.append(m)
    return "with recursive " + ",\n".join(CTES[n] for n in done)


def query(name: str, sql: str | None = None):
    """Register a query and, where SQL can say the same, its SQL."""

    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def sup(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as files of districts (nations) in languages (regions)."""
    s, n, r = (table(spark, d, t) for t in ("supplier", "nation", "region"))
    joined = s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(
        F.col("s_suppkey").alias("file_id"), F.concat_ws("/", "r_name", "n_name", "s_name").alias("path"), F.col("s_nationkey").alias("district"),
        F.col("r_name").alias("lang"), F.col("n_name").alias("district_name"),
    )


def sequence(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, ts): consecutive suppliers of an order."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_shipdate").alias("ts"), F.lead("l_suppkey").over(order).alias("dst"))
    return rows.where("dst is not null and src <> dst")


def arcs(spark: SparkSession, d: str) -> DataFrame:
    """(src, dst, n): all arcs."""
    return sequence(spark, d).groupBy("src", "dst").agg(F.count("*").alias("n"))


def heavy_arcs(spark: SparkSession, d: str, most: int = 3) -> DataFrame:
    """A sparse graph at every size of the tables: of each source the ``most`` heaviest arcs, the smaller target on ties."""
    order = Window.partitionBy("src").orderBy(F.desc("n"), "dst")
    return arcs(spark, d).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= most).drop("rn")


def undirected(spark: SparkSession, d: str) -> DataFrame:
    return arcs(spark, d).groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum("n").cast("double").alias("weight"))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """(a, b, ahead, back): the arcs a to b and b to a, and in rows with a = b the orders of a, by one pass over the orders.
    What else the sequence is ordered by comes after the supplier, and changes no arc."""
    return N.consecutive(table(spark, d, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey"], "l_suppkey")


def directed(pairs: DataFrame) -> DataFrame:
    """(src, dst, n) of pairs: what :func:`arcs` gives."""
    ahead = pairs.where("a <> b and ahead > 0").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.col("ahead").alias("n"))
    return ahead.union(pairs.where("a <> b and back > 0").select("b", "a", "back"))


def linked(pairs: DataFrame) -> DataFrame:
    """(a, b, weight) of pairs: what :func:`undirected` gives."""
    return pairs.where("a <> b").select("a", "b", (F.col("ahead") + F.col("back")).cast("double").alias("weight"))


def commit_files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sha"), F.col("l_suppkey").alias("f")).distinct()


def part_files(spark: SparkSession, d: str) -> DataFrame:
    """Parts as files: churn from orders, fan-in from quantities, complexity from the size."""
    used = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("file_id")).agg(F.count("*").alias("churn"), F.sum("l_quantity").alias("fanin"))
    p = table(spark, d, "part").select(
        F.col("p_partkey").alias("file_id"), F.concat(F.lit("src/"), "p_brand", F.lit("/"), "p_name").alias("path"), F.col("p_size").cast("long").alias("complexity"),
        F.col("p_brand").alias("package"), F.col("p_name").alias("name"),
    )
    zero = lambda c, kind: F.coalesce(c, F.lit(0)).cast(kind).alias(c)
    return p.join(used, "file_id", "left").select("file_id", "path", "complexity", zero("churn", "long"), zero("fanin", "double"), "package", "name")
