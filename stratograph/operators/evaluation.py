"""Evaluation operators: percentiles, correlations, set comparison, threshold replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import round_even


def quantile7(df: DataFrame, by: list[str], column: str, ps: list[float]) -> DataFrame:
    """Linear (type 7) quantiles by group."""
    return df.groupBy(*by).agg(*[F.percentile(column, F.lit(p)).alias(f"p{round(p * 100):02d}") for p in ps])


def nearest_rank(df: DataFrame, by: list[str], column: str, p: int) -> DataFrame:
    """The value at rank max(1, ceil(p / 100 * n))."""
    rows = df.withColumns({"rn": F.row_number().over(Window.partitionBy(*by).orderBy(column)), "n": F.count("*").over(Window.partitionBy(*by))})
    rank = F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("n") / 100))
    return rows.where(F.col("rn") == rank).select(*by, F.col(column).alias("value"))


def first_mode(df: DataFrame, by: list[str], column: str, pos: str) -> DataFrame:
    """The most frequent value; of equally frequent ones the first met."""
    counts = df.groupBy(*by, column).agg(F.count("*").alias("n"), F.min(pos).alias("first"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), "first")
    return counts.withColumn("rn", F.row_number().over(w)).where("rn = 1").select(*by, F.col(column).alias("mode"))


def correlations(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Pearson, and Spearman on average ranks, by group."""

    def ranks(c):
        w = Window.partitionBy(*by)
        return F.rank().over(w.orderBy(c)) + (F.count("*").over(Window.partitionBy(*by, c)) - 1) / 2

    ranked = df.withColumns({"rx": ranks(x), "ry": ranks(y)})
    return ranked.groupBy(*by).agg(round_even(F.corr(x, y), 6).alias("pearson"), round_even(F.corr("rx", "ry"), 6).alias("spearman"))


def set_compare(hand: DataFrame, other: DataFrame) -> DataFrame:
    """One row: sizes of two sets of pairs, what both and one alone have, recall, share of new ones."""
    a, b = hand.distinct().withColumn("h", F.lit(1)), other.distinct().withColumn("o", F.lit(1))
    both = a.join(b, hand.columns, "full_outer")
    n = lambda c: F.count_if(c)
    h, o = F.col("h").isNotNull(), F.col("o").isNotNull()
    out = both.agg(n(h).alias("hand"), n(o).alias("other"), n(h & o).alias("both"), n(h & ~o).alias("hand_only"), n(~h & o).alias("other_only"))
    return out.select(
        "*", round_even(F.try_divide("both", "hand"), 4).alias("hand_recall"), round_even(F.try_divide("other_only", "other"), 4).alias("new_share")
    )


def recall_gate(hand: DataFrame, other: DataFrame, least: float = 0.8) -> DataFrame:
    """One row: hand pairs found, recall, passed; no hand pairs pass."""
    n = hand.distinct().agg(F.count("*").alias("hand"))
    met = hand.intersect(other).agg(F.count("*").alias("found"))
    recall = F.when(F.col("hand") == 0, F.lit(1.0)).otherwise(F.col("found") / F.col("hand"))
    return n.crossJoin(met).select("hand", "found", round_even(recall, 6).alias("recall"), (recall >= least).alias("passed"))


def fire_rates(rows: DataFrame, districts: list[int], dqs: list[float]) -> DataFrame:
    """(max_districts, max_dq, fired, total): how often each pair of thresholds would fail.  The thresholds are a short
    list, exploded in each row."""
    pairs = F.array(*[F.struct(F.lit(d).alias("max_districts"), F.lit(q).alias("max_dq")) for d in districts for q in dqs])
    out = rows.select("districts", "dq", F.explode(pairs).alias("t")).select("districts", "dq", "t.*")
    fired = (F.col("districts") > F.col("max_districts")) | (F.col("dq") < -F.col("max_dq"))
    return out.groupBy("max_districts", "max_dq").agg(F.count_if(fired).alias("fired"), F.count("*").alias("total"))


def map_stats(files: DataFrame, arcs: DataFrame) -> DataFrame:
    """(district, files, internal, crossing): arcs inside a district, and with one end in it."""
    at = lambda end: files.select(F.col("file_id").alias(end), F.col("district").alias(f"d_{end}"))
    ends = arcs.join(at("src"), "src").join(at("dst"), "dst")
    inside = F.col("d_src") == F.col("d_dst")
    sides = ends.select(
        F.explode(
            F.when(inside, F.array(F.struct(F.col("d_src").alias("d"), F.lit(1).alias("i"), F.lit(0).alias("x")))).otherwise(
                F.array(F.struct(F.col("d_src").alias("d"), F.lit(0).alias("i"), F.lit(1).alias("x")), F.struct(F.col("d_dst").alias("d"), F.lit(0).alias("i"), F.lit(1).alias("x")))
            )
        ).alias("e")
    )
    sums = sides.groupBy(F.col("e.d").alias("district")).agg(F.sum("e.i").alias("internal"), F.sum("e.x").alias("crossing"))
    sizes = files.groupBy("district").agg(F.count("*").alias("files"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return sizes.join(sums, "district", "left").select("district", "files", zero("internal"), zero("crossing"))


def displacement(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: mean, median and 90th percentile distance of common points (id, x, y), share beyond a tenth."""
    both = before.select("id", F.col("x").alias("xa"), F.col("y").alias("ya")).join(after.select("id", "x", "y"), "id")
    d = F.sqrt(F.pow(F.col("x") - F.col("xa"), F.lit(2.0)) + F.pow(F.col("y") - F.col("ya"), F.lit(2.0)))
    return both.select(d.alias("d")).agg(
        round_even(F.avg("d"), 6).alias("mean"), round_even(F.percentile("d", F.lit(0.5)), 6).alias("median"),
        round_even(F.percentile("d", F.lit(0.9)), 6).alias("p90"), round_even(F.avg((F.col("d") > 0.1).cast("double")), 6).alias("moved"),
    )


def rename_share(before: DataFrame, after: DataFrame, matches: DataFrame) -> DataFrame:
    """Share of matched districts (da, db) whose names (district, name) differ."""
    named = matches.join(before.select(F.col("district").alias("da"), F.col("name").alias("na")), "da").join(
        after.select(F.col("district").alias("db"), F.col("name").alias("nb")), "db"
    )
    return named.agg(F.count("*").alias("matched"), round_even(F.avg((F.col("na") != F.col("nb")).cast("double")), 6).alias("renamed"))


def score_pairs(hand: DataFrame, other: DataFrame, causes: DataFrame | None = None) -> DataFrame:
    """(cause, n): agreed, new, and misses by their cause (a, b, cause), unknown without one."""
    a, b = hand.distinct().withColumn("h", F.lit(True)), other.distinct().withColumn("o", F.lit(True))
    both = a.join(b, ["a", "b"], "full_outer")
    if causes is not None:
        both = both.join(causes, ["a", "b"], "left")
    else:
        both = both.withColumn("cause", F.lit(None).cast("string"))
    kind = F.when(F.col("h") & F.col("o"), "agreed").when(F.col("o"), "new").otherwise(F.coalesce("cause", F.lit("unknown")))
    return both.groupBy(kind.alias("cause")).agg(F.count("*").alias("n"))
