"""District names from directory segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import STOP_SEGMENTS, segments

COMMON_SHARE, MIN_SCORE, SECOND_SHARE, MAX_NAME = 0.6, 0.08, 0.55, 32


def segment_frequency(files: DataFrame) -> DataFrame:
    """(segment, df): files that have a directory segment."""
    return files.select(F.explode(F.array_distinct(segments(F.col("path")))).alias("segment")).groupBy("segment").agg(F.count("*").alias("df"))


def ranked_terms(files: DataFrame) -> DataFrame:
    """(district, segment, score, rank): depth-weighted inverse document frequency of the segments of each district;
    stop words and segments in over 60 % of all files do not count."""
    total = files.count()
    parts = F.filter(segments(F.col("path")), lambda s: ~s.isin(STOP_SEGMENTS))
    spots = files.select("district", "path", F.posexplode(parts).alias("depth", "segment"))
    scored = spots.join(segment_frequency(files), "segment").where(F.col("df") <= COMMON_SHARE * total)
    each = F.lit(1.0) / (1.0 + F.col("depth") * 0.4) * F.log(F.lit(float(total + 1)) / (F.col("df") + 1))
    sums = scored.groupBy("district", "segment").agg(F.sum(each).alias("raw"), F.min(F.struct("path", "depth")).alias("first"))
    sums = sums.where(F.col("raw") > MIN_SCORE).withColumn("score", F.rint(F.col("raw") * 1e6) / 1e6)
    order = Window.partitionBy("district").orderBy(F.desc("score"), "first.path", "first.depth")
    return sums.select("district", "segment", "score", F.row_number().over(order).alias("rank"))


def filename_words(files: DataFrame, pairs: DataFrame) -> DataFrame:
    """(district, other, word, score, rank): words of a district's file names that tell it from the other one of the same
    name: longer than three letters, in two of its files and 30 % of them at least; by the inverse document frequency
    over the files of both, then by word.  ``pairs``: district, other."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    parts = F.split(F.lower(F.regexp_replace(stem, r"([a-z0-9])([A-Z])", "$1 $2")), r"[^a-z0-9]+")
    words = files.select("district", "path", F.explode(F.array_distinct(F.filter(parts, lambda w: F.length(w) > 3))).alias("word"))
    sizes = files.groupBy("district").agg(F.count("*").alias("size"))
    counts = words.groupBy("district", "word").agg(F.count("*").alias("n"))
    own = pairs.join(counts, "district").join(sizes, "district")
    there = counts.select(F.col("district").alias("other"), "word", F.col("n").alias("m"))
    out = own.join(there, ["other", "word"], "left").join(sizes.select(F.col("district").alias("other"), F.col("size").alias("others")), "other")
    enough = F.col("n") >= F.greatest(F.lit(2.0), 0.3 * F.col("size"))
    score = F.col("n") / F.col("size") * F.log((F.col("size") + F.col("others") + 1) / (F.col("n") + F.coalesce("m", F.lit(0)) + F.lit(1.0)))
    out = out.where(enough).withColumn("score", F.rint(score * 1e6) / 1e6)
    order = Window.partitionBy("district", "other").orderBy(F.desc("score"), "word")
    return out.select("district", "other", "word", "score", F.row_number().over(order).alias("rank"))


def proposed_names(ranked: DataFrame) -> DataFrame:
    """(district, name): the first term, and the second if it scores over 0.55 of it; 32 characters at most."""
    first = ranked.where("rank = 1").select("district", F.col("segment").alias("s1"), F.col("score").alias("v1"))
    second = ranked.where("rank = 2").select("district", F.col("segment").alias("s2"), F.col("score").alias("v2"))
    both = first.join(second, "district", "left")
    name = F.when(F.col("v2") > SECOND_SHARE * F.col("v1"), F.concat_ws(" & ", "s1", "s2")).otherwise(F.col("s1"))
    return both.select("district", F.substring(name, 1, MAX_NAME).alias("name"))


def unique_names(ranked: DataFrame, sizes: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """(district, name): districts that hold a name already (district, name) keep it; then the largest district of a name
    has it, and others take their next term that no name has yet, and a number last.  The ranked terms of all districts come to the driver: a map has some hundred districts."""
    terms: dict = {}
    for r in ranked.orderBy("district", "rank").collect():
        terms.setdefault(r["district"], []).append(r["segment"])
    names = {r["district"]: r["name"] for r in proposed_names(ranked).collect()}
    order = [r["district"] for r in sizes.orderBy(F.desc("size"), "district").collect()]
    out = [(r["district"], r["name"]) for r in held.collect()] if held is not None else []
    taken, done = {n for _, n in out}, {d for d, _ in out}
    for d in (d for d in order if d not in done):
        base = names.get(d) or f"district {d}"
        tries = [base] + [f"{base} / {t}"[:MAX_NAME] for t in terms.get(d, []) if t not in base.split(" & ")]
        name = next((t for t in tries if t not in taken), None)
        k = 2
        while name is None or name in taken:
            name, k = f"{base} {k}", k + 1
        taken.add(name)
        out.append((d, name))
    return sizes.sparkSession.createDataFrame(out, f"district {sizes.schema['district'].dataType.simpleString()}, name string")
