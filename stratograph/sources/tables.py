"""Table access: explicit reads, and cuts of long lineages in the shared checkpoint folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: dict[str, str] = {}


ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver found it, whatever their working folder is."""
    known = spark.sparkContext.environment
    paths = [p for p in known.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        known["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder ``spark.checkpoint.dir``; in local mode, where that may be unset (tests), one of this application."""
    context = spark.sparkContext
    told = context.getConf().get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
    app = context.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="stratograph-")
    return _own[app]


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read again: the lineage ends there, and no stage runs twice."""
    path = f"{scratch_root(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, *order: Column | str, value: str | None = None) -> DataFrame:
    """``df`` with ``place``, its rows' numbers from 0 in a total order, and with ``before``, the sum of ``value`` over the
    rows ahead.  Rows are dealt by ranges of the order, and sums over the ranges, one row each, are put before them: no
    task holds more than a range."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    ranges = checkpointed(df.repartitionByRange(*cols).withColumn("__range", F.spark_partition_id()))
    ahead = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    size = F.sum(value) if value else F.lit(None).cast("long")
    parts = ranges.groupBy("__range").agg(F.count("*").alias("__n"), size.alias("__s"))
    starts = parts.select("__range", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__n0"), F.coalesce(F.sum("__s").over(ahead), F.lit(0)).alias("__s0"))
    inside = Window.partitionBy("__range").orderBy(*cols)
    out = ranges.withColumn("__i", F.row_number().over(inside))
    if value:
        upto = inside.rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("__b", F.coalesce(F.sum(value).over(upto), F.lit(0)))
    out = out.join(F.broadcast(starts), "__range").withColumn("place", F.col("__n0") + F.col("__i") - 1)
    if value:
        out = out.withColumn("before", F.col("__s0") + F.col("__b")).drop("__b")
    return out.drop("__range", "__i", "__n0", "__s0")
