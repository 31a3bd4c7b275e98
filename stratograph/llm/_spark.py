"""Session helpers shared by the operators: the shared scratch folder, tables that cut lineage, id filters.

Scratch tables live under the folder that the session names in ``spark.checkpoint.dir``; executors and the
driver all see it, so a lost executor costs a re-read and never a table.  Only in local mode, where the setting may be
absent (tests), is a folder of this process made, once; a cluster without the setting is an error.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import importable

#: ASCII white space as the contracts define it: space and the controls 9 to 13.
SPACE = r"[\x20\x09-\x0D]+"
#: A word: a run of anything else.
WORD = r"[^\x20\x09-\x0D]+"
#: Largest id list that is sent to every executor: 8 bytes each, 8 MB.
MAX_BROADCAST_IDS = 1_000_000

_own: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir`` of the session, else one made for this application."""
    told = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if told:
        return told.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="stratograph-")
    return _own[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


#: Rows of a scratch file where the number of rows is known.
FILE_ROWS = 25_000


def written(df: DataFrame, name: str, compression: str = "snappy", rows: int | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: the lineage ends there.

    ``rows``: how many there are at most, if that is known; small tables then make few files.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // FILE_ROWS)))
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Delete a table of :func:`written` that no later plan reads."""
    spark = df.sparkSession
    jvm = spark._jvm
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        if folder.toString().split("/")[-2:-1] and scratch_root(spark).split("://")[-1] in folder.toString():
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bound what one Arrow batch holds, so that long texts do not add up in a Python worker, and let workers find the
    operators."""
    importable(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def keep_ids(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """``df`` semi- or anti-joined with a table of ids.

    The ids are counted first: up to ``MAX_BROADCAST_IDS`` they are broadcast, beyond that both sides shuffle.
    """
    ids = ids.select(F.col(ids.columns[0]).alias(key)).distinct()
    return df.join(F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids, key, how)


#: A key with more than one in so many rows, and more than ``LEAST_HOT``, is hot; there are never more hot keys than this.
HOT_PARTS = 10_000
LEAST_HOT = 100


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], count: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined on ``keys`` (without nulls) with ``table``, whose rows have in ``count`` how many of the ``total``
    rows have their key, at most.

    A hot key's rows are dealt to salts, each with a copy of its rows of ``table``, so that no task gets more than a small
    share of all rows for one key.  The list of hot keys is broadcast: ``HOT_PARTS`` at most.  ``table`` is read twice, so
    give a written one.
    """
    share = max(LEAST_HOT, total // HOT_PARTS)
    salts = F.ceil(F.col(count) / F.lit(share)).cast("int")
    hot = table.where(F.col(count) > share).select(*keys, salts.alias("__salts")).distinct()
    salt = F.coalesce(F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("__salts")), F.lit(0)).cast("int")
    rows = rows.join(F.broadcast(hot), keys, "left").withColumn("__salt", salt).drop("__salts")
    table = table.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)))
    return rows.join(table, [*keys, "__salt"], how).drop("__salt")


def ranked(df: DataFrame, *order: Column, name: str = "ranked") -> DataFrame:
    """``df`` with ``rank``: its rows' numbers from 0 in the order given, by ranges and prefix sums over them."""
    ranges = df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id())
    ranges = written(ranges, name)
    # one row for each range
    upto = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranges.groupBy("__range").agg(F.count("*").alias("n"))
    starts = counts.select("__range", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    out = ranges.withColumn("__inside", inside).join(F.broadcast(starts), "__range")
    return out.withColumn("rank", F.col("__start") + F.col("__inside") - 1).drop("__range", "__start", "__inside")


def crc32_of(text: Column) -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; null counts as empty."""
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def let(value: Column, body) -> Column:
    """``body`` of ``value``, with ``value`` evaluated once per row: inside a lambda a plain column reference
    would be inlined and evaluated again for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)
