"""Every query with SQL gives the same rows in DuckDB."""

import math

import duckdb
import pandas as pd
import pytest

from stratograph.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    columns = sorted(frame.columns)

    def plain(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        if not isinstance(v, list) and pd.isna(v):
            return None
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    return columns, sorted(repr([plain(v) for v in r]) for r in frame[columns].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    return connection


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_as_sql(spark, sf, duck, name):
    ours = rows(catalogue.QUERIES[name](spark, sf).toPandas())
    theirs = rows(duck.execute(catalogue.ORACLES[name]).fetchdf())
    assert ours == theirs


def test_entry_is_stable(spark):
    import __spark_entry__

    one, two = (rows(__spark_entry__.entry(spark).toPandas()) for _ in range(2))
    assert one == two and not math.isnan(len(one[1]))


def test_streams(spark, sf, tmp_path):
    from stratograph.streaming import events

    source = tmp_path / "in"
    spark.read.parquet(f"{sf}/events.parquet").union(spark.read.parquet(f"{sf}/events.parquet").limit(5)).repartition(3).write.parquet(str(source))
    events.run_once(events.deduplicated(events.stream(spark, str(source), 100)), str(tmp_path / "out"), str(tmp_path / "c1"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == spark.read.parquet(f"{sf}/events.parquet").count()
    events.run_once(events.latest_stage(events.stream(spark, str(source))), str(tmp_path / "stages"), str(tmp_path / "c2"), "complete")
    assert spark.read.parquet(str(tmp_path / "stages")).count() == spark.read.parquet(f"{sf}/events.parquet").select("user_id").distinct().count()
