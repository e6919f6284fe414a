"""Readers for the Parquet tables an input folder holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def database_table(spark: SparkSession, url: str, query: str, key: str | None = None, parts: int = 16, **options: str) -> DataFrame:
    """The rows of a query in a database, through Spark's JDBC source; the driver has to be on the class path.

    With `key`, a numeric column, the rows come in `parts` ranges of it, so
    that one connection doesn't carry them all.
    """
    reader = spark.read.format("jdbc").options(url=url, **options)
    if key is None:
        return reader.option("query", query).load()
    one = reader.option("query", f"SELECT min({key}) AS low, max({key}) AS high FROM ({query}) q").load().first()
    low, high = (0, 1) if one.low is None else (one.low, one.high + 1)
    return reader.options(dbtable=f"({query}) q", partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts)).load()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table `name` of `folder`, through Spark's own reader (any Hadoop path works)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
