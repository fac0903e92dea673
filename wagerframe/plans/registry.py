"""Where queries and their SQL twins are declared side by side."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
TWINS: dict[str, str] = {}


def query(name: str, twin: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``twin`` is SQL that must return the same rows."""

    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is declared twice")
        QUERIES[name] = function
        if twin is not None:
            TWINS[name] = twin
        return function

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, key: str, costly: bool = False) -> DataFrame:
    """Give every core work when a file arrives as a few splits.

    A scan has no more tasks with rows than its files have row groups, and one row group may hold a
    million rows. On a local master rows are always dealt out; on a cluster where they are few bytes
    and ``costly`` to work on. There they are dealt by a hash of the key, so that a later join by the
    key shuffles by itself and can split a heavy key. ``wagerframe.spread`` set to false switches both
    off. It never changes rows.
    """
    spark = df.sparkSession
    local = spark.sparkContext.master.startswith("local[")
    if spark.conf.get("wagerframe.spread", str(local or costly).lower()) != "true":
        return df
    cores = spark.sparkContext.defaultParallelism
    if local:
        return df.repartition(cores, key)
    return df.repartition(max(4 * cores, int(spark.conf.get("spark.sql.shuffle.partitions"))), F.xxhash64(key))
