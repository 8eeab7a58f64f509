"""Table readers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stagekin.schemas import TABLES


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stored table with its fixed schema; files written before a column was added give nulls."""
    return spark.read.schema(TABLES[name]).parquet(f"{root}/{name}")


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def read_jdbc(
    spark: SparkSession, url: str, table: str, partition_column: str, lower: int, upper: int, partitions: int
) -> DataFrame:
    """Parallel read of a table that still lives in a relational database."""
    return (
        spark.read.format("jdbc")
        .option("url", url)
        .option("dbtable", table)
        .option("partitionColumn", partition_column)
        .option("lowerBound", lower)
        .option("upperBound", upper)
        .option("numPartitions", partitions)
        .load()
    )


def where_equal(df: DataFrame, **values) -> DataFrame:
    """Equality filters joined by AND; an unset (falsy) parameter is not applied."""
    tests: list[Column] = [F.col(name) == F.lit(value) for name, value in values.items() if value]
    return df.filter(reduce(Column.__and__, tests)) if tests else df


def startlist(startlists: DataFrame, slug: str, season: int) -> DataFrame:
    return startlists.filter((F.col("race_slug") == slug) & (F.col("season") == season))


def only_url(pages: DataFrame, url: str | None) -> DataFrame:
    """Single-item mode: the job input cut to one URL when one is given."""
    return pages.filter(F.col("url") == url) if url else pages
