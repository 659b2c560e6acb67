"""The benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task that sorts or reads texts, about.
TASK_ROWS = 500_000


def parts(df: DataFrame, rows: int = TASK_ROWS) -> int:
    """How many parts of about ``rows`` rows a table of files makes, two a core at least: a task then holds as much of a large table as of a small one.

    Files are counted by what they say of themselves, unread.
    """
    return max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
