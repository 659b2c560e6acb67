"""Late restatements and sessions as streams (STRM-00): state that no order of arrival changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import new_folder


def restated_state(cells: DataFrame, keys: list[str], value: str, order: str, is_new: Column) -> DataFrame:
    """CMP-02 over a stream or a table: (keys, latest, new_value, status) of rows that are history or the new report (``is_new``).

    A key's state is its newest value of either side and the set of all older values: greatest and union forget neither
    order nor repeats, so rows that come late, out of order or twice end in the state that a batch has.
    """
    old = F.when(~is_new, F.col(order))
    held = cells.groupBy(*keys).agg(
        F.max_by(value, old).alias("latest"), F.collect_set(F.when(~is_new, F.col(value))).alias("older"), F.bool_or(~is_new).alias("has_old"),
        F.max_by(value, F.when(is_new, F.col(order))).alias("new_value"), F.bool_or(is_new).alias("has_new"),
    )
    status = (
        F.when(~F.col("has_new"), "vanished")
        .when(~F.col("has_old"), "new")
        .when(F.col("new_value").eqNullSafe(F.col("latest")), "equal")
        .when(F.coalesce(F.array_contains("older", F.col("new_value")), F.lit(False)), "returns")
        .otherwise("changed")
    )
    return held.select(*keys, "latest", "new_value", status.alias("status"))


def run_updates(changes: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Run a streaming aggregation over what is there now, and the last row of each key.

    Updated rows are written by batch, each batch to a folder of its own that a retry overwrites.
    """
    spark: SparkSession = changes.sparkSession
    path, checkpoint = new_folder(spark, name), new_folder(spark, f"{name}-checkpoint")

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    changes.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    rest = [c for c in changes.columns if c not in keys]
    return spark.read.parquet(path).groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def run_appends(rows: DataFrame, name: str) -> DataFrame:
    """Run a stream in append mode over what is there now, and all its rows."""
    spark: SparkSession = rows.sparkSession
    path = new_folder(spark, name)
    query = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", new_folder(spark, f"{name}-checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(path)
