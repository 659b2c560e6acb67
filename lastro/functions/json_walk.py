"""Paths and leaves of JSON (JSON-01)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import checkpointed


def json_leaves(rows: DataFrame, text: str) -> DataFrame:
    """The other columns of ``rows`` with path, key, leaf and kind of every leaf of the JSON in ``text``.

    The text is parsed to a VARIANT once; each round opens the objects and arrays of one level, and rounds end when none
    are left, so depth costs rounds, not a limit. path: ``a.b[0].c``; key: the name of the object's entry, null inside an array;
    leaf: text, null for JSON null; kind: the VARIANT's type. Empty objects and arrays have no leaves; a text that is null or no
    JSON has none either; a text that is one scalar is a leaf with the path ''.
    """
    spark = rows.sparkSession
    kept = [c for c in rows.columns if c != text]
    kind = F.schema_of_variant("value")
    nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
    leaf = lambda df: df.select(*kept, "path", "key", F.variant_get("value", "$", "string").alias("leaf"), F.lower(kind).alias("kind"))
    whole = rows.select(*kept, F.lit("").alias("path"), F.lit(None).cast("string").alias("key"), F.try_parse_json(text).alias("value")).where("value is not null")
    found, level = leaf(whole.where(~nested)), whole.where(nested)
    while True:
        opened = level.withColumnRenamed("value", "parent").drop("key").lateralJoin(spark.tvf.variant_explode(F.col("parent").outer()))
        step = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).when(F.col("path") == "", F.col("key")).otherwise(F.concat(F.lit("."), "key"))
        opened = checkpointed(opened.select(*kept, F.concat("path", step).alias("path"), "key", "value"))
        found = found.unionByName(leaf(opened.where(~nested)))
        level = opened.where(nested)
        if level.isEmpty():
            return found
