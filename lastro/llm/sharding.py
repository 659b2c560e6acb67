"""Two-pass external shuffle into shards, with DataFrame functions only.

Pass one scatters the records over memory-sized buckets by a seeded hash of their place in the input; pass two
shuffles each bucket (``shuffle`` is Spark's seeded Fisher-Yates) and writes it. A bucket is one partition, of
its own number, from which ``shuffle`` takes its seed: so the result depends on the records' places and the
seed, not on how many partitions other shuffles have. A record's place in the global order is its bucket's
offset plus its place in the bucket; places are dealt to the shards in turn, so counts are at most one apart
(law ``rows``) and slots have no gap.

Defined results: a null text has size 1 (its end alone) and the crc32 of no bytes; repeated rows, null
ids and equal texts are records like any other and are spread by their place in the input, so no key
fills a bucket; an empty table gives an empty one; columns of any name are kept.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

SHARDS = 8
SEED = 20_240_229
BUCKET_BYTES = 16 << 20
#: Buckets whose offsets are summed by one task.
RANGE = 4096


def shuffle_to_shards(records: DataFrame, shards: int = SHARDS, text: str = "text", seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``records`` in a uniformly random order as (record struct, size, text_crc32, shard, slot), written and read again."""
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    total = records.agg(F.sum(size)).first()[0] or 0
    buckets = max(1, math.ceil(total / bucket_bytes))
    place = F.xxhash64(F.lit(seed), F.monotonically_increasing_id())
    row = F.struct(place.alias("place"), size.alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"), F.struct(*[F.col(f"`{c}`") for c in records.columns]).alias("record"))
    bucket = F.pmod(F.xxhash64("row.place"), F.lit(buckets)).cast("int")
    scattered = records.select(row.alias("row")).withColumn("bucket", bucket).repartitionById(buckets, "bucket")
    in_order = lambda a, b: F.when(a["place"] < b["place"], -1).when(a["place"] > b["place"], 1).otherwise(0)
    shuffled = scattered.groupBy("bucket").agg(F.shuffle(F.array_sort(F.collect_list("row"), in_order), seed).alias("rows"))
    written = stage(shuffled.select("bucket", F.posexplode("rows").alias("at", "row")).select("bucket", "at", "row.size", "row.text_crc32", "row.record"), "shuffled")
    place = F.col("offset") + F.col("at")
    return written.join(bucket_offsets(written), "bucket").select("record", "size", "text_crc32", F.pmod(place, F.lit(shards)).cast("int").alias("shard"), F.floor(place / shards).alias("slot"))


def bucket_offsets(written: DataFrame) -> DataFrame:
    """(bucket, offset): the records in the buckets before, summed in ranges of ``RANGE`` buckets and over the ranges."""
    counts = written.groupBy("bucket").count().withColumn("range", F.floor(F.col("bucket") / RANGE))
    here = Window.partitionBy("range").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    ranges = counts.groupBy("range").agg(F.sum("count").alias("held")).select("range", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"))
    within = counts.withColumn("within", F.coalesce(F.sum("count").over(here), F.lit(0)))
    return within.join(ranges, "range").select("bucket", (F.col("start") + F.col("within")).alias("offset"))


def write_shards(records: DataFrame, path: str, **options) -> None:
    """The shuffled records as Parquet, one folder a shard, its files in order of their slots.

    Files are ranges of (shard, slot), so a shard is written by as many tasks as it has ranges.
    """
    found = shuffle_to_shards(records, **options).select("record", "shard", "slot")
    found = found.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    found.write.partitionBy("shard").parquet(path)


def shard_digest(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for every row."""
    found = shuffle_to_shards(docs, shards)
    return found.select(F.col("record.doc_id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
