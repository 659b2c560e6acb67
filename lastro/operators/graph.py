"""Connected groups and dated relations (RULE-04, JOIN-13, JOIN-16, MATCH-07, MATCH-08)."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage in the folder of spark.checkpoint.dir; one of our own only where that is unset and Spark is one process."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="lastro-checkpoint-"))
    return df.checkpoint()


def connected_groups(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, group_id): the smallest node reachable from each of ``nodes`` over ``links`` (a, b)."""
    return nodes.select("node").distinct().join(linked_groups(links), "node", "left").select("node", F.coalesce("group_id", "node").alias("group_id"))


def linked_groups(links: DataFrame) -> DataFrame:
    """(node, group_id) of the nodes that have a link to another.

    Each round a node takes the least label of its neighbours and then that label's own label, so paths
    halve; rounds are checkpointed and end when no label falls.
    """
    both = checkpointed(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = both.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct()
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        least = labels.join(near, F.col("node") == F.col("a"), "left").select("node", "label", F.least("label", F.coalesce("near", "label")).alias("next"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        moved = checkpointed(least.join(jump, F.col("next") == F.col("via"), "left").select("node", F.least("next", F.coalesce("far", "next")).alias("label"), (F.least("next", F.coalesce("far", "next")) < F.col("label")).alias("fell")))
        labels = moved.select("node", "label")
        if moved.where("fell").isEmpty():
            return labels.select("node", F.col("label").alias("group_id"))


def shared_value_links(df: DataFrame, node: str, keys: list[str]) -> DataFrame:
    """RULE-04: each node linked to the smallest with the same keys: n links for a group of n, never all its pairs.

    The rows are shuffled once, by their keys; only links, which most rows have none of, are shuffled again.
    """
    held = df.select(*keys, F.col(node).alias("a")).dropna()
    return held.withColumn("b", F.min("a").over(Window.partitionBy(*keys))).where("a <> b").select("a", "b").distinct()


def siblings(df: DataFrame, keys: list[str], member: str) -> DataFrame:
    """JOIN-16: (keys, member, n_siblings): the members of every key that has several; any two of a key are siblings."""
    held = df.select(*keys, member).where(F.col(member).isNotNull()).distinct()
    several = held.groupBy(*keys).agg((F.count("*") - 1).alias("n_siblings")).where("n_siblings > 0")
    return held.join(several, keys)


def without_placeholders(series: DataFrame) -> DataFrame:
    """RULE-04: rows (issuer, code, number, isin, date) less those without ISIN whose number has a row with one.

    Of rows of one issuer and ISIN the newest stays, then the smallest code.
    """
    named = series.where("isin <> ''").select("issuer", "number").distinct()
    blank = series.where("isin = ''").join(named, ["issuer", "number"], "left_anti")
    newest = series.where("isin <> ''").groupBy("issuer", "isin").agg(F.min_by(F.struct("code", "number", "date"), F.struct(-F.unix_date("date"), "code")).alias("r"))
    return newest.select("issuer", "r.code", "r.number", "isin", "r.date").unionByName(blank.select("issuer", "code", "number", "isin", "date"))


def alias_groups(series: DataFrame) -> DataFrame:
    """RULE-04: (issuer, code, group_id) from rows (issuer, code, isin): codes of one issuer that share a valid ISIN.

    A group is named by its most frequent code, ties to the smallest. Codes without a link name themselves and take no part.
    """
    coded = series.withColumn("node", F.concat_ws("|", "issuer", "code"))
    links = shared_value_links(coded.where("isin <> ''"), "node", ["issuer", "isin"])
    # by node, so that the join needs no other shuffle
    counted = coded.select("node", "issuer", "code").repartition("node").groupBy("node", "issuer", "code").count()
    linked = checkpointed(counted.join(linked_groups(links), "node"))
    named = linked.groupBy("group_id").agg(F.min_by("code", F.struct(-F.col("count"), "code")).alias("name"))
    names = linked.join(named, "group_id").select("node", "name").distinct()
    return counted.join(names, "node", "left").select("issuer", "code", F.coalesce("name", "code").alias("group_id"))


def active_on(relations: DataFrame, moment: Column) -> DataFrame:
    """JOIN-13: valid at an instant, both ends included, open where null."""
    return relations.where((F.col("valid_from").isNull() | (F.col("valid_from") <= moment)) & (F.col("valid_to").isNull() | (moment <= F.col("valid_to"))))


def first_pairs(parties: DataFrame, a: str, b: str, line: str) -> DataFrame:
    """MATCH-07: the first line of each pair; relations of one with itself are left out."""
    return parties.where(F.col(a) != F.col(b)).groupBy(a, b).agg(F.min(line).alias("first_line"))
