"""Instruments as several providers describe them, each with a priority (MATCH-10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def search_outcomes(asked: DataFrame, results: DataFrame) -> DataFrame:
    """(query, outcome, key, row): ``found`` with its one candidate, ``ambiguous`` or ``not_found``.

    results: query, priority, provider, asset_code, isin and whatever else a provider knows. A candidate is what has
    one code, or one ISIN where it has no code; rows with neither are none. Of a candidate's rows that of the
    highest priority is taken whole, of equal ones that of the last provider by name.
    """
    key = F.coalesce(F.nullif("asset_code", F.lit("")), F.nullif("isin", F.lit("")))
    held = results.withColumn("key", key).where("key is not null")
    whole = F.struct(*[F.col(c) for c in results.columns])
    candidates = held.groupBy("query", "key").agg(F.max_by(whole, F.struct("priority", "provider")).alias("row"))
    single = candidates.groupBy("query").agg(F.count("*").alias("n"), F.min_by(F.struct("key", "row"), "key").alias("c"))
    found = asked.select("query").distinct().join(single, "query", "left")
    outcome = F.when(F.col("n").isNull(), "not_found").when(F.col("n") > 1, "ambiguous").otherwise("found")
    return found.select("query", outcome.alias("outcome"), F.when(F.col("n") == 1, F.col("c.key")).alias("key"), F.when(F.col("n") == 1, F.col("c.row")).alias("row"))


def merged(asked: DataFrame, results: DataFrame, described: DataFrame, fields: Sequence[str], lists: Sequence[str]) -> DataFrame:
    """(query, outcome, key, fields, lists) of each query: the candidate and what providers know of its code.

    described: asset_code, priority, provider, fields and lists. A field has the value of the highest priority that has
    one, the candidate's own is the lowest; lists are joined, the candidate's first, then by rising priority. Queries that
    are not found or ambiguous have null fields and lists.
    """
    found = search_outcomes(asked, results)
    own = found.where("outcome = 'found'").select("query", "row")
    code = F.col("row.asset_code")
    known = [*fields, *lists]
    rank = lambda mine, priority, provider: F.struct(F.lit(mine).alias("later"), priority.alias("priority"), provider.alias("provider")).alias("rank")
    base = own.select("query", rank(0, F.lit(0).cast("long"), F.lit("")), *[F.col(f"row.{c}").alias(c) for c in known])
    added = own.select("query", code.alias("asset_code")).join(described, "asset_code").select("query", rank(1, F.col("priority").cast("long"), F.col("provider")), *known)
    best = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col("rank"))).alias(f) for f in fields]
    # as many entries as providers
    joined = [F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("rank", F.col(c).alias("held"))))), lambda x: x["held"])).alias(c) for c in lists]
    return found.select("query", "outcome", "key").join(base.unionByName(added).groupBy("query").agg(*best, *joined), "query", "left")
