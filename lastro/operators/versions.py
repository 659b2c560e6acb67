"""Which rows are current (WIN-*, SCAN-15, SORT-03, SORT-08, JOIN-12): one window each, with explicit ties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_rows(df: DataFrame, keys: list, order: list, n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key. The filter stands right above the window, so Spark limits groups before the shuffle."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__nth", nth).where(F.col("__nth") <= n).drop("__nth")


def rows_of_first(df: DataFrame, keys: list, order: list) -> DataFrame:
    """WIN-05: every row of the first version of each key, not one of them."""
    rank = F.dense_rank().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def unique_first(df: DataFrame, keys: list, order: list) -> DataFrame:
    """WIN-12: the best row of each key, keys whose best rows tie are left out."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumn("__rank", F.rank().over(w.orderBy(*order))).where("__rank = 1")
    return ranked.withColumn("__n", F.count("*").over(w)).where("__n = 1").drop("__rank", "__n")


def current_values(observations: DataFrame, sources: DataFrame, keys: list, order: list) -> DataFrame:
    """WIN-01 with JOIN-01: observations of active sources, by priority, then ``order``."""
    active = sources.where("active").select("source_id", "priority")
    return first_rows(observations.join(active, "source_id"), keys, [F.col("priority").desc(), *order])


def preferred_pages(pages: DataFrame) -> DataFrame:
    """SCAN-15: native text unless it is blank; then recognised text."""
    order = [(F.trim(F.coalesce("text", F.lit(""))) != "").desc(), (F.col("extractor") == "ocr").asc(), F.col("extractor").asc()]
    return first_rows(pages, ["document_version_id", "page_number"], order)


def capped_top(df: DataFrame, kind: str, owner: str, order: list, per_kind: int, per_owner: int) -> DataFrame:
    """SORT-03: in rank order, at most ``per_owner`` rows of an owner and ``per_kind`` of a kind.

    The same rows as a greedy loop: the owner's counter moves only on rows picked and the kind's cap cuts a prefix.
    """
    return first_rows(first_rows(df, [kind, owner], order, per_owner), [kind], order, per_kind)


def previous(df: DataFrame, keys: list, order: list, columns: list[str], prefix: str = "prev_") -> DataFrame:
    """WIN-08: the columns of the row before, whatever the gap."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumns({f"{prefix}{c}": F.lag(c).over(w) for c in columns})


def in_force(facts: DataFrame, parameters: DataFrame, keys: list[str], on: str, fact_id: str) -> DataFrame:
    """Every parameter whose validity holds the fact's date, both ends included, open where null; matches: how many.

    For facts of which few share a key with many parameters; ``only_in_force`` settles the count without pairs. ``fact_id`` numbers the facts, so that two facts equal in all else are counted apart; the count is by the
    id alone and carries no other column.
    """
    holds = (F.coalesce("valid_from", F.lit("0001-01-01").cast("date")) <= F.col(on)) & (F.col(on) <= F.coalesce("valid_to", F.lit("9999-12-31").cast("date")))
    found = facts.join(parameters, keys).where(holds)
    return found.withColumn("matches", F.count("*").over(Window.partitionBy(fact_id)))


def only_in_force(facts: DataFrame, parameters: DataFrame, keys: list[str], on: str, parameter_id: str) -> DataFrame:
    """JOIN-12: the facts with matches, how many parameters of their key hold on their date, and the id if it is one.

    Validities include both ends and are open where null; one that ends before it begins holds never; null keys and
    dates match nothing. ``parameter_id`` is a whole number. A sweep: each parameter adds one, and its id, on its first day
    and takes them off after its last; running sums over a key's days give the count on each day and, where that is one, the
    id. Changes and facts are first summed by key and day, so a window holds a row a day of its key however many rows
    the key has, and no fact meets a parameter.
    """
    first = F.coalesce("valid_from", F.lit("0001-01-01").cast("date"))
    number = F.col(parameter_id).cast("decimal(38,0)")
    opens = F.struct(first.alias("day"), F.lit(1).alias("n"), number.alias("ids"))
    closes = F.when(F.col("valid_to") < F.lit("9999-12-31").cast("date"), F.struct(F.date_add("valid_to", 1).alias("day"), F.lit(-1).alias("n"), (-number).alias("ids")))
    valid = parameters.where(F.col("valid_to").isNull() | (F.col("valid_to") >= first)).dropna(subset=keys)
    changes = valid.select(*keys, F.inline(F.array_compact(F.array(opens, closes))))
    asked = facts.select(*keys, F.col(on).alias("day")).dropna().distinct().select(*keys, "day", F.lit(0).alias("n"), F.lit(0).cast("decimal(38,0)").alias("ids"))
    days = changes.unionByName(asked).groupBy(*keys, "day").agg(F.sum("n").alias("n"), F.sum("ids").alias("ids"))
    until = Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = days.select(*keys, F.col("day").alias(on), F.sum("n").over(until).alias("matches"), F.sum("ids").over(until).alias("ids"))
    found = facts.join(held, [*keys, on], "left")
    return found.select(*facts.columns, F.coalesce("matches", F.lit(0)).alias("matches"), F.when(F.col("matches") == 1, F.col("ids")).cast("long").alias(parameter_id))
