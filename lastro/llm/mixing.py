"""Mixing sources to target weights by weighted fair queueing.

Each source queues its shuffled documents, up to ``EPOCHS`` times over. A document's virtual finish time is
the words its source has sent by then over the source's target. All documents are sorted by finish time over
range partitions and taken until the budget is spent. Running totals are sums within a range partition, plus
what the partitions before it hold, so no source and no queue is summed by one task.

The shuffle is by the md5 of seed, id and text: reruns agree, whatever the partitions.

Defined results: a null text has size 0; a null source is a source of its own, the last; a document of
size 0 takes part and is given 0 words; repeated rows are documents of their own, equal in all that orders
them, so it doesn't matter which of them is taken; equal finish times go by source, then hash; an empty
table gives an empty one; other columns keep their values, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2
SEED = 90_210


def source_targets(sizes: DataFrame, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(source_key, source_size, target) from (source_key, source, size): one row a source.

    Targets are the smaller of ``epochs`` x size and level x weight, at the level whose targets add up to the budget.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    found = sizes.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    found = found.withColumn("weight", weight).withColumn("cap", F.col("source_size") * float(epochs)).withColumn("budget", F.sum("source_size").over(Window.partitionBy()) * share)
    up = Window.orderBy(F.col("cap") / F.col("weight"), "source_key")
    before, on = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(on)
    found = found.withColumn("level", level).withColumn("at", F.row_number().over(up))
    reached = F.when(F.col("level") <= F.col("cap") / F.col("weight") * (1 + 1e-12), F.col("at"))
    first = F.min_by(F.when(reached.isNotNull(), F.col("level")), reached).over(Window.partitionBy())
    return found.select("source_key", "source_size", F.least("cap", first * F.col("weight")).alias("target"))


def running_sum(rows: DataFrame, within: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``rows`` with ``name``: the sum of ``value`` up to and with each row, in ``order`` among rows of equal ``within``."""
    parts = stage(rows.repartitionByRange(*within, *order).withColumn("part", F.spark_partition_id()), "mix-ranges")
    sums = parts.groupBy(*within, "part").agg(F.sum(value).alias("here"))
    before = (Window.partitionBy(*within) if within else Window.partitionBy()).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*within, "part", F.coalesce(F.sum("here").over(before), F.lit(0)).alias("offset"))  # a row for each range partition and group
    here = Window.partitionBy(*within, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return parts.withColumn(name, F.sum(value).over(here)).join(offsets, [*within, "part"]).withColumn(name, F.col(name) + F.col("offset")).drop("part", "offset")


def mix(docs: DataFrame, row: str | None = None, text: str = "text", doc_id: str = "doc_id", source: str = "source", share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """(row, doc_id, source, mix_size, mix_source_size, mix_target, mix_copies): how often each document is taken, 0 to ``epochs``.

    ``row``: a column that numbers the rows of ``docs``; they are numbered here if there is none.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("-"))
    order = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit("|"), F.coalesce(text, F.lit(""))))
    number = F.monotonically_increasing_id() if row is None else F.col(row)
    sized = stage(docs.select(number.alias("row"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), key.alias("source_key"), word_count(F.col(text)).alias("mix_size"), order.alias("order")), "mix-sizes")
    targets = source_targets(sized.groupBy("source_key", "source").agg(F.sum("mix_size").alias("size")), share, epochs)
    targets = stage(targets.select("source_key", F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target")), "mix-targets")
    sent = running_sum(sized.select("row", "source_key", "mix_size", "order"), ["source_key"], ["order", "row"], "mix_size", "sent").join(targets, "source_key")
    queue = sent.where("mix_size > 0 and mix_target > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    queue = queue.select("row", "source_key", "order", F.col("mix_size").alias("size"), ((F.col("sent") + F.col("epoch") * F.col("mix_source_size")) / F.col("mix_target")).alias("finish"))
    budget = targets.agg(F.sum("mix_target")).first()[0] or 0.0
    spent = running_sum(queue, [], ["finish", "source_key", "order", "row"], "size", "spent")
    taken = spent.where(F.col("spent") <= F.lit(budget * (1 + 1e-9))).groupBy("row").agg(F.count("*").cast("int").alias("copies"))
    found = sized.drop("order").join(taken, "row", "left").join(targets, "source_key")
    return found.select("row", "doc_id", "source", "mix_size", "mix_source_size", "mix_target", F.coalesce("copies", F.lit(0)).alias("mix_copies"))


def mixed_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", **options) -> DataFrame:
    """The documents taken, each as often as it is taken, with the columns of ``docs``."""
    rows = stage(docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("record")), "mix-rows")
    plain = rows.select("row", *[F.col(f"record.`{c}`").alias(name) for c, name in ((text, "text"), (doc_id, "doc_id"), (source, "source"))])
    taken = mix(plain, "row", **options).where("mix_copies > 0").select("row", "mix_copies")
    copies = F.explode(F.sequence(F.lit(1), F.col("mix_copies")))
    return rows.join(taken, "row").select("record", copies).select("record.*")


def mix_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row."""
    return mix(docs).select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


#: The same rows in DuckDB: the sums need no ranges there.
SQL = rf"""
with sized as (
    select row_number() over () as rn, doc_id, source, coalesce('=' || source, '-') as source_key,
        coalesce(len(regexp_extract_all(text, '[^ 	-
]+')), 0)::bigint as size,
        md5('{SEED}|' || coalesce(doc_id::varchar, '') || '|' || coalesce(text, '')) as ord
    from documents),
sources as (select source_key, source, sum(size)::bigint as source_size from sized group by 1, 2),
weighed as (
    select *, (([3.0, 1.0, 2.0])[(row_number() over (order by source is null, source) - 1) % 3 + 1])::double as weight,
        source_size * {float(EPOCHS)}::double as cap, sum(source_size) over () * {SHARE}::double as budget from sources),
levels as (
    select *, (budget - coalesce(sum(cap) over (order by cap / weight, source_key rows between unbounded preceding and 1 preceding), 0.0))
        / sum(weight) over (order by cap / weight, source_key rows between current row and unbounded following) as level,
        row_number() over (order by cap / weight, source_key) as place from weighed),
targets as (
    select source_key, source_size, least(cap, (select level from levels where level <= cap / weight * (1 + 1e-12::double) order by place limit 1) * weight) as target from levels),
queued as (
    select s.*, t.source_size, t.target, sum(size) over (partition by s.source_key order by ord, rn rows between unbounded preceding and current row) as sent
    from sized s join targets t using (source_key)),
finished as (
    select rn, size, source_key, ord, ((sent + e * source_size)::double) / target as finish
    from queued, (select unnest(range({EPOCHS})) as e) where size > 0 and target > 0),
spent as (
    select rn, size, sum(size) over (order by finish, source_key, ord, rn rows between unbounded preceding and current row) as spent from finished),
taken as (
    select rn, sum(size)::bigint as taken from spent where spent <= (select sum(target) from targets) * (1 + 1e-9::double) group by rn)
select doc_id, size, source_size, target, coalesce(taken, 0)::bigint as taken from queued left join taken using (rn)
"""
