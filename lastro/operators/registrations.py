"""Which registration of an entity is in force, and the classes whose fund has one (RULE-15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Reasons for leaving an entity out, the first that holds.
INVALID_ID, INCONSISTENT, INVALID_DATE, TIE, OTHER_TYPE, FUND_NOT_CHOSEN, CHOSEN = "invalid_id", "inconsistent", "invalid_date", "tie", "other_type", "fund_not_chosen", "chosen"


def current_registrations(rows: DataFrame, key: str, record: str, cancelled: Column, date: Column, consistent: Column, dated: Column, in_scope: Column) -> DataFrame:
    """(key, n_rows, reason, record): the registration in force of each entity that has one in scope; ``record`` is null without a choice.

    Not cancelled comes before cancelled, then the newest date; a null date is the oldest. An entity with any
    inconsistent registration or any invalid date is left out, as is one with several best ones or whose best one is
    of another type. Registrations in scope without a key are rows of their own. A null condition is false.

    Rows are counted by rank before they are brought together by entity, so no entity's rows lie in one task.
    """
    of = lambda c, name: F.coalesce(c, F.lit(False)).alias(name)
    rank = F.struct((~F.coalesce(cancelled, F.lit(False))).alias("open"), F.coalesce(date.cast("string"), F.lit("")).alias("date"))
    found = rows.select(F.col(key), F.col(record).alias("record"), rank.alias("rank"), of(consistent, "consistent"), of(dated, "dated"), of(in_scope, "scoped"))
    ranks = found.where(F.col(key).isNotNull()).groupBy(key, "rank").agg(F.count("*").alias("n"), F.min("record").alias("record"), F.bool_or("scoped").alias("scoped"), F.bool_and("consistent").alias("consistent"), F.bool_and("dated").alias("dated"))
    best = F.max(F.struct("rank", "n", "record", "scoped")).alias("best")
    owners = ranks.groupBy(key).agg(F.sum("n").alias("n_rows"), best, F.bool_or("scoped").alias("scoped"), F.bool_and("consistent").alias("consistent"), F.bool_and("dated").alias("dated")).where("scoped")
    reason = F.when(~F.col("consistent"), INCONSISTENT).when(~F.col("dated"), INVALID_DATE).when(F.col("best.n") > 1, TIE).when(~F.col("best.scoped"), OTHER_TYPE).otherwise(CHOSEN)
    owners = owners.select(key, "n_rows", reason.alias("reason"), F.when(reason == CHOSEN, F.col("best.record")).alias("record"))
    nameless = found.where(F.col(key).isNull() & F.col("scoped")).select(key, F.lit(1).cast("long").alias("n_rows"), F.lit(INVALID_ID).alias("reason"), F.lit(None).cast(dict(rows.dtypes)[record]).alias("record"))
    return owners.unionByName(nameless)


def classes_of_chosen_funds(classes: DataFrame, funds: DataFrame) -> DataFrame:
    """(class_id, fund_id, reason, differs): a class counts only if its fund was chosen; ``differs``: their scopes do.

    classes: class_id, fund_id, scope; funds: fund_id, scope, one row a fund. A class without a fund is left out.
    """
    owners = funds.select(F.col("fund_id").alias("owner"), F.col("scope").alias("owner_scope"))
    joined = classes.join(owners, F.col("fund_id") == F.col("owner"), "left")
    missing = F.col("owner").isNull()
    return joined.select("class_id", "fund_id", F.when(missing, FUND_NOT_CHOSEN).otherwise(CHOSEN).alias("reason"), (~missing & ~F.col("scope").eqNullSafe(F.col("owner_scope"))).alias("differs"))
