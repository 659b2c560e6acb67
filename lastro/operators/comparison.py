"""Comparisons of two states of the same keys (CMP-*, SET-*, JOIN-09, JOIN-20, MATCH-04)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell_status(stored: DataFrame, new: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """CMP-01: equal, changed, new or vanished for every key of either side."""
    both = stored.withColumn("__o", F.lit(1)).alias("o").join(new.withColumn("__n", F.lit(1)).alias("n"), keys, "full_outer")
    old, now = F.col(f"o.{value}"), F.col(f"n.{value}")
    status = F.when(F.col("__o").isNull(), "new").when(F.col("__n").isNull(), "vanished").when(old.eqNullSafe(now), "equal").otherwise("changed")
    return both.select(*keys, old.alias("old_value"), now.alias("new_value"), status.alias("status"))


def restated(history: DataFrame, new: DataFrame, keys: list[str], order: str, value: str = "value") -> DataFrame:
    """CMP-02: against the latest value and the older ones: equal, changed, new, returns or vanished."""
    past = history.groupBy(*keys).agg(F.max_by(value, order).alias("latest"), F.collect_set(value).alias("older"))
    both = past.alias("o").join(new.withColumn("__n", F.lit(1)).alias("n"), keys, "full_outer")
    now = F.col(f"n.{value}")
    status = (
        F.when(F.col("__n").isNull(), "vanished")
        .when(F.col("older").isNull(), "new")
        .when(now.eqNullSafe(F.col("latest")), "equal")
        .when(F.array_contains("older", now), "returns")
        .otherwise("changed")
    )
    return both.select(*keys, "latest", now.alias("new_value"), status.alias("status"))


#: Why a stored cell is missing, and what happened to a party.
EMPTY_CELL, NO_ROW = "vazias", "sem_linha"
PARTY = {"equal": "igual", "returns": "volta", "name": "nome_alterado", "share": "percentual_alterado", "swapped": "cnpj_trocado", "new": "entrou", "gone": "saiu"}


def restated_cells(history: DataFrame, new: DataFrame, rows: DataFrame, subject: list[str], keys: list[str], order: str, value: str = "value") -> DataFrame:
    """CMP-02 whole: ``restated`` with the reason of each vanished cell: its subject has a row among ``rows``, or none."""
    found = restated(history, new, [*subject, *keys], order, value)
    present = rows.select(*subject).distinct().withColumn("__row", F.lit(True))
    reason = F.when(F.col("status") == "vanished", F.when(F.col("__row"), EMPTY_CELL).otherwise(NO_ROW))
    return found.join(present, subject, "left").withColumn("reason", reason).drop("__row")


def party_changes(history: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """CMP-03: (keys, status) of each position: equal, back to an older party, name, share or identifier changed, entered, left.

    Rows: keys, cnpj, name, share. The identifier decides before the name, and the name before the share.
    """
    whole = F.struct("cnpj", "name", "share")
    past = history.groupBy(*keys).agg(F.max_by(whole, order).alias("was"), F.collect_set(whole).alias("older"))
    both = past.join(new.select(*keys, whole.alias("now")), keys, "full_outer")
    differs = lambda c: ~F.col(f"was.{c}").eqNullSafe(F.col(f"now.{c}"))
    status = (
        F.when(F.col("now").isNull(), PARTY["gone"])
        .when(F.col("was").isNull(), PARTY["new"])
        .when(F.col("was") == F.col("now"), PARTY["equal"])
        .when(F.array_contains("older", F.col("now")), PARTY["returns"])
        .when(differs("cnpj"), PARTY["swapped"])
        .when(differs("name"), PARTY["name"])
        .otherwise(PARTY["share"])
    )
    return both.select(*keys, status.alias("status"))


def period_change(before: Column, after: Column, scale_known: Column, numeric: Column) -> dict[str, Column]:
    """CMP-04: status, absolute and relative change, decided in this order: one side, scale, numbers, texts."""
    a, b = before.try_cast("decimal(28,8)"), after.try_cast("decimal(28,8)")
    status = (
        F.when(before.isNull() | after.isNull(), "only_one_side")
        .when(~scale_known, "excluded_scale_unknown")
        .when(numeric, F.when(a == b, "unchanged").otherwise("changed"))
        .otherwise(F.when(before == after, "unchanged").otherwise("state_changed"))
    )
    changed = (status == "changed") | (status == "unchanged")
    return {"status": status, "absolute": F.when(changed & numeric, b - a), "relative": F.when(changed & numeric, F.bround(F.try_divide(b - a, a).cast("double"), 6))}


def membership(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """SET-02, SET-03: every key with both, new or gone, in one shuffle."""
    tagged = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r")))
    held = tagged.groupBy(key).agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return held.select(key, F.when(F.col("l") + F.col("r") == 2, "both").when(F.col("r") == 1, "new").otherwise("gone").alias("status"))


def relation_outcomes(stored: DataFrame, read: DataFrame, keys: list[str], complete: bool) -> DataFrame:
    """MATCH-04: created, kept, reopened, closed or left open; only a complete snapshot closes a relation."""
    both = stored.alias("o").join(read.withColumn("__n", F.lit(1)).alias("n"), keys, "full_outer")
    open_, closed = F.col("o.status") == "active", F.col("o.status") == "closed"
    seen = F.col("__n").isNotNull()
    outcome = (
        F.when(F.col("o.status").isNull(), "created")
        .when(seen & open_, "kept")
        .when(seen & closed, "reopened")
        .when(open_ & F.lit(complete), "closed")
        .when(open_, "left_open")
        .otherwise("unchanged")
    )
    return both.select(*keys, outcome.alias("outcome"))


def token_relation(a: Column, b: Column) -> Column:
    """SET-07: equal, subset, disjoint or overlapping sets of tokens."""
    common = F.size(F.array_intersect(a, b))
    return (
        F.when((F.size(F.array_except(a, b)) == 0) & (F.size(F.array_except(b, a)) == 0), "equal")
        .when((F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0), "subset")
        .when(common == 0, "disjoint")
        .otherwise("overlap")
    )
