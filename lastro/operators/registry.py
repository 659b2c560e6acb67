"""The registry of funds and classes as it stands: which run speaks for it, who is in it, who belongs to whom (SCAN-17)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import active_on

#: Why a run is incomplete, in the order in which it is checked.
REASONS = ("status_nao_success", "fonte_diferente", "membro_ausente", "membro_nao_processado", "line_count_nulo")


def incomplete_reasons(runs: DataFrame, members: DataFrame, source: str, wanted: Sequence[str]) -> DataFrame:
    """``runs`` with reason: the first check that fails, null for a complete run.

    runs: run_id, status, source; members: run_id, member, status, line_count, any number a member. Every run is held
    against every wanted member, so a member that left no row at all is seen. A member is processed if one of
    its rows is, and counted if one of those has a line count.
    """
    processed = F.col("m.status") == "processed"
    grid = runs.select("run_id", F.explode(F.array(*[F.lit(m) for m in wanted])).alias("member"))
    seen = members.where(F.col("member").isin(*wanted)).alias("m").groupBy("run_id", "member").agg(F.count_if(processed).alias("n"), F.count(F.when(processed, F.col("m.line_count"))).alias("counted"))
    checks = grid.join(seen, ["run_id", "member"], "left").groupBy("run_id").agg(
        F.bool_or(F.col("n").isNull()).alias("absent"), F.bool_or(F.col("n") == 0).alias("unprocessed"), F.bool_or((F.col("n") > 0) & (F.col("counted") == 0)).alias("uncounted")
    )
    conditions = (~F.col("status").eqNullSafe("success"), ~F.col("source").eqNullSafe(source), F.col("absent"), F.col("unprocessed"), F.col("uncounted"))
    reason = reduce(lambda rest, c: F.when(c[0], c[1]).otherwise(rest), reversed(list(zip(conditions, REASONS, strict=True))), F.lit(None).cast("string"))
    return runs.join(checks, "run_id", "left").withColumn("reason", reason).drop("absent", "unprocessed", "uncounted")


def chosen_runs(runs: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Of runs with reason and started_at the newest complete one of each key; where none is complete, the newest. No keys: one row."""
    newest = F.struct(F.col("reason").isNull(), "started_at", "run_id")
    return runs.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in runs.columns if c not in keys]), newest).alias("r")).select(*keys, "r.*").where("run_id is not null")


def newest_reference(observations: DataFrame, field: str) -> DataFrame:
    """The rows of the newest reference date that has ``field``: a filter by one value, which reaches the scan."""
    newest = observations.where(F.col("field") == field).agg(F.max("reference")).scalar()
    return observations.where(F.col("reference") == newest)


def class_owners(funds: DataFrame, classes: DataFrame, with_data: DataFrame) -> DataFrame:
    """(class_id, cnpj, fund_id, kind): each class with data and the fund that has its identifier.

    funds: fund_id, cnpj; classes: class_id, fund_id, cnpj; with_data: kind (``fund`` or ``class``), id. kind: ``only_class``
    where no fund has the identifier, ``fund_without_data``, ``same_cnpj`` for the class's own fund, else
    ``other_fund_cnpj``. Of funds with one identifier the largest id counts.
    """
    held = lambda kind, name: with_data.where(F.col("kind") == kind).select(F.col("id").alias(name)).distinct()
    owners = funds.groupBy("cnpj").agg(F.max("fund_id").alias("owner")).join(held("fund", "owner").withColumn("has_data", F.lit(True)), "owner", "left")
    joined = classes.join(held("class", "class_id"), "class_id", "left_semi").join(owners, "cnpj", "left")
    kind = F.when(F.col("owner").isNull(), "only_class").when(F.col("has_data").isNull(), "fund_without_data").when(F.col("owner") == F.col("fund_id"), "same_cnpj").otherwise("other_fund_cnpj")
    return joined.select("class_id", "cnpj", F.col("owner").alias("fund_id"), kind.alias("kind"))


def subjects(observations: DataFrame, funds: DataFrame, classes: DataFrame, own: dict[str, str], of_class: dict[str, str]) -> DataFrame:
    """(source, source_id, cnpj, a sorted set of values for each name): funds with data, and classes that have no fund.

    observations: kind (``fund`` or ``class``), id, field, value, of one reference; blank values are none but their row is data. ``own`` names the
    fields of the subject itself: a fund's are those of funds, a class's those of classes; ``of_class`` fields that a fund takes
    from its classes and a class from itself.
    """
    with_data = observations.select("kind", "id").distinct()
    owners = class_owners(funds, classes, with_data)
    joins = owners.where(F.col("kind").isin("same_cnpj", "other_fund_cnpj")).select("class_id", "fund_id")
    alone = owners.where("kind = 'only_class'").select("class_id", "cnpj")
    value = F.nullif(F.trim("value"), F.lit(""))
    rows = observations.select("kind", "id", "field", value.alias("value"))
    base = funds.join(with_data.where("kind = 'fund'").select(F.col("id").alias("fund_id")), "fund_id", "left_semi").select(F.lit("fund").alias("source"), F.col("fund_id").alias("source_id"), "cnpj")
    base = base.unionByName(alone.select(F.lit("class").alias("source"), F.col("class_id").alias("source_id"), "cnpj"))
    own_rows = rows.where(F.col("field").isin(*own.values())).select(F.col("kind").alias("source"), F.col("id").alias("source_id"), "field", "value")
    class_rows = rows.where(F.col("field").isin(*of_class.values()) & (F.col("kind") == "class"))
    lent = class_rows.join(joins, F.col("id") == F.col("class_id")).select(F.lit("fund").alias("source"), F.col("fund_id").alias("source_id"), "field", "value")
    kept = class_rows.select(F.lit("class").alias("source"), F.col("id").alias("source_id"), "field", "value")
    values = own_rows.unionByName(lent).unionByName(kept)
    named = {**own, **of_class}
    sets = values.groupBy("source", "source_id").agg(*[F.collect_set(F.when(F.col("field") == f, F.col("value"))).alias(n) for n, f in named.items()])
    none = F.array().cast("array<string>")
    return base.join(sets, ["source", "source_id"], "left").select("source", "source_id", "cnpj", *[F.array_sort(F.coalesce(n, none)).alias(n) for n in named])


def party_links(parties: DataFrame, owners: DataFrame) -> DataFrame:
    """(source, source_id, role, cnpj, name, party_id) of the subjects: a fund has its own parties and those of its classes.

    parties: party_id, kind, id, role, cnpj, name; owners: of ``class_owners``. Parties of classes whose fund has no data are no subject's.
    """
    of_funds = parties.where("kind = 'fund'").select(F.lit("fund").alias("source"), F.col("id").alias("source_id"), "role", "cnpj", "name", "party_id")
    owner = owners.select("class_id", F.col("fund_id").alias("owner"), F.col("kind").alias("owned"))
    of_classes = parties.where("kind = 'class'").join(owner.where("owned <> 'fund_without_data'"), F.col("id") == F.col("class_id"))
    alone = F.col("owned") == "only_class"
    lent = of_classes.select(F.when(alone, "class").otherwise("fund").alias("source"), F.when(alone, F.col("id")).otherwise(F.col("owner")).alias("source_id"), "role", "cnpj", "name", "party_id")
    return of_funds.unionByName(lent)


def relations_of(relations: DataFrame, entity: Column, side: str, kind: str | None = None) -> DataFrame:
    """MATCH-08: relations whose ``side`` (``source`` or ``target``) is the entity, of one kind if that is given; the filter reaches the scan."""
    if side not in ("source", "target"):
        raise ValueError("side is source or target")
    found = relations.where(F.col(f"{side}_id") == entity)
    return found.where(F.col("kind") == kind) if kind else found


def relation_by_key(relations: DataFrame, key: str) -> DataFrame:
    """MATCH-08: the relation of a canonical key, blanks around it ignored; a blank key is an error."""
    if not key.strip():
        raise ValueError("a canonical key is not blank")
    return relations.where(F.col("canonical_key") == key.strip())


def relations_active(relations: DataFrame, moment: Column, kind: str | None = None) -> DataFrame:
    """MATCH-08: relations of status ``active`` that are valid at an instant, of one kind if that is given."""
    found = relations.where("status = 'active'")
    return active_on(found.where(F.col("kind") == kind) if kind else found, moment)
