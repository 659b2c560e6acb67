"""Contract rules over approved facts and parameters (RULE-09, RULE-10).

facts: asset, name, date, value (text), unit, source; parameters: asset, name, value (text), valid_from,
valid_to (both ends included, open where null; those of one name and asset don't overlap); amounts: asset,
month (yyyy-MM), path, value, scale: what the monthly reports in force declare.

Parameters are merged, never broadcast: they are as many as the assets, and a table made of few columns looks smaller to Spark than it is.

Every rule gives (asset, rule, month, instance_key, compliant, value, expected); compliant is null where the
rule's parameter is not in force on the date, which stops nothing but itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import MONEY, UNITS, canonical_decimal

#: What a statement of no payment says; the scale that makes a reported amount unusable.
NO_PAYMENT, UNKNOWN_SCALE = "nenhum", "unknown"
#: The months of a year's two parameters of the guarantee ratio.
EARLY, LATE = "01-08", "09-12"


def _number(text: Column) -> Column:
    return text.try_cast(MONEY)


def _row(rule: dict, month: Column, compliant: Column, value: Column, expected: Column, instance: Column | None = None) -> list[Column]:
    key = F.lit(None).cast("string") if instance is None else instance.cast("string")
    return [F.col("asset"), F.lit(rule["id"]).alias("rule"), month.alias("month"), key.alias("instance_key"), compliant.alias("compliant"), value.cast("string").alias("value"), expected.cast("string").alias("expected")]


def _month(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")


def _together(facts: DataFrame, names: list[str]) -> DataFrame:
    """(asset, date, f0, f1, ...): the first fact of each name (value, unit), of dates that have all names."""
    named = lambda n: F.min_by(F.when(F.col("name") == n, F.struct("value", "unit")), F.when(F.col("name") == n, F.col("source")))
    found = facts.where(F.col("name").isin(*names)).groupBy("asset", "date").agg(*[named(n).alias(f"f{k}") for k, n in enumerate(names)])
    return found.where(reduce(lambda a, b: a & b, [F.col(f"f{k}").isNotNull() for k in range(len(names))]))


def _with_parameter(rows: DataFrame, parameters: DataFrame, name: str, column: str) -> DataFrame:
    """``rows`` (asset, date, ...) with the parameter's value in force on the date, null if there is none."""
    p = parameters.where(F.col("name") == name).select(F.col("asset").alias("p_asset"), _number(F.col("value")).alias(column), "valid_from", "valid_to")
    holds = (F.col("valid_from").isNull() | (F.col("valid_from") <= F.col("date"))) & (F.col("valid_to").isNull() | (F.col("date") <= F.col("valid_to")))
    return rows.join(p.hint("merge"), (F.col("asset") == F.col("p_asset")) & holds, "left").drop("p_asset", "valid_from", "valid_to")


def _sum(names: list[str], factor: Column | None = None) -> Column:
    each = [_number(F.col(f"f{k}.value")) * (F.lit(1) if factor is None else _factor(F.col(f"f{k}.unit"))) for k in range(len(names))]
    return reduce(lambda a, b: a + b, each).cast(MONEY)


def _factor(unit: Column) -> Column:
    known = reduce(lambda c, kv: F.when(unit == kv[0], kv[1]).otherwise(c), UNITS.items(), F.lit(None).cast("int"))
    return F.coalesce(known, F.raise_error(F.concat(F.lit("no conversion of unit "), F.coalesce(unit, F.lit("null")))).cast("int"))


def assignment_minimum(rule: dict, facts: DataFrame, parameters: DataFrame, amounts: DataFrame) -> DataFrame:
    """In the rule's months, the facts of the first variant whose parameter is in force add up to it at least."""
    variants = rule.get("variants") or [{"parameter": rule["parameter"], "facts": [rule["fact"]]}]
    dates = facts.select("asset", "date").distinct().where(F.date_format("date", "MM").isin(*rule["months"]))
    for k, v in enumerate(variants):
        dates = _with_parameter(dates, parameters, v["parameter"], f"minimum{k}")
        have = _together(facts, v["facts"]).select("asset", "date", _sum(v["facts"]).alias(f"value{k}"))
        dates = dates.join(have, ["asset", "date"], "left")
    chosen = F.coalesce(*[F.when(F.col(f"minimum{k}").isNotNull(), F.struct(F.col(f"minimum{k}").alias("minimum"), F.col(f"value{k}").alias("value"))) for k in range(len(variants))])
    found = dates.select("asset", "date", chosen.alias("v")).where("v is null or v.value is not null")
    return found.select(*_row(rule, _month(F.col("date")), F.col("v.value") >= F.col("v.minimum"), canonical_decimal(F.col("v.value")), canonical_decimal(F.col("v.minimum"))))


def guarantee_ratio(rule: dict, facts: DataFrame, parameters: DataFrame, amounts: DataFrame) -> DataFrame:
    """The sum of some facts over another one against the parameter of the year's part."""
    names = [*rule["numerator_facts"], rule["denominator_fact"]]
    found = _together(facts, names).withColumns({"top": _sum(names[:-1]), "below": _number(F.col(f"f{len(names) - 1}.value"))})
    found = _with_parameter(_with_parameter(found, parameters, rule["parameters"][EARLY], "early"), parameters, rule["parameters"][LATE], "late")
    minimum = F.when(F.month("date") <= 8, F.col("early")).otherwise(F.col("late"))
    return found.select(*_row(rule, _month(F.col("date")), F.col("top") >= minimum * F.col("below"), canonical_decimal(F.bround(F.try_divide("top", "below"), 4)), canonical_decimal(minimum)))


def payment_reconciliation(rule: dict, facts: DataFrame, parameters: DataFrame, amounts: DataFrame) -> DataFrame:
    """What was announced in a month against what its report declares, within a tolerance."""
    declared = amounts.where((F.col("path") == rule["informe_path"]) & F.col("value").isNotNull() & (F.col("scale") != UNKNOWN_SCALE) & F.col("month").isin(*rule["coverage_months"]))
    announced = facts.where(F.col("name") == rule["fact"]).groupBy("asset", _month(F.col("date")).alias("month")).agg(F.sum(_number(F.col("value"))).alias("announced"))
    found = declared.select("asset", "month", F.col("value").cast(MONEY).alias("declared")).join(announced, ["asset", "month"], "left").withColumn("announced", F.coalesce("announced", F.lit(0).cast(MONEY)))
    return found.select(*_row(rule, F.col("month"), F.abs(F.col("declared") - F.col("announced")) <= F.lit(rule["tolerance_brl"]).cast(MONEY), canonical_decimal(F.col("announced")), canonical_decimal(F.col("declared"))))


def trustee_statement(rule: dict, facts: DataFrame, parameters: DataFrame, amounts: DataFrame) -> DataFrame:
    """A trustee's statement that nothing was paid in a year against the sum of the year's reports."""
    stated = facts.where((F.col("name") == rule["fact"]) & (F.col("value") == NO_PAYMENT)).select("asset", F.year("date").cast("string").alias("year"), "source")
    usable = amounts.where((F.col("path") == rule["informe_path"]) & (F.col("scale") != UNKNOWN_SCALE))
    paid = usable.groupBy("asset", F.substring("month", 1, 4).alias("year")).agg(F.sum(F.col("value").cast(MONEY)).alias("paid"))
    found = stated.join(paid, ["asset", "year"], "left").withColumn("paid", F.coalesce("paid", F.lit(0).cast(MONEY)))
    return found.select(*_row(rule, F.concat("year", F.lit("-12")), F.col("paid") == 0, canonical_decimal(F.col("paid")), F.lit("0")))


def obligation_deadlines(rule: dict, facts: DataFrame, parameters: DataFrame, amounts: DataFrame) -> DataFrame:
    """Obligations that are proved, overdue or due within ``warn_days`` of the rule's ``today``."""
    out = None
    for item in rule["obligations"]:
        proof, due = item.get("fulfilled_by_fact"), F.coalesce(F.lit(item.get("due")), F.col("value"))
        rows = parameters.where(F.col("name") == item["parameter"]).select("asset", due.alias("due"))
        if isinstance(proof, dict):
            proved = facts.where((F.col("name") == proof["fact"]) & (F.col("date") == F.lit(proof["reference_date"]).cast("date"))).select("asset", F.lit(True).alias("proved")).distinct()
            rows = rows.join(proved, "asset", "left")
        else:
            rows = rows.withColumn("proved", F.lit(None).cast("boolean"))
        days = F.datediff(F.col("due").cast("date"), F.lit(rule["today"]).cast("date"))
        told = F.coalesce("proved", F.lit(False)) | ((days <= rule["warn_days"]) & F.lit(not proof or isinstance(proof, dict)))
        rows = rows.where(told).select(*_row(rule, F.substring("due", 1, 7), F.coalesce("proved", F.lit(False)), days, F.col("due"), F.lit(item["parameter"])))
        out = rows if out is None else out.unionByName(rows)
    return out


def fact_minimum(rule: dict, facts: DataFrame, parameters: DataFrame, amounts: DataFrame) -> DataFrame:
    """The facts' sum, in the parameter's unit, against the least value; an unknown unit is an error."""
    found = _together(facts, rule["facts"])
    if rule.get("months"):
        found = found.where(F.date_format("date", "MM").isin(*rule["months"]))
    found = _with_parameter(found.withColumn("total", _sum(rule["facts"], F.lit(1))), parameters, rule["parameter"], "minimum")
    return found.select(*_row(rule, _month(F.col("date")), F.col("total") >= F.col("minimum"), canonical_decimal(F.col("total")), canonical_decimal(F.col("minimum"))))


def fact_flag(rule: dict, facts: DataFrame, parameters: DataFrame, amounts: DataFrame) -> DataFrame:
    """Facts whose value contradicts an approved obligation of the asset."""
    obliged = parameters.where(F.col("name") == rule["parameter"]).select("asset", F.col("value").alias("obligation")).dropDuplicates(["asset"])
    flagged = F.lower(F.trim("value")).isin(*[v.strip().lower() for v in rule["alert_values"]])
    found = facts.where(F.col("name").isin(*rule["facts"])).join(obliged.hint("merge"), "asset", "left")
    return found.select(*_row(rule, _month(F.col("date")), F.when(F.col("obligation").isNotNull(), ~flagged), F.col("value"), F.col("obligation"), F.col("name")))


def _comparable(text: Column, kind: str) -> Column:
    if kind == "number":
        return canonical_decimal(_number(text))
    if kind == "date":
        return text.try_cast("date").cast("string")
    return F.upper(F.regexp_replace(text, r"\s", ""))


def registry_against_terms(rule: dict, facts: DataFrame, parameters: DataFrame, amounts: DataFrame) -> DataFrame:
    """Registry values of an asset's newest report against the parameters of its contract; without one, none is presumed.

    amounts holds them too, as text, with the series in instance_key; {n} in a parameter's name is the series.
    """
    newest = amounts.groupBy("asset").agg(F.max("month").alias("month"))
    values = amounts.join(newest, ["asset", "month"]).where(F.trim(F.coalesce(F.col("value").cast("string"), F.lit(""))) != "")
    out = None
    for c in rule["comparisons"]:
        series = F.coalesce(F.col("instance_key").cast("string"), F.lit("-"))
        rows = values.where(F.col("path").endswith(c["informe_path"])).select("asset", "month", series.alias("series"), F.col("value").cast("string").alias("reported"))
        if c.get("series"):
            rows = rows.where(F.col("series").isin(*[str(n) for n in c["series"]]))
        rows = rows.withColumns({"name": F.replace(F.lit(c["parameter"]), F.lit("{n}"), F.col("series")), "date": F.last_day(F.to_date("month", "yyyy-MM"))})
        before, after = c["parameter"].partition("{n}")[0], c["parameter"].rpartition("{n}")[2]
        p = parameters.where(F.col("name").startswith(before) & F.col("name").endswith(after)).select("asset", "name", F.col("value").alias("agreed"), "valid_from", "valid_to")
        holds = (F.col("valid_from").isNull() | (F.col("valid_from") <= F.col("date"))) & (F.col("valid_to").isNull() | (F.col("date") <= F.col("valid_to")))
        rows = rows.join(p.hint("merge"), ["asset", "name"]).where(holds)
        a, b = _comparable(F.col("reported"), c["kind"]), _comparable(F.col("agreed"), c["kind"])
        rows = rows.where(a.isNotNull() & b.isNotNull()).select(*_row(rule, F.col("month"), a == b, F.col("reported"), F.col("agreed"), F.concat(F.lit(c["label"] + ":"), "series")))
        out = rows if out is None else out.unionByName(rows)
    return out


#: The types of contract rules.
RULES = {
    "cessao_fiduciaria_minima": assignment_minimum,
    "razao_garantia_minima": guarantee_ratio,
    "payment_reconciliation": payment_reconciliation,
    "trustee_payment_statement": trustee_statement,
    "obligation_deadlines": obligation_deadlines,
    "fact_minimum": fact_minimum,
    "fact_flag": fact_flag,
    "informe_registry_vs_terms": registry_against_terms,
}


def contract_alerts(rules: list[dict], facts: DataFrame, parameters: DataFrame, amounts: DataFrame) -> DataFrame:
    """RULE-10: all rules' rows; a rule of an unknown type is an error before anything runs."""
    unknown = sorted({r["type"] for r in rules} - set(RULES))
    if unknown:
        raise ValueError(f"unknown contract rules: {', '.join(unknown)}")
    return reduce(DataFrame.unionByName, [RULES[r["type"]](r, facts, parameters, amounts) for r in rules])
