"""Requested ids, audit rows, series proposals, golden sets and asset descriptions (SORT-09, AUD-01, RULE-22, RULE-24, MATCH-13)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def explicit_ids(requested: DataFrame, catalogue: DataFrame, key: str, belongs: Column) -> DataFrame:
    """(key, status) for each distinct trimmed id of ``requested``: ``selected``, ``other_owner`` or ``unknown``. Blank ids are left out."""
    asked = requested.select(F.trim(F.col(key).cast("string")).alias(key)).where(F.col(key) != "").distinct()
    known = catalogue.groupBy(F.col(key).cast("string").alias(key)).agg(F.bool_or(F.coalesce(belongs, F.lit(False))).alias("_own"))
    status = F.when(F.col("_own").isNull(), "unknown").when(F.col("_own"), "selected").otherwise("other_owner")
    return asked.join(known, key, "left").select(key, status.alias("status"))


def audit_rows(before: DataFrame, after: DataFrame, keys: Sequence[str], entity_type: str) -> DataFrame:
    """(keys, entity_type, action, before_json, after_json) for every row that was created, removed or changed; keys are never null."""
    kept = [c for c in before.columns if c not in keys]

    def as_json(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.to_json(F.struct(*kept), {"ignoreNullFields": "false"}).alias(name))

    both = as_json(before, "before_json").join(as_json(after, "after_json"), list(keys), "full").where(~F.col("before_json").eqNullSafe(F.col("after_json")))
    action = F.when(F.col("before_json").isNull(), "create").when(F.col("after_json").isNull(), "remove").otherwise("update")
    return both.select(*keys, F.lit(entity_type.strip().lower()).alias("entity_type"), action.alias("action"), "before_json", "after_json")


def latest_current_report(reports: DataFrame) -> DataFrame:
    """The newest current report of each asset; on equal dates the larger id. Columns asset_id, report_id, reference_date, is_current."""
    newest = F.max_by(F.struct("report_id", "reference_date"), F.struct("reference_date", "report_id"))
    return reports.where("is_current").groupBy("asset_id").agg(newest.alias("r")).select("asset_id", "r.*")


def series_proposals(reports: DataFrame, leaves: DataFrame, fields: dict[str, str], parameters: DataFrame) -> DataFrame:
    """A row for each asset and series instance of its latest current report, the leaf of each path in ``fields`` as a column.

    ``parameters`` (asset_id, instance_key, value) are the approved open ones; where a series has several, ``ambiguous`` is
    true and its value null. Leaf values lose outer blanks; blank ones are null.
    """
    latest = latest_current_report(reports)
    named = leaves.where(F.col("instance_key").isNotNull() & F.col("xml_path").isin(*fields.values())).join(latest, "report_id")
    value = F.nullif(F.trim("raw_text"), F.lit(""))
    columns = [F.max(F.when(F.col("xml_path") == path, value)).alias(name) for name, path in fields.items()]
    series = named.groupBy("asset_id", "report_id", "reference_date", "instance_key").agg(*columns)
    approved = parameters.groupBy("asset_id", "instance_key").agg(F.max("value").alias("_value"), F.count("*").alias("_n"))
    several = F.coalesce(F.col("_n") > 1, F.lit(False))
    out = series.join(approved, ["asset_id", "instance_key"], "left")
    return out.select("asset_id", "report_id", "reference_date", "instance_key", *fields, F.when(~several, F.col("_value")).alias("approved_class"), several.alias("ambiguous"))


def golden_divergences(golden: DataFrame, observed: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(keys, problems): the fields, by name, whose frozen value differs from the observed one; null frozen values aren't compared."""
    seen = observed.select(*keys, *[F.col(f).alias(f"_{f}") for f in fields])
    differs = [F.when(F.col(f).isNotNull() & ~F.col(f).eqNullSafe(F.col(f"_{f}")), F.lit(f)) for f in sorted(fields)]
    return golden.join(seen, list(keys), "left").select(*keys, F.array_compact(F.array(*differs)).alias("problems"))


def golden_coverage(golden: DataFrame, by: Sequence[str], required: Sequence[str], optional: Sequence[str] = ()) -> DataFrame:
    """(by, items, approved, pending, missing, publishable) from items with review_status and case_types.

    Publishable: every item is approved and every required case that isn't optional is covered.
    """
    covers = [F.max(F.array_contains("case_types", c).cast("int")).alias(f"_case{i}") for i, c in enumerate(required)]
    review = lambda s: F.count_if(F.col("review_status") == s)
    sums = golden.groupBy(*by).agg(F.count("*").alias("items"), review("approved").alias("approved"), review("pending").alias("pending"), *covers)
    missing = F.array_compact(F.array(*[F.when(F.coalesce(F.col(f"_case{i}"), F.lit(0)) == 0, F.lit(c)) for i, c in enumerate(required)]))
    needed = F.size(F.array_except(missing, F.array(*map(F.lit, optional)).cast("array<string>"))) == 0
    return sums.select(*by, "items", "approved", "pending", missing.alias("missing"), ((F.col("approved") == F.col("items")) & needed).alias("publishable"))


def describes_asset(text: Column, isin: Column, code: Column) -> Column:
    """The text names the asset: by its ISIN anywhere, else by its code as a word of its own in a text without any ISIN.

    Words are runs of A-Z and 0-9 after upper-casing; other signs count as blanks. Null identifiers never match.
    """
    upper = F.upper(F.coalesce(text, F.lit("")))
    words = F.concat(F.lit(" "), F.regexp_replace(upper, "[^A-Z0-9]", " "), F.lit(" "))
    by_isin = F.coalesce((isin != "") & F.contains(upper, F.upper(isin)), F.lit(False))
    own = F.coalesce((code != "") & ~F.upper(code).eqNullSafe(F.upper(isin)) & F.contains(words, F.concat(F.lit(" "), F.upper(code), F.lit(" "))), F.lit(False))
    return by_isin | (own & ~F.regexp_like(words, F.lit(" BR[A-Z0-9]{9}[0-9] ")))


def only_candidate(pairs: DataFrame, asset: str, candidate: str) -> DataFrame:
    """(asset, candidate) of the assets that have exactly one distinct candidate."""
    found = pairs.groupBy(asset).agg(F.min(candidate).alias(candidate), F.max(candidate).alias("_last"))
    return found.where(F.col(candidate) == F.col("_last")).drop("_last")


def position_lines(rows: DataFrame, application: str, wanted: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows whose trimmed ``application`` is ``wanted``, with ``line_order`` from 1 among the rows of equal ``keys`` (SCAN-09)."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return rows.where(F.trim(application) == wanted).withColumn("line_order", F.row_number().over(by))


def mask_out_of_scope(rows: DataFrame, in_scope: Column, kept: Sequence[str]) -> DataFrame:
    """All rows; those out of scope hold null in every column but ``kept`` (SCAN-06)."""
    return rows.select(*[F.col(c) if c in kept else F.when(in_scope, F.col(c)).alias(c) for c in rows.columns])


def competence(rows: DataFrame, reference: str, keys: Sequence[str]) -> DataFrame:
    """(keys, competence, n, status) of a monthly report (SCAN-08): the month's last day, and ``not_first_day``, ``repeated`` or ``ok``."""
    day = F.to_date(reference)
    n = F.count("*")
    status = F.when(F.dayofmonth("_day") != 1, "not_first_day").when(n > 1, "repeated").otherwise("ok")
    return rows.withColumn("_day", day).groupBy(*keys, "_day").agg(n.alias("n"), status.alias("status")).select(*keys, F.last_day("_day").alias("competence"), "n", "status")


def filings_citing(filings: DataFrame, wanted: DataFrame, code: str, filing: Sequence[str], version: str) -> DataFrame:
    """Rows of each filing's highest version that cite a ``code`` of ``wanted`` (SCAN-10)."""
    last = filings.groupBy(*filing).agg(F.max(version).alias(version))
    return filings.join(wanted.select(code).distinct(), code, "left_semi").join(last, [*filing, version], "left_semi")
