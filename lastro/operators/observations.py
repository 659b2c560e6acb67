"""Observations in long form: unpivot, pivot, conflicts, idempotent append, snapshot merge (EAV-*, CONF-*, STATE-*, UPS-*)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import record_hash


def to_long(df: DataFrame, keys: list[str], fields: list[str], value: str = "value") -> DataFrame:
    """EAV-01: a row for each field that isn't blank."""
    text = df.select(*keys, *[F.col(f).cast("string").alias(f) for f in fields])
    return text.unpivot(keys, fields, "field_name", value).where(F.trim(value) != "")


def to_wide(df: DataFrame, keys: list[str], fields: list[str], value: str = "value") -> DataFrame:
    """EAV-03: fixed columns; naming the fields saves a pass to find them."""
    return df.groupBy(*keys).pivot("field_name", fields).agg(F.max(value))


def typed_value(kind: Column) -> Column:
    """PROJ-01: the one value column that the type names, as text."""
    columns = {"text": "value_text", "numeric": "value_numeric", "date": "value_date", "boolean": "value_boolean"}
    found = F.lit(None).cast("string")
    for name, column in columns.items():
        found = F.when(kind == name, F.col(column).cast("string")).otherwise(found)
    return found


def convert(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """PROJ-03: every text column by its declared kind; what doesn't convert is null."""
    casts = {"text": "string", "date": "date", "numeric": "decimal(28,8)", "boolean": "boolean", "integer": "bigint"}
    return df.select(*[F.col(c).try_cast(casts[k]).alias(c) for c, k in kinds.items()])


def conflicts(df: DataFrame, keys: list[str], row_id: str, value: str) -> DataFrame:
    """CONF-01, CONF-04: (keys, value, class_id, n_rows, n_classes) for every value of a key that has several.

    Any two classes of a key conflict, and every row of one with every row of the other; class_id is the
    class's smallest row. So a key of n rows gives at most n class rows, never its pairs.
    """
    classes = df.groupBy(*keys, F.col(value).alias("value")).agg(F.min(row_id).alias("class_id"), F.count("*").alias("n_rows"))
    found = classes.withColumn("n_classes", F.count("*").over(Window.partitionBy(*keys)))
    return found.where("n_classes > 1")


def conflict_status(opened: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """CONF-03: (keys, status, note): open until its newest event resolves or ignores it; events: keys, at, status, note."""
    newest = events.groupBy(*keys).agg(F.max_by(F.struct("status", "note"), "at").alias("e"))
    return opened.select(*keys).distinct().join(newest, keys, "left").select(*keys, F.coalesce("e.status", F.lit("open")).alias("status"), F.col("e.note").alias("note"))


def conflicting_keys(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """CONF-04 at scale: keys with more than one value, and how many values and rows they have."""
    found = df.groupBy(*keys).agg(F.countDistinct(F.struct(value)).alias("n_values"), F.count("*").alias("n_rows"))
    return found.where("n_values > 1")


def other_source_conflict(new: DataFrame, stored: DataFrame, key: str, row_id: str, order: str, source: str = "source_id", value: str = "value") -> DataFrame:
    """CONF-02: (new_id, conflicting_value): for each new row the newest stored row of another source that differs.

    Of a key's source only its newest row and the newest row that differs from that can ever be the answer: if
    the first has the new row's value, the second hasn't. So each key keeps two rows a source, and a new row
    looks through them, not through the key's history. Null is a value that differs from others; sources are few. Rows of one
    order go by the larger value.
    """
    newest = stored.where(F.col(key).isNotNull() & F.col(source).isNotNull()).groupBy(key, F.col(source).alias("source"), F.col(value).alias("value")).agg(F.max(order).alias("at"))
    by_age = Window.partitionBy(key, "source").orderBy(F.col("at").desc(), F.col("value").desc_nulls_last())
    two = newest.withColumn("nth", F.row_number().over(by_age)).where("nth <= 2")
    held = two.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", F.col("value").isNotNull().alias("there"), "value", "source"))).alias("held"))
    differs = lambda x: (x["source"] != F.col(source)) & ~x["value"].eqNullSafe(F.col(value))
    found = new.join(held, key).select(F.col(row_id).alias("new_id"), F.filter("held", differs).alias("others")).where(F.size("others") > 0)
    return found.select("new_id", F.element_at("others", -1)["value"].alias("conflicting_value"))


def not_yet_stored(new: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """STATE-01, STATE-02: rows whose key is not stored, nulls equal; a batch that repeats itself adds a row once."""
    same = [F.col(f"n.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    return new.dropDuplicates(keys).alias("n").join(stored.select(*keys).alias("s"), same, "left_anti")


def append_with_conflicts(new: DataFrame, stored: DataFrame, subject: list[str], identity: list[str], row_id: str, value: str) -> tuple[DataFrame, DataFrame]:
    """SINK-03: the rows of a batch to append, and (new_id, other_id) of each that differs from what its subject had.

    A row whose ``identity`` is stored or came before it in the batch is not appended. The batch goes by ``row_id``,
    after all that is stored; the other row is the newest before with another value, of any source. Null is a value.
    A subject's rows are sorted and passed once: where a value changes, the row before is the other one, for all of the
    run of equal values that begins there.
    """
    same = [F.col(f"n.{k}").eqNullSafe(F.col(f"s.{k}")) for k in identity]
    first = new.groupBy(*identity).agg(F.min(F.struct(row_id, F.struct("*").alias("row"))).alias("first")).select("first.row.*")
    appended = first.alias("n").join(stored.select(*identity).alias("s"), same, "left_anti").select("n.*")
    held = lambda df, late: df.select(*subject, F.col(row_id).alias("id"), F.col(value).alias("value"), F.lit(late).alias("late"))
    wanted = appended.select(*subject).distinct()
    touched = held(stored, False).alias("n").join(wanted.alias("s"), [F.col(f"n.{k}").eqNullSafe(F.col(f"s.{k}")) for k in subject], "left_semi")
    by_age = Window.partitionBy(*subject).orderBy("late", "id")
    changed = F.when(~F.col("value").eqNullSafe(F.lag("value").over(by_age)), F.lag("id").over(by_age))
    rows = touched.unionByName(held(appended, True)).withColumn("changed", changed)
    rows = rows.withColumn("other_id", F.last("changed", True).over(by_age.rowsBetween(Window.unboundedPreceding, 0)))
    return appended, rows.where("late and other_id is not null").select(F.col("id").alias("new_id"), "other_id")


def observation_hash(fields: list[Column], status: Column, run: Column) -> Column:
    """STATE-03: the hash that keeps an observation from being stored twice.

    A value that returns after another one is an observation again, so the run that saw it becomes part of the hash.
    """
    return record_hash(*fields, F.when(status == "returns", run).alias("run"))


def merge_snapshot(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """UPS-01: the new rows, and the old ones of other keys."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def merge_blanks(old: DataFrame, new: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """UPS-03: a full outer merge in which a blank never erases; outcome: inserted, updated or unchanged."""
    o, n = old.alias("o"), new.alias("n")
    merged = {f: F.coalesce(F.nullif(F.trim(F.col(f"n.{f}")), F.lit("")), F.col(f"o.{f}")) for f in fields}
    changed = F.lit(False)
    for f in fields:
        changed = changed | ~merged[f].eqNullSafe(F.col(f"o.{f}"))
    outcome = F.when(F.col(f"o.{key}").isNull(), "inserted").when(F.col(f"n.{key}").isNotNull() & changed, "updated").otherwise("unchanged")
    return o.join(n, key, "full_outer").select(key, *[v.alias(f) for f, v in merged.items()], outcome.alias("outcome"))


def upsert_by_two_keys(stored: DataFrame, new: DataFrame, first: str, second: str, fields: list[str], issue: list[str]) -> tuple[DataFrame, DataFrame]:
    """UPS-03: (merged, refused) of an asset table whose rows are known by either of two codes.

    ``stored``: row_id, both codes, fields; ``new``: new_id, the same. Codes are compared trimmed and in upper case. A new row
    without a code, with one code as both, or whose codes belong to two stored rows is refused, and so is one
    that names another issue than the stored row (``issue``: columns that differ where both are filled), and all
    new rows that claim one stored row or one new code together: none of them is known to be the right one. merged:
    row_id, new_id, codes, fields, outcome (inserted, updated, unchanged, kept: a stored row without a new one); a blank never erases.
    refused: new_id, reason. Every new row is in one of the two.
    """
    code = lambda c: F.nullif(F.upper(F.trim(c)), F.lit(""))
    n = new.select("new_id", code(first).alias("a"), code(second).alias("b"), *[F.col(f).alias(f"new_{f}") for f in fields])
    s = stored.select("row_id", code(first).alias("sa"), code(second).alias("sb"), *fields)
    by = lambda side, name: s.where(F.col(side).isNotNull()).groupBy(F.col(side).alias("code")).agg(F.min("row_id").alias(name))
    met = n.join(by("sa", "by_a"), F.col("a") == F.col("code"), "left").drop("code").join(by("sb", "by_b"), F.col("b") == F.col("code"), "left").drop("code")
    met = met.withColumn("row_id", F.coalesce("by_a", "by_b")).join(s, "row_id", "left")
    differs = F.lit(False)
    for f in issue:
        old, put = F.nullif(F.trim(f), F.lit("")), F.nullif(F.trim(f"new_{f}"), F.lit(""))
        differs = differs | F.coalesce(old != put, F.lit(False))
    # new rows that claim one stored row, or one code where none is stored
    crowd = lambda *by: F.count("*").over(Window.partitionBy(*by)) > 1
    claims = (F.col("row_id").isNotNull() & crowd("row_id")) | (F.col("row_id").isNull() & ((F.col("a").isNotNull() & crowd(F.col("row_id").isNull(), "a")) | (F.col("b").isNotNull() & crowd(F.col("row_id").isNull(), "b"))))
    reason = (
        F.when(F.col("a").isNull() & F.col("b").isNull(), "no_code")
        .when(F.col("a") == F.col("b"), "one_code_twice")
        .when(F.col("by_a") != F.col("by_b"), "two_assets")
        .when(F.col("row_id").isNotNull() & differs, "another_issue")
    )
    judged = met.withColumn("reason", reason)
    sound = judged.where("reason is null").withColumn("reason", F.when(claims, "claimed_twice"))
    refused = judged.where("reason is not null").select("new_id", "reason").unionByName(sound.where("reason is not null").select("new_id", "reason"))
    taken = sound.where("reason is null")
    kept = lambda f: F.coalesce(F.nullif(F.trim(f"new_{f}"), F.lit("")), F.col(f))
    codes = {first: F.coalesce("a", "sa"), second: F.coalesce("b", "sb")}
    same = codes[first].eqNullSafe(F.col("sa")) & codes[second].eqNullSafe(F.col("sb"))
    for f in fields:
        same = same & kept(f).eqNullSafe(F.col(f))
    outcome = F.when(F.col("row_id").isNull(), "inserted").when(same, "unchanged").otherwise("updated")
    put = taken.select("row_id", "new_id", *[v.alias(c) for c, v in codes.items()], *[kept(f).alias(f) for f in fields], outcome.alias("outcome"))
    rest = s.join(taken.select("row_id").where("row_id is not null"), "row_id", "left_anti")
    rest = rest.select("row_id", F.lit(None).cast(new.schema["new_id"].dataType).alias("new_id"), F.col("sa").alias(first), F.col("sb").alias(second), *fields, F.lit("kept").alias("outcome"))
    return put.unionByName(rest), refused


def alert_lifecycle(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """UPS-02: (fingerprint, alert_key, status): open again, new, or resolved where a newer alert of the key was opened."""
    both = stored.alias("o").join(seen.alias("n"), "fingerprint", "full_outer")
    key = F.coalesce("n.alert_key", "o.alert_key").alias("alert_key")
    status = F.when(F.col("n.alert_key").isNotNull() & F.col("o.alert_key").isNotNull(), "seen_again").when(F.col("n.alert_key").isNotNull(), "new").otherwise("open")
    merged = both.select("fingerprint", key, status.alias("status"))
    opened = F.max(F.col("status") == "new").over(Window.partitionBy("alert_key"))
    return merged.withColumn("status", F.when((F.col("status") == "open") & opened, "resolved").otherwise(F.col("status")))


def upsert_documents(stored: DataFrame, new: DataFrame, other: str, evidence: Column) -> DataFrame:
    """UPS-04: (source_id, source, sha256, title, category, outcome) of both sides; rows: sha256, source_id, source, title, category.

    A document is known by its hash, else by its id at the source. A blank never erases, and a category is not
    lowered to ``other`` unless ``evidence`` holds for the new row (its columns have the prefix new_).
    """
    n = new.select(*[F.col(c).alias(f"new_{c}") for c in new.columns]).dropDuplicates(["new_sha256"])
    by_hash = stored.join(n, F.col("sha256") == F.col("new_sha256"))
    left = n.join(stored.select("sha256"), F.col("new_sha256") == F.col("sha256"), "left_anti")
    # a stored row that a hash has found takes no second one by its id
    rest = stored.join(new.select("sha256"), "sha256", "left_anti")
    by_id = rest.join(left, (F.col("source_id") == F.col("new_source_id")) & (F.col("source") == F.col("new_source")), "full_outer")
    both = by_hash.unionByName(by_id)
    kept = lambda c: F.coalesce(F.nullif(F.trim(f"new_{c}"), F.lit("")), F.col(c))
    lowered = (F.col("new_category") == other) & (F.col("category") != other) & ~F.coalesce(evidence, F.lit(False))
    category = F.when(F.coalesce(lowered, F.lit(False)), F.col("category")).otherwise(kept("category"))
    fields = {"source_id": kept("source_id"), "source": kept("source"), "sha256": kept("sha256"), "title": kept("title"), "category": category}
    same = F.lit(True)
    for name, value in fields.items():
        same = same & value.eqNullSafe(F.col(name))
    outcome = F.when(F.col("sha256").isNull(), "inserted").when(F.col("new_sha256").isNull() | same, "unchanged").otherwise("updated")
    return both.select(*[v.alias(k) for k, v in fields.items()], outcome.alias("outcome"))


def indicator_series(rows: DataFrame, report: str, series: str, indicators: dict[str, Column], known: list | None = None) -> DataFrame:
    """EAV-04: (report, indicator + series in lower case, ...): every indicator of a report, a column for each series.

    ``indicators``: an aggregate by name; ``known``: the series, if they needn't be found by a pass over the rows.
    """
    values = F.struct(*[c.alias(name) for name, c in indicators.items()])
    pivoted = rows.groupBy(report).pivot(series, known).agg(values)
    return pivoted.select(report, *[F.col(f"`{c}`")[name].alias(f"{name}{c.lower()}") for c in pivoted.columns[1:] for name in indicators])


def sibling_keys(leaves: DataFrame, within: list[str], block: str, leaf: str, value: str, key_leaves: list[str]) -> DataFrame:
    """EAV-06: ``leaves`` with instance_key and repeats: a block's key is the value of the first of ``key_leaves`` that it holds.

    repeats: the leaves of that name with that key among all blocks of ``within``. A block without a key leaf, or with
    blank ones alone, has none. Of several leaves of one name the smallest value is the key.
    """
    place = F.lit(None)
    for at, name in reversed(list(enumerate(key_leaves))):
        place = F.when(F.col(leaf) == name, at).otherwise(place)
    said = F.when(F.col(leaf).isin(*key_leaves) & (F.trim(value) != ""), F.struct(place.alias("place"), F.trim(value).alias("v")))
    there = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*within, block)])
    keyed = leaves.withColumn("instance_key", F.when(there, F.min(said).over(Window.partitionBy(*within, block))["v"]))
    return keyed.withColumn("repeats", F.count("*").over(Window.partitionBy(*within, leaf, "instance_key")))
