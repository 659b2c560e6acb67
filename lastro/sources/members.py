"""Archives of many members with one report in them (SCAN-07), and files read again (SCAN-04)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .files import physical_lines
from .scratch import new_folder

#: The members of a fund report's archive.
FUND_TABLES = ("tab_I", "tab_II", "tab_III", "tab_IV", "tab_V", "tab_VI", "tab_VII", "tab_VIII", "tab_IX", "tab_X", "tab_X_1", "tab_X_1_1", "tab_X_2", "tab_X_3", "tab_X_4", "tab_X_5", "tab_X_6", "tab_X_7")
MEMBER_NAME = r"^inf_mensal_fidc_(tab_[IVX0-9_]+?)_([0-9]{6})\.csv$"
ARCHIVE_NAME = r"(?:^|/)inf_mensal_fidc_([0-9]{6})\.zip$"
NAME_TABLE = "tab_I"
SUBJECT_TYPES = ("Classe", "Fundo")
KIND, SUBJECT, NAME, COMPETENCE, SERIES, SUBCLASS = "TP_FUNDO_CLASSE", "CNPJ_FUNDO_CLASSE", "DENOM_SOCIAL", "DT_COMPTC", "TAB_X_CLASSE_SERIE", "ID_SUBCLASSE"


def members(archived: DataFrame) -> DataFrame:
    """``archived`` (file, member, text) with the table and the period that a member's name tells; null for other names."""
    part = lambda k: F.nullif(F.regexp_extract("member", MEMBER_NAME, k), F.lit(""))
    return archived.withColumn("table", part(1)).withColumn("period", part(2))


def member_records(archived: DataFrame, headers: dict[str, list[str]]) -> DataFrame:
    """(file, table, line, cells, problem): every record of every known member, by its own header, in one pass.

    cells: map of column to text, null where the record has another number of fields; a header that isn't the
    table's own is a record with a problem. ``headers``: the columns of each table, in order.
    """
    spark = archived.sparkSession
    expected = F.broadcast(spark.createDataFrame([(t, list(c)) for t, c in headers.items()], "table string, expected array<string>"))
    lines = physical_lines(members(archived).where("table is not null").select("file", "table", "text")).join(expected, "table", "left")
    fits = F.size("cells") == F.size("expected")
    problem = (
        F.when(F.col("expected").isNull(), "unknown_table")
        .when((F.col("line") == 0) & (F.col("cells") != F.col("expected")), "unexpected_header")
        .when(~fits, "wrong_number_of_fields")
    )
    cells = F.when(fits & (F.col("line") > 0), F.map_from_arrays("expected", "cells"))
    return lines.select("file", "table", "line", cells.alias("cells"), problem.alias("problem")).where("line > 0 or problem is not null")


def member_table(records: DataFrame, table: str, columns: dict[str, str]) -> DataFrame:
    """One member's records in columns of their own types; a cell that its type refuses is null."""
    cell = lambda c: F.nullif(F.trim(F.col("cells")[c]), F.lit(""))
    return records.where((F.col("table") == table) & F.col("cells").isNotNull()).select("file", "line", *[cell(c).try_cast(t).alias(c) for c, t in columns.items()])


def _when(condition: Column, name: str) -> Column:
    return F.when(condition, F.lit(name))


def archive_report(archived: DataFrame, headers: dict[str, list[str]], today: Column | None = None) -> DataFrame:
    """SCAN-07: one row for each archive: its competence, what the members agree on, and ``problems``, sorted.

    Problems: missing, unexpected and repeated members; periods of members that differ, or from the archive's
    name; a header or a record of another form; competences that are none, several, of another month or later than
    ``today``. Figures: subjects of the name table; subjects whose name in another table differs or is missing in
    the name table; rows, ids and shared ids of subclasses; rows of an unknown kind of subject.
    An archive with problems isn't to be loaded; nothing is raised, so that one report tells all.
    """
    today = F.current_date() if today is None else today
    tables = F.array(*[F.lit(t) for t in headers])
    named = members(archived)
    by_table = named.groupBy("file", "table").agg(F.count("*").alias("n"), F.collect_set("period").alias("periods"))
    found = by_table.groupBy("file").agg(
        F.array_sort(F.array_except(tables, F.collect_list("table"))).alias("missing"),
        F.sum(F.when(F.col("table").isNull() | ~F.array_contains(tables, F.col("table")), F.col("n")).otherwise(0)).alias("unexpected"),
        F.count_if((F.col("n") > 1) & F.col("table").isNotNull()).alias("repeated"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("periods")))).alias("periods"),
    )
    records = member_records(archived, headers)
    cell = lambda c: F.nullif(F.trim(F.col("cells")[c]), F.lit(""))
    rows = records.select("file", "table", "line", "problem", cell(KIND).alias("kind"), cell(SUBJECT).alias("subject"), cell(NAME).alias("name"), cell(COMPETENCE).try_cast("date").alias("competence"), F.col("cells").isNotNull().alias("read"), cell(SERIES).alias("series"), cell(SUBCLASS).alias("subclass"))
    forms = rows.groupBy("file").agg(
        F.bool_or(F.col("problem") == "unexpected_header").alias("bad_header"),
        F.bool_or(F.col("problem") == "wrong_number_of_fields").alias("bad_record"),
        F.bool_or(F.col("read") & F.col("competence").isNull()).alias("no_competence"),
        F.min("competence").alias("competence"),
        F.max("competence").alias("last_competence"),
        F.count_if("read").alias("n_rows"),
        F.count_if(F.col("read") & (F.col("kind").isNull() | ~F.col("kind").isin(*SUBJECT_TYPES))).alias("n_other_kinds"),
    )
    own = F.col("table") == NAME_TABLE
    subjects = rows.where("read").groupBy("file", "kind", "subject").agg(
        F.max_by("name", F.when(own, F.col("line"))).alias("own"), F.bool_or(own).alias("listed"), F.bool_or(~own).alias("elsewhere"),
        F.min(F.when(~own, F.coalesce("name", F.lit("")))).alias("least"), F.max(F.when(~own, F.coalesce("name", F.lit("")))).alias("most"),
    )
    own_name = F.coalesce("own", F.lit(""))
    divergent = F.col("elsewhere") & (~F.col("listed") | (F.col("least") != own_name) | (F.col("most") != own_name))
    names = subjects.groupBy("file").agg(F.count_if("listed").alias("n_subjects"), F.count_if(divergent).alias("n_divergent_names"))
    ids = rows.where("subclass is not null").groupBy("file", "subclass").agg(F.count("*").alias("n"), F.countDistinct(F.struct("kind", "subject", "series")).alias("owners"))
    shared = ids.groupBy("file").agg(F.sum("n").alias("n_subclass_rows"), F.count("*").alias("n_subclasses"), F.count_if(F.col("owners") > 1).alias("n_shared_subclasses"))
    whole = found.join(forms, "file", "left").join(names, "file", "left").join(shared, "file", "left")
    own_period = F.nullif(F.regexp_extract("file", ARCHIVE_NAME, 1), F.lit(""))
    period = F.date_format("competence", "yyyyMM")
    problems = F.array(
        _when(F.size("missing") > 0, "missing_members"),
        _when(F.col("unexpected") > 0, "unexpected_members"),
        _when(F.col("repeated") > 0, "repeated_members"),
        _when(F.size("periods") > 1, "several_periods"),
        _when((F.size("periods") == 1) & (own_period != F.col("periods")[0]), "archive_of_another_period"),
        _when(F.col("bad_header"), "unexpected_header"),
        _when(F.col("bad_record"), "wrong_number_of_fields"),
        _when(F.coalesce(F.col("no_competence"), F.lit(True)), "no_competence"),
        _when(F.col("competence") != F.col("last_competence"), "several_competences"),
        _when((F.size("periods") == 1) & (period != F.col("periods")[0]), "competence_of_another_month"),
        _when(F.col("last_competence") > today, "competence_in_future"),
    )
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    figures = ("n_rows", "n_other_kinds", "n_subjects", "n_divergent_names", "n_subclass_rows", "n_subclasses", "n_shared_subclasses")
    return whole.select("file", "competence", *map(count, figures), F.array_sort(F.array_compact(problems)).alias("problems"))


def shared_subclasses(records: DataFrame) -> DataFrame:
    """(file, subclass): ids that more than one subject or series has."""
    cell = lambda c: F.nullif(F.trim(F.col("cells")[c]), F.lit(""))
    rows = records.where("cells is not null").select("file", cell(KIND).alias("kind"), cell(SUBJECT).alias("subject"), cell(SERIES).alias("series"), cell(SUBCLASS).alias("subclass")).where("subclass is not null")
    return rows.groupBy("file", "subclass").agg(F.countDistinct(F.struct("kind", "subject", "series")).alias("n")).where("n > 1").select("file", "subclass")


def rewrite_changed(path: str, fresh: DataFrame) -> DataFrame:
    """SCAN-04: (file_id, status, rows_before, rows) of files read again; only partitions of changed files are written.

    ``path`` holds Parquet partitioned by ``file_id`` with a column ``member``; ``fresh`` has the same columns. A file
    without stored rows is not_loaded and stays out; one whose members and their row counts are what they were
    is unchanged; any other is reparsed. The new rows are staged and counted before Spark swaps partitions.
    """
    spark = fresh.sparkSession
    staged = new_folder(spark, "reparsed")
    fresh.write.partitionBy("file_id").parquet(staged)
    stored = spark.read.parquet(path)
    fresh = spark.read.schema(stored.schema).parquet(staged)
    count = lambda df, name: df.groupBy("file_id", "member").agg(F.count("*").alias(name))
    files = fresh.select("file_id").distinct()
    both = count(fresh, "rows").join(count(stored.join(files, "file_id", "left_semi"), "rows_before"), ["file_id", "member"], "full")
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    sums = both.groupBy("file_id").agg(F.sum(n("rows_before")).alias("rows_before"), F.sum(n("rows")).alias("rows"), F.bool_and(n("rows") == n("rows_before")).alias("same"))
    status = F.when(F.col("rows_before") == 0, "not_loaded").when(F.col("same"), "unchanged").otherwise("reparsed")
    outcome_path = new_folder(spark, "reparsed-outcome")
    sums.select("file_id", status.alias("status"), "rows_before", "rows").write.parquet(outcome_path)
    outcome = spark.read.parquet(outcome_path)
    changed = fresh.join(outcome.where("status = 'reparsed'").select("file_id"), "file_id", "left_semi").select(*stored.columns)
    changed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("file_id").parquet(path)
    return outcome
