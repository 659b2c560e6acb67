"""Personal data that must not be written (RULE-23): a write that is stopped before a file appears."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.identifiers import valid_cnpj, valid_cpf

#: Columns of natural persons and of contacts, which are never written.
FORBIDDEN = ("Diretor", "Email_Administrador", "Site", "Servico_Atendimento_Cotista", "Entidade_Administradora")


def column_of(field: Column) -> Column:
    """The column in ``table.column``; the whole name if there is no dot."""
    return F.when(F.contains(field, F.lit(".")), F.substring(field, F.instr(field, ".") + 1, 1 << 20)).otherwise(field)


def refusal(field: Column, value: Column) -> Column:
    """Why an observation must not be written, null if it may: a forbidden column, or an identifier that isn't a CNPJ as it is stored.

    Reasons name the field, never the value. A null value in a column of identifiers is no CNPJ either.
    """
    column = F.lower(column_of(field))
    identifies = column.contains("cpf") | column.contains("cnpj")
    stored = F.coalesce(value.rlike("^[0-9A-Z]{12}[0-9]{2}$") & valid_cnpj(value), F.lit(False))
    is_cpf = F.coalesce(valid_cpf(value) | value.rlike(r"^\s*\d{3}\.\d{3}\.\d{3}-\d{2}\s*$"), F.lit(False))
    return (
        F.when(column.isin(*[c.lower() for c in FORBIDDEN]), F.concat(field, F.lit(": column of a natural person or of a contact")))
        .when(identifies & ~stored & is_cpf, F.concat(field, F.lit(": looks like a CPF")))
        .when(identifies & ~stored, F.concat(field, F.lit(": not a CNPJ as it is stored")))
    )


def guarded(observations: DataFrame, field: str = "field_name", value: str = "value") -> DataFrame:
    """The same rows; reading one that must not be written is an error."""
    found = refusal(F.col(field), F.col(value))
    stop = F.when(found.isNull(), True).otherwise(F.raise_error(F.concat(F.lit("personal data, nothing is written: "), found)).cast("boolean"))
    return observations.where(stop)


def unpivoted(df: DataFrame, keys: list[str]) -> DataFrame:
    """A wide table as observations: keys, field_name, value."""
    return df.select(*keys, F.inline(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).cast("string").alias("value")) for c in df.columns if c not in keys])))


def write_guarded(observations: DataFrame, path: str, field: str = "field_name", value: str = "value") -> dict[str, int]:
    """Write Parquet at ``path``, which must not be there, if no row is refused; else nothing appears there. Returns counted rows.

    The rows go to a folder beside ``path`` first; only when all of them are written does it take the name. A refused row
    fails the job, and the folder goes.
    """
    spark = observations.sparkSession
    paths = spark._jvm.org.apache.hadoop.fs.Path
    target, staged = paths(path), paths(f"{path.rstrip('/')}.unchecked")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(target):
        raise FileExistsError(path)
    seen = Observation("guarded write")
    column = F.lower(column_of(F.col(field)))
    watched = observations.observe(seen, F.count("*").alias("rows"), F.count_if(column.contains("cpf") | column.contains("cnpj")).alias("identifiers"))
    try:
        guarded(watched, field, value).write.mode("overwrite").parquet(staged.toString())
        if not fs.rename(staged, target):
            raise OSError(f"can't rename to {path}")
    finally:
        fs.delete(staged, True)
    return dict(seen.get)
