"""Numbers, dates and hashes as column expressions (NUM-*, DATE-*, STR-12 to STR-16, JSON-01, HASH-01)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(28,8)"
#: Month names in folded Portuguese, January first.
MONTHS = ("janeiro", "fevereiro", "marco", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro")
#: Factors of the declared units.
UNITS = {"BRL": 1, "BRL_mil": 1000}
SUSPECT_FACTOR = 20


def decimal_text(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(".")).try_cast(MONEY)


def money_or_zero(text: Column) -> Column:
    """NUM-01, market: 0 where the text is no number."""
    return F.coalesce(decimal_text(text), F.lit(0).cast(MONEY))


def money_or_null(text: Column) -> Column:
    """NUM-01, events: null where the text is no number."""
    return decimal_text(F.nullif(F.trim(text), F.lit("")))


def brazilian_decimal(text: Column) -> Column:
    """STR-15: R$ and % dropped, points for thousands, a comma for decimals; other characters go."""
    bare = F.replace(F.regexp_replace(text, r"R\$|%|\.", ""), F.lit(","), F.lit("."))
    return F.regexp_replace(bare, "[^-+0-9.]", "").try_cast(MONEY)


def canonical_decimal(value: Column) -> Column:
    """No exponent, no trailing zeros, no negative zero."""
    # a decimal has no negative zero and, as text, always its twelve places
    return F.rtrim(F.rtrim(F.coalesce(value.cast("decimal(38,12)").cast("string"), F.lit("null")), F.lit("0")), F.lit("."))


def share(value: Column) -> Column:
    """NUM-02: over 1 and up to 100 is a percentage; null outside (0, 1]."""
    fraction = F.when((value > 1) & (value <= 100), value / 100).otherwise(value)
    return F.when((fraction > 0) & (fraction <= 1), fraction)


def suspect_balance(balance: Column, paid_in: Column) -> Column:
    """NUM-03: over 20 times what was paid in."""
    return (paid_in > 0) & (balance > SUSPECT_FACTOR * paid_in)


def trusted_balance(balance: Column, paid_in: Column) -> Column:
    return F.when(suspect_balance(balance, paid_in), 0).otherwise(balance)


def relative_change(before: Column, after: Column) -> Column:
    """NUM-04: to six places, half to even; null from zero."""
    return F.bround(F.try_divide(after - before, before), 6)


def within_tolerance(a: Column, b: Column, percent: float = 0.01) -> Column:
    """NUM-05: relative, with a floor of one unit."""
    return F.abs(a - b) <= percent * F.greatest(F.lit(1.0), F.abs(b)) / 100


def in_units(value: Column, unit: Column) -> Column:
    """NUM-06: an unknown unit is an error."""
    factor = F.lit(None)
    for name, n in UNITS.items():
        factor = F.when(unit == name, n).otherwise(factor)
    return value * F.coalesce(factor, F.raise_error(F.concat(F.lit("unknown unit "), unit)).cast("int"))


def month_index(date: Column) -> Column:
    """DATE-01."""
    return F.year(date) * 12 + F.month(date) - 1


def months_between(a: Column, b: Column) -> Column:
    return month_index(b) - month_index(a)


def window_start(date: Column, months: int) -> Column:
    """DATE-02: first day of the month, ``months`` back."""
    return F.add_months(F.trunc(date, "month"), -months)


def delivery_delay(delivered: Column, reference: Column) -> Column:
    """DATE-03: days after the end of the reference month."""
    return F.datediff(delivered, F.last_day(reference))


def named_months(folded: Column) -> Column:
    """DATE-04: months (0 to 11) spelt out in a folded text."""
    found = [F.when(folded.rlike(rf"\b{name}\b"), F.lit(k)) for k, name in enumerate(MONTHS)]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def brazilian_date(text: Column) -> Column:
    return F.to_date(F.try_to_timestamp(text, F.lit("dd/MM/yyyy")))


def legacy_timestamp(text: Column) -> Column:
    """DATE-05: ISO with or without zone, else dd/MM/yyyy with or without time."""
    return F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("dd/MM/yyyy HH:mm")), F.try_to_timestamp(text, F.lit("dd/MM/yyyy")))


#: Folded texts that mean no rating.
NO_RATING = ("0", "-", "--", "n/a", "na", "nao ha", "nao possui", "sem rating", "sem classificacao", "nao se aplica", "nao aplicavel", "nao avaliado", "nd", "n.d.")


def rating_key(text: Column) -> Column:
    """STR-13: folded, blanks collapsed, no final points; empty for the texts that mean no rating."""
    from .identifiers import let
    from .text import collapse, fold

    return let(F.regexp_replace(collapse(fold(text)), r"\.+$", ""), lambda x: F.when(x.isin(*NO_RATING), "").otherwise(x))


#: How indexes are written in folded remuneration texts.
INDEXES = (
    ("DI", r"\b(?:taxa\s+)?c?di\b"),
    ("IPCA", r"\bipca\b"),
    ("SELIC", r"\bselic\b"),
    ("IGPM", r"\bigp-?m\b"),
    ("PREFIXADA", r"\b(?:pre-?fixad[ao]s?|pre)\b"),
)
#: What stands between a percentage and the index that it multiplies, and what tells that it is a spread.
OF_INDEX = r"^\s*(?:\([^)]{0,80}\)\s*)?(?:d[aeo]s?\s+)?(?:variacao\s+(?:acumulada\s+)?(?:d[aeo]s?\s+)?)?(?:taxa\s+)?(?:c?di\b|ipca\b|selic\b|indexador\b)"
INDEX_WORD = r"\b(?:c?di|ipca|selic|indexador)\b"
SPREAD_WORDS = r"[\d%]|\bano\b|a\.a|\bmes\b|\bacima\b|\bsobre\b|\bacrescid"


def rate_tokens(text: Column) -> Column:
    """STR-10: mult= (a percentage of an index), taxa= (a rate or spread) and idx= tokens of a remuneration text, sorted.

    A percentage multiplies the index if the index follows at once, or within 100 characters that hold no
    other number and no word of a spread.
    """
    from .identifiers import let
    from .text import strip_accents

    return let(F.lower(strip_accents(F.coalesce(text, F.lit("")))), _tokens_of_folded)


def _tokens_of_folded(folded: Column) -> Column:
    from .identifiers import let

    each = F.lit(r"(?s)(\d+(?:[.,]\d+)?)\s*%(?=(.{0,110}))")
    seen = F.arrays_zip(F.regexp_extract_all(folded, each, F.lit(1)).alias("n"), F.regexp_extract_all(folded, each, F.lit(2)).alias("after"))

    def named(x: Column) -> Column:
        gap = F.regexp_extract(x["after"], f"(?s)^(.*?){INDEX_WORD}", 1)
        loose = x["after"].rlike(INDEX_WORD) & let(gap, lambda g: (F.char_length(g) <= 100) & ~g.rlike(SPREAD_WORDS))
        number = canonical_decimal(F.replace(x["n"], F.lit(","), F.lit(".")))
        return F.concat(F.when(F.substring(x["after"], 1, 40).rlike(OF_INDEX) | loose, "mult=").otherwise("taxa="), number)

    numbers = F.transform(seen, named)
    indexes = F.filter(F.array(*[F.when(folded.rlike(p), F.lit(f"idx={n}")) for n, p in INDEXES]), lambda x: x.isNotNull())
    floating = lambda found: F.exists(found, lambda t: t.startswith("mult=") | (t.startswith("idx=") & (t != "idx=PREFIXADA")))
    return let(F.array_distinct(F.concat(numbers, indexes)), lambda found: F.array_sort(F.when(floating(found), F.array_remove(found, "idx=PREFIXADA")).otherwise(found)))


def rate_key(text: Column) -> Column:
    """STR-12: the tokens of a rate with numbers to two places."""
    rounded = lambda t: F.concat(F.substring(t, 1, 5), canonical_decimal(F.bround(F.substring(t, 6, 60).cast(MONEY), 2)))
    return F.array_sort(F.array_distinct(F.transform(rate_tokens(text), lambda t: F.when(t.startswith("idx="), t).otherwise(rounded(t)))))


def rate_numbers(text: Column) -> Column:
    """STR-12: of the key, the numbers alone; only they decide whether a rate changed."""
    return F.filter(rate_key(text), lambda t: ~t.startswith("idx="))


def grouped(whole: Column) -> Column:
    """Digits with a point before every three: 1.234.567."""
    return F.replace(F.format_number(whole.cast("decimal(38,0)"), 0), F.lit(","), F.lit("."))


def value_variants(value: Column, unit: Column) -> Column:
    """STR-14: how an approved value is written in folded contracts; empty where it is too general to look for.

    Dates as day/month/year and in words; shares as percentages; amounts with points and cents; other whole
    numbers from 1000.
    """
    from .text import fold

    none = F.array().cast("array<string>")
    kind = fold(unit)
    day, number = F.substring(value, 9, 2), value.try_cast("decimal(28,10)")
    written = F.concat(F.lit(" de "), F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.greatest(F.lit(1), F.coalesce(F.substring(value, 6, 2).try_cast("int"), F.lit(1)))), F.lit(" de "), F.substring(value, 1, 4))
    dates = F.array(F.concat(day, F.lit("/"), F.substring(value, 6, 2), F.lit("/"), F.substring(value, 1, 4)), F.concat(F.regexp_replace(day, "^0", ""), written), F.concat(day, written))
    dates = F.array_distinct(F.when(day == "01", F.array_append(dates, F.concat(F.lit("1o"), written))).otherwise(dates))
    percent = canonical_decimal(number * 100)
    comma = F.replace(percent, F.lit("."), F.lit(","))
    padded = F.concat(F.substring_index(percent, ".", 1), F.lit(","), F.regexp_replace(F.substring_index(percent, ".", -1), "^(.)$", "$10"))
    shares = F.when(percent.contains("."), F.array_distinct(F.array(F.concat(comma, F.lit("%")), F.concat(padded, F.lit("%"))))).otherwise(F.transform(F.array(F.lit("%"), F.lit(",00%"), F.lit(",0%")), lambda end: F.concat(percent, end)))
    cents = F.bround(number, 2).cast("decimal(28,2)").cast("string")
    whole = grouped(F.substring_index(cents, ".", 1))
    amounts = F.array(F.concat(whole, F.lit(","), F.substring_index(cents, ".", -1)), F.concat(F.lit("r$ "), whole))
    return (
        F.when(value.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), dates)
        .when(~F.coalesce(value, F.lit("")).rlike(r"^[0-9]+(\.[0-9]+)?$"), none)
        .when(kind.contains("fracao"), shares)
        .when(kind.contains("brl"), amounts)
        .when((number == F.floor(number)) & (number >= 1000), F.array(grouped(number)))
        .otherwise(none)
    )


#: What a leaf's text must look like, by declared type.
LEAF_FORMS = {"decimal": r"^-?[0-9]+(\.[0-9]+)?$", "integer": r"^-?[0-9]+$", "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"}


def leaf_value(raw: Column, data_type: Column) -> Column:
    """PROJ-04: struct<value, state, validity> of a leaf's text by its declared type; an unknown type is an error."""
    text = F.regexp_replace(raw, r"^\s+|\s+$", "")
    formed = F.when(data_type == "decimal", text.rlike(LEAF_FORMS["decimal"])).when(data_type == "integer", text.rlike(LEAF_FORMS["integer"])).when(data_type == "date", text.rlike(LEAF_FORMS["date"]) & text.try_cast("date").isNotNull())
    formed = formed.when(data_type.isin("identifier", "text"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("unknown data type "), F.coalesce(data_type, F.lit("null")))).cast("boolean"))
    state = F.when(raw.isNull(), "absent").when(text == "", "present_empty").when(~formed, "invalid")
    state = state.when(data_type.isin("decimal", "integer") & (text.try_cast("decimal(38,12)") == 0), "zero").otherwise("present_value")
    kept = F.when(data_type.isin("identifier", "text"), raw).otherwise(text)
    return F.struct(F.when(state.isin("zero", "present_value"), kept).alias("value"), state.alias("state"), F.when(state == "invalid", "invalid").otherwise("valid").alias("validity"))


def record_hash(*columns: Column) -> Column:
    """STR-16: SHA-256 of the fields' JSON, nulls included."""
    fields = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    return F.sha2(fields, 256)
