"""Company and personal identifiers as column expressions (STR-07 to STR-09)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Mod-11 weights of the two check digits of a company and of a personal id.
CNPJ_WEIGHTS = ((5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2), (6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2))
CPF_WEIGHTS = ((10, 9, 8, 7, 6, 5, 4, 3, 2), (11, 10, 9, 8, 7, 6, 5, 4, 3, 2))


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def check_digit(base: Column, weights: tuple[int, ...]) -> Column:
    """The digit after ``base``; a character's value is its code less that of the digit 0, for letters too."""
    characters = F.slice(F.split(base, ""), 1, len(weights))
    products = F.zip_with(characters, F.array(*[F.lit(w) for w in weights]), lambda c, w: (F.ascii(c) - 48) * w)
    return let(F.aggregate(products, F.lit(0), lambda s, x: s + x) % 11, lambda rest: F.when(rest < 2, 0).otherwise(11 - rest))


def _checked(text: Column, weights: tuple[tuple[int, ...], tuple[int, ...]]) -> Column:
    n = len(weights[0])
    digits = F.concat(check_digit(F.substring(text, 1, n), weights[0]).cast("string"), check_digit(F.substring(text, 1, n + 1), weights[1]).cast("string"))
    return F.substring(text, n + 1, 2) == digits


#: The whole mask of a company's and of a personal id.
CNPJ_MASK = r"^[0-9A-Z]{2}\.[0-9A-Z]{3}\.[0-9A-Z]{3}/[0-9A-Z]{4}-[0-9]{2}$"
CPF_FORM = r"^([0-9]{11}|[0-9]{3}\.[0-9]{3}\.[0-9]{3}-[0-9]{2})$"


def bare(text: Column) -> Column:
    """Upper case without outer blanks; without the mask if the whole mask is there, and as it is otherwise."""
    return let(F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")), lambda x: F.when(x.rlike(CNPJ_MASK), F.regexp_replace(x, r"[./-]", "")).otherwise(x))


def valid_cnpj(text: Column) -> Column:
    """STR-07: 12 letters or digits, two check digits, not all equal."""
    formed = text.rlike("^[0-9A-Z]{12}[0-9]{2}$") & ~text.rlike(r"^(.)\1{13}$")
    return F.when(formed, _checked(text, CNPJ_WEIGHTS)).otherwise(False)


def valid_cpf(text: Column) -> Column:
    formed = text.rlike("^[0-9]{11}$") & ~text.rlike(r"^(.)\1{10}$")
    return F.when(formed, _checked(text, CPF_WEIGHTS)).otherwise(False)


def normalise_cnpj(text: Column, pad: bool = False) -> Column:
    """STR-07: the bare valid id or null; ``pad`` restores the left zeros of 12 or 13 digits."""
    b = bare(text)
    if pad:
        b = let(b, lambda x: F.when(x.rlike("^[0-9]{12,13}$"), F.lpad(x, 14, "0")).otherwise(x))
    return let(b, lambda x: F.when(valid_cnpj(x), x))


def fund_identifier_class(text: Column) -> Column:
    """STR-08, funds: empty, cpf (by form alone), cnpj (left zeros restored) or invalid."""
    stripped = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    return let(stripped, lambda x: F.when(x == "", "empty").when(x.rlike(CPF_FORM), "cpf").when(normalise_cnpj(x, pad=True).isNotNull(), "cnpj").otherwise("invalid"))


def market_identifier_class(text: Column) -> Column:
    """STR-08, market: cnpj, cnpj_sem_zeros, cpf (checked), nao_informado or invalido.

    Without letters only the digits count. A value with a letter is never padded and never a personal id.
    """
    given = F.coalesce(text, F.lit(""))
    lettered, digits = given.rlike(r"\p{L}"), F.regexp_replace(given, r"\D", "")

    def kind(d: Column) -> Column:
        own = F.when(lettered, normalise_cnpj(given)).otherwise(F.when(valid_cnpj(d), d))
        nothing = (d == "") | d.rlike("^[01]{1,2}$") | d.rlike(r"^(.)\1*$")
        return (
            F.when(own.isNotNull(), "cnpj")
            .when(nothing, "nao_informado")
            .when(lettered, "invalido")
            .when(d.rlike("^[0-9]{12,13}$") & valid_cnpj(F.lpad(d, 14, "0")), "cnpj_sem_zeros")
            .when(valid_cpf(d), "cpf")
            .otherwise("invalido")
        )

    return let(digits, kind)


def format_cnpj(text: Column) -> Column:
    """STR-09: 00.000.000/0000-00."""
    part = lambda at, n: F.substring(text, at, n)
    return F.concat(part(1, 2), F.lit("."), part(3, 3), F.lit("."), part(6, 3), F.lit("/"), part(9, 4), F.lit("-"), part(13, 2))
