"""Text normalisers as column expressions (STR-01 to STR-06, STR-11, STR-17, STR-18)."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .identifiers import let, normalise_cnpj

#: Markers that a portal writes where an identifier is missing.
EMPTY_IDENTIFIER = r"^0+$"
#: Words of a party's name that tell nothing.
NAME_STOP_WORDS = ("s.a.", "sa", "s/a", "ltda", "e", "de", "do", "da", "dos", "das", "cnpj", "nire", "sede", "cidade", "estado", "sociedade", "por", "acoes", "em", "no", "na")
#: Where the name ends and its description begins.
NAME_END = r"[(,;]|\bsociedade\b|\bcnpj\b"
#: What a personal id, a mail address and a phone number look like, and tags that hold them.
PERSONAL = (r"\b\d{3}\.\d{3}\.\d{3}-\d{2}\b", r"[\w.+-]+@[\w-]+\.[\w.]+", r"\(?\b\d{2}\)?\s?9?\d{4}-\d{4}\b")
PERSONAL_TAGS = r"(?i)cpf|email|telefone|celular|endereco"
#: Shapes of values, the first that fits.
SHAPES = (
    ("empty", r"^$"),
    ("zero", r"^-?0+(\.0+)?$"),
    ("integer", r"^-?\d+$"),
    ("decimal_dot", r"^-?\d+\.\d+$"),
    ("decimal_comma", r"^(-?\d{1,3}(\.\d{3})*,\d+|-?\d+,\d+)$"),
    ("date_iso", r"^\d{4}-\d{2}-\d{2}$"),
    ("date_br", r"^\d{2}/\d{2}/\d{4}$"),
    ("cnpj_formatted", r"^[\dA-Z]{2}\.[\dA-Z]{3}\.[\dA-Z]{3}/[\dA-Z]{4}-\d{2}$"),
)
SECRETS = r"(?i)(token|senha|password|secret|api[_-]?key)(\s*[=:]\s*)\S+"


def _without_marks(text: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def _plain(texts: pa.Array) -> pa.Array:
    # a part at a time, so that a batch of long texts isn't held as Python strings too
    parts = (texts.slice(at, 64).to_pylist() for at in range(0, len(texts), 64))
    return pa.concat_arrays([pa.array([], pa.string()), *(pa.array([x if x is None or x.isascii() else _without_marks(x) for x in part], pa.string()) for part in parts)])


def _sign_by_sign() -> tuple[str, str, str]:
    """Signs that become another one, those signs and then none for marks, and a class of all signs that don't become several.

    Marks go wherever they stand, so a text's plain form is that of its signs, one after another. Latin letters,
    combining marks, dashes and quotes are looked at; what is not among them is left to Python.
    """
    signs = [chr(c) for a, b in ((0, 0x180), (0x300, 0x370), (0x2010, 0x2024)) for c in range(a, b)]
    plain = {c: _without_marks(c) for c in signs}
    changed = [c for c in signs if len(plain[c]) == 1 and plain[c] != c]
    gone = [c for c in signs if not plain[c]]
    simple = "".join(f"\\u{ord(c):04x}" for c in signs if len(plain[c]) < 2 and ord(c) > 0x7F)
    return "".join(changed + gone), "".join(plain[c] for c in changed), simple


_CHANGED, _PLAIN, _SIMPLE = _sign_by_sign()
#: Letters of a text that is translated sign by sign.
SHORT = 500


def strip_accents(text: Column) -> Column:
    """Compatibility forms spelt out and combining marks dropped (NFKD, which Spark has no function for): "1º ﬁm" is "1o fim".

    Of texts that aren't ASCII, only long ones and those with signs that become several, or that are rare, go through
    Python: translating sign by sign pays for short texts alone.
    """
    ascii_only = F.octet_length(text) == F.char_length(text)
    handed = F.when(~ascii_only & ((F.char_length(text) > SHORT) | text.rlike(f"(?=[^\\x00-\\x7F])[^{_SIMPLE}]")), text)
    return F.coalesce(F.arrow_udf(_plain, "string")(handed), F.when(ascii_only, text).otherwise(F.translate(text, _CHANGED, _PLAIN)))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def fold(text: Column) -> Column:
    """STR-01: no accents, lower case, no outer blanks; null is empty."""
    return strip(F.lower(strip_accents(F.coalesce(text, F.lit("")))))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def matching_name(text: Column) -> Column:
    """STR-02: ASCII letters and digits in upper case, everything else one space."""
    ascii_only = F.regexp_replace(strip_accents(F.coalesce(text, F.lit(""))), r"[^\x00-\x7F]", "")
    return F.trim(F.regexp_replace(F.upper(ascii_only), "[^A-Z0-9]+", " "))


def series_key(text: Column) -> Column:
    """STR-03: folded, without the pipe character, blanks collapsed."""
    return collapse(F.replace(fold(text), F.lit("|"), F.lit("")))


def clean_identifier(text: Column) -> Column:
    """STR-05: no blanks, control or format characters, upper case; all zeros is empty."""
    cleaned = F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s\p{Cc}\p{Cf}]", ""))
    return F.when(cleaned.rlike(EMPTY_IDENTIFIER), "").otherwise(cleaned)


def real_isin(text: Column) -> Column:
    """STR-06: an ISIN of valid form, or empty."""
    cleaned = F.upper(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(cleaned.rlike("^[A-Z]{2}[A-Z0-9]{9}[0-9]$"), cleaned).otherwise("")


def value_shape(text: Column) -> Column:
    """STR-17: the name of the value's form."""
    found = F.lit("text")
    for name, pattern in reversed(SHAPES):
        found = F.when(text.rlike(pattern.replace(r"\d", "[0-9]")), name).otherwise(found)
    return found


def personal_data_suspected(tag: Column, text: Column) -> Column:
    """STR-17: by the tag's name, or by what the value looks like."""
    found = tag.rlike(PERSONAL_TAGS)
    for pattern in PERSONAL:
        found = found | text.rlike(pattern)
    return found


def shown_example(tag: Column, text: Column, most: int = 60) -> Column:
    """STR-17: a value as an example, letters and digits starred where it may be personal, cut at ``most``."""
    return let(F.when(personal_data_suspected(tag, text), F.regexp_replace(text, "[A-Za-z0-9]", "*")).otherwise(text), lambda x: F.when(F.char_length(x) <= most, x).otherwise(F.concat(F.substring(x, 1, most), F.lit("…"))))


def mask_personal(text: Column) -> Column:
    """STR-17: personal ids and e-mail addresses masked."""
    masked = F.regexp_replace(text, r"\b\d{3}\.?\d{3}\.?\d{3}-?\d{2}\b", "***.***.***-**")
    return F.regexp_replace(masked, PERSONAL[1], "***@***")


def mask_secrets(text: Column) -> Column:
    """STR-18: values of secret keys masked."""
    return F.regexp_replace(text, SECRETS, "$1$2***")


def has_secret(text: Column) -> Column:
    return text.rlike(SECRETS)


def party_tokens(text: Column) -> Column:
    """STR-11: w= words of a party's name and cnpj= identifiers written in it, sorted.

    Identifiers of digits alone are taken as they are; one with letters only if its check digits are right.
    """
    given = F.coalesce(text, F.lit(""))
    folded = F.lower(strip_accents(given))
    digits = F.transform(F.regexp_extract_all(folded, F.lit(r"(\d{2}\.?\d{3}\.?\d{3}/?\d{4}-?\d{2})")), lambda x: F.concat(F.lit("cnpj="), F.regexp_replace(x, r"\D", "")))
    lettered = F.filter(F.regexp_extract_all(given, F.lit(r"((?<![0-9A-Za-z])[0-9A-Z]{2}\.?[0-9A-Z]{3}\.?[0-9A-Z]{3}/?[0-9A-Z]{4}-?[0-9]{2}(?![0-9A-Za-z]))")), lambda x: x.rlike("[A-Z]"))
    lettered = F.filter(F.transform(lettered, lambda x: F.concat(F.lit("cnpj="), normalise_cnpj(F.regexp_replace(x, r"[./-]", "")))), lambda x: x.isNotNull())
    words = F.regexp_extract_all(F.element_at(F.split(folded, NAME_END, 2), 1), F.lit("([a-z0-9]{3,})"))
    words = F.transform(F.array_except(words, F.array(*[F.lit(x) for x in NAME_STOP_WORDS])), lambda w: F.concat(F.lit("w="), F.upper(w)))
    return F.array_sort(F.array_distinct(F.concat(digits, lettered, words)))


def same_company(a: Column, b: Column) -> Column:
    """STR-04: equal names once normalised, neither empty."""
    x, y = matching_name(a), matching_name(b)
    return (x == y) & (x != "")
