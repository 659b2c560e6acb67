"""Candidates for a securitisation term's values, read from its pages (TXT-07, TXT-08); ``terms`` compares them with the market."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identifiers import let, valid_cnpj
from ..functions.text import collapse
from ..functions.values import rate_numbers

#: How each field is written: letters of which some must be there, and the pattern, in which V is the value. The first pattern is the field's own, the second a looser one.
DATE = r"(?:\d{1,2}\s*(?:º|o)?\s+de\s+[a-zç]+\s+de\s+\d{4}|\d{2}/\d{2}/\d{4})"
MONEY = r"[\d.]{1,20},\d{2}"
COUNT = r"[\d.]{3,15}"
PATTERNS = {
    "data_emissao": (
        DATE,
        (("data de emiss",), r"data de emiss[aã]o(?: dos (?:cra|cri))?\W{0,4}(?:[^.;\d]{0,60}?)V"),
        (("data de emiss",), r"data de emiss[aã]o(?: dos (?:cra|cri))?[^.;]{0,120}?V"),
    ),
    "data_vencimento": (
        DATE,
        (("vencendo",), r"vencendo(?:-se)?,?\s+(?:portanto,?\s+)?em\s+V"),
        (("data de vencimento",), r"data de vencimento(?: final)?(?: dos (?:cra|cri))?[^.;]{0,160}?V"),
    ),
    "valor_total": (
        MONEY,
        (("valor total da",), r"valor total da (?:emiss[aã]o|oferta)[^.;]{0,120}?r\$\s*V"),
        (("valor global",), r"valor global(?: dos (?:cra|cri))?[^.;]{0,80}?r\$\s*V"),
    ),
    "quantidade": (
        COUNT,
        (("compreende", "emitidos", "emiss", "quantidade de"), r"(?:compreende|ser[aã]o emitidos|emiss[aã]o de|quantidade de (?:cra|cri)[^\d]{0,60}?)\s*V\s*\("),
        ((") cra", ") cri", ") certificados", ")cr", ")certificados"), r"\bV\s*\([^)]{3,80}\)\s*(?:cra|cri|certificados)\b"),
    ),
    "valor_nominal_unitario": (MONEY, (("valor nominal unit",), r"valor nominal unit[aá]rio[^.;]{0,80}?r\$\s*V")),
}
MONTHS = ("janeiro", "fevereiro", "marco", "abril", "maio", "junho", "julho", "agosto", "setembro", "outubro", "novembro", "dezembro")
BACKING = r"deb[eê]ntures?|notas? comerciais|nota comercial|\bccbs?\b|c[eé]dulas? de cr[eé]dito|\bcdcas?\b|\bcpr(?:-f)?s?\b|\bccis?\b"
SECURITY = r"\bcra\b|\bcri\b|certificados de receb[ií]veis"
RATE_ANCHOR = r"juros remunerat[oó]rios|remunera[cç][aã]o (?:dos (?:cra|cri)|da (?:\d+ª )?s[eé]rie)|far[aã]o jus a|sobretaxa|spread"
DEBTOR_ANCHOR = r"devedor[ae]?s?\b|cedentes?\b|emitente\b|avalistas?\b|fiador[ae]?s?\b"
CNPJ = r"\d{2}\.?\d{3}\.?\d{3}\s*/\s*\d{4}\s*-?\s*\d{2}"
LETTERED_CNPJ = r"(?<![0-9A-Za-z])[0-9A-Z]{2}\.?[0-9A-Z]{3}\.?[0-9A-Z]{3}\s*/\s*[0-9A-Z]{4}\s*-?\s*[0-9]{2}(?![0-9A-Za-z])"
#: Letters read before a due date, shown around a candidate, and read after an anchor.
BEFORE, SHOWN_BEFORE, SHOWN_AFTER, RATE_REACH, DEBTOR_REACH = 250, 40, 20, 360, 600


def speaks_of_backing(before: Column) -> Column:
    """TXT-07: whether the text before a date names the backing title after it last named the security."""
    return before.rlike(f"(?iUs)(?:{BACKING})(?!.*(?:{SECURITY}))")


def _date(raw: Column) -> Column:
    words = r"(?iU)^(\d{1,2})\s*(?:º|o)?\s+de\s+([a-zç]+)\s+de\s+(\d{4})$"
    name = F.replace(F.lower(F.regexp_extract(raw, words, 2)), F.lit("ç"), F.lit("c"))
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), name)
    written = F.when(month > 0, F.concat_ws("-", F.regexp_extract(raw, words, 3), F.lpad(month.cast("string"), 2, "0"), F.lpad(F.regexp_extract(raw, words, 1), 2, "0")))
    return F.when(raw.contains("/"), F.concat_ws("-", F.substring(raw, 7, 4), F.substring(raw, 4, 2), F.substring(raw, 1, 2))).otherwise(written)


def _amount(raw: Column) -> Column:
    plain = F.regexp_replace(F.replace(F.replace(raw, F.lit("."), F.lit("")), F.lit(","), F.lit(".")), r"^0+(?=\d)", "")
    return F.when(plain.startswith("."), F.concat(F.lit("0"), plain)).otherwise(plain)


def _count(raw: Column) -> Column:
    digits = F.replace(raw, F.lit("."), F.lit(""))
    return F.when(digits.rlike("[1-9]"), digits)


READ = {DATE: _date, MONEY: _amount, COUNT: _count}


def _matches(text: Column, pattern: str, value: str) -> Column:
    """array<struct<before, whole, raw, after>> of all matches: one pass of the pattern, each match then looked for behind the last one."""
    wholes = F.regexp_extract_all(text, F.lit(f"(?iUs)({pattern.replace('V', f'(?:{value})')})"), F.lit(1))
    return let(wholes, lambda found: _around(text, found, pattern, value))


def _around(text: Column, wholes: Column, pattern: str, value: str) -> Column:
    start = F.struct(F.array().cast("array<int>").alias("ats"), F.lit(1).alias("next"))

    def placed(s: Column, whole: Column) -> Column:
        put = lambda at: F.struct(F.array_append(s["ats"], at).alias("ats"), (at + F.char_length(whole)).alias("next"))
        return let(F.position(whole, text, s["next"]), put)

    ats = F.aggregate(wholes, start, placed, lambda s: s["ats"])
    raw = f"(?iUs){pattern.replace('V', f'({value})')}"

    def match(m: Column) -> Column:
        at, whole = m["at"], m["whole"]
        before = F.substring(text, F.greatest(F.lit(1), at - BEFORE), F.least(at - 1, F.lit(BEFORE)))
        return F.struct(before.alias("before"), whole.alias("whole"), F.regexp_extract(whole, raw, 1).alias("raw"), F.substring(text, at + F.char_length(whole), F.lit(SHOWN_AFTER)).alias("after"))

    return F.transform(F.arrays_zip(ats.alias("at"), wholes.alias("whole")), match)


def _candidate(field: str, strength: int, read):
    """What a match of a field's pattern says, as a function of the match and its number."""

    def candidate(m: Column, at: Column) -> Column:
        kind = F.when(speaks_of_backing(m["before"]), "data_vencimento_lastro").otherwise(field) if field == "data_vencimento" else F.lit(field)
        excerpt = F.trim(F.concat(F.right(m["before"], F.lit(SHOWN_BEFORE)), m["whole"], m["after"]))
        return F.struct(kind.alias("field"), F.lit(strength).alias("strength"), at.alias("at"), read(m["raw"]).alias("value"), excerpt.alias("excerpt"))

    return candidate


def _may_hold(low: Column, letters: tuple[str, ...]) -> Column:
    """Whether a text in lower case holds some of ``letters``; true for those with a long s or an i without its dot or with one more, which patterns of any case take for s and i."""
    return reduce(lambda a, b: a | b, [low.contains(x) for x in (*letters, "ſ", "ı", "i\u0307")])


def value_candidates(pages: DataFrame) -> DataFrame:
    """TXT-07: (asset, doc, doc_rank, field, strength, page, value, excerpt): each distinct value of a field in a document, where it stands first.

    pages: asset, doc, doc_rank, page, text. Values are ISO dates, amounts with a point, whole numbers; what can't be read is
    no candidate. A due date after words of the backing title is one of ``data_vencimento_lastro``.
    """
    flat = pages.select("asset", "doc", "doc_rank", "page", F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", " ").alias("flat"))
    flat = flat.withColumn("low", F.lower("flat"))
    none = F.array().cast("array<struct<field:string,strength:int,at:int,value:string,excerpt:string>>")
    parts = []
    for field, (value, *patterns) in PATTERNS.items():
        for strength, (letters, pattern) in enumerate(patterns):
            found = F.transform(_matches(F.col("flat"), pattern, value), _candidate(field, strength, READ[value]))
            # most pages don't hold the letters, which are cheap to look for
            parts.append(F.when(_may_hold(F.col("low"), letters), found).otherwise(none))
    rows = flat.select("asset", "doc", "doc_rank", "page", F.inline(F.concat(*parts))).where("value is not null")
    first = F.min_by(F.struct("strength", "page", "excerpt"), F.struct("page", "strength", "at"))
    return rows.groupBy("asset", "doc", "doc_rank", "field", "value").agg(first.alias("f")).select("asset", "doc", "doc_rank", "field", "f.strength", "f.page", "value", "f.excerpt")


def _after(text: Column, anchor: str, reach: int) -> Column:
    """The text from each place where the anchor stands on, ``reach`` letters of it."""
    return F.regexp_extract_all(text, F.lit(f"(?iUs)(?={anchor})(?=(.{{1,{reach}}}))"), F.lit(1))


def rate_candidates(pages: DataFrame) -> DataFrame:
    """TXT-08: (asset, doc, doc_rank, field, strength, page, value): numbers of rates near what names the remuneration, with two places; the first page of each."""
    flat = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", " ")
    near = pages.select("asset", "doc", "doc_rank", "page", F.explode(_after(flat, RATE_ANCHOR, RATE_REACH)).alias("chunk"))
    rows = near.select("asset", "doc", "doc_rank", "page", F.explode(rate_numbers(F.col("chunk"))).alias("value"))
    found = rows.groupBy("asset", "doc", "doc_rank", "value").agg(F.min("page").alias("page"))
    return found.select("asset", "doc", "doc_rank", F.lit("remuneracao").alias("field"), F.lit(0).alias("strength"), "page", "value")


def debtor_candidates(pages: DataFrame) -> DataFrame:
    """TXT-08: (asset, doc, doc_rank, field, strength, page, value): valid company numbers after a debtor, assignor, issuer or surety is named.

    A definition often ends on the next page, so a document's pages are read as one text; page is that of its first one.
    Numbers with letters count in upper case only.
    """
    held = pages.groupBy("asset", "doc", "doc_rank").agg(F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text")))).alias("p"))
    whole = collapse(F.array_join(F.transform("p", lambda x: x["text"]), " "))
    chunks = held.select("asset", "doc", "doc_rank", F.col("p")[0]["page"].alias("page"), F.explode(_after(whole, DEBTOR_ANCHOR, DEBTOR_REACH)).alias("chunk"))
    lettered = F.filter(F.regexp_extract_all("chunk", F.lit(f"({LETTERED_CNPJ})")), lambda x: x.rlike("[A-Z]"))
    raw = chunks.select("asset", "doc", "doc_rank", "page", F.explode(F.concat(F.regexp_extract_all("chunk", F.lit(f"({CNPJ})")), lettered)).alias("raw"))
    value = raw.select("asset", "doc", "doc_rank", "page", F.regexp_replace("raw", "[^0-9A-Z]", "").alias("value")).distinct()
    return value.where(valid_cnpj(F.col("value"))).select("asset", "doc", "doc_rank", F.lit("devedor").alias("field"), F.lit(0).alias("strength"), "page", "value")


def term_candidates(pages: DataFrame) -> DataFrame:
    """TXT-07, TXT-08: all candidates, as ``terms.term_verdicts`` takes them."""
    return value_candidates(pages).drop("excerpt").unionByName(rate_candidates(pages)).unionByName(debtor_candidates(pages))
