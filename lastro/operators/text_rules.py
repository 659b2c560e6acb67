"""Rules over texts (TXT-*): ordered keywords, strict categories, topics, clauses, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_category(text: Column, rules: list[tuple[str, str]], other: str = "other") -> Column:
    """TXT-01: the first rule whose pattern is found names the category."""
    found = F.lit(other)
    for name, pattern in reversed(rules):
        found = F.when(text.rlike(pattern), name).otherwise(found)
    return found


def strict_category(text: Column, rules: list[tuple[str, str]], veto: str | None = None, other: str = "other") -> Column:
    """TXT-02: a veto, then exactly one category, else other; several are ambiguous."""
    found = F.array_distinct(F.filter(F.array(*[F.when(text.rlike(p), F.lit(n)) for n, p in rules]), lambda x: x.isNotNull()))
    n = F.size(found)
    result = F.when(n == 1, F.element_at(found, 1)).when(n > 1, "ambiguous").otherwise(other)
    return F.when(text.rlike(veto), other).otherwise(result) if veto else result


def topic_excerpt(text: Column, pattern: str, before: int = 80, after: int = 120) -> Column:
    """TXT-04: the text around the first place where the pattern is found; null if nowhere."""
    at = F.regexp_instr(text, F.lit(pattern))
    return F.when(at > 0, F.substring(text, F.greatest(F.lit(1), at - before), F.least(at - 1, F.lit(before)) + after))


def excerpt_evidence(text: Column, most: int = 300) -> dict[str, Column]:
    """TXT-14: a bounded excerpt and the hash of the whole."""
    return {"excerpt": F.substring(text, 1, most), "text_sha256": F.sha2(text, 256)}


def clause_lines(texts: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """TXT-10: (key, line, clause) for each line that has the pattern."""
    lines = texts.select(key, F.posexplode(F.split(text, "\n")).alias("line", "clause"))
    return lines.where(F.col("clause").rlike(pattern)).withColumn("line", F.col("line") + 1)


def term_candidates(texts: DataFrame, key: str, text: str, patterns: list[tuple[int, str]]) -> DataFrame:
    """TXT-07: (key, candidate, strength): every distinct match, the strongest pattern that found it."""
    found = None
    for strength, pattern in patterns:
        part = texts.select(key, F.explode(F.regexp_extract_all(text, F.lit(f"({pattern})"))).alias("candidate"), F.lit(strength).alias("strength"))
        found = part if found is None else found.unionByName(part)
    return found.groupBy(key, "candidate").agg(F.max("strength").alias("strength"))


def near_anchor(text: Column, anchor: str, value: str, reach: int = 200) -> Column:
    """TXT-08: the first value within ``reach`` characters after the anchor; empty if none."""
    return F.regexp_extract(text, f"(?s){anchor}.{{0,{reach}}}?({value})", 1)


#: A line of a table of contents, the title of an annex, words that begin a meaning in a glossary.
TOC_LINE = r"(\.{4,}|…{2,}|_{4,})\s*\d+\s*$"
ANNEX_TITLE = r"^ANEXO\s+(?:[IVXLC]+|[A-Z]|\d+)\b"
MEANING = r"^(?:significa|tem o significado|possui o significado|terao? o significado|tem os significados|correspondem?|refere-se)"
TOC_LINES, GLOSSARY_LINES, FIRST_ANNEX_PAGE = 5, 4, 4


def page_kinds(pages: DataFrame, doc: str = "doc_id", page: str = "page", text: str = "text") -> DataFrame:
    """TXT-09: (doc, page, is_toc, is_glossary, is_annex) of a contract's pages.

    A table of contents has five lines that end in leaders and a number; a glossary four quoted terms and three
    meanings; an annex runs from a page that opens with its title, after the third page, but for one that holds the
    consolidated contract.
    """
    from .excerpts import in_annex, page_flags

    flags = pages.select(doc, page, *[c.alias(n) for n, c in page_flags(F.col(text), F.col(page)).items()])
    return flags.select(doc, page, "is_toc", "is_glossary", in_annex([doc], page).alias("is_annex"))


def contract_sections(pages: DataFrame) -> DataFrame:
    """TXT-09: each line's kind: table of contents, annex, clause, definition or body; with the clause it lies in."""
    line = F.col("line_text")
    kind = (
        F.when(line.rlike(TOC_LINE), "toc")
        .when(line.rlike(r"(?iu)^\s*anexo\s+[ivx\d]+"), "annex")
        .when(line.rlike(r"(?iu)^\s*(cl[aá]usula|\d+(\.\d+)*\.?\s)"), "clause")
        .when(line.rlike("^\\s*[\"“][^\"”]+[\"”]\\s*[:\\-–]"), "definition")
        .otherwise("body")
    )
    lines = pages.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "line_text")).withColumn("kind", kind)
    w = Window.partitionBy("doc_id").orderBy("line")
    return lines.withColumn("clause", F.last(F.when(F.col("kind").isin("clause", "annex"), F.trim("line_text")), True).over(w))


#: Verbs of a decision in folded Portuguese, by outcome, the negated first.
DECISIONS = (
    ("rejected", r"nao\s+(?:foi\s+|foram\s+)?aprovad|reprovad|rejeitad"),
    ("suspended", r"suspens|adiad|retirad[ao]s?\s+de\s+pauta"),
    ("no_quorum", r"(?:falta|ausencia|sem)\s+(?:de\s+)?quorum|nao\s+instalad"),
    ("approved", r"aprovad|aprovou|aprovaram|deliberad"),
)


def decisions(folded: Column) -> Column:
    """TXT-05: array of struct<sentence, outcome> for sentences of minutes that hold a decision.

    A sentence owns its verb; a negated verb is looked for before the plain one.
    """
    sentences = F.split(folded, r"(?<=[.;])\s+")
    outcome = lambda s: F.coalesce(*[F.when(s.rlike(p), F.lit(n)) for n, p in DECISIONS])
    marked = F.transform(sentences, lambda s: F.struct(s.alias("sentence"), outcome(s).alias("outcome")))
    return F.filter(marked, lambda x: x["outcome"].isNotNull())


#: Comparisons and the number that follows them, in contracts.
LIMIT = (
    r"(?iu)(n[ãa]o\s+(?:poder[áa]\s+ser\s+|ser[áa]\s+|seja\s+|deve(?:r[áa])?\s+ser\s+)?(?:superior|maior|inferior|menor)"
    r"|igual\s+ou\s+(?:inferior|superior|menor|maior)|(?:inferior|superior|menor|maior)\s+ou\s+igual"
    r"|(?:inferior|superior|menor|maior)(?:\s+(?:a|que|do\s+que))?|(?:no\s+|ao\s+)?m[áa]ximo(?:\s+de)?,?|(?:no\s+|ao\s+)?m[íi]nimo(?:\s+de)?,?"
    r"|pelo\s+menos|≤|≥|<=|>=|<|>)"
    r"\s*(?:a\s+|que\s+|de\s+)?\(?\s*(\d{1,3}(?:[.,]\d+)?)\s*(%|x\b|vezes)?"
)
SYMBOLS = {"≤": "<=", "<=": "<=", "<": "<", "≥": ">=", ">=": ">=", ">": ">"}
#: Covenants and guarantees, by what names them.
COVENANTS = {
    "razao_garantia": r"Raz[ãa]o (?:M[íi]nima )?de Garantia|[ÍI]ndice de Cobertura|Raz[ãa]o de Cobertura",
    "ltv": r"(?i)\bLTV\b|Loan[- ]to[- ]Value",
    "divida_liquida_ebitda": r"D[íi]vida (?:Financeira )?L[íi]quida(?: Consolidada)?\s*(?:/|sobre|dividida pelo|e o)\s*(?:o )?EBITDA",
    "ebitda_despesa_financeira": r"EBITDA(?: Ajustado)?\s*(?:/|sobre|dividido pel[ao]s?)\s*(?:as |a |o )?(?:Despesas? Financeiras?|Resultado Financeiro)",
    "liquidez_corrente": r"[ÍI]ndice de Liquidez(?: Corrente)?|\bLiquidez Corrente\b",
    "endividamento_patrimonio": r"(?:D[íi]vida|Endividamento)[^.;]{0,30}(?:/|sobre)\s*(?:o )?Patrim[ôo]nio L[íi]quido",
}
GUARANTEES = {
    "alienacao_fiduciaria_imovel": r"Aliena[çc][ãa]o Fiduci[áa]ria (?:de |do |dos |da |das )?(?:Im[óo]ve|Fra[çc][ãa]o|Terreno|Unidade)",
    "alienacao_fiduciaria_participacao": r"Aliena[çc][ãa]o Fiduci[áa]ria (?:de |das |dos )?(?:A[çc][õo]es|Quotas|Cotas|Participa)",
    "alienacao_fiduciaria_bens": r"Aliena[çc][ãa]o Fiduci[áa]ria (?:de |das |dos )?(?:Equipamentos|M[áa]quinas|Bens M[óo]veis|Ve[íi]culos|Estoques?|Produtos|Gr[ãa]os|Caf[ée]|Soja|Milho|Gado|Animais)",
    "cessao_fiduciaria": r"Cess[ãa]o Fiduci[áa]ria",
    "fianca": r"\bFian[çc]a\b",
    "aval": r"\bAval(?:istas?)?\b",
    "hipoteca": r"\bHipoteca\b",
    "penhor": r"\bPenhor\b",
    "coobrigacao": r"\b[Cc]oobriga[çc][ãa]o\b",
    "garantia_flutuante": r"\b[Gg]arantia [Ff]lutuante\b",
    "fundo_reserva": r"\bFundo de Reserva\b",
    "fundo_liquidez": r"\bFundo de (?:Liquidez|Reten[çc][ãa]o|Amortiza[çc][ãa]o)\b",
    "fundo_despesas": r"\bFundo de Despesas\b",
    "seguro": r"\bSeguro[- ](?:Garantia|de Cr[ée]dito)\b",
}
#: What denies a guarantee in its sentence and after its label, where sentences end, and how often a covenant is measured.
DENIED = (
    r"(?iu)\bn[ãa]o\s+(?:contar[ãa]o|contar[áa]|conta(?:m)?|haver[áa]|h[áa]|ser[ãa]o\s+constitu[íi]d[ao]s|ser[áa]\s+constitu[íi]d[ao]|"
    r"possui|possuem|contam?|est[ãa]o\s+sujeit[ao]s)\b|\bsem\s+(?:qualquer\s+)?(?:garantia|coobriga)|\bn[ãa]o\s+se\s+aplica"
)
LABEL_DENIED = r"(?iu)[:–-]\s*n[ãa]o\b|\bn[ãa]o\s+exist|\binexist"
HEADING = r"(?iu)^\(?[0-9ivxlc.]*\)?\s*[\p{L}\p{N}_\sçãõáéíóúâêô]{0,45}[.:]?$"
#: What a list of the trustee's other issues is made of, and what begins a definition.
ISSUE_STATUS = r"(?iu)Adimplente|Inadimplente|Inadimplementos? no per[íi]odo"
OTHER_ISSUES = r"(?iu)Inadimplementos? no per[íi]odo|Valor (?:Total )?da Emiss[ãa]o:|Quantidade de (?:ativos|t[íi]tulos|CR[IA]s?|valores)|\bAdimplente\b|\bInadimplente\b|Data de Vencimento:|Esp[ée]cie:|Remunera[çc][ãa]o:|Emissora:"
DEFINES = r"(?iu)tem o significado|significa|ter[áa] o significado"
AMOUNTS = r"R\$\s?\d{1,3}(?:\.\d{3})*(?:,\d{2})?"
SHARES = r"\d{1,3}(?:,\d+)?\s?%"
#: Letters of a sentence that a short answer may follow, of that answer, and read after a heading.
SHORT, ANSWER, AFTER_HEADING, AFTER_LABEL = 70, 40, 250, 40
SENTENCE_END = r"(?<=[.;:])(?=\s+[A-ZÁÉÍÓÚÂÊÔÃÕÇ(\"“'(])|(?<=[.;])(?=\s*\n)"
PERIOD = r"(?iu)\b(trimestral(?:mente)?|semestral(?:mente)?|anual(?:mente)?|mensal(?:mente)?)\b"


def limit_operator(raw: Column) -> Column:
    """TXT-06: the comparison that is asked for: "não poderá ser superior a" is <=, "igual ou superior a" is >=, "superior a" is >."""
    low = F.lower(F.trim(F.regexp_replace(raw, r"\s+", " ")))
    denied, equal = low.rlike("^n[ãa]o "), low.contains("igual")
    symbol = F.lit(None).cast("string")
    for sign, operator in SYMBOLS.items():
        symbol = F.when(low == sign, operator).otherwise(symbol)
    words = (
        F.when(low.rlike("m[áa]ximo"), "<=")
        .when(low.rlike("m[íi]nimo") | low.contains("pelo menos"), ">=")
        .when(low.rlike("superior|maior"), F.when(denied, "<=").when(equal, ">=").otherwise(">"))
        .when(low.rlike("inferior|menor"), F.when(denied, ">=").when(equal, "<=").otherwise("<"))
        .otherwise("")
    )
    return F.coalesce(symbol, words)


def limits(text: Column) -> Column:
    """TXT-06: array of struct<operator, limit, unit> for the comparisons with a number in a covenant's text, in order."""
    group = lambda k: F.regexp_extract_all(text, F.lit(LIMIT), F.lit(k))
    found = F.arrays_zip(group(1).alias("o"), group(2).alias("n"), group(3).alias("u"))
    unit = lambda x: F.replace(F.lower(x["u"]), F.lit("vezes"), F.lit("x"))
    return F.transform(found, lambda x: F.struct(limit_operator(x["o"]).alias("operator"), F.replace(x["n"], F.lit(","), F.lit(".")).cast("double").alias("limit"), unit(x).alias("unit")))


def lists_other_issues(text: Column) -> Column:
    """TXT-06: a page that lists the trustee's other issues, whose guarantees are not this contract's."""
    status = F.regexp_count(text, F.lit(ISSUE_STATUS))
    return (status >= 2) | ((status >= 1) & (F.regexp_count(text, F.lit(OTHER_ISSUES)) >= 5))


def first_limit(text: Column) -> Column:
    """The first of ``limits``, null if there is none: what follows it is not searched."""
    return F.try_element_at(limits(F.regexp_extract(text, LIMIT, 0)), F.lit(1))


def sentences(pages: DataFrame, doc: str = "doc_id", page: str = "page", text: str = "text", headings: bool = True) -> DataFrame:
    """(doc, page, at, sentence, raw, following): the sentences of pages, blanks collapsed; lists of other issues are left out.

    A short sentence has the short one behind it as its answer ("Coobrigação da Emissora." "Não há."). following: what the
    page says after a heading, null for other sentences; without ``headings``, (doc, page, at, sentence) alone.
    """
    parts = F.split(text, SENTENCE_END)
    clean = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    # each sentence has two letters or more, so that half as many sentences as letters are enough
    after = lambda i: F.substring(F.array_join(F.slice("parts", i + 2, AFTER_HEADING // 2), ""), 1, AFTER_HEADING)
    cut = pages.where(~lists_other_issues(F.coalesce(F.col(text), F.lit("")))).select(doc, page, parts.alias("parts"))
    cut = cut.select(doc, page, "parts", F.transform("parts", clean).alias("clean"))

    def whole(x: Column, i: Column) -> Column:
        answer = F.get("clean", i + 1)
        return F.when((F.char_length(x) < SHORT) & (F.char_length(answer) <= ANSWER), F.rtrim(F.concat(x, F.lit(" "), answer))).otherwise(x)

    if headings:
        found = F.transform("clean", lambda x, i: F.struct(whole(x, i).alias("sentence"), F.get("parts", i).alias("raw"), F.when(whole(x, i).rlike(HEADING), after(i)).alias("following")))
    else:
        found = F.transform("clean", lambda x, i: F.struct(whole(x, i).alias("sentence")))
    rows = cut.select(doc, page, F.posexplode(found).alias("at", "s"))
    return rows.select(doc, page, "at", "s.*").where("sentence <> ''")


def covenant_terms(pages: DataFrame, doc: str = "doc_id", page: str = "page") -> DataFrame:
    """TXT-06: (doc, item, status, operator, limit, unit, period, page): each covenant's first sentence with a limit, else its first."""
    found = sentences(pages, doc, page, headings=False)
    named = F.filter(F.array(*[F.when(F.col("sentence").rlike(p), F.struct(F.lit(n).alias("item"), F.regexp_extract("sentence", f"({p})" if not p.startswith("(?i)") else f"(?i)({p[4:]})", 1).alias("name"))) for n, p in COVENANTS.items()]), lambda x: x.isNotNull())
    rows = found.select(doc, page, "at", "sentence", F.explode(named).alias("c"))
    rows = rows.withColumn("l", first_limit(F.expr("substring(sentence, greatest(1, locate(c.name, sentence)))")))
    best = rows.groupBy(doc, F.col("c.item").alias("item")).agg(F.min_by(F.struct(page, "sentence", "l"), F.struct(F.col("l").isNull().alias("none"), page, "at")).alias("b"))
    period = F.lower(F.regexp_extract("b.sentence", PERIOD, 1))
    return best.select(doc, "item", F.when(F.col("b.l").isNotNull(), "com_limite").otherwise("sem_limite").alias("status"), "b.l.operator", "b.l.limit", "b.l.unit", period.alias("period"), F.col(f"b.{page}").alias(page))


def guarantee_terms(pages: DataFrame, doc: str = "doc_id", page: str = "page") -> DataFrame:
    """TXT-06: (doc, item, status, page, amounts, sentence): presente from two mentions that affirm a guarantee, citada from one, negada if all deny it.

    A heading affirms nothing: it denies if what follows it does. The sentence shown is the first that affirms without
    defining, else the first that affirms, else the first that denies, with its amounts and shares.
    """
    found = sentences(pages, doc, page)
    named = F.filter(F.array(*[F.when(F.col("sentence").rlike(p) & F.col("raw").rlike(p), F.struct(F.lit(n).alias("item"), F.regexp_count("raw", F.lit(p)).alias("n"), F.regexp_replace("raw", f"^(?s:.*?)(?:{p})", "").alias("rest"))) for n, p in GUARANTEES.items()]), lambda x: x.isNotNull())
    rows = found.select(doc, page, "at", "sentence", "following", F.inline(named))
    behind = F.trim(F.regexp_replace(F.substring(F.concat("rest", "following"), 1, AFTER_HEADING), r"\s+", " "))
    denies = F.col("sentence").rlike(DENIED) | F.col("sentence").rlike(LABEL_DENIED)
    heading_denies = behind.rlike(DENIED) | F.substring(behind, 1, AFTER_LABEL).rlike(LABEL_DENIED)
    kind = F.when(denies, "denied").when(F.col("following").isNotNull(), F.when(heading_denies, "denied")).otherwise("affirmed")
    rows = rows.withColumn("kind", kind).where("kind is not null")
    n = F.coalesce(F.sum(F.when(F.col("kind") == "affirmed", F.col("n"))), F.lit(0))
    shown = F.struct((F.col("kind") == "denied").alias("denied"), (F.col("sentence").rlike(DEFINES) & (F.col("kind") == "affirmed")).alias("defines"), page, "at")
    best = rows.groupBy(doc, "item").agg(F.when(n >= 2, "presente").when(n == 1, "citada").otherwise("negada").alias("status"), F.min_by(F.struct(page, "sentence"), shown).alias("b"))
    values = lambda p: F.regexp_extract_all("b.sentence", F.lit(f"({p})"))
    amounts = F.substring(F.array_join(F.array_distinct(F.concat(values(AMOUNTS), values(SHARES))), "; "), 1, 200)
    return best.select(doc, "item", "status", F.col(f"b.{page}").alias(page), amounts.alias("amounts"), F.substring("b.sentence", 1, 400).alias("sentence"))


def page_recall(found: Column, expected: Column, tolerance: int) -> Column:
    """TXT-11: any found page within ``tolerance`` of the expected one."""
    return F.exists(found, lambda p: F.abs(p - expected) <= tolerance)


def html_pairs(html: Column) -> Column:
    """SCAN-12: label to value of two-cell rows and definition lists; the first label wins."""
    cell = lambda tag: rf"<{tag}[^>]*>(.*?)</{tag}>"
    rows = rf"(?is)<tr[^>]*>\s*{cell('t[dh]')}\s*{cell('td')}\s*</tr>"
    lists = rf"(?is){cell('dt')}\s*{cell('dd')}"
    read = lambda p: F.arrays_zip(F.regexp_extract_all(html, F.lit(p), F.lit(1)).alias("k"), F.regexp_extract_all(html, F.lit(p), F.lit(2)).alias("v"))
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]+>", ""), r"\s+", " "))
    pairs = F.transform(F.concat(read(rows), read(lists)), lambda x: F.struct(clean(x["k"]).alias("key"), clean(x["v"]).alias("value")))
    first = F.aggregate(pairs, F.array().cast("array<struct<key:string,value:string>>"), lambda s, x: F.when(F.exists(s, lambda y: y["key"] == x["key"]), s).otherwise(F.concat(s, F.array(x))))
    return F.map_from_entries(first)
