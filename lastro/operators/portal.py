"""What a portal's listings, minutes and monthly grids are about (TXT-01, TXT-02, TXT-12, TXT-15, SCAN-22).

All rules are column expressions over one row, so they run inside the scan's stage. A null text is empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.identifiers import let
from ..functions.text import fold, strip
from .text_rules import first_category

#: Words of a listing's title, without accents, in lower case, signs as blanks.
RECEIPT = r"\bprotocolo\b"
STRONG_KINDS = [
    ("ata", r"\batas?\b|termo de nao instalacao|nao instalacao|\bsumario de ata"),
    ("edital", r"\bedital\b|\bconvocacao\b|\bconvocatoria\b"),
    ("fato_relevante", r"fatos? relevantes?"),
    ("proposta", r"\bproposta\b(?! vinculante)"),
]
WEAK_KINDS = [
    ("assembleia", r"\bassembleias?\b|\bag[teo]s?\b|\bage ?ago\b"),
    ("comunicado", r"\bcomunicados?\b|\bnotificacao\b|\baviso aos? (?:titulares|investidores)\b"),
]
OTHER_PAPERS = (
    r"relatorio|\binforme\b|demonstra[cç]|\bdfs?\b|termo de securitiza|\bprospecto\b|\blamina\b|"
    r"anuncio de (?:inicio|encerramento)|\baviso ao mercado\b|\brating\b|\bescritura\b|aditamento|"
    r"material de apoio|(?:inicio|encerramento|modificacao|revogacao|suspensao) da oferta|\bmonitoramento\b"
)

#: Grave decisions by the beginning of their names, grave topics, decisions that name no matter.
GRAVE_DECISIONS = [
    ("vencimento_antecipado_declarado", "vencimento antecipado declarado"),
    ("vencimento_antecipado_nao_declarado", "vencimento antecipado não declarado"),
    ("vencimento_antecipado_efeitos_sustados", "vencimento antecipado ocorrido, efeitos sustados"),
    ("sustacao_dos_efeitos_do_vencimento_antecipado_rejeitada", "sustação dos efeitos do vencimento antecipado rejeitada"),
    ("nao_declaracao_do_vencimento_antecipado_rejeitada", "não declaração do vencimento antecipado rejeitada"),
    ("recuperacao_judicial", "recuperação judicial"),
    ("liquidacao_patrimonio", "liquidação do patrimônio separado"),
    ("waiver", "waiver"),
    ("prorrogacao_repactuacao", "repactuação/prorrogação"),
]
GRAVE_TOPICS = {
    "vencimento_antecipado": "vencimento antecipado",
    "liquidacao_patrimonio": "liquidação do patrimônio separado",
    "waiver": "waiver",
    "prorrogacao_repactuacao": "repactuação/prorrogação",
}
DEFAULT_TOPIC, RECOVERY, RECOVERY_EVENT = "inadimplencia_devedor", r"(?iu)recupera[cç][aã]o (?:judicial|extrajudicial)|fal[eê]ncia", "recuperação judicial"
MATTERLESS = ("outras_materias_aprovadas", "ordem_do_dia_aprovada_em_bloco", "assembleia_suspensa", "nao_instalada", "sem_quorum_para_deliberar", "titulares_se_abstiveram")
GRAVEST_FIRST = ("vencimento antecipado", "recuperação judicial", "liquidação do patrimônio separado", "waiver", "repactuação/prorrogação")

#: What a monthly grid's status cell says, by the house that writes it.
MET, UNMET, NOT_APPLICABLE, UNVERIFIED_STATUS, OTHER_STATUS = "atendido", "nao_atendido", "nao_se_aplica", "nao_verificado", "outro"
GRID_STATUSES = {
    "vert": {
        "enquadrado": MET, "enquadrada": MET,
        "desenquadrado": UNMET, "desenquadrada": UNMET, "nao enquadrado": UNMET, "não enquadrado": UNMET,
        "n/a": NOT_APPLICABLE, "na": NOT_APPLICABLE, "nao se aplica": NOT_APPLICABLE, "não se aplica": NOT_APPLICABLE,
        "nao aplicavel": NOT_APPLICABLE, "não aplicável": NOT_APPLICABLE,
        "nao verificado": UNVERIFIED_STATUS, "não verificado": UNVERIFIED_STATUS, "nao apurado": UNVERIFIED_STATUS,
        "não apurado": UNVERIFIED_STATUS, "pendente": UNVERIFIED_STATUS, "em apuração": UNVERIFIED_STATUS,
        "-": "",
    },
    "canal": {"enquadrado": MET, "enquadrada": MET, "desenquadrado": UNMET, "desenquadrada": UNMET, "n/a": NOT_APPLICABLE, "na": NOT_APPLICABLE, "-": ""},
    "opea": {
        "atendido": MET, "nao atendido": UNMET, "não atendido": UNMET,
        "nao verificado": UNVERIFIED_STATUS, "não verificado": UNVERIFIED_STATUS,
        "nao se aplica": NOT_APPLICABLE, "não se aplica": NOT_APPLICABLE, "-": "",
    },
}
NOTE_MARKS = r"[\d¹²³⁴⁵*]+$"
FIRST_WORDS = ("enquadrado", "desenquadrado", "enquadrada", "desenquadrada")
BARI_UNMET, BARI_MET = r"^(desenquadrad|não atendido|nao atendido)|^descoberto$", r"^enquadrad|^(atendido|coberto)$"

#: Categories of a filing by words of its fields, in order; statements of accounts are never one.
STATEMENTS = r"\bdemonstracoes\s+financeiras\b|\bdemonstracao\s+financeira\b"
CATEGORY_RULES = [
    ("Termo de Securitização", "termo"),
    ("Aditamento", "aditamento"),
    ("Informe Mensal", "informe|mensal"),
    ("Ata/Edital", r"edital|\bata\b|\bago/e\b|\bago\b|\bage\b"),
    ("Fato Relevante", "fato relevante"),
    ("Relatório Agente Fiduciário", "agente fiduciario"),
    ("Relatório de Rating", "rating"),
    ("Anúncio de Encerramento", "encerramento"),
]
#: Strict rules: id, category, whether a real listing has shown it, fields in order, pattern, unless.
VETO = ("DF-VETO-01", "Outro", True, ("type", "name", "species"), r"\bdemonstracoes?\s+financeiras?\b", None)
STRICT_RULES = [
    ("IM-01", "Informe Mensal", True, ("type", "name"), r"\binforme\s+mensal\b", None),
    ("ATA-ESP-01", "Ata/Edital", True, ("species",), r"\bata\b", None),
    ("EDT-ESP-01", "Ata/Edital", True, ("species",), r"\bedital\b", None),
    ("ADT-01", "Aditamento", False, ("type", "name", "species"), r"\baditamento\b", None),
    ("TS-01", "Termo de Securitização", False, ("type", "name", "species"), r"\btermo\s+de\s+securitizacao\b", r"\baditamento\b"),
    ("FR-01", "Fato Relevante", False, ("type", "name", "species"), r"\bfato\s+relevante\b", None),
    ("AF-01", "Relatório Agente Fiduciário", False, ("type", "name", "species"), r"\brelatorio\s+(?:anual\s+)?(?:do\s+|de\s+)?agente\s+fiduciario\b", None),
    ("RT-01", "Relatório de Rating", False, ("type", "name", "species"), r"\brelatorio\s+de\s+(?:rating|classificacao\s+de\s+risco)\b", None),
    ("AE-01", "Anúncio de Encerramento", False, ("type", "name", "species"), r"\banuncio\s+de\s+encerramento\b", None),
]
OTHER = "Outro"

#: Names, stamps and amounts of a house's monthly reports.
STORED_FILE = r'href="(https?://[^"/]+/public/storage/Arquivo/\d{10}[^"]+)"'
FOLLOW_UP, MANAGEMENT = r"(?iu)acompanhamento mensal", r"(?iu)relat[óo]rio mensal\.pdf|relat[óo]rio de gest"
MONEY, UNIT_PRICE = r"R\$\s*-?[\d.]+,\d{2}", r"R\$\s*[\d.]+,\d{2,8}"
MANAGEMENT_LABELS = {
    "credits": ("Valor atualizado de todos os Créditos", MONEY),
    "retention_fund": ("(Fundo de Retenção)", MONEY),
    "expense_fund": ("(Fundo de Despesas)", MONEY),
    "reserve_fund": ("(Fundo de Reserva)", MONEY),
    "last_due_date": ("Data de Vencimento Final", r"\d{2}/\d{2}/\d{4}"),
}
ADHERENCE, NOT_ADHERENT = r"(N[ãa]o\s+Aderente|Aderente|Desenquadrad\w*|Enquadrad\w*)", r"(?iu)^(não|nao|desenq)"
CLASS_BALANCE = r"(S[êe]nior|Mezanino|Subordinada(?:\s+J[úu]nior)?)\s*(" + MONEY + ")"


def plain_title(text: Column) -> Column:
    """Folded, with signs and runs of blanks as one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(fold(text), r"[_\-.()\[\]/]+", " "), r"\s+", " "))


def document_kind(title: Column, category: Column) -> Column:
    """TXT-12: ata, edital, fato_relevante, proposta, assembleia or comunicado; empty for what is none of them.

    A title's own strong words come first. A paper of another sort is not saved by its category; a title that
    says nothing takes what the category says.
    """
    kind = lambda text, rules: first_category(text, rules, None)
    pair = F.struct(plain_title(title).alias("t"), plain_title(category).alias("c"))

    def told(p: Column) -> Column:
        t, c = p["t"], p["c"]
        other = F.when(t.rlike(OTHER_PAPERS) | c.rlike(OTHER_PAPERS), "")
        found = F.coalesce(kind(t, STRONG_KINDS), other, kind(t, WEAK_KINDS), kind(c, STRONG_KINDS), kind(c, WEAK_KINDS), F.lit(""))
        return F.when(t.rlike(RECEIPT) | c.rlike(RECEIPT), "").otherwise(found)

    return let(pair, told)


def only_drafted(kind: Column, meeting: Column, published: Column, today: Column) -> Column:
    """TXT-12: minutes of a meeting after ``today`` are a draft and decide nothing."""
    return kind.isin("ata", "assembleia") & (F.greatest(F.coalesce(meeting, published), F.coalesce(published, meeting)) > today)


def _grave_decision(event: Column) -> Column:
    """The name of a grave decision with how it was voted; null for others."""
    found = F.lit(None)
    for prefix, label in reversed(GRAVE_DECISIONS):
        name = F.lit(label)
        if not prefix.startswith(("vencimento", "nao_declaracao")):
            vote = F.regexp_extract(event, f"^{prefix}_*(aprovado|rejeitado)", 1)
            name = F.when(vote == "", name).otherwise(F.concat(name, F.lit(" ("), vote, F.lit(")")))
        found = F.when(event.startswith(prefix), name).otherwise(found)
    return found


def _grave_topic(topic: Column, excerpt: Column) -> Column:
    found = F.when((topic == DEFAULT_TOPIC) & excerpt.rlike(RECOVERY), RECOVERY_EVENT)
    for name, label in GRAVE_TOPICS.items():
        found = F.when(topic == name, label).otherwise(found)
    return found


def _gravest_first(events: Column) -> Column:
    """Distinct events without nulls, the gravest first, else as they came."""
    kept = F.array_distinct(F.filter(events, lambda e: e.isNotNull()))
    rank = lambda e: reduce(lambda found, k: F.when(e.startswith(GRAVEST_FIRST[k]), k).otherwise(found), reversed(range(len(GRAVEST_FIRST))), F.lit(99))
    return F.transform(F.array_sort(F.transform(kept, lambda e, at: F.struct(rank(e).alias("rank"), at.alias("at"), e.alias("e")))), lambda x: x["e"])


def grave_events(decisions: Column, topics: Column) -> Column:
    """TXT-12: struct(events, origin): what minutes decided, else what their text is about.

    ``decisions``: array<string>; ``topics``: array<struct<topic, excerpt>>. Minutes that decided a matter that
    is not grave take nothing from their text, where an early maturity is a stock clause.
    """
    decided = _gravest_first(F.transform(F.coalesce(decisions, F.array().cast("array<string>")), _grave_decision))
    discussed = _gravest_first(F.transform(F.coalesce(topics, F.array().cast("array<struct<topic: string, excerpt: string>>")), lambda x: _grave_topic(x["topic"], x["excerpt"])))
    matter = F.coalesce(F.exists(decisions, lambda e: ~e.isin(*MATTERLESS)), F.lit(False))
    result = lambda events, origin: F.struct(events.alias("events"), F.lit(origin).alias("origin"))
    none = result(F.array().cast("array<string>"), "")
    told = let(discussed, lambda d: F.when(F.size(d) > 0, result(d, "texto")).otherwise(none))
    return let(decided, lambda d: F.when(F.size(d) > 0, result(d, "decisão")).when(matter, none).otherwise(told))


def grid_status(text: Column, house: str) -> Column:
    """TXT-15: what a monthly grid's status cell says, as the ``house`` (bari, vert, canal, opea) writes it; empty for an empty cell.

    Words that a house has no status for are outro; those of bari are empty.
    """
    cell = F.lower(strip(F.coalesce(text, F.lit(""))))
    if house == "bari":
        return F.when(cell.rlike(BARI_UNMET), UNMET).when(cell.rlike(BARI_MET), MET).otherwise("")
    known = GRID_STATUSES[house]
    cell = strip(F.regexp_replace(cell, r"\s+", " "))
    if house == "vert":
        cell = strip(F.regexp_replace(cell, NOTE_MARKS, ""))

    def told(key: Column) -> Column:
        found = F.lit(OTHER_STATUS)
        if house == "canal":
            first = F.substring_index(key, " ", 1)
            for word in FIRST_WORDS:
                found = F.when(first == word, known[word]).otherwise(found)
        for name, status in known.items():
            found = F.when(key == name, status).otherwise(found)
        return F.when(key == "", "").otherwise(found)

    return let(cell, told)


def _joined(fields: tuple[Column, ...]) -> Column:
    return fold(F.concat_ws(" ", *fields))


def filing_category(category: Column, kind: Column, species: Column, name: Column) -> Column:
    """TXT-01: the category of a filing by its fields together; statements of accounts are Outro (their own category field doesn't say so)."""
    accounts = _joined((name, kind, species)).rlike(STATEMENTS)
    return F.when(accounts, OTHER).otherwise(let(_joined((category, kind, species, name)), lambda x: first_category(x, CATEGORY_RULES, OTHER)))


def strict_filing_category(kind: Column, species: Column, name: Column, unverified: bool = False) -> Column:
    """TXT-02: struct(category, rule_id, field, value, candidates, ambiguous, vetoed): a category only if all rules met agree on one.

    ``unverified``: take the rules too that no real listing has shown.
    """
    fields = {"type": kind, "species": species, "name": name}
    folded = F.struct(*[fold(c).alias(k) for k, c in fields.items()])
    kinds = "struct<category: string, rule_id: string, field: string, value: string, candidates: array<string>, ambiguous: boolean, vetoed: boolean>"

    def met(rule: tuple, x: Column) -> Column:
        rule_id, category, _, roles, pattern, unless = rule
        hit = F.lit(None)
        for role in reversed(roles):
            found = x[role].rlike(pattern)
            if unless:
                found &= ~x[role].rlike(unless)
            hit = F.when(found, F.struct(F.lit(category).alias("category"), F.lit(rule_id).alias("rule_id"), F.lit(role).alias("field"), strip(fields[role]).alias("value"))).otherwise(hit)
        return hit

    def result(category, rule_id, field, value, candidates, ambiguous=False, vetoed=False) -> Column:
        return F.struct(*[c if isinstance(c, Column) else F.lit(c) for c in (category, rule_id, field, value, candidates, ambiguous, vetoed)]).cast(kinds)

    def chosen(hits: Column) -> Column:
        candidates, one = F.array_distinct(F.transform(hits, lambda h: h["category"])), F.try_element_at(hits, F.lit(1))
        none = F.array().cast("array<string>")
        veto = F.when(one["rule_id"] == VETO[0], result(OTHER, one["rule_id"], one["field"], one["value"], none, vetoed=True))
        several = F.when(F.size(candidates) > 1, result(OTHER, None, None, None, candidates, ambiguous=True))
        single = F.when(F.size(candidates) == 1, result(one["category"], one["rule_id"], one["field"], one["value"], candidates))
        return F.coalesce(veto, several, single, result(OTHER, None, None, None, none))

    rules = [VETO, *(r for r in STRICT_RULES if r[2] or unverified)]
    return let(let(folded, lambda x: F.filter(F.array(*[met(r, x) for r in rules]), lambda h: h.isNotNull())), chosen)


def report_links(html: Column) -> Column:
    """SCAN-22: array<struct<uploaded: long, url, name, kind>> of a page's monthly reports, newest first, each once.

    uploaded: the Unix stamp before the stored file's name; kind: acompanhamento or gestao.
    """
    name = lambda url: F.substring(F.try_url_decode(F.replace(F.element_at(F.split(url, "/Arquivo/", 2), 2), F.lit("+"), F.lit("%2B"))), 11, 1 << 20)
    urls = F.array_distinct(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(STORED_FILE)))
    stamp = lambda url: F.regexp_extract(url, r"/Arquivo/(\d{10})", 1).cast("long")
    kind = lambda x: F.when(x.rlike(FOLLOW_UP), "acompanhamento").when(x.rlike(MANAGEMENT), "gestao")
    links = F.transform(urls, lambda u: F.struct(stamp(u).alias("uploaded"), u.alias("url"), name(u).alias("name"), kind(name(u)).alias("kind")))
    return F.reverse(F.array_sort(F.filter(links, lambda x: x["kind"].isNotNull())))


def _one_blank(text: Column) -> Column:
    return strip(F.regexp_replace(text, r"\s+", " "))


def management_report(text: Column) -> Column:
    """SCAN-22: struct(month, unit_prices, credits, retention_fund, expense_fund, reserve_fund, last_due_date) of a management report; empty where absent.

    unit_prices: array<struct<series, price>>, read between the line of the nominal value and the updated one.
    """
    text = F.coalesce(text, F.lit(""))
    block = F.regexp_extract(text, r"(?s)Saldo do Valor Nominal Unitário(.*?)(?:Valor atualizado|\z)", 1)
    line = r"(\d+)ª\s*S[ée]rie[^:\n]*:\s*(" + UNIT_PRICE + ")"
    prices = F.arrays_zip(F.regexp_extract_all(block, F.lit(line), F.lit(1)).alias("series"), _each(F.regexp_extract_all(block, F.lit(line), F.lit(2))).alias("price"))
    below = {k: _one_blank(F.regexp_extract(text, rf"(?iu)\Q{label}\E[^\n]*\n\s*({pattern})", 1)).alias(k) for k, (label, pattern) in MANAGEMENT_LABELS.items()}
    return F.struct(F.regexp_extract(text, r"Relat[óo]rio de Gest[ãa]o\s*-\s*([A-Za-zçÇ]+/\d{4})", 1).alias("month"), prices.alias("unit_prices"), *below.values())


def _each(values: Column) -> Column:
    return F.transform(values, _one_blank)


def follow_up_totals(text: Column) -> Column:
    """SCAN-22: struct(items, not_adherent, balances, total): a follow-up report's verdicts counted and its balances by class.

    balances: map of senior, mezanino, subordinada to the amount as written, the last if one is repeated; total: their sum, null without any.
    """
    text = F.coalesce(text, F.lit(""))
    verdicts = F.regexp_extract_all(text, F.lit(ADHERENCE), F.lit(1))
    name = lambda x: F.translate(F.lower(F.regexp_extract(x, r"^\S+", 0)), "ê", "e")
    names = F.transform(F.regexp_extract_all(text, F.lit(CLASS_BALANCE), F.lit(1)), name)
    pairs = F.arrays_zip(names.alias("name"), _each(F.regexp_extract_all(text, F.lit(CLASS_BALANCE), F.lit(2))).alias("amount"))
    last = F.filter(pairs, lambda x, at: ~F.exists(F.slice(pairs, at + 2, F.size(pairs)), lambda y: y["name"] == x["name"]))
    number = lambda x: F.replace(F.replace(F.regexp_extract(x, r"-?[\d.]+,\d+", 0), F.lit("."), F.lit("")), F.lit(","), F.lit(".")).cast("decimal(20,2)")
    total = F.when(F.size(last) > 0, F.aggregate(last, F.lit(0).cast("decimal(20,2)"), lambda t, x: (t + number(x["amount"])).cast("decimal(20,2)")))
    return F.struct(
        F.size(verdicts).cast("long").alias("items"),
        F.size(F.filter(verdicts, lambda v: v.rlike(NOT_ADHERENT))).cast("long").alias("not_adherent"),
        F.map_from_entries(last).alias("balances"),
        total.alias("total"),
    )
