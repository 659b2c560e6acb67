"""What an assembly decided, from the text of its minutes (TXT-05).

The text is compared without accents and blanks, which tolerates recognised text whose words run together; a
place map leads back to the original for excerpts. Verbs part the decision section among themselves: each owns the
span up to the next one, and topics found in a verb's span are decided by it. An approval of the whole agenda
takes the topics of the agenda; a tally ("nenhum ... rejeitaram") decides nothing.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Forms of the minutes, over text without accents and blanks.
DECISION_START = re.compile(r"delibera(?:coes|cao)(?:\w{0,3})?:|colocad[ao]s?em(?:discussaoe)?votacao|deliberaram|(?:foram|foi)tomadasasseguintesdeliberacoes")
NOT_INSTALLED = re.compile(
    r"nao(?:houve|foiverificad[ao]|atingiu|seatingiu|foiatingido)[^.]{0,60}quorum(?:minimo)?(?:de|para)instalacao|"
    r"nao(?:foi)?instalada|termodenaoinstalacao|deixoudeserinstalada|naoinstalacao"
)
SUSPENDED = re.compile(
    r"suspens(?:ao|os?|as?)(?:dos|da)?(?:trabalhos|votacao)|suspendera?(?:m)?(?:os|a)?(?:trabalhos|votacao)|"
    r"foisuspensa|ficasuspensa|reaberturadostrabalhos|reaberturamarcada|seraretomada|"
    r"suspensaodapresente(?:assembleia|deliberacao|da)|novasuspensao|deveraserreaberta|serareaberta|"
    r"(?:pela|por)suspen(?:sao|der)|suspenderaapreciacao|suspendendoapresenteassembleia"
)
NOTICE = re.compile(r"editalde(?:primeira|segunda|1a|2a)?convocacao|ficamconvocad|convoca(?:m)?ossenhores|pelopresenteedital")
TITLE = re.compile(r"atad[ae]s?(?:\w{0,30})?assembleia|termodenaoinstalacao")
_RESOLVED_FOR = r"(?:deliberaram|deliberou|decidiram|decidiu|resolveram|resolveu)[^.:;]{0,250}?(?:pel[ao]s?|por)(?!unanimidade|maioria|cento)"
APPROVED = re.compile(
    r"(?:foi|foram|restou|restaram)aprovad|aprovaram|aprovadas|aprovados|aprovada|aprovado|aprovam|aprovou|autorizaram|autorizou|ratificaram|ratificou|"
    r"aprova(?![rc])|(?<=[:;)])aprovar|(?:deliberaram|decidiram|resolveram)[^.]{0,60}?aprovar|" + _RESOLVED_FOR
)
FIRM = re.compile(
    r"(?:foi|foram|restou|restaram)aprovad|aprovaram|aprovam|aprovar|aprovou|autorizaram|autorizou|ratificaram|ratificou|"
    r"(?:deliberaram|decidiram|resolveram)[^.]*aprovar|" + _RESOLVED_FOR
)
REJECTED = re.compile(
    r"naoaprova|naoforamaprovad|naofoiaprovad|reprova(?:m|ram|da|do|das|dos)|rejeita(?:m|ram|da|do|das|dos)|"
    r"naohouvequorum(?:de|para)(?:aprovacao|deliberacao)|naoatingi\w{0,8}quorum(?:de|para)(?:aprovacao|deliberacao)"
)
ABSTAINED = re.compile(
    r"manifest\w{0,6}(?:pela)?abstencao|seabster(?:em)?(?:de|do)?(?:direitode)?votar|abstiveram-?se(?:de|do)?(?:direitode)?vot|"
    r"abstencaoaodireitodevoto|abstencaodevotosobreatotalidade"
)
CLOSING = re.compile(r"\d{0,2}\.?disposicoesfinais|\d{0,2}\.?encerramento:|nadamaishavendoatratar")
WHOLE_AGENDA = re.compile(
    r"todasasmaterias|ositens\(?[ivx]+\)?a\(?[ivx]+\)?daordemdodia|asmateriasconstantes(?:da|na)ordemdodia|"
    r"integralidadedaordemdodia|integralidadedasmaterias|todosositens|aordemdodia(?:integralmente|naintegra)|"
    r"aprovacaointegral|integraldositens|naintegradositens|itensdescritosnaordemdodia"
)
STOCK_PHRASE = re.compile(r"(?:implementacao|efetivacao|execucao|formalizacao|cumprimento)(?:e\w{0,14})?d[ao]?s?$")
NO_QUORUM = re.compile(
    r"aus[e]nciadequorum(?:minimo)?(?:para|de)(?:a)?deliberacao|ausenciadoquorum(?:minimo)?(?:para|de)(?:a)?deliberacao|"
    r"naohouvequorum(?:minimo)?(?:para|de)(?:a)?deliberacao|naofoiatingidooquorum(?:minimo)?(?:para|de)(?:a)?deliberacao|quoruminsuficienteparadeliberacao"
)
CONDITION = re.compile(r"(?:caso|se|umavez|desdeque|hipotesede|emcasode|sejam?|seja)$")
TALLY_TAIL = re.compile(r"^,?(?:nenhum\w*?(?:seabstiveram|rejeitaram|votaramcontra|seabsteve|rejeitou)e?){1,3}")
INSTALL_CONDITION = re.compile(r"(?:caso|hipotese|emcaso|se)\w{0,12}$")
INSTALL_BEFORE = re.compile(r"^\w{0,6}(?:em)?(?:1a|1ª|primeira)convocacao")
NEGATION = re.compile(r"(?:nao|reprova|rejeit)\w{0,12}$")
_OF_ACCELERATION = r"(?:d[eo]s?)?(?:efeitos)?(?:d[eo]s?)?(?:evento(?:s)?de)?vencimentoantecipado"
NOT_ACCELERATED = re.compile(r"nao(?:a)?(?:declaracao|decretacao|declarar|decretar)" + _OF_ACCELERATION)
ACCELERATED = re.compile(r"(?:declaracao|decretacao|declarar|decretar)" + _OF_ACCELERATION)
EFFECTS_STAYED = re.compile(r"(?:sustacao|suspensao|sustar|suspender)" + _OF_ACCELERATION)
TOPICS = {
    "waiver": r"waiver|anuenciapravia|anuenciaprevia|perdaotemporario|renunciaadireitos|renunciadedireitos",
    "prorrogacao_repactuacao": r"prorroga(?:cao|r)(?!d[ao]vigencia|d[ao]prazodevigencia|d[ao]contrato)|repactua|novocronograma|alteracaodo(?:s)?cronograma|carencia|posterga[cd]|alteracaod[ao]s?(?:datas?de)?vencimento",
    "liquidacao_patrimonio": r"liquidacaodopatrimonioseparado",
    "troca_prestador": r"(?:substituicao|destituicao)d[oa](?:agentefiduciario|securitizadora|emissora|custodiante|servicer)",
    "resgate_amortizacao": r"resgateantecipado|amortizacaoextraordinaria|ofertaderesgate",
    "dacao_em_pagamento": r"dacaoempagamento",
    "garantias": r"(?:substituicao|reforco|liberacao|complementacao)d[ae]s?garantia",
    "dfs": r"demonstracoesfinanceiras|demonstracoescontabeis",
    "aporte_titulares": r"aportederecursos|aporte(?:,)?pelostitulares|aportedostitulares|aportepelosinvestidores|aportedosinvestidores|realizacaodeaporte|aportedevalores",
    "assessor_legal": r"contratacaod[eoa]s?(?:\w{0,12})?(?:assessor|assessoria|escritorio|advogad)|assessorlegal|assessoriajuridica|honorariosadvocaticios",
    "recuperacao_judicial": r"recuperacaojudicial|recuperacaoextrajudicial|planoderecuperacao|habilitacaod[eo]s?credito|individualizacaod[eo]s?(?:seu)?(?:direito|credito)|pedidodefalencia|falenciad",
    "uso_fundo_reserva": r"(?:utiliza\w{0,4}|uso|recomposicao|liberacao)(?:d[eoa]s?)?(?:recursosd[oa])?(?:fundo(?:s)?dereserva|fundodedespesas)",
}
#: How far a verb's span reaches, how far its first topics lie, and how far looks back go.
SPAN, NEAR, NEGATION_REACH, TALLY_REACH, MINORITY_REACH = 260, 190, 25, 90, 70

_TOPICS = {name: re.compile(pattern) for name, pattern in TOPICS.items()}
_VERB = re.compile(f"{REJECTED.pattern}|{APPROVED.pattern}")
_AGENDA = re.compile(r"ordemdodia:"), re.compile(r"ordemdodia")

RESULT = "struct<kind: string, status: string, decisions: array<struct<event: string, excerpt: string>>>"


class _Bare(dict):
    """What each sign, by its code point, becomes; a sign may fold into several, and its lower case may be longer than it."""

    def __missing__(self, code: int) -> str:
        sign = chr(code)
        self[code] = bare = "" if sign.isspace() else "".join(c.lower() for c in unicodedata.normalize("NFKD", sign) if not unicodedata.combining(c))
        return bare


_BARE = _Bare()


class Compact:
    """A text in lower case without accents and blanks, and each sign's place in the original."""

    def __init__(self, text: str) -> None:
        self.text, self.flat = text, text.translate(_BARE)

    @cached_property
    def places(self) -> np.ndarray:
        """Made when an excerpt is asked for; most texts have none or few."""
        codes, which = np.unique(np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)
        return np.repeat(np.arange(len(which)), np.array([len(_BARE[c]) for c in codes.tolist()], np.int64)[which])

    def excerpt(self, start: int, end: int) -> str:
        a, b = self.places[max(0, start)], self.places[min(len(self.places) - 1, end)]
        return " ".join(self.text[a : b + 1].split())


class Verb(NamedTuple):
    """A verb of decision and the span that it owns."""

    start: int
    end: int
    approves: bool
    firm: bool
    span: str
    after_tally: bool


def _agenda_place(flat: str) -> tuple[int, int] | None:
    for pattern in _AGENDA:
        if found := pattern.search(flat):
            return found.span()
    return None


def _not_installed(flat: str) -> tuple[int, int] | None:
    """Where the text says that the assembly was not opened, conditions and an earlier call left aside."""
    for found in NOT_INSTALLED.finditer(flat):
        a, b = found.span()
        conditional = INSTALL_CONDITION.search(flat, max(0, a - NEGATION_REACH), a)
        if found[0].startswith("termode") or not (conditional or INSTALL_BEFORE.search(flat[b : b + 30])):
            return a, b
    return None


def _is_tally(part: str, start: int) -> bool:
    return "nenhum" in part[max(0, start - TALLY_REACH) : start]


def _minority(part: str, start: int) -> bool:
    """A rejection by some per cent in a sentence that already has the majority's approval."""
    sentence = part[max(0, start - 600) : start].rpartition(".")[2]
    return "%" in part[max(0, start - MINORITY_REACH) : start] and APPROVED.search(sentence) is not None


def owned_spans(part: str) -> Iterator[Verb]:
    """The verbs that decide something, each with its own span.

    A tally's verb neither owns text nor ends another's span. A span ends at the next verb that begins 20 signs or
    more after this one's end, and SPAN signs on at most; behind a tally it starts anew.
    """
    found = [v for v in _VERB.finditer(part) if not (REJECTED.fullmatch(v[0]) and _is_tally(part, v.start()))]
    starts = [v.start() for v in found]
    for at, verb in enumerate(found):
        start, end = verb.span()
        rejects = REJECTED.fullmatch(verb[0]) is not None or NEGATION.search(part[max(0, start - 14) : start]) is not None
        if rejects and (_is_tally(part, start) or _minority(part, start)):
            continue
        if not rejects and CONDITION.search(part[max(0, start - 12) : start]):
            continue
        limit = next((s for s in starts[at + 1 :] if s >= end + 20), len(part))
        span = part[end : min(end + SPAN, limit)]
        tally = TALLY_TAIL.search(span)
        if tally:
            span = part[end + tally.end() : min(end + len(span) + tally.end(), limit)]
        if not SUSPENDED.search(span[:80]):
            yield Verb(start, end, not rejects, FIRM.fullmatch(verb[0]) is not None, span, tally is not None)


def _denied(text: str, start: int) -> bool:
    return "nao" in text[max(0, start - NEGATION_REACH) : start]


def _acceleration(text: str, approved: bool) -> str | None:
    stayed, denied, declared = (p.search(text) for p in (EFFECTS_STAYED, NOT_ACCELERATED, ACCELERATED))
    if stayed and not _denied(text, stayed.start()):
        return "vencimento_antecipado_efeitos_sustados" if approved else "sustacao_dos_efeitos_do_vencimento_antecipado_rejeitada"
    if denied and (declared is None or denied.start() <= declared.start()):
        return "vencimento_antecipado_nao_declarado" if approved else "nao_declaracao_do_vencimento_antecipado_rejeitada"
    if declared and not _denied(text, declared.start()):
        return "vencimento_antecipado_declarado" if approved else "vencimento_antecipado_nao_declarado"
    return None


def topics_in(text: str, approved: bool, near: int | None = None) -> list[str]:
    """Acceleration anywhere in the text, other topics in its first ``near`` signs; denied ones are left out."""
    first, head = _acceleration(text, approved), text[:near]
    hits = ((name, pattern.search(head)) for name, pattern in _TOPICS.items())
    ending = "aprovado" if approved else "rejeitado"
    return [*([first] if first else []), *(f"{name}_{ending}" for name, hit in hits if hit and not _denied(head, hit.start()))]


def _events(verb: Verb, agenda: str) -> list[str]:
    block = WHOLE_AGENDA.search(verb.span[:250])
    if block and verb.approves and agenda and not STOCK_PHRASE.search(verb.span[max(0, block.start() - 30) : block.start()]):
        own = topics_in(verb.span[: block.start()], True)
        return own + [f"{e}_em_bloco" for e in topics_in(agenda, True) if e not in own] or ["ordem_do_dia_aprovada_em_bloco"]
    return topics_in(verb.span, verb.approves, NEAR)


def assembly_outcome(text: str | None) -> dict:
    """Kind of document, status, and decisions with their excerpts."""
    held = Compact(text or "")
    flat = held.flat

    def result(kind: str, status: str, *decisions: tuple[str, int, int]) -> dict:
        return {"kind": kind, "status": status, "decisions": [{"event": e, "excerpt": held.excerpt(a, b)} for e, a, b in decisions]}

    unopened, agenda_at = _not_installed(flat), _agenda_place(flat)
    not_opened = lambda: result("ata", "nao_instalada", ("nao_instalada", unopened[0] - 120, unopened[1] + 80))
    other = result("edital_ou_outro", "sem_decisao_identificada")
    if NOTICE.search(flat[:1500]) and not TITLE.search(flat[:700]):
        return other
    begin = DECISION_START.search(flat, agenda_at[1] if agenda_at else int(len(flat) * 0.2))
    if begin is None:
        return not_opened() if unopened else other
    begin = begin.start()
    end = CLOSING.search(flat, begin + 40)
    part = flat[begin : end.start() if end else len(flat)]
    agenda = flat[agenda_at[1] : begin] if agenda_at else ""

    events: dict[str, tuple[int, int]] = {}
    verdicts, unnamed = set(), None
    for verb in owned_spans(part):
        found = _events(verb, agenda)
        if found:
            verdicts.add(verb.approves)
            reach = 380 if verb.after_tally else 220
            for event in found:
                events.setdefault(event, (begin + verb.start - 60, begin + verb.end + reach))
        elif verb.approves and verb.firm and unnamed is None:
            unnamed = begin + verb.start
    decided = [(e, *place) for e, place in events.items()]
    if not decided and unopened:
        return not_opened()
    place = lambda p: (lambda m: (begin + m.start(), begin + m.end()) if m else None)(p.search(part))
    no_quorum, suspended, abstained = place(NO_QUORUM), place(SUSPENDED), place(ABSTAINED)
    if not decided and no_quorum:
        return result("ata", "sem_quorum_para_deliberar", ("sem_quorum_para_deliberar", no_quorum[0] - 80, no_quorum[1] + 120))
    if not decided and abstained and not suspended:
        return result("ata", "abstencao", ("titulares_se_abstiveram", abstained[0] - 120, abstained[1] + 200))
    if suspended:
        decided.append(("assembleia_suspensa", suspended[0] - 100, suspended[1] + 120))
    elif not decided and unnamed is not None:
        verdicts.add(True)
        decided.append(("outras_materias_aprovadas", unnamed - 60, unnamed + 260))
    if not decided:
        return result("ata", "sem_decisao_identificada")
    status = {(True,): "aprovada", (False,): "rejeitada", (): "suspensa"}.get(tuple(sorted(verdicts)), "mista")
    return result("ata", status, *decided)


def assembly_outcomes(documents: DataFrame, text: str = "text") -> DataFrame:
    """TXT-05: the documents with kind, status and decisions (event, excerpt); a null text is one without decisions."""

    @F.arrow_udf(RESULT)
    def decide(texts: pa.Array) -> pa.Array:
        kind = pa.struct([("kind", pa.string()), ("status", pa.string()), ("decisions", pa.list_(pa.struct([("event", pa.string()), ("excerpt", pa.string())])))])
        return pa.array([assembly_outcome(t.as_py()) for t in texts], kind)

    return documents.withColumn("__outcome", decide(F.col(text))).select(*documents.columns, "__outcome.*")
