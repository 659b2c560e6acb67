"""What a reader should look at first: the watch list of assets and the tiers of the review queue (RULE-13, RULE-19)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Decisions of minutes that are severe at any date, and those that are stress for twelve months.
SEVERE = ("vencimento_antecipado_declarado", "recuperacao_judicial", "liquidacao_patrimonio", "dacao_em_pagamento")
STRESS = ("waiver", "prorrogacao_repactuacao", "vencimento_antecipado_nao_declarado", "aporte_titulares")
REFUSED_STAY = "nao_declaracao_do_vencimento_antecipado_rejeitada"
OPINION_FLAGS = ("df_com_ressalva", "df_abstencao_ou_adversa")
#: Words of a note that ask for a decision, and the verdicts of a visual check that do.
DOUBTFUL = r"(?iu)contradiz|revis[aã]o humana|inferid|interpreta[cç][aã]o|ambígu|ambigu|diverge"
DOUBTED = ("diverge", "inconclusivo")


def _said(text: Column) -> Column:
    return F.replace(text, F.lit("_"), F.lit(" "))


def _held(*pairs: tuple[Column, Column | str]) -> Column:
    """The texts whose condition holds, in order."""
    return F.filter(F.array(*[F.when(c, t if isinstance(t, Column) else F.lit(t)) for c, t in pairs]), lambda x: x.isNotNull())


def is_severe(event: Column) -> Column:
    """Declared or approved severe events; of refusals only that of not declaring the early maturity."""
    return event.startswith(REFUSED_STAY) | (event.rlike("^(?:" + "|".join(SEVERE) + ")") & ~event.rlike("_rejeitad[oa]$"))


def is_stress(event: Column) -> Column:
    return event.rlike("^(?:" + "|".join(STRESS) + ")") & ~event.rlike("_rejeitad[oa]$")


def watch_list(assets: DataFrame, decisions: DataFrame, since: str | Column) -> DataFrame:
    """RULE-13: (asset, level, reasons), level 1 (severe) to 5 (nothing).

    assets: asset, late_series, informe_events (array of "month event"), df_opinion, df_flags (array), contagion,
    ranking_score; nulls are no signal. decisions: asset, date (ISO text), event. ``since`` bounds the decisions of level 3;
    those of level 1 hold at any date. The newest severe decision is named, of one day the last in alphabetical order.
    """
    recent = is_stress(F.col("event")) & (F.col("date") >= since)
    summed = decisions.where(F.col("event").isNotNull()).groupBy("asset").agg(F.max(F.when(is_severe(F.col("event")), F.struct("date", "event"))).alias("severe"), F.array_sort(F.collect_set(F.when(recent, F.col("event")))).alias("recent"))
    rows = assets.join(summed, "asset", "left")
    events = F.array_sort(F.array_distinct(F.transform(F.coalesce("informe_events", F.array().cast("array<string>")), lambda e: F.substring_index(e, " ", -1))))
    late = F.coalesce("late_series", F.lit(0))
    score = F.coalesce("ranking_score", F.lit(0))
    stress = _held(
        (F.size(F.coalesce("recent", F.array().cast("array<string>"))) > 0, F.concat(F.lit("atas em 12 meses: "), _said(F.array_join("recent", ", ")))),
        (F.arrays_overlap(F.coalesce("df_flags", F.array().cast("array<string>")), F.array(*[F.lit(f) for f in OPINION_FLAGS])), F.concat(F.lit("DF: "), F.coalesce("df_opinion", F.lit("")))),
        (F.coalesce("contagion", F.lit(False)), "devedor com outras emissões em atraso"),
    )
    others = _held(
        (F.size(events) > 0, F.concat(F.lit("Informe em 12 meses: "), F.array_join(events, ", "))),
        (score > 0, F.concat(F.lit("ranking de triagem: "), score.cast("string"), F.lit(" pontos"))),
    )
    severe = F.col("severe").isNotNull()
    first = F.when(severe, F.array(F.concat(F.lit("ata de "), F.col("severe.date"), F.lit(": "), _said(F.col("severe.event"))))).when(late > 0, F.array(F.concat(late.cast("string"), F.lit(" série(s) em atraso no Informe")))).otherwise(F.array().cast("array<string>"))
    level = F.when(severe, 1).when(late > 0, 2).when(F.size(stress) > 0, 3).when(F.size(others) > 0, 4).otherwise(5)
    return rows.select("asset", level.alias("level"), F.concat(first, stress, others).alias("reasons"))


def fact_tier(note: Column, verdict: Column, method: Column, diverges: Column, feeds_alert: Column) -> dict[str, Column]:
    """RULE-19: tier 1 (decide first) to 5 (not checked by eye) of a fact, and its reasons; a null or empty note is none."""
    noted = F.coalesce(note, F.lit("")) != ""
    urgent = _held(
        (diverges, "diverge de outro documento"),
        (verdict.isin(*DOUBTED), F.concat(F.lit("conferência visual "), verdict)),
        (note.rlike(DOUBTFUL), "nota com contradição/interpretação"),
    )
    weighty = _held((feeds_alert, "alimenta alerta contratual"), (method.contains("ocr"), "leitura por OCR"))
    unseen = ~verdict.eqNullSafe(F.lit("confere"))
    reasons = (
        F.when(F.size(urgent) > 0, urgent)
        .when(F.size(weighty) > 0, weighty)
        .when(unseen, F.array(F.when(noted, "sem conferência visual; tem observação na proposta").otherwise("sem conferência visual")))
        .when(noted, F.array(F.lit("conferido visualmente; ler a observação da proposta")))
        .otherwise(F.array(F.lit("conferido visualmente, sem observação")))
    )
    return {"tier": F.when(F.size(urgent) > 0, 1).when(F.size(weighty) > 0, 2).when(unseen, 5).when(noted, 3).otherwise(4), "reasons": reasons}


def parameter_tier(name: Column, justification: Column, diverges: Column, core: list[str]) -> dict[str, Column]:
    """RULE-19: tier 1, 2 (a core field) or 5 of a contract parameter, and its reasons."""
    urgent = _held((diverges, "diverge de outro documento"), (justification.rlike(DOUBTFUL), "nota com contradição/interpretação"))
    is_core = F.coalesce(name.isin(*core), F.lit(False))
    reasons = F.when(F.size(urgent) > 0, urgent).when(is_core, F.array(F.lit("campo core do catálogo"))).otherwise(F.array(F.lit("parâmetro sem conferência visual")))
    return {"tier": F.when(F.size(urgent) > 0, 1).when(is_core, 2).otherwise(5), "reasons": reasons}
