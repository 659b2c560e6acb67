"""Listings, minutes, grids and monthly reports of portals: known cases."""

from __future__ import annotations

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lastro.operators import portal

KINDS = [
    ("Ata da Assembleia - Reunião de 28/10/2026", "Assembleia", "ata"),
    ("Edital de Convocaçao - Reunião de 19/10/2026", "Assembleia", "edital"),
    ("Proposta para a Assembleia - Reunião de 19/10/2026", "Assembleia", "proposta"),
    ("Proposta vinculante", "Assembleia", "assembleia"),
    ("Sumário de ATA de Assembleia", "ATA de Assembleia", "ata"),
    (" Ajuizamento do pedido de  Recuperação Judicial ", "Fato Relevante", "fato_relevante"),
    ("Comunicado ao Mercado", "Comunicado ao Mercado", "comunicado"),
    ("Termo_de_Não_Instalação_296ª_Segunda_convocação_15042025[1].pdf", None, "ata"),
    ("CRI.301.CIA.1 20261028-Assinado", "Atas de Assembléias", "ata"),
    ("Apresentação aos investidores", "Assembléias", "assembleia"),
    ("Informe Mensal CVM - 08/2026", "Assembleia", ""),
    ("Anúncio de início", "Comunicados ao Mercado", ""),
    ("DFs Patrimônio Separado", "DFs Patrimônio Separado", ""),
    ("Protocolo CVM ATA de Assembleia sem lista ", "ATA de Assembleia", ""),
    ("Comunicado de encerramento da oferta", "Comunicado ao Mercado", ""),
    ("Ata da Assembleia - Termo de Não Instalação - Aprovação Automática DF", "", "ata"),
    (None, None, ""),
    ("", "", ""),
]
GRAVE = [
    (["waiver_aprovado_em_bloco", "vencimento_antecipado_nao_declarado", "dfs_aprovado"], [("waiver", "...")], ["vencimento antecipado não declarado", "waiver (aprovado)"], "decisão"),
    (["dfs_aprovado"], [("vencimento_antecipado", "evento")], [], ""),
    (["nao_instalada"], [("prorrogacao_repactuacao", "x"), ("inadimplencia_devedor", "ajuizou pedido de recuperação judicial")], ["recuperação judicial", "repactuação/prorrogação"], "texto"),
    ([], [("inadimplencia_devedor", "atraso no pagamento da parcela")], [], ""),
    (["waiver_rejeitado", "waiver", "waiver_rejeitado", None], None, ["waiver (rejeitado)", "waiver"], "decisão"),
    (["sustacao_dos_efeitos_do_vencimento_antecipado_rejeitada", "recuperacao_judicial__aprovado"], [], ["recuperação judicial (aprovado)", "sustação dos efeitos do vencimento antecipado rejeitada"], "decisão"),
    (None, None, [], ""),
    (None, [("waiver", None), (None, None), ("inadimplencia_devedor", None)], ["waiver"], "texto"),
]
STATUSES = [
    ("bari", "Desenquadrada em 2025", "nao_atendido"), ("bari", "coberto", "atendido"), ("bari", "coberto em parte", ""), ("bari", "Não atendido*", "nao_atendido"), ("bari", None, ""),
    ("vert", "Enquadrado¹", "atendido"), ("vert", "Não  Enquadrado 2", "nao_atendido"), ("vert", "N/A", "nao_se_aplica"), ("vert", "-", ""), ("vert", "em apuração", "nao_verificado"), ("vert", "talvez", "outro"), ("vert", " ", ""),
    ("canal", "Desenquadrado (ver nota)", "nao_atendido"), ("canal", "não se aplica", "outro"), ("canal", "-", ""), ("canal", "NA", "nao_se_aplica"),
    ("opea", "Não Atendido", "nao_atendido"), ("opea", "enquadrado", "outro"), ("opea", "não verificado", "nao_verificado"), ("opea", None, ""),
]


def test_kinds_of_listings(spark):
    df = spark.createDataFrame(KINDS, "t string, c string, kind string")
    assert [r["found"] for r in df.select(portal.document_kind(F.col("t"), F.col("c")).alias("found")).collect()] == [k[2] for k in KINDS]


def test_grave_events(spark):
    df = spark.createDataFrame([(d, t) for d, t, _, _ in GRAVE], "d array<string>, t array<struct<topic: string, excerpt: string>>")
    found = [r["g"] for r in df.select(portal.grave_events(F.col("d"), F.col("t")).alias("g")).collect()]
    assert [(g["events"], g["origin"]) for g in found] == [(e, o) for _, _, e, o in GRAVE]


def test_minutes_of_a_meeting_to_come_are_drafts(spark):
    rows = [("ata", "2026-12-01", "2026-10-01"), ("ata", None, "2026-12-01"), ("edital", "2026-12-01", None), ("assembleia", "2026-10-01", "2026-10-02"), ("ata", None, None)]
    df = spark.createDataFrame(rows, "k string, m string, p string").select(portal.only_drafted(F.col("k"), F.col("m"), F.col("p"), F.lit("2026-11-01")).alias("x"))
    assert [bool(r["x"]) for r in df.collect()] == [True, True, False, False, False]


@pytest.mark.parametrize("house", ["bari", "vert", "canal", "opea"])
def test_grid_statuses(spark, house):
    cases = [(t, s) for h, t, s in STATUSES if h == house]
    df = spark.createDataFrame(cases, "t string, s string").select("s", portal.grid_status(F.col("t"), house).alias("found"))
    assert [r["found"] for r in df.collect()] == [s for _, s in cases]


def test_filing_categories(spark):
    cases = [
        (None, "Termo de Securitização", None, "1º Aditamento", "Termo de Securitização"),
        ("Assembleia", "AGE", None, None, "Ata/Edital"),
        ("Dados", None, "data", "página", "Outro"),
        ("Relatório", None, None, "Agente Fiduciário 2024", "Relatório Agente Fiduciário"),
        ("Informe", "Demonstrações  Financeiras", None, None, "Outro"),
        ("Demonstrações Financeiras - rating", None, None, None, "Relatório de Rating"),
        (None, None, None, None, "Outro"),
    ]
    df = spark.createDataFrame(cases, "c string, k string, s string, n string, x string")
    found = df.select(portal.filing_category(F.col("c"), F.col("k"), F.col("s"), F.col("n")).alias("x")).collect()
    assert [r["x"] for r in found] == [c[-1] for c in cases]


def test_strict_categories_take_one_candidate(spark):
    rows = [("Informe Mensal", "", "x"), (None, "Ata", "Edital"), (None, "ATA e edital", None), ("Informe Mensal", "Ata", None), (" Demonstrações Financeiras ", "Ata", None), ("Termo de Securitização", None, "Aditamento"), (None, None, None)]
    df = spark.createDataFrame(rows, "k string, s string, n string")
    of = lambda u: [r["x"] for r in df.select(portal.strict_filing_category(F.col("k"), F.col("s"), F.col("n"), u).alias("x")).collect()]
    found = of(False)
    assert [(x["category"], x["rule_id"], x["ambiguous"], x["vetoed"]) for x in found] == [
        ("Informe Mensal", "IM-01", False, False), ("Ata/Edital", "ATA-ESP-01", False, False), ("Ata/Edital", "ATA-ESP-01", False, False), ("Outro", None, True, False),
        ("Outro", "DF-VETO-01", False, True), ("Outro", None, False, False), ("Outro", None, False, False),
    ]
    assert found[3]["candidates"] == ["Informe Mensal", "Ata/Edital"] and (found[4]["field"], found[4]["value"]) == ("type", "Demonstrações Financeiras")
    assert of(True)[5]["candidates"] == ["Aditamento", "Termo de Securitização"]


def test_monthly_report_links(spark):
    base = "https://a.b/public/storage/Arquivo/"
    html = f'<a href="{base}1700000000Mar%C3%A7o_2024-Relatorio Mensal.pdf"><a href="{base}1710000000Acompanhamento Mensal+1.pdf"><a href="{base}1700000000Mar%C3%A7o_2024-Relatorio Mensal.pdf"><a href="{base}1720000000Termo.pdf">'
    found = spark.createDataFrame([(html,), (None,)], "h string").select(portal.report_links(F.col("h")).alias("x")).collect()
    assert [(x["uploaded"], x["name"], x["kind"]) for x in found[0]["x"]] == [(1710000000, "Acompanhamento Mensal+1.pdf", "acompanhamento"), (1700000000, "Março_2024-Relatorio Mensal.pdf", "gestao")]
    assert found[1]["x"] == []


def test_monthly_reports(spark):
    text = "Relatório de Gestão - Março/2024\nSaldo do Valor Nominal Unitário\n1ª Série - 190ª Emissão: R$ 457,03091931\n2ª Serie: R$  1.000,10\nValor atualizado de todos os Créditos:\n\n R$ 1.234,56\n(Fundo de Despesas) saldo\nR$ -7,00\n3ª Série: R$ 9,99\n"
    follow = "Aderente\nNão  Aderente\nEnquadrado\nDesenquadrada\nSênior R$ 1.000,50 Mezanino R$ 20,00\nSubordinada Júnior R$ 3,25\nMezanino R$ 21,00"
    r = spark.createDataFrame([(text, follow), (None, None)], "m string, f string").select(portal.management_report(F.col("m")).alias("m"), portal.follow_up_totals(F.col("f")).alias("f")).collect()
    m, f = r[0]["m"], r[0]["f"]
    assert m["month"] == "Março/2024" and [tuple(x) for x in m["unit_prices"]] == [("1", "R$ 457,03091931"), ("2", "R$ 1.000,10")]
    assert (m["credits"], m["expense_fund"], m["retention_fund"], m["last_due_date"]) == ("R$ 1.234,56", "R$ -7,00", "", "")
    assert (f["items"], f["not_adherent"], f["total"]) == (4, 2, Decimal("1024.75")) and f["balances"]["mezanino"] == "R$ 21,00"
    assert r[1]["m"]["month"] == "" and r[1]["f"]["total"] is None and r[1]["f"]["items"] == 0
