"""Watch list, review tiers, registry runs and providers on small rows whose outcome is known."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lastro.operators import providers, registry, watch

SINCE = "2025-08-01"
ASSETS = "asset int, late_series int, informe_events array<string>, df_opinion string, df_flags array<string>, contagion boolean, ranking_score int"
NOTHING = (None, None, None, None, None, None)


def test_watch_list(spark):
    cases = [
        ((2, None, None, None, None, None), [("2024-04-24", "vencimento_antecipado_declarado")], (1, ["ata de 2024-04-24: vencimento antecipado declarado"])),
        (NOTHING, [("2026-01-01", "dacao_em_pagamento_rejeitado")], (5, [])),
        (NOTHING, [("2026-01-01", "nao_declaracao_do_vencimento_antecipado_rejeitada")], (1, ["ata de 2026-01-01: nao declaracao do vencimento antecipado rejeitada"])),
        (NOTHING, [("2026-01-01", "vencimento_antecipado_nao_declarado")], (3, ["atas em 12 meses: vencimento antecipado nao declarado"])),
        ((1, None, None, None, None, None), [], (2, ["1 série(s) em atraso no Informe"])),
        (NOTHING, [("2024-01-10", "waiver_aprovado")], (5, [])),
        ((None, None, "Com ressalva", ["df_com_ressalva"], None, None), [(None, None)], (3, ["DF: Com ressalva"])),
        ((0, [], "", [], True, 0), [], (3, ["devedor com outras emissões em atraso"])),
        ((None, ["2026-07 taxa_mudou"], None, None, None, 4), [], (4, ["Informe em 12 meses: taxa_mudou", "ranking de triagem: 4 pontos"])),
        (NOTHING, [("2025-08-01", "waiver_aprovado"), ("2026-02-01", "aporte_titulares_aprovado"), ("2026-03-01", "waiver_aprovado")], (3, ["atas em 12 meses: aporte titulares aprovado, waiver aprovado"])),
    ]
    assets = spark.createDataFrame([(i, *signals) for i, (signals, _, _) in enumerate(cases)], ASSETS)
    decisions = spark.createDataFrame([(i, *d) for i, (_, ds, _) in enumerate(cases) for d in ds], "asset int, date string, event string")
    found = {r["asset"]: (r["level"], r["reasons"]) for r in watch.watch_list(assets, decisions, SINCE).collect()}
    assert found == {i: expected for i, (_, _, expected) in enumerate(cases)}
    assert watch.watch_list(assets.limit(0), decisions, SINCE).count() == 0


@pytest.mark.parametrize(
    ("note", "verdict", "method", "diverges", "feeds", "expected"),
    [
        (None, "confere", "texto", True, True, (1, ["diverge de outro documento"])),
        ("pede Revisão Humana", "inconclusivo", None, False, False, (1, ["conferência visual inconclusivo", "nota com contradição/interpretação"])),
        (None, "confere", "pdf_ocr", False, True, (2, ["alimenta alerta contratual", "leitura por OCR"])),
        ("ver capa", None, "texto", False, False, (5, ["sem conferência visual; tem observação na proposta"])),
        ("", None, None, None, None, (5, ["sem conferência visual"])),
        ("ver capa", "confere", "texto", False, False, (3, ["conferido visualmente; ler a observação da proposta"])),
        (None, "confere", "texto", False, False, (4, ["conferido visualmente, sem observação"])),
    ],
)
def test_fact_tiers(spark, note, verdict, method, diverges, feeds, expected):
    found = watch.fact_tier(*[F.lit(x).cast("string") for x in (note, verdict, method)], *[F.lit(x).cast("boolean") for x in (diverges, feeds)])
    row = spark.range(1).select(found["tier"], found["reasons"]).first()
    assert (row[0], row[1]) == expected


@pytest.mark.parametrize(("name", "note", "diverges", "tier"), [("taxa", "inferido", False, 1), ("taxa", None, True, 1), ("taxa", "", False, 2), ("prazo", None, None, 5), (None, None, False, 5)])
def test_parameter_tiers(spark, name, note, diverges, tier):
    found = watch.parameter_tier(F.lit(name).cast("string"), F.lit(note).cast("string"), F.lit(diverges).cast("boolean"), ["taxa"])
    assert spark.range(1).select(found["tier"]).first()[0] == tier


def test_run_reasons(spark):
    runs = [(1, "success", "cadastro", 10), (2, "failed", "cadastro", 20), (3, "success", "x", 30), (4, "success", "cadastro", 40), (5, "success", "cadastro", 50), (6, "success", "cadastro", 60), (7, None, None, 70), (8, "success", "cadastro", 5)]
    both = lambda run, status, lines: [(run, "f", status, lines), (run, "c", status, lines)]
    members = [*both(1, "processed", 3), *both(2, "processed", 3), *both(3, "processed", 3), (4, "f", "processed", 3), (4, "z", "processed", 3), *both(5, "error", 3), *both(6, "processed", None), *both(6, "error", 3), *both(8, "error", None), *both(8, "processed", 1), (9, "f", "processed", 1)]
    found = registry.incomplete_reasons(spark.createDataFrame(runs, "run_id int, status string, source string, started_at int"), spark.createDataFrame(members, "run_id int, member string, status string, line_count int"), "cadastro", ["f", "c"])
    assert {r["run_id"]: r["reason"] for r in found.collect()} == {1: None, 2: "status_nao_success", 3: "fonte_diferente", 4: "membro_ausente", 5: "membro_nao_processado", 6: "line_count_nulo", 7: "status_nao_success", 8: None}
    assert [r["run_id"] for r in registry.chosen_runs(found).collect()] == [1]
    assert [r["run_id"] for r in registry.chosen_runs(found.where("reason is not null")).collect()] == [7]
    assert registry.chosen_runs(found.limit(0)).count() == 0


def test_registry_subjects(spark):
    funds = spark.createDataFrame([(1, "A"), (2, "B"), (3, None)], "fund_id int, cnpj string")
    classes = spark.createDataFrame([(10, 1, "A"), (11, 1, "B"), (12, 2, "Z"), (13, 1, "A"), (14, 3, None)], "class_id int, fund_id int, cnpj string")
    rows = spark.createDataFrame([("fund", 1, "name", "Um"), ("fund", 1, "name", " "), ("class", 10, "type", "x"), ("class", 11, "type", "y"), ("class", 12, "type", "z"), ("class", 12, "name", "Zê"), ("class", 14, "type", None), ("fund", 9, "name", "fora")], "kind string, id int, field string, value string")
    owners = registry.class_owners(funds, classes, rows.select("kind", "id"))
    assert {r["class_id"]: (r["fund_id"], r["kind"]) for r in owners.collect()} == {10: (1, "same_cnpj"), 11: (2, "fund_without_data"), 12: (None, "only_class"), 14: (None, "only_class")}
    found = registry.subjects(rows, funds, classes, {"names": "name"}, {"types": "type"})
    assert {(r["source"], r["source_id"]): (r["cnpj"], r["names"], r["types"]) for r in found.collect()} == {("fund", 1): ("A", ["Um"], ["x"]), ("class", 12): ("Z", ["Zê"], ["z"]), ("class", 14): (None, [], [])}
    parties = spark.createDataFrame([(1, "fund", 1), (2, "class", 10), (3, "class", 11), (4, "class", 12)], "party_id int, kind string, id int").selectExpr("*", "'r' AS role", "'' AS cnpj", "'' AS name")
    assert {(r["party_id"], r["source"], r["source_id"]) for r in registry.party_links(parties, owners).collect()} == {(1, "fund", 1), (2, "fund", 1), (4, "class", 12)}


def test_stored_relations_refuse_blank_keys(spark):
    with pytest.raises(ValueError, match="blank"):
        registry.relation_by_key(spark.createDataFrame([("k",)], "canonical_key string"), "  ")
    with pytest.raises(ValueError, match="source or target"):
        registry.relations_of(spark.range(1), F.lit(1), "both")


def test_providers_equal_a_loop(spark):
    draw = random.Random(11)
    pick = lambda *x: draw.choice(x)
    results = [(q, p, f"p{p}", pick("c1", "c2", None, "c1", ""), pick("i1", None), pick("s", "t", None), [f"{q}{p}"]) for q in range(60) for p in range(pick(0, 1, 2, 3))]
    described = [(c, p, f"p{p}", pick("u", "v", None), pick([f"{c}{p}"], None)) for c in ("c1", "c2") for p in range(4)]
    expected = {}
    for q in range(60):
        unique = {}
        for r in results:
            if r[0] == q and (r[3] or r[4]):
                unique[r[3] or r[4]] = r
        if len(unique) != 1:
            expected[q] = ("ambiguous" if unique else "not_found", None, None)
            continue
        (row,) = unique.values()
        status, events = row[5], list(row[6])
        for c, _, _, s, e in described:
            if c == row[3]:
                status, events = s if s is not None else status, events + (e or [])
        expected[q] = ("found", status, events)
    asked = spark.createDataFrame([(q,) for q in range(60)], "query int")
    r = spark.createDataFrame(results, "query int, priority int, provider string, asset_code string, isin string, status string, events array<string>")
    d = spark.createDataFrame(described, "asset_code string, priority int, provider string, status string, events array<string>")
    found = {x["query"]: (x["outcome"], x["status"], x["events"]) for x in providers.merged(asked, r, d, ["status"], ["events"]).collect()}
    assert {x[0] for x in expected.values()} == {"found", "ambiguous", "not_found"} and found == expected
