"""Rules whose result depends on order, overlap or many rows at once, against loops and known cases."""

from __future__ import annotations

import os
import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from lastro.functions.json_walk import json_leaves
from lastro.operators import matching, minutes, observations, terms, versions
from lastro.sources import guard, members
from lastro.streaming import restated

HEADER = "ATA DA ASSEMBLEIA ESPECIAL DE TITULARES DOS CRA DA 190ª EMISSÃO\n4. PRESENÇA: Titulares dos CRA representando 73%.\n"
AGENDA = "5. ORDEM DO DIA: Deliberar sobre: (i) Aprovar a concessão de waiver prévio para o eventual descumprimento dos índices financeiros; (ii) Aprovar a não declaração do vencimento antecipado do CDCA.\n"
CLOSING = "7. DISPOSIÇÕES FINAIS: autorização para que sejam celebrados quaisquer instrumentos relacionados à matéria aqui aprovada. 8. ENCERRAMENTO: nada mais havendo a tratar."


def held(decisions: str) -> str:
    return f"{HEADER}{AGENDA}6. DELIBERAÇÕES: {decisions}\n{CLOSING}"


BLOCK = ["vencimento_antecipado_nao_declarado_em_bloco", "waiver_aprovado_em_bloco"]
MINUTES = [
    (held("Os Titulares dos CRA presentes, representativos de 73,87% dos CRA em Circulação aprovam a concessão do Waiver, nenhum dos Titulares se abstiveram e nenhum dos Titulares dos CRA presentes rejeitaram. Os Titulares aprovaram a não declaração do vencimento antecipado do CDCA e, consequentemente, a não realização do resgate antecipado dos CRA."), "aprovada", ["waiver_aprovado", "vencimento_antecipado_nao_declarado"]),
    (held("Caso aprovado o item (i), a Securitizadora fica autorizada a realizar o resgate antecipado. Os Titulares não aprovaram a declaração do vencimento antecipado das CPR-F."), "rejeitada", ["vencimento_antecipado_nao_declarado"]),
    (held("OsTitularesdosCRArepresentando80%dosCRAemCirculacaoaprovaramadecretacaodoVencimentoAntecipadodasCPR-F."), "aprovada", ["vencimento_antecipado_declarado"]),
    (HEADER + "TERMO DE NÃO INSTALAÇÃO: considerando que compareceram titulares abaixo do quórum", "nao_instalada", ["nao_instalada"]),
    (held("Em caso de não instalação da assembleia de reabertura, o termo de adesão será considerado. Os Titulares aprovaram a prorrogação da data de vencimento."), "aprovada", ["prorrogacao_repactuacao_aprovado"]),
    (held("A Assembleia não foi instalada em 1ª convocação. Os Titulares aprovaram a substituição do agente fiduciário."), "aprovada", ["troca_prestador_aprovado"]),
    (held("Os Titulares deliberaram por suspender a votação dos itens da ordem do dia com reabertura marcada para 24/03."), "suspensa", ["assembleia_suspensa"]),
    (held("Em vista da ausência do quórum mínimo para deliberação das matérias, a Securitizadora observará os trâmites."), "sem_quorum_para_deliberar", ["sem_quorum_para_deliberar"]),
    ("EDITAL DE CONVOCAÇÃO DA ASSEMBLEIA ESPECIAL\n" + AGENDA + "Em caso de não aprovação, ficam os titulares convocados.", None, []),
    (held("Os Titulares, por unanimidade, decidiram por aprovar todas as matérias constantes na Ordem do Dia."), "aprovada", BLOCK),
    (held("Os Titulares discutiram as matérias e pediram novas informações à Devedora."), "sem_decisao_identificada", []),
    (held("Os Titulares de CRA, representando 100% (cem por cento) dos CRA em Circulação, sem voto em contrário ou abstenção, deliberaram pela aprovação integral dos itens descritos na Ordem do Dia."), "aprovada", BLOCK),
    (held("Os Titulares aprovaram a substituição do agente fiduciário e aprovar a autorização para que a Securitizadora pratique todo e qualquer ato necessário para a implementação das matérias constantes da Ordem do Dia."), "aprovada", ["troca_prestador_aprovado"]),
    (held("Os Titulares dos CRA, representando 30,30% dos CRA em Circulação, deliberaram pela suspensão dos respectivos itens, com reabertura programada para 30 de setembro."), "suspensa", ["assembleia_suspensa"]),
    (held("Com relação ao item (i), os Titulares aprovaram a realização de aporte de recursos pelos Titulares dos CRA, no montante de R$ 821.312,81. Com relação ao item (ii), os Titulares aprovaram que os titulares pleiteiem, perante o juízo da Recuperação Judicial da Devedora, a individualização de seu crédito."), "aprovada", ["aporte_titulares_aprovado", "recuperacao_judicial_aprovado"]),
    (held("O Titular dos CRA detentor de 100% dos CRA em Circulação manifestou a abstenção ao direito de voto sobre a totalidade das matérias da Ordem do Dia."), "abstencao", ["titulares_se_abstiveram"]),
    (held("Os Titulares representando 60% dos CRA em Circulação aprovaram a ratificação da contratação do escritório X Advogados, 3% se abstiveram e 0,57% dos Titulares dos CRA em Circulação presentes rejeitaram a ratificação da contratação do escritório X Advogados."), "aprovada", ["assessor_legal_aprovado"]),
    (held("O(s) Titular(es) dos CRI, representando 100% dos CRI em circulação, aprovaram a sustação dos efeitos do vencimento antecipado, em razão da verificação do Evento de Vencimento Antecipado Automático, caracterizado pela decretação de vencimento antecipado em valor igual ou superior a R$ 5.000.000,00, ficando a sustação sujeita à condição resolutiva."), "aprovada", ["vencimento_antecipado_efeitos_sustados"]),
    (None, None, []),
    ("", None, []),
]


def test_minutes(spark):
    rows = spark.createDataFrame([(i, t, "x") for i, (t, _, _) in enumerate(MINUTES)], "id int, text string, status_before string")
    found = {r["id"]: r for r in minutes.assembly_outcomes(rows).collect()}
    for i, (_, status, events) in enumerate(MINUTES):
        assert [d["event"] for d in found[i]["decisions"]] == events, i
        assert found[i]["kind"] == ("edital_ou_outro" if status is None else "ata"), i
        assert found[i]["status"] == (status or "sem_decisao_identificada"), i
    assert "aprovam a concessão do Waiver" in found[0]["decisions"][0]["excerpt"]


def test_one_parameter_in_force(spark):
    rng = random.Random(4)
    day = lambda n: date(2026, 1, 1) + timedelta(days=n)
    parameters = [(i, "hot" if i < 200 else f"k{i % 5}", day(a) if i % 9 else None, day(a + rng.randrange(-2, 9)) if i % 7 else None) for i in range(300) for a in [rng.randrange(400)]]
    facts = [(i, "hot" if i % 3 else f"k{i % 6}", day(rng.randrange(-5, 410))) for i in range(900)] + [(901, None, day(3)), (902, "hot", None)]
    p = spark.createDataFrame([*parameters, (999, None, None, None)], "p long, k string, valid_from date, valid_to date")
    f = spark.createDataFrame(facts, "id long, k string, day date")
    got = {r["id"]: (r["matches"], r["p"]) for r in versions.only_in_force(f, p, ["k"], "day", "p").collect()}
    for i, k, d in facts:
        hits = [n for n, key, a, b in parameters if k is not None and d is not None and key == k and (a or date.min) <= d <= (b or date.max)]
        assert got[i] == (len(hits), hits[0] if len(hits) == 1 else None)
    plan = versions.only_in_force(f, p, ["k"], "day", "p")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # facts meet days, never parameters


def test_newest_differing_row_of_another_source(spark):
    rng = random.Random(5)
    stored = [(i, rng.choice("ab"), rng.choice("xyz"), rng.choice(["1", "2", "3", None])) for i in range(120)]
    new = [(1000 + i, rng.choice("abc"), rng.choice("xyz"), rng.choice(["1", "2", "4", None])) for i in range(80)]
    schema = "id long, k string, source_id string, value string"
    got = {r["new_id"]: r["conflicting_value"] for r in observations.other_source_conflict(spark.createDataFrame(new, schema), spark.createDataFrame(stored, schema), "k", "id", "id").collect()}
    want = {}
    for i, k, s, v in new:
        others = [(at, value) for at, key, source, value in stored if key == k and source != s and value != v]
        if others:
            want[i] = max(others, key=lambda x: x[0])[1]
    assert got == want


def loop_import(batch, entities):
    by_cnpj, by_name, out = {}, {}, {}
    for e, cnpj, name in entities:
        if cnpj:
            by_cnpj.setdefault(cnpj, (e, None))
        by_name.setdefault(name, (e, None, cnpj))
    for i, cnpj, name in batch:
        if cnpj and cnpj in by_cnpj:
            out[i] = ("matched", *by_cnpj[cnpj])
        elif name in by_name:
            e, made, other = by_name[name]
            out[i] = ("blocked" if cnpj and other else "review", e, made)
        else:
            out[i] = ("created", None, i)
            by_name[name] = (None, i, cnpj)
            if cnpj:
                by_cnpj[cnpj] = (None, i)
    return out


def test_batches_imported_in_order(spark):
    rng = random.Random(6)
    batch, entities, want = [], [], {}
    for b in range(200):
        cnpj = lambda: rng.choice([None, *(f"{b}-{n}" for n in range(6))])  # noqa: B023, E731
        own = [(b * 100 + n, cnpj(), f"N{b}X{rng.randrange(6)}") for n in range(rng.randrange(3))]
        rows = [(b * 100 + n, cnpj(), f"N{b}X{rng.randrange(8)}") for n in range(rng.randrange(1, 14))]
        want |= loop_import(rows, own)
        batch += rows
        entities += own
    got = matching.import_in_order(spark.createDataFrame([(*r, "f") for r in batch], "id long, cnpj string, name string, type string"), spark.createDataFrame([(*r, "f") for r in entities], "entity_id long, cnpj string, name string, type string"))
    assert {r["id"]: (r["outcome"], r["entity_id"], r["created_by"]) for r in got.collect()} == want


def test_two_key_upsert_keeps_every_new_row(spark):
    stored = [(1, "A1", "B1", "x", "e1"), (2, "A2", None, "y", "e2"), (3, None, "B3", "z", "")]
    new = [(10, " a1 ", "b1", "", "e1"), (11, "A1", "B3", "q", ""), (12, "", " ", "q", ""), (13, "Q", "Q", "q", ""), (14, "A2", "B9", "new", "other"), (15, "A5", None, "n", "e5"), (16, None, "B3", "z!", "e3"), (17, "A6", None, "n", ""), (18, "A6", "B7", "n", "")]
    schema = "a string, b string, segment string, issue string"
    merged, refused = observations.upsert_by_two_keys(spark.createDataFrame(stored, f"row_id long, {schema}"), spark.createDataFrame(new, f"new_id long, {schema}"), "a", "b", ["segment", "issue"], ["issue"])
    assert {r["new_id"]: r["reason"] for r in refused.collect()} == {11: "two_assets", 12: "no_code", 13: "one_code_twice", 14: "another_issue", 17: "claimed_twice", 18: "claimed_twice"}
    assert {(r["row_id"], r["new_id"], r["a"], r["b"], r["segment"], r["issue"], r["outcome"]) for r in merged.collect()} == {
        (1, 10, "A1", "B1", "x", "e1", "unchanged"), (2, None, "A2", None, "y", "e2", "kept"), (3, 16, None, "B3", "z!", "e3", "updated"), (None, 15, "A5", None, "n", "e5", "inserted")
    }


def test_guarded_write_leaves_nothing_behind(spark, tmp_path):
    schema = "field_name string, value string"
    sound = spark.createDataFrame([("t.CNPJ_Classe", "11222333000181"), ("t.Valor", "529.982.247-25"), ("Nome", None)], schema)
    assert guard.write_guarded(sound, f"{tmp_path}/kept") == {"rows": 3, "identifiers": 1}
    assert spark.read.parquet(f"{tmp_path}/kept").count() == 3
    with pytest.raises(FileExistsError):
        guard.write_guarded(sound, f"{tmp_path}/kept")
    for bad in (("t.CPF_CNPJ", "529.982.247-25"), ("t.diretor", "x"), ("CNPJ", None), ("t.cnpj_gestor", "11.222.333/0001-81")):
        with pytest.raises(Exception, match="nothing is written") as stopped:
            guard.write_guarded(sound.unionByName(spark.createDataFrame([bad], schema)), f"{tmp_path}/refused")
        assert "529" not in str(stopped.value).partition("\n")[0]
    assert sorted(p for p in os.listdir(tmp_path) if not p.startswith(".")) == ["kept"]
    wide = guard.unpivoted(spark.createDataFrame([(1, "a", 2)], "id int, Site string, n int"), ["id"])
    assert [tuple(r) for r in wide.collect()] == [(1, "Site", "a"), (1, "n", "2")]


def test_only_changed_files_are_rewritten(spark, tmp_path):
    path = f"{tmp_path}/loaded"
    rows = [(f, m, n) for f in range(4) for m in ("a", "b") for n in range(5)]
    schema = "file_id int, member string, n int"
    spark.createDataFrame([r for r in rows if not (r[0] == 1 and r[2] > 2)], schema).coalesce(1).write.partitionBy("file_id").parquet(path)
    stamps = lambda: {p: os.stat(f"{path}/{p}").st_mtime_ns for p in os.listdir(path) if p.startswith("file_id")}
    files = lambda f: sorted(os.listdir(f"{path}/file_id={f}"))
    before, held_files = stamps(), {f: files(f) for f in range(4)}
    fresh = [r for r in rows if r[0] in (1, 2)] + [(3, "a", n) for n in range(10)] + [(9, "a", 1)]
    found = {r["file_id"]: (r["status"], r["rows_before"], r["rows"]) for r in members.rewrite_changed(path, spark.createDataFrame(fresh, schema)).collect()}
    assert found == {1: ("reparsed", 6, 10), 2: ("unchanged", 10, 10), 3: ("reparsed", 10, 10), 9: ("not_loaded", 0, 1)}
    assert files(0) == held_files[0] and files(2) == held_files[2] and files(1) != held_files[1]
    assert {p for p, t in stamps().items() if t == before.get(p)} >= {"file_id=0", "file_id=2"}
    assert {r["file_id"]: r["count"] for r in spark.read.parquet(path).groupBy("file_id").count().collect()} == {0: 10, 1: 10, 2: 10, 3: 10}


def test_restatements_of_a_stream_in_any_order(spark, tmp_path):
    rng = random.Random(7)
    rows = [(rng.randrange(30), rng.choice("abc"), n, n > 400) for n in range(500)]
    schema = "k int, value string, at long, is_new boolean"
    batch = restated.restated_state(spark.createDataFrame(rows, schema), ["k"], "value", "at", F.col("is_new")).collect()
    late = rows + rng.sample(rows, 60)
    rng.shuffle(late)
    for part in range(4):
        spark.createDataFrame(late[part::4], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    state = restated.restated_state(stream, ["k"], "value", "at", F.col("is_new"))
    assert sorted(map(tuple, restated.run_updates(state, ["k"], "test-restated").collect())) == sorted(map(tuple, batch))


def test_json_of_any_depth(spark):
    deep = '{"x":' * 30 + "[7]" + "}" * 30
    rows = spark.createDataFrame([(1, deep), (2, '{"a": [{}, [], null, "s", {"b.c": 1.5}], "b": true}'), (3, "5"), (4, None), (5, "no json"), (6, "{}")], "id int, j string")
    found = {(r["id"], r["path"], r["key"], r["leaf"]) for r in json_leaves(rows, "j").collect()}
    assert found == {(1, ".".join(["x"] * 30) + "[0]", None, "7"), (2, "a[2]", None, None), (2, "a[3]", None, "s"), (2, "a[4].b.c", "b.c", "1.5"), (2, "b", "b", "true"), (3, "", None, "5")}


def test_terms_against_the_market(spark):
    candidates = [
        ("X", "T1", 0, "data_emissao", 0, 2, "2020-01-02"), ("X", "T1", 0, "data_emissao", 0, 9, "2021-01-01"), ("X", "A1", 1, "data_emissao", 0, 1, "2022-01-01"),
        ("X", "T1", 0, "data_vencimento", 1, 4, "2030-01-01"), ("X", "T1", 0, "data_vencimento", 1, 8, "2031-01-01"), ("X", "A1", 1, "data_vencimento_lastro", 0, 1, "2032-01-01"),
        ("X", "T1", 0, "valor_total", 0, 1, "1000000"), ("X", "T1", 0, "quantidade", 0, 1, "600"), ("X", "A1", 1, "quantidade", 0, 1, "400"), ("X", "T1", 0, "valor_nominal_unitario", 0, 1, "1000"),
        ("X", "T1", 0, "remuneracao", 0, 1, "taxa=5"), ("X", "T1", 0, "devedor", 0, 1, "111"), ("Y", "T2", 0, "devedor", 0, 1, "111"), ("Z", "T3", 0, "valor_total", 0, 1, "5"),
    ]
    series = [("X", "2020-01-02", "S1", "2030-01-01", 600_500, 600, "100% DI + 5%", ["mult=100", "taxa=5"]), ("X", "2020-01-02", "S2", "2032-01-01", 400_000, 400, "IPCA + 6%", ["taxa=6"]), ("X", "2020-01-02", "S3", "2031-01-01", 0, 0, "100% DI", ["mult=100"]), ("Z", None, "S1", None, 0, 0, "x", [])]
    c = spark.createDataFrame(candidates, "asset string, doc string, doc_rank int, field string, strength int, page int, value string")
    s = spark.createDataFrame(series, "asset string, issued string, series string, due string, paid_in int, quantity int, rate string, rate_numbers array<string>").withColumns({k: F.col(k).cast("decimal(18,2)") for k in ("paid_in", "quantity")})
    d = spark.createDataFrame([("X", "111"), ("X", "222")], "asset string, debtor string")
    found = {(r["asset"], r["field"]): (r["outcome"], r["term"], r["market"], r["source"]) for r in terms.term_verdicts(c, s, d).collect()}
    assert found == {
        ("X", "data_emissao"): ("concorda", "2020-01-02", "2020-01-02", "T1 p.2"),
        ("X", "vencimento S1"): ("concorda", "2030-01-01", "2030-01-01", ""),
        ("X", "vencimento S2"): ("informe_usa_data_do_lastro", "2030-01-01", "2032-01-01", ""),
        ("X", "vencimento S3"): ("diverge", "2030-01-01; lastro 2032-01-01", "2031-01-01", ""),
        ("X", "valor_total"): ("concorda", "1000000.00", "1000500.00", ""),
        ("X", "quantidade"): ("diverge", "400; 600", "1000", ""),
        ("X", "valor_nominal_unitario"): ("concorda", "1000.00", "1000.83", ""),
        ("X", "devedor"): ("concorda", "111", "111; 222", ""),
        ("X", "remuneracao S1"): ("concorda", "taxa=5", "100% DI + 5%", ""),
        ("X", "remuneracao S2"): ("diverge", "taxa=5", "IPCA + 6%", ""),
        ("Y", "emissao"): ("sem_dado_cvm", "", "", ""),
        ("Z", "data_emissao"): ("sem_valor_no_termo", "", "", ""),
        ("Z", "vencimento S1"): ("sem_valor_no_termo", "", "", ""),
    }
