"""Rules on small rows whose outcome is known."""

from __future__ import annotations

import io
import random
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from lastro.functions import identifiers, text, values
from lastro.operators import comparison, contracts, graph, market, matching, observations, proposals, text_rules, versions
from lastro.sources import files
from lastro.streaming import windows


def one(spark, *columns, **values_):
    df = spark.createDataFrame([tuple(values_.values())], list(values_)) if values_ else spark.range(1)
    return df.select(*columns).first()


@pytest.mark.parametrize(
    ("given", "kind"),
    [("11.222.333/0001-81", "cnpj"), ("11222333000182", "invalid"), ("", "empty"), ("123.456.789-00", "cpf"), ("00000000000000", "invalid"), ("12ABC34501DE35", "cnpj"), ("1-1222333000181", "invalid"), ("11.222.3330001-81", "invalid"), ("191", "invalid"), (" 000000000191 ", "cnpj"), ("12.abc.345/01de-35", "cnpj")],
)
def test_fund_identifier_class(spark, given, kind):
    assert one(spark, identifiers.fund_identifier_class(F.lit(given)))[0] == kind


@pytest.mark.parametrize(
    ("given", "kind"),
    [
        ("0", "nao_informado"),
        ("NA", "nao_informado"),
        ("99.999.999/9999-99", "nao_informado"),
        (None, "nao_informado"),
        ("191", "invalido"),
        ("000000000191", "cnpj_sem_zeros"),
        ("11-222333000181", "cnpj"),
        ("12.ABC.345/01DE-35", "cnpj"),
        ("ABC12345678", "invalido"),
        ("529.982.247-25", "cpf"),
        ("529.982.247-24", "invalido"),
    ],
)
def test_market_identifier_class(spark, given, kind):
    assert one(spark, identifiers.market_identifier_class(F.lit(given)))[0] == kind


def test_text_normalisers(spark):
    r = one(spark, text.fold(F.lit(" Ação ÚNICA ")), text.matching_name(F.lit("Cia. Áçúcar & Filhos S/A")), text.series_key(F.lit("Série | 1  Sênior")), text.clean_identifier(F.lit(" ab​1 ")), text.clean_identifier(F.lit("000")), text.real_isin(F.lit("brxxxxxxxxx1")), text.real_isin(F.lit("00000")))
    assert tuple(r) == ("acao unica", "CIA ACUCAR FILHOS S A", "serie 1 senior", "AB1", "", "BRXXXXXXXXX1", "")
    r = one(spark, text.mask_personal(F.lit("cpf 529.982.247-25 a@b.co")), text.mask_secrets(F.lit("token: abc")), text.same_company(F.lit("Açúcar SA"), F.lit("ACUCAR  SA")))
    assert tuple(r) == ("cpf ***.***.***-** ***@***", "token: ***", True)
    r = one(spark, text.strip_accents(F.lit("1º de março, ﬁm ½")), text.fold(F.lit("  1ª VIA ")), text.shown_example(F.lit("EmailDevedor"), F.lit("a1@b.c")), text.shown_example(F.lit("x"), F.lit("y" * 70)), text.personal_data_suspected(F.lit("x"), F.lit("(11) 91234-5678")))
    assert tuple(r) == ("1o de marco, fim 1⁄2", "1a via", "**@*.*", "y" * 60 + "…", True)


@pytest.mark.parametrize(
    ("given", "shape"),
    [("", "empty"), ("-0.00", "zero"), ("12", "integer"), ("1.5", "decimal_dot"), ("9.999,99", "decimal_comma"), ("9999,9", "decimal_comma"), ("2026-01-31", "date_iso"), ("31/01/2026", "date_br"), ("12.ABC.345/01DE-35", "cnpj_formatted"), ("R$ 1", "text")],
)
def test_value_shape(spark, given, shape):
    assert one(spark, text.value_shape(F.lit(given)))[0] == shape


@pytest.mark.parametrize(
    ("given", "tokens"),
    [
        ("100% da Taxa DI", ["idx=DI", "mult=100"]),
        ("108% (cento e oito por cento) da variação acumulada das taxas médias diárias dos DI", ["idx=DI", "mult=108"]),
        ("8,88% ao ano acima do IPCA", ["idx=IPCA", "taxa=8.88"]),
        ("CDI + 2,50% a.a., base 252", ["idx=DI", "taxa=2.5"]),
        ("Pré-fixada 14,4287%", ["idx=PREFIXADA", "taxa=14.4287"]),
        ("IPCA mais taxa prefixada de 1,5%", ["idx=IPCA", "taxa=1.5"]),
        ("IGP-M", ["idx=IGPM"]),
        (None, []),
    ],
)
def test_rate_tokens(spark, given, tokens):
    assert one(spark, values.rate_tokens(F.lit(given).cast("string")))[0] == tokens


def test_rate_keys(spark):
    r = one(spark, values.rate_numbers(F.lit("Pré-fixada 14,4287%")) == values.rate_numbers(F.lit("14,43% PRE")), values.rate_key(F.lit("CDI + 6,734%")), values.rate_numbers(F.lit("taxa a definir")))
    assert tuple(r) == (True, ["idx=DI", "taxa=6.73"], [])


def test_party_tokens(spark):
    r = one(spark, text.party_tokens(F.lit("Usina São João Açúcar e Álcool S.A. (sociedade, CNPJ 11.222.333/0001-81)")), text.party_tokens(F.lit("ACME 12.ABC.345/01DE-35 e 12.ABC.345/01DE-36")), text.party_tokens(F.lit(None).cast("string")))
    assert r[0] == ["cnpj=11222333000181", "w=ACUCAR", "w=ALCOOL", "w=JOAO", "w=SAO", "w=USINA"]
    assert "cnpj=12ABC34501DE35" in r[1] and "cnpj=12ABC34501DE36" not in r[1] and r[2] == []


@pytest.mark.parametrize(
    ("value", "unit", "variants"),
    [
        ("2026-03-01", "", ["01/03/2026", "1 de marco de 2026", "01 de marco de 2026", "1o de marco de 2026"]),
        ("2026-12-15", "", ["15/12/2026", "15 de dezembro de 2026"]),
        ("0.125", "fração", ["12,5%", "12,50%"]),
        ("0.2", "fracao", ["20%", "20,00%", "20,0%"]),
        ("1234567.891", "BRL", ["1.234.567,89", "r$ 1.234.567"]),
        ("1500", "unidades", ["1.500"]),
        ("30", "dias", []),
        ("sim", None, []),
        (None, None, []),
    ],
)
def test_value_variants(spark, value, unit, variants):
    assert one(spark, values.value_variants(F.lit(value).cast("string"), F.lit(unit).cast("string")))[0] == variants


def test_leaf_values(spark):
    cases = [("1.50", "decimal", ("1.50", "present_value", "valid")), ("0.00", "decimal", ("0.00", "zero", "valid")), ("1,5", "decimal", (None, "invalid", "invalid")), ("1.0", "integer", (None, "invalid", "invalid")), ("2026-02-30", "date", (None, "invalid", "invalid")), (" ", "text", (None, "present_empty", "valid")), (None, "date", (None, "absent", "valid")), (" a ", "text", (" a ", "present_value", "valid"))]
    for raw, kind, expected in cases:
        assert tuple(one(spark, values.leaf_value(F.lit(raw).cast("string"), F.lit(kind)))[0]) == expected
    with pytest.raises(Exception, match="unknown data type"):
        one(spark, values.leaf_value(F.lit("1"), F.lit("money")))


def test_numbers(spark):
    r = one(spark, values.brazilian_decimal(F.lit("R$ 1.234,56")).cast("double"), values.money_or_zero(F.lit("x")).cast("int"), values.money_or_null(F.lit("x")), values.share(F.lit(50.0)), values.share(F.lit(0.0)), values.share(F.lit(101.0)), values.relative_change(F.lit(0.0), F.lit(5.0)), values.canonical_decimal(F.lit("-0.00")), values.canonical_decimal(F.lit("12.3400")))
    assert tuple(r) == (1234.56, 0, None, 0.5, None, None, None, "0", "12.34")
    r = one(spark, values.brazilian_decimal(F.lit("-1,5 %")).cast("double"), values.brazilian_decimal(F.lit("R$ -")), values.rating_key(F.lit("Não possui")), values.rating_key(F.lit("Não há")), values.rating_key(F.lit("brAA+.")), values.named_months(F.lit("junho e dezembro")))
    assert tuple(r) == (-1.5, None, "", "", "braa+", [5, 11])
    with pytest.raises(Exception, match="unknown unit"):
        one(spark, values.in_units(F.lit(1), F.lit("USD")))


def test_dates(spark):
    r = one(spark, values.delivery_delay(F.lit("2026-10-15").cast("date"), F.lit("2026-09-10").cast("date")), values.months_between(F.lit("2025-11-30").cast("date"), F.lit("2026-01-01").cast("date")), values.brazilian_date(F.lit("31/12/2025")), values.brazilian_date(F.lit("31/02/2025")))
    assert tuple(r) == (15, 2, date(2025, 12, 31), None)


def test_priority_beats_recency_and_inactive_sources_are_left_out(spark):
    sources = spark.createDataFrame([(1, 100, True), (2, 300, False), (3, 200, True)], "source_id int, priority int, active boolean")
    rows = spark.createDataFrame([("k", 1, 9, "new"), ("k", 2, 9, "inactive"), ("k", 3, 1, "best"), ("k", 3, 0, "older")], "k string, source_id int, at int, value string")
    assert [r["value"] for r in versions.current_values(rows, sources, ["k"], [F.col("at").desc()]).collect()] == ["best"]


def test_capped_top_equals_the_greedy_loop(spark):
    rows = [(i % 2, i * 7 % 5, i) for i in range(60)]
    got = {r["i"] for r in versions.capped_top(spark.createDataFrame(rows, "kind int, owner int, i int"), "kind", "owner", ["i"], 6, 2).collect()}
    kinds, owners, expected = {}, {}, set()
    for kind, owner, i in sorted(rows, key=lambda r: r[2]):
        if kinds.get(kind, 0) < 6 and owners.get((kind, owner), 0) < 2:
            kinds[kind], owners[kind, owner] = kinds.get(kind, 0) + 1, owners.get((kind, owner), 0) + 1
            expected.add(i)
    assert got == expected


def test_partial_last_month_is_skipped(spark):
    rows = [("2026-07", i) for i in range(10)] + [("2026-08", i) for i in range(10)] + [("2026-09", i) for i in range(3)]
    assert market.reference_month(spark.createDataFrame(rows, "m string, c int"), "m", "c").first()[0] == "2026-08"


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_medians_of_split_keys(spark, reuse):
    import statistics

    settings = {"spark.sql.exchange.reuse": reuse, "spark.sql.adaptive.enabled": reuse}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        rows = [("a", float(i % 97)) for i in range(1001)] + [("b", 1.0), ("b", 4.0), ("c", 7.0), ("d", None)]
        found = {r[0]: (r[1], r[2]) for r in market.medians(spark.createDataFrame(rows, "k string, v double").repartition(5), "k", "v").collect()}
        assert found == {"a": (statistics.median(v for k, v in rows if k == "a"), 1001), "b": (2.5, 2), "c": (7.0, 1)}
        draw = random.Random(3)
        many = [(draw.choice("xxxxxxxy"), draw.random() ** 3) for _ in range(60_000)]
        found = {r[0]: r[1] for r in market.medians(spark.createDataFrame(many, "k string, v double").repartition(7), "k", "v").collect()}
        assert found == {k: statistics.median(v for n, v in many if n == k) for k in "xy"}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_outliers_of_counted_values(spark):
    import statistics

    draw = random.Random(5)
    rows = [(i, draw.choice("ppq"), round(draw.gauss(0, 1) ** 3, 1)) for i in range(3000)] + [(9000 + i, "few", float(i)) for i in range(11)] + [(9100 + i, "same", 1.0) for i in range(20)] + [(9200, "p", None)]
    expected = set()
    for key in "pq":
        own = [v for _, k, v in rows if k == key and v is not None]
        middle = statistics.median(own)
        mad = statistics.median(abs(v - middle) for v in own)
        expected |= {i for i, k, v in rows if k == key and v is not None and abs(v - middle) / (1.4826 * mad) > 5}
    found = market.outliers(spark.createDataFrame(rows, "id long, k string, v double"), "k", "v", 5)
    assert expected and {r["id"] for r in found.collect()} == expected


def test_series_events(spark):
    base = {"k": "s", "status": "Adimplente", "rating": "brAA", "due": "2030-01-01", "rate": "CDI + 2%", "balance": "100", "amortised": "0"}
    months = [base, base | {"status": "Em atraso", "rating": "Não há"}, base | {"due": "2031-01-01", "rate": "DI acrescido de 2,00% a.a.", "balance": "85"}, base | {"rating": "brA", "due": "2031-01-01", "rate": "3% CDI", "balance": "70", "amortised": "10"}, base | {"rating": "brA", "due": "2031-01-01", "balance": "0"}]
    df = spark.createDataFrame([{**m, "month": f"2026-0{i}"} for i, m in enumerate(months, 1)])
    found = {}
    for r in market.series_events(df, ["k"], "month").collect():
        found.setdefault(r["month"], set()).add(r["event"])
    assert found == {"2026-02": {"entrou_em_atraso"}, "2026-03": {"saiu_do_atraso", "vencimento_mudou", "saldo_caiu_sem_amortizacao"}, "2026-04": {"rating_mudou", "taxa_mudou"}, "2026-05": {"taxa_mudou", "saldo_zerou"}}


def test_watch_reasons(spark):
    def level(*held):
        c = {n: F.lit(n in held) for n in ("ata", "atraso", "df", "ranking")}
        found = market.watch_reasons({"ata": c["ata"]}, {"atraso": c["atraso"]}, {"df": c["df"]}, {"ranking": c["ranking"]})
        return tuple(one(spark, found["level"], found["reasons"]))

    assert level("ata", "atraso", "df") == (1, ["ata", "df"])
    assert level("atraso", "ranking") == (2, ["atraso", "ranking"])
    assert level("df", "ranking") == (3, ["df", "ranking"]) and level("ranking") == (4, ["ranking"]) and level() == (5, [])


def test_covenant_groups_and_table(spark):
    r = one(spark, market.covenant_group(F.lit("Fundo"), F.lit("índice")), market.covenant_group(F.lit(""), F.lit("Razão de garantia")), market.covenant_group(F.lit(None).cast("string"), F.lit("Alienação")), market.covenant_group(F.lit("x"), F.lit("envio")))
    assert tuple(r) == ("fundo", "covenant", "garantia", "obrigacao")
    names = ["codes", "isins", "month", "kind", "group_title", "item", "reference", "condition_text", "condition", "measured", "status", "debtor"]
    rows = [("C1, C2", "BR1", "2026-01", "Fundo", "QUADRO", "Saldo", "10", "ou mais", "", "12", "ok", "D"), ("C1", "", "2026-01", "", "", "(nada)", "1", "", "", "", "", ""), ("C3", "", "2026-01", "x", "Título", "Item", "", "", "", "9", "", "")]
    registry = spark.createDataFrame([("C1", "BRX", "Sec", "Dev")], "code string, isin string, issuer string, debtor string")
    found = {r["code"]: r for r in market.monthly_covenants(spark.createDataFrame(rows, names), registry).collect()}
    assert set(found) == {"C1", "C2"}
    assert tuple(found["C1"][c] for c in ("isin", "issuer", "debtor", "item_group", "item", "required")) == ("BR1", "Sec", "Dev", "fundo", "Saldo", "10 ou mais")
    assert tuple(found["C2"][c] for c in ("isin", "issuer", "debtor")) == ("", "", "D")


def test_parties_and_cells(spark):
    kind = "k string, t int, cnpj string, name string, share string"
    history = [("same", 1, "1", "a", "5"), ("back", 1, "1", "a", "5"), ("back", 2, "2", "a", "5"), ("name", 1, "1", "a", "5"), ("share", 1, "1", "a", "5"), ("swap", 1, "1", "a", "5"), ("gone", 1, "1", "a", "5"), ("null", 1, "1", None, "5")]
    new = [("same", 0, "1", "a", "5"), ("back", 0, "1", "a", "5"), ("name", 0, "1", "b", "6"), ("share", 0, "1", "a", "6"), ("swap", 0, "3", "z", "5"), ("new", 0, "1", "a", "5"), ("null", 0, "1", "b", "5")]
    found = comparison.party_changes(spark.createDataFrame(history, kind), spark.createDataFrame(new, kind), ["k"], "t")
    assert {r["k"]: r["status"] for r in found.collect()} == {"same": "igual", "back": "volta", "name": "nome_alterado", "share": "percentual_alterado", "swap": "cnpj_trocado", "gone": "saiu", "new": "entrou", "null": "nome_alterado"}
    cells = spark.createDataFrame([("f", "x", 1, "1"), ("f", "y", 1, "2"), ("g", "x", 1, "3")], "s string, c string, t int, value string")
    fresh = spark.createDataFrame([("f", "x", "1")], "s string, c string, value string")
    got = comparison.restated_cells(cells, fresh, fresh, ["s"], ["c"], "t")
    assert {(r["s"], r["c"]): (r["status"], r["reason"]) for r in got.collect()} == {("f", "x"): ("equal", None), ("f", "y"): ("vanished", "vazias"), ("g", "x"): ("vanished", "sem_linha")}


def test_conflict_classes(spark):
    rows = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b"), ("k", 3, "a"), ("k", 4, None), ("m", 5, "a"), ("m", 6, "a")], "k string, id int, value string")
    found = {r["value"]: (r["class_id"], r["n_rows"], r["n_classes"]) for r in observations.conflicts(rows, ["k"], "id", "value").collect()}
    assert found == {"a": (1, 2, 3), "b": (2, 1, 3), None: (4, 1, 3)}


def test_equal_facts_have_one_parameter_each(spark):
    facts = spark.createDataFrame([(1, "k", date(2026, 1, 5)), (2, "k", date(2026, 1, 5))], "id int, k string, day date")
    parameters = spark.createDataFrame([("k", "p", date(2026, 1, 1), None)], "k string, p string, valid_from date, valid_to date")
    assert [(r["id"], r["matches"]) for r in versions.in_force(facts, parameters, ["k"], "day", "id").orderBy("id").collect()] == [(1, 1), (2, 1)]


def test_best_name_match(spark):
    left = spark.createDataFrame([(1, "Açúcar S.A.", "Doce"), (2, "x", "Mel"), (3, "Mel", ""), (4, "nada", "")], "id int, name string, trade string")
    right = spark.createDataFrame([(7, "ACUCAR SA", ""), (8, "Açúcar s a", "mel"), (9, "outro", "mel")], "id int, name string, trade string")
    assert {r[0]: tuple(r)[1:] for r in matching.best_name_match(left, right).collect()} == {1: (70, 1, 8), 2: (45, 2, 8), 3: (40, 2, 8), 4: (0, 0, None)}


def test_documents_are_upserted_by_hash_then_id(spark):
    kind = "sha256 string, source_id string, source string, title string, category string"
    stored = spark.createDataFrame([("h1", "1", "s", "old", "DF"), ("h2", "2", "s", "two", "DF"), ("h3", "3", "s", "three", "Ata")], kind)
    new = spark.createDataFrame([("h1", "9", "s", " ", "Outro"), ("h2x", "2", "s", "two", "DF"), ("h4", "4", "s", "four", "Ata")], kind)
    found = {r["sha256"]: (r["source_id"], r["title"], r["category"], r["outcome"]) for r in observations.upsert_documents(stored, new, "Outro", F.lit(False)).collect()}
    assert found == {"h1": ("9", "old", "DF", "updated"), "h2x": ("2", "two", "DF", "updated"), "h3": ("3", "three", "Ata", "unchanged"), "h4": ("4", "four", "Ata", "inserted")}


def test_placeholder_series_and_siblings(spark):
    rows = spark.createDataFrame([("e", "C1", 1, "I1", date(2026, 1, 1)), ("e", "C2", 1, "I1", date(2026, 2, 1)), ("e", "C3", 1, "", date(2026, 3, 1)), ("e", "C4", 2, "", date(2026, 1, 1)), ("f", "C5", 1, "", date(2026, 1, 1))], "issuer string, code string, number int, isin string, date date")
    assert {r["code"] for r in graph.without_placeholders(rows).collect()} == {"C2", "C4", "C5"}
    assert {(r["code"], r["n_siblings"]) for r in graph.siblings(rows.where("isin <> ''"), ["issuer", "isin"], "code").collect()} == {("C1", 1), ("C2", 1)}


def test_contract_rules(spark):
    facts = spark.createDataFrame([("a", "gar", date(2026, 1, 31), "100", "BRL", "d1"), ("a", "gar", date(2026, 9, 30), "2", "BRL_mil", "d2"), ("a", "div", date(2026, 9, 30), "1", "BRL", "d2"), ("a", "ok", date(2026, 1, 31), " Não ", "", "d3"), ("a", "pago", date(2026, 1, 10), "40", "BRL", "d4"), ("a", "af", date(2026, 12, 31), "nenhum", "", "d5")], "asset string, name string, date date, value string, unit string, source string")
    parameters = spark.createDataFrame([("a", "min", "90", date(2026, 1, 1), date(2026, 6, 30)), ("a", "r1", "1", None, None), ("a", "r2", "3", None, None), ("a", "dever", "sim", None, None), ("a", "prazo", "2026-02-10", None, None), ("a", "taxa_1", "2.50", None, None)], "asset string, name string, value string, valid_from date, valid_to date")
    amounts = spark.createDataFrame([("a", "2026-01", "r/pago", "40.004", "units", None), ("a", "2026-02", "r/pago", "9", "unknown", None), ("a", "2026-02", "r/s/taxa", "2.5", "units", "1"), ("a", "2026-02", "r/s/taxa", "9", "units", "2")], "asset string, month string, path string, value string, scale string, instance_key string")
    rules = [
        {"id": "min", "type": "fact_minimum", "facts": ["gar"], "parameter": "min"},
        {"id": "ces", "type": "cessao_fiduciaria_minima", "months": ["01", "09"], "parameter": "min", "fact": "gar"},
        {"id": "raz", "type": "razao_garantia_minima", "numerator_facts": ["gar"], "denominator_fact": "div", "parameters": {"01-08": "r1", "09-12": "r2"}},
        {"id": "pag", "type": "payment_reconciliation", "fact": "pago", "informe_path": "r/pago", "coverage_months": ["2026-01", "2026-02"], "tolerance_brl": "0.01"},
        {"id": "af", "type": "trustee_payment_statement", "fact": "af", "informe_path": "r/pago"},
        {"id": "prz", "type": "obligation_deadlines", "today": "2026-02-01", "warn_days": 15, "obligations": [{"parameter": "prazo", "label": "x"}]},
        {"id": "flg", "type": "fact_flag", "facts": ["ok"], "parameter": "dever", "alert_values": ["não"]},
        {"id": "reg", "type": "informe_registry_vs_terms", "comparisons": [{"informe_path": "/taxa", "parameter": "taxa_{n}", "kind": "number", "label": "Taxa"}]},
    ]
    found = {(r["rule"], r["month"], r["instance_key"]): r["compliant"] for r in contracts.contract_alerts(rules, facts, parameters, amounts).collect()}
    assert found == {
        ("min", "2026-01", None): True, ("min", "2026-09", None): None, ("ces", "2026-01", None): True, ("ces", "2026-09", None): None, ("raz", "2026-09", None): False,
        ("pag", "2026-01", None): True, ("af", "2026-12", None): False, ("prz", "2026-02", "prazo"): False, ("flg", "2026-01", "ok"): False, ("reg", "2026-02", "Taxa:1"): True,
    }
    with pytest.raises(ValueError, match="unknown contract rules: x"):
        contracts.contract_alerts([{"id": "x", "type": "x"}], facts, parameters, amounts)
    with pytest.raises(Exception, match="no conversion of unit"):
        contracts.contract_alerts(rules[:1], facts.withColumn("unit", F.lit("USD")), parameters, amounts).collect()


def test_exposure_counts_the_first_link_once(spark):
    links = spark.createDataFrame([("d", "A", 1.0, 1), ("d", "A", 0.1, 2), ("d", "B", 50.0, 3), ("d", "E", 500.0, 4)], "debtor string, certificate string, share double, position int")
    certificates = spark.createDataFrame([("A", 100.0, True), ("B", 200.0, False), ("E", 1.0, False)], "certificate string, balance double, late boolean")
    r = market.exposure(links, certificates).first()
    assert (r["exposure"], r["contagion"], r["n_invalid_share"], r["n_certificates"]) == (200.0, True, 1, 3)


def test_alias_groups_stay_within_an_issuer(spark):
    rows = [("1", "BRABC1", "X1"), ("1", "BRABC1", "X2"), ("1", "CRA023X", "X1"), ("1", "OUTRA", "Y"), ("2", "DOUTRA", "X1"), ("1", "PLACE", "")]
    found = {(r["issuer"], r["code"]): r["group_id"] for r in graph.alias_groups(spark.createDataFrame(rows, "issuer string, code string, isin string")).collect()}
    assert found == {("1", "BRABC1"): "BRABC1", ("1", "CRA023X"): "BRABC1", ("1", "OUTRA"): "OUTRA", ("2", "DOUTRA"): "DOUTRA", ("1", "PLACE"): "PLACE"}


def test_long_chain_of_links(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(80)], "a int, b int")
    found = graph.connected_groups(spark.range(82).select(F.col("id").cast("int").alias("node")), links)
    assert {r["node"]: r["group_id"] for r in found.collect()} == {i: 0 if i < 81 else 81 for i in range(82)}


def test_restatement_returns_to_an_older_value(spark):
    history = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "x"), ("c", 1, "x")], "k string, t int, value string")
    new = spark.createDataFrame([("a", "x"), ("b", "z"), ("d", "x")], "k string, value string")
    assert {r["k"]: r["status"] for r in comparison.restated(history, new, ["k"], "t").collect()} == {"a": "returns", "b": "changed", "c": "vanished", "d": "new"}


def test_period_change_is_decided_in_order(spark):
    def status(a, b, scale, numeric):
        return one(spark, comparison.period_change(F.lit(a).cast("string"), F.lit(b).cast("string"), F.lit(scale), F.lit(numeric))["status"])[0]

    assert [status(None, "1", False, True), status("1", "2", False, True), status("1", "1.0", True, True), status("1", "2", True, True), status("a", "b", True, False)] == ["only_one_side", "excluded_scale_unknown", "unchanged", "changed", "state_changed"]


def test_identifier_conflict_beats_a_match(spark):
    left = spark.createDataFrame([(1, "cnpj", "x", True), (1, "isin", "i", False), (2, "cnpj", "z", True)], "id int, type string, value string, is_primary boolean")
    right = spark.createDataFrame([(9, "cnpj", "y", True), (9, "isin", "i", False), (8, "cnpj", "z", True)], "id int, type string, value string, is_primary boolean")
    assert {(r[0], r[1]): r[2] for r in matching.compare_identifiers(left, right).collect()} == {(1, 9): "blocked", (2, 8): "matched"}


def test_idempotent_append(spark):
    old = spark.createDataFrame([("a", None)], "k string, v string")
    new = spark.createDataFrame([("a", None), ("b", None), ("b", None)], "k string, v string")
    assert [r["k"] for r in observations.not_yet_stored(new, old, ["k", "v"]).collect()] == ["b"]


def test_decisions_and_limits(spark):
    minutes = "foi aprovada a emissao. nao foi aprovado o aditamento. a assembleia foi suspensa. nada mais."
    r = one(spark, text_rules.decisions(F.lit(minutes)), text_rules.limits(F.lit("índice igual ou superior a 1,2 e dívida no máximo 3,5x; nao podera ser superior a 3,0x, inferior a 80%, pelo menos 2 vezes")))
    assert [x["outcome"] for x in r[0]] == ["approved", "rejected", "suspended"]
    assert [tuple(x) for x in r[1]] == [(">=", 1.2, ""), ("<=", 3.5, "x"), ("<=", 3.0, "x"), ("<", 80.0, "%"), (">=", 2.0, "x")]
    r = one(spark, *[text_rules.limit_operator(F.lit(x)) for x in ("não seja inferior", "maior ou igual", "≤", "menor que", "mínimo de")])
    assert tuple(r) == (">=", ">=", "<=", "<", ">=")


def test_html_pairs(spark):
    page = "<table><tr><td>Code</td><td><b>X1</b></td></tr><tr><th>Code</th><td>later</td></tr></table><dl><dt>Issuer</dt><dd>ACME\n SA</dd></dl>"
    assert one(spark, text_rules.html_pairs(F.lit(page)))[0] == {"Code": "X1", "Issuer": "ACME SA"}


def test_contract_sections(spark):
    pages = spark.createDataFrame([(1, 'CLÁUSULA 1 - Objeto\ncorpo\n"Agente": o agente\nANEXO I\nfim ........ 12')], "doc_id int, text string")
    rows = text_rules.contract_sections(pages).orderBy("line").collect()
    assert [r["kind"] for r in rows] == ["clause", "body", "definition", "annex", "toc"]
    assert rows[2]["clause"] == "CLÁUSULA 1 - Objeto" and rows[4]["clause"] == "ANEXO I"


def test_zip_of_csv_by_physical_line(spark, tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("inf_1.csv", 'A;B\r\n1;"dois; três"\r\n2;"aberta\r\n'.encode("latin-1"))
        z.writestr("leia.txt", "x")
    (tmp_path / "f.zip").write_bytes(buffer.getvalue())
    members = files.zip_members(spark, str(tmp_path / "f.zip"))
    rows = files.with_header(files.physical_lines(members.select("member", "text")), ["A", "B"]).orderBy("line").collect()
    assert [(r["A"], r["B"]) for r in rows] == [("1", "dois; três"), ("2", '"aberta')]
    with pytest.raises(Exception, match="unexpected header"):
        files.with_header(files.physical_lines(members.select("member", "text")), ["A", "C"]).collect()


def test_tab_export(spark):
    df = spark.createDataFrame([("f", "preamble\nCodigo do Ativo\tEmpresa\tSerie\nAAA11\tAcme\n")], "file string, text string")
    assert files.tab_export(df, "Codigo do Ativo").first()["cells"] == {"Codigo do Ativo": "AAA11", "Empresa": "Acme", "Serie": ""}


def test_xml_leaves(spark):
    content = b'<r total="2" xmlns:xsi="x"><a>1</a><s><v>2</v></s>\n<s><v xsi:nil="true"/></s></r>'
    rows = files.xml_values(spark.createDataFrame([(7, bytearray(content))], "doc int, content binary")).collect()
    assert [(r["xml_path"], r["chain"], r["raw_text"], r["xsi_nil"], r["line"]) for r in rows] == [("r/a", [0], "1", False, 1), ("r/s/v", [0, 0], "2", False, 1), ("r/s/v", [0, 1], "", True, 2)]
    for bad in (b"<a>x<b/></a>", b"<!DOCTYPE a><a/>", b"<a>" * 70 + b"</a>" * 70):
        with pytest.raises(ValueError, match="mixed|DOCTYPE|deep"):
            files.xml_leaves(bad)


def test_export_and_typed_read(spark, tmp_path):
    df = spark.createDataFrame([("a", 1)], "k string, n int")
    files.export(df, str(tmp_path / "x"), "csv")
    assert spark.read.csv(str(tmp_path / "x"), header=True).first()["k"] == "a"
    part = next((tmp_path / "x").glob("part-*"))
    assert part.read_bytes().startswith(b"\xef\xbb\xbf")
    drift = files.land_as_text([df, df.withColumn("z", F.lit(1.5))])
    assert drift.columns == ["k", "n", "z"] and drift.where("z is null").count() == 1


def test_stream_gives_the_rows_of_the_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = windows.windowed_counts(stream).writeStream.format("memory").queryName("hourly").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    batch = {tuple(r) for r in windows.windowed_counts(events).collect()}
    assert {tuple(r) for r in spark.table("hourly").collect()} == batch
    q = windows.append_new(stream.withWatermark("ts", "1 day"), str(tmp_path / "out"), str(tmp_path / "cp"), ["event_id"])
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.select("event_id").distinct().count()


def test_opinions_and_reviews(spark):
    r = one(spark, *[proposals.opinion_severity(F.lit(x).cast("string")) for x in ("Sem ressalva", "Opinião COM ressalva", "Abstenção", "adversa", "", "n/d")])
    assert tuple(r) == (0, 2, 3, 3, None, None)
    amounts = lambda *x: F.array(*[F.lit(v).cast("double") for v in x])
    r = one(spark, proposals.status_against_delinquency(F.array(F.lit("Em atraso"), F.lit("Adimplente")), amounts(0, None)), proposals.status_against_delinquency(F.array(F.lit("Adimplente")), amounts(0, 5)), proposals.status_against_delinquency(F.array(F.lit("Em atraso")), amounts(5)))
    assert tuple(r) == ("late_without_amounts", "amounts_without_late", None)
    r = one(spark, proposals.validation_status(F.array(F.lit("valid")), F.array().cast("array<string>"), F.lit(None).cast("string")), proposals.validation_status(F.array(F.lit("valid"), F.lit("warning")), F.array(F.lit("invalid")), F.lit(None).cast("string")), proposals.validation_status(F.array(F.lit("invalid")), F.array(F.lit("valid")), F.lit("TOO_LARGE")))
    assert [tuple(x) for x in r] == [("valid", None), ("invalid", None), ("failed", "TOO_LARGE")]


def test_older_snapshots_are_refused(spark):
    applied = spark.createDataFrame([(date(2026, 3, 1),)], "d date")
    same = spark.createDataFrame([(date(2026, 3, 1),)], "d date")
    assert proposals.refuse_older(same, applied, "d").count() == 1
    assert proposals.refuse_older(same, applied.limit(0), "d").count() == 1
    with pytest.raises(Exception, match="older than the snapshot"):
        proposals.refuse_older(spark.createDataFrame([(date(2026, 2, 1),)], "d date"), applied, "d").collect()
