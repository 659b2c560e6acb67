"""Registers, stored relations, providers, watch list and review tiers (SCAN-17, MATCH-08, MATCH-10, RULE-13, RULE-19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import providers, registry, watch
from ..sources.tables import table
from .registry import query

RUNS_SQL = """
r AS (SELECT o_orderkey AS run_id, o_custkey AS k, CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'success' END AS status, CASE WHEN o_orderkey % 7 = 0 THEN 'outra' ELSE 'cadastro' END AS source, o_orderdate AS started_at FROM orders),
m AS (SELECT l_orderkey AS run_id, CASE l_linenumber % 3 WHEN 1 THEN 'fundo' WHEN 2 THEN 'classe' ELSE 'outro' END AS member, CASE WHEN l_returnflag = 'R' THEN 'error' ELSE 'processed' END AS status, CASE WHEN l_tax < 0.04 THEN l_partkey END AS line_count FROM lineitem),
g AS (SELECT run_id, w.member FROM r, (VALUES ('fundo'), ('classe')) w(member)),
c AS (SELECT g.run_id, g.member, count(m.member) AS rows, count(*) FILTER (m.status = 'processed') AS n, count(line_count) FILTER (m.status = 'processed') AS counted FROM g LEFT JOIN m ON g.run_id = m.run_id AND g.member = m.member GROUP BY 1, 2),
x AS (SELECT run_id, bool_or(rows = 0) AS a, bool_or(rows > 0 AND n = 0) AS b, bool_or(n > 0 AND counted = 0) AS d FROM c GROUP BY 1),
q AS (SELECT r.*, CASE WHEN status <> 'success' THEN 'status_nao_success' WHEN source <> 'cadastro' THEN 'fonte_diferente' WHEN a THEN 'membro_ausente' WHEN b THEN 'membro_nao_processado' WHEN d THEN 'line_count_nulo' END AS reason FROM r JOIN x ON r.run_id = x.run_id)"""


def _runs(spark, sf_dir):
    k = F.col("o_orderkey")
    runs = table(spark, sf_dir, "orders").select(k.alias("run_id"), F.col("o_custkey").alias("k"), F.when(F.col("o_orderstatus") == "P", "failed").otherwise("success").alias("status"), F.when(k % 7 == 0, "outra").otherwise("cadastro").alias("source"), F.col("o_orderdate").alias("started_at"))
    n = F.col("l_linenumber") % 3
    members = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.when(n == 1, "fundo").when(n == 2, "classe").otherwise("outro").alias("member"), F.when(F.col("l_returnflag") == "R", "error").otherwise("processed").alias("status"), F.when(F.col("l_tax") < 0.04, F.col("l_partkey")).alias("line_count"))
    return registry.incomplete_reasons(runs, members, "cadastro", ["fundo", "classe"])


@query(f"WITH {RUNS_SQL} SELECT run_id, reason FROM q")
def registry_runs(spark, sf_dir):
    """SCAN-17: why a run of the registry is incomplete, if it is."""
    return _runs(spark, sf_dir).select("run_id", "reason")


@query(f"WITH {RUNS_SQL} SELECT k, run_id, reason FROM q QUALIFY row_number() OVER (PARTITION BY k ORDER BY reason IS NULL DESC, started_at DESC, run_id DESC) = 1")
def registry_chosen_runs(spark, sf_dir):
    """SCAN-17: the newest complete run, else the newest."""
    return registry.chosen_runs(_runs(spark, sf_dir), ["k"]).select("k", "run_id", "reason")


REGISTER_SQL = """
f AS (SELECT c_custkey AS fund_id, CASE WHEN c_custkey % 9 <> 0 THEN CAST(c_custkey AS VARCHAR) END AS cnpj FROM customer),
c AS (SELECT o_orderkey AS class_id, o_custkey AS fund_id, CAST(CASE o_orderkey % 4 WHEN 0 THEN o_custkey + 1 WHEN 1 THEN o_custkey + 1000000 ELSE o_custkey END AS VARCHAR) AS cnpj FROM orders),
v AS (SELECT 'fund' AS kind, c_custkey AS id, 'nome_fundo' AS field, c_mktsegment AS value FROM customer WHERE c_acctbal > 1000 UNION ALL SELECT 'class', o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'tipo_classe' ELSE 'nome_classe' END, CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE o_orderpriority END FROM orders WHERE o_totalprice > 90000),
w AS (SELECT DISTINCT kind, id FROM v),
l AS (SELECT c.class_id, c.cnpj, o.fund_id, CASE WHEN o.fund_id IS NULL THEN 'only_class' WHEN d.id IS NULL THEN 'fund_without_data' WHEN o.fund_id = c.fund_id THEN 'same_cnpj' ELSE 'other_fund_cnpj' END AS kind FROM c JOIN w ON w.kind = 'class' AND w.id = c.class_id LEFT JOIN f o ON o.cnpj = c.cnpj LEFT JOIN w d ON d.kind = 'fund' AND d.id = o.fund_id)"""


def _register(spark, sf_dir):
    customers, orders, k = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), F.col("o_orderkey") % 4
    funds = customers.select(F.col("c_custkey").alias("fund_id"), F.when(F.col("c_custkey") % 9 != 0, F.col("c_custkey").cast("string")).alias("cnpj"))
    number = F.when(k == 0, F.col("o_custkey") + 1).when(k == 1, F.col("o_custkey") + 1000000).otherwise(F.col("o_custkey"))
    classes = orders.select(F.col("o_orderkey").alias("class_id"), F.col("o_custkey").alias("fund_id"), number.cast("string").alias("cnpj"))
    rows = customers.where("c_acctbal > 1000").select(F.lit("fund").alias("kind"), F.col("c_custkey").alias("id"), F.lit("nome_fundo").alias("field"), F.col("c_mktsegment").alias("value"))
    of_classes = orders.where("o_totalprice > 90000").select(F.lit("class").alias("kind"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, "tipo_classe").otherwise("nome_classe").alias("field"), F.when(F.col("o_orderkey") % 5 == 0, " ").otherwise(F.col("o_orderpriority")).alias("value"))
    return funds, classes, rows.unionByName(of_classes)


@query(f"WITH {REGISTER_SQL} SELECT class_id, fund_id, kind FROM l")
def registry_class_owners(spark, sf_dir):
    """SCAN-17: the fund that a class goes with, by identifier."""
    funds, classes, rows = _register(spark, sf_dir)
    return registry.class_owners(funds, classes, rows.select("kind", "id")).select("class_id", "fund_id", "kind")


@query(f"""WITH {REGISTER_SQL},
b AS (SELECT 'fund' AS source, fund_id AS source_id, cnpj FROM f WHERE EXISTS (SELECT 1 FROM w WHERE kind = 'fund' AND id = fund_id) UNION ALL SELECT 'class', class_id, cnpj FROM l WHERE kind = 'only_class'),
t AS (SELECT kind AS source, id AS source_id, CASE field WHEN 'nome_fundo' THEN 'n' WHEN 'nome_classe' THEN 'n' ELSE 't' END AS f, value FROM v WHERE kind = 'fund' OR EXISTS (SELECT 1 FROM l WHERE l.kind = 'only_class' AND class_id = id)
 UNION ALL SELECT 'fund', l.fund_id, 't', value FROM v JOIN l ON v.kind = 'class' AND v.id = l.class_id WHERE l.kind IN ('same_cnpj', 'other_fund_cnpj') AND field = 'tipo_classe')
SELECT b.source, b.source_id, b.cnpj, coalesce(array_to_string(list_sort(list(DISTINCT value) FILTER (f = 'n' AND trim(value) <> '')), ','), '') AS names, coalesce(array_to_string(list_sort(list(DISTINCT value) FILTER (f = 't' AND trim(value) <> '')), ','), '') AS class_types FROM b LEFT JOIN t ON b.source = t.source AND b.source_id = t.source_id GROUP BY 1, 2, 3""")
def registry_subjects(spark, sf_dir):
    """SCAN-17: funds with data and classes without a fund, with their sets of values."""
    funds, classes, rows = _register(spark, sf_dir)
    named = rows.withColumn("field", F.when(F.col("field").isin("nome_fundo", "nome_classe"), "nome").otherwise(F.col("field")))
    found = registry.subjects(named, funds, classes, {"names": "nome"}, {"class_types": "tipo_classe"})
    return found.select("source", "source_id", "cnpj", F.array_join("names", ",").alias("names"), F.array_join("class_types", ",").alias("class_types"))


@query(f"""WITH {REGISTER_SQL}, p AS (SELECT l_orderkey * 10 + l_linenumber AS party_id, CASE WHEN l_linenumber % 2 = 0 THEN 'fund' ELSE 'class' END AS kind, CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey ELSE l_orderkey END AS id, l_returnflag AS role FROM lineitem)
SELECT 'fund' AS source, id AS source_id, role, party_id FROM p WHERE kind = 'fund' UNION ALL SELECT CASE WHEN l.kind = 'only_class' THEN 'class' ELSE 'fund' END, CASE WHEN l.kind = 'only_class' THEN id ELSE fund_id END, role, party_id FROM p JOIN l ON p.kind = 'class' AND id = class_id WHERE l.kind <> 'fund_without_data'""")
def registry_parties(spark, sf_dir):
    """SCAN-17: parties of subjects; a fund has those of its classes too."""
    funds, classes, rows = _register(spark, sf_dir)
    even = F.col("l_linenumber") % 2 == 0
    parties = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("party_id"), F.when(even, "fund").otherwise("class").alias("kind"), F.when(even, F.col("l_suppkey")).otherwise(F.col("l_orderkey")).alias("id"), F.col("l_returnflag").alias("role"), F.lit("").alias("cnpj"), F.lit("").alias("name"))
    return registry.party_links(parties, registry.class_owners(funds, classes, rows.select("kind", "id"))).select("source", "source_id", "role", "party_id")


@query("""
WITH r AS (SELECT l_suppkey AS source_id, l_partkey AS target_id, l_returnflag AS kind, l_orderkey || '/' || l_linenumber AS canonical_key, CASE WHEN l_linestatus = 'F' THEN 'active' ELSE 'ended' END AS status, l_shipdate AS valid_from, CASE WHEN l_linenumber % 2 = 0 THEN l_shipdate + INTERVAL 400 DAY END AS valid_to FROM lineitem)
SELECT 'source' AS asked, canonical_key FROM r WHERE source_id = 7 UNION ALL SELECT 'target', canonical_key FROM r WHERE target_id = 11 AND kind = 'N' UNION ALL SELECT 'key', canonical_key FROM r WHERE canonical_key = '1/1'
UNION ALL SELECT 'active', canonical_key FROM r WHERE status = 'active' AND kind = 'A' AND valid_from <= TIMESTAMP '1994-06-01' AND (valid_to IS NULL OR TIMESTAMP '1994-06-01' <= valid_to)""")
def stored_relations(spark, sf_dir):
    """MATCH-08: relations by source, by target and kind, by key, and those active at an instant."""
    ship = F.col("l_shipdate")
    r = table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("target_id"), F.col("l_returnflag").alias("kind"), F.concat(F.col("l_orderkey"), F.lit("/"), F.col("l_linenumber")).alias("canonical_key"),
        F.when(F.col("l_linestatus") == "F", "active").otherwise("ended").alias("status"), ship.alias("valid_from"), F.when(F.col("l_linenumber") % 2 == 0, ship + F.expr("interval 400 days")).alias("valid_to"),
    )
    asked = {
        "source": registry.relations_of(r, F.lit(7), "source"),
        "target": registry.relations_of(r, F.lit(11), "target", "N"),
        "key": registry.relation_by_key(r, " 1/1 "),
        "active": registry.relations_active(r, F.lit("1994-06-01").cast(r.schema["valid_from"].dataType), "A"),
    }
    parts = [df.select(F.lit(name).alias("asked"), "canonical_key") for name, df in asked.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("""
WITH s AS (SELECT o_custkey AS query, o_orderkey % 4 AS priority, CAST(o_orderkey AS VARCHAR) AS provider, CASE WHEN o_orderkey % 3 <> 0 THEN 'A' || (o_custkey + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END) END AS code, CASE WHEN o_orderkey % 5 = 0 THEN 'I' || o_custkey END AS isin, CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END AS status, o_orderkey AS event FROM orders WHERE o_orderkey % 2 = 0),
k AS (SELECT *, coalesce(code, isin) AS key FROM s WHERE coalesce(code, isin) IS NOT NULL),
b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY query, key ORDER BY priority DESC, provider DESC) = 1),
o AS (SELECT query, count(*) AS n, min(key) AS key, min_by(code, key) AS code, min_by(status, key) AS status, min_by(event, key) AS event FROM b GROUP BY 1),
a AS (SELECT c_custkey AS query, CASE WHEN n IS NULL THEN 'not_found' WHEN n > 1 THEN 'ambiguous' ELSE 'found' END AS outcome, CASE WHEN n = 1 THEN key END AS key, CASE WHEN n = 1 THEN code END AS code, o.status, o.event FROM customer LEFT JOIN o ON query = c_custkey),
d AS (SELECT 'A' || l_suppkey AS code, l_linenumber AS priority, l_orderkey * 100000 + l_partkey AS provider, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS status, l_orderkey AS event FROM lineitem WHERE l_quantity > 49),
e AS (SELECT a.query, d.status, d.event, d.priority, d.provider, 1 AS later FROM a JOIN d ON a.code = d.code WHERE outcome = 'found' UNION ALL SELECT query, status, event, 0, 0, 0 FROM a WHERE outcome = 'found'),
g AS (SELECT query, list_sort(list(struct_pack(later := later, priority := priority, provider := provider, status := status)) FILTER (status IS NOT NULL)) AS ss, list_sort(list(struct_pack(later := later, priority := priority, provider := provider, event := event))) AS es FROM e GROUP BY 1)
SELECT a.query, outcome, key, ss[len(ss)].status AS status, array_to_string(list_transform(es, lambda x: x.event), ',') AS events FROM a LEFT JOIN g ON a.query = g.query""")
def provider_lookup(spark, sf_dir):
    """MATCH-10: one candidate or an outcome; fields by priority, lists joined."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    results = table(spark, sf_dir, "orders").where(k % 2 == 0).select(
        c.alias("query"), (k % 4).alias("priority"), k.cast("string").alias("provider"), F.when(k % 3 != 0, F.concat(F.lit("A"), c + F.when(k % 11 == 0, 1).otherwise(0))).alias("asset_code"),
        F.when(k % 5 == 0, F.concat(F.lit("I"), c)).alias("isin"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("status"), F.array(k).alias("events"),
    )
    number = F.col("l_orderkey") * 100000 + F.col("l_partkey")
    described = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select(
        F.concat(F.lit("A"), "l_suppkey").alias("asset_code"), F.col("l_linenumber").alias("priority"), F.lpad(number.cast("string"), 20, "0").alias("provider"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("status"), F.array("l_orderkey").alias("events")
    )
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query"))
    return providers.merged(asked, results, described, ["status"], ["events"]).withColumn("events", F.array_join("events", ","))


@query("""
WITH d AS (SELECT o_custkey AS asset, strftime(o_orderdate, '%Y-%m-%d') AS date, CASE o_orderkey % 60 WHEN 0 THEN 'vencimento_antecipado_declarado' WHEN 1 THEN 'dacao_em_pagamento_rejeitado' WHEN 2 THEN 'waiver_aprovado' WHEN 3 THEN 'waiver_rejeitado' WHEN 4 THEN 'aporte_titulares_aprovado' WHEN 5 THEN 'nao_declaracao_do_vencimento_antecipado_rejeitada' ELSE 'contas_aprovado' END AS event FROM orders),
s AS (SELECT asset, max(date || ': ' || replace(event, '_', ' ')) FILTER (event IN ('vencimento_antecipado_declarado', 'nao_declaracao_do_vencimento_antecipado_rejeitada')) AS severe, array_to_string(list_sort(list(DISTINCT replace(event, '_', ' ')) FILTER (date >= '1995-01-01' AND event IN ('waiver_aprovado', 'aporte_titulares_aprovado'))), ', ') AS recent FROM d GROUP BY 1),
x AS (SELECT c_custkey AS asset, CASE WHEN c_custkey % 13 = 0 THEN 2 ELSE 0 END AS late, c_acctbal BETWEEN 0 AND 500 AS q, c_acctbal < -900 AS contagion, c_mktsegment = 'BUILDING' AS e, c_nationkey % 5 AS score, severe, recent FROM customer LEFT JOIN s ON asset = c_custkey)
SELECT asset, CASE WHEN severe IS NOT NULL THEN 1 WHEN late > 0 THEN 2 WHEN recent IS NOT NULL OR q OR contagion THEN 3 WHEN e OR score > 0 THEN 4 ELSE 5 END AS level,
 concat_ws(' ; ', CASE WHEN severe IS NOT NULL THEN 'ata de ' || severe WHEN late > 0 THEN late || ' série(s) em atraso no Informe' END, 'atas em 12 meses: ' || recent, CASE WHEN q THEN 'DF: Com ressalva' END, CASE WHEN contagion THEN 'devedor com outras emissões em atraso' END, CASE WHEN e THEN 'Informe em 12 meses: rating_mudou, taxa_mudou' END, CASE WHEN score > 0 THEN 'ranking de triagem: ' || score || ' pontos' END) AS reasons FROM x""")
def watch_list(spark, sf_dir):
    """RULE-13: levels with their reasons; severe decisions count at any date, stress from a date on."""
    k = F.col("o_orderkey") % 60
    event = F.when(k == 0, "vencimento_antecipado_declarado").when(k == 1, "dacao_em_pagamento_rejeitado").when(k == 2, "waiver_aprovado").when(k == 3, "waiver_rejeitado").when(k == 4, "aporte_titulares_aprovado").when(k == 5, "nao_declaracao_do_vencimento_antecipado_rejeitada").otherwise("contas_aprovado")
    decisions = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("asset"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), event.alias("event"))
    b = F.col("c_acctbal")
    assets = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("asset"), F.when(F.col("c_custkey") % 13 == 0, 2).alias("late_series"), F.when(F.col("c_mktsegment") == "BUILDING", F.array(F.lit("2026-07 taxa_mudou"), F.lit("2026-05 rating_mudou"), F.lit("2026-06 taxa_mudou"))).alias("informe_events"),
        F.lit("Com ressalva").alias("df_opinion"), F.when(b.between(0, 500), F.array(F.lit("df_com_ressalva"))).alias("df_flags"), (b < -900).alias("contagion"), (F.col("c_nationkey") % 5).alias("ranking_score"),
    )
    return watch.watch_list(assets, decisions, "1995-01-01").withColumn("reasons", F.array_join("reasons", " ; "))


@query("""
WITH f AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, CASE l_partkey % 6 WHEN 0 THEN 'valor inferido' WHEN 1 THEN 'lido na capa' WHEN 2 THEN '' END AS note, CASE l_suppkey % 5 WHEN 0 THEN 'diverge' WHEN 1 THEN 'inconclusivo' WHEN 4 THEN NULL ELSE 'confere' END AS verdict, CASE WHEN l_returnflag = 'R' THEN 'pdf_ocr' ELSE 'texto' END AS method, l_tax > 0.07 AS d, l_discount > 0.08 AS a FROM lineitem),
u AS (SELECT *, concat_ws(' ; ', CASE WHEN d THEN 'diverge de outro documento' END, CASE WHEN verdict <> 'confere' THEN 'conferência visual ' || verdict END, CASE WHEN note LIKE '%inferid%' THEN 'nota com contradição/interpretação' END) AS u, concat_ws(' ; ', CASE WHEN a THEN 'alimenta alerta contratual' END, CASE WHEN method = 'pdf_ocr' THEN 'leitura por OCR' END) AS w, coalesce(note, '') <> '' AS noted, verdict IS DISTINCT FROM 'confere' AS unseen FROM f)
SELECT k, n, p, CASE WHEN u <> '' THEN 1 WHEN w <> '' THEN 2 WHEN unseen THEN 5 WHEN noted THEN 3 ELSE 4 END AS tier,
 CASE WHEN u <> '' THEN u WHEN w <> '' THEN w WHEN unseen AND noted THEN 'sem conferência visual; tem observação na proposta' WHEN unseen THEN 'sem conferência visual' WHEN noted THEN 'conferido visualmente; ler a observação da proposta' ELSE 'conferido visualmente, sem observação' END AS reasons FROM u""")
def review_tiers(spark, sf_dir):
    """RULE-19: tiers of facts in the review queue."""
    p, s = F.col("l_partkey") % 6, F.col("l_suppkey") % 5
    note = F.when(p == 0, "valor inferido").when(p == 1, "lido na capa").when(p == 2, "")
    verdict = F.when(s == 0, "diverge").when(s == 1, "inconclusivo").when(s != 4, "confere")
    found = watch.fact_tier(note, verdict, F.when(F.col("l_returnflag") == "R", "pdf_ocr").otherwise("texto"), F.col("l_tax") > 0.07, F.col("l_discount") > 0.08)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), found["tier"].alias("tier"), F.array_join(found["reasons"], " ; ").alias("reasons"))
