"""Listings, minutes, grids and monthly reports of portals (TXT-01, TXT-02, TXT-12, TXT-15, SCAN-22).

The tables hold no Portuguese filings, so each row's keys choose among titles, cells and lines, in every
combination; the SQL reads the same texts by its own rules.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators import portal
from ..sources.tables import table
from .registry import query

TITLES = ("Ata da Assembleia", "Atalho", "Termo_de_Não_Instalação", "Edital", "Fatos Relevantes", "Proposta", "Proposta vinculante", "AGT", "Comunicado ao Mercado", "Relatório", "DFs", "Protocolo", "Notificação", "")
ADDED = ("", "- Convocação", "(data 10.2025)", "do Rating", "/Assembleias", "Aviso aos titulares", "encerramento da oferta")
TABS = ("", "Atas", "Assembléias", "Prospecto", "Convocatória", "Comunicados")
DECISIONS = ("waiver_aprovado_em_bloco", "waiver", "waiver__rejeitado", "vencimento_antecipado_nao_declarado", "vencimento_antecipado_declarado_aprovado", "dfs_aprovado", "nao_instalada", "assembleia_suspensa", "prorrogacao_repactuacao_aprovado", "recuperacao_judicial_rejeitado", "liquidacao_patrimonio")
TOPICS = ("waiver", "vencimento_antecipado", "inadimplencia_devedor", "taxa", "prorrogacao_repactuacao")
EXCERPTS = ("atraso da parcela", "pedido de Recuperação Extrajudicial", "FALÊNCIA")
CELLS = ("Enquadrado", "Desenquadrada¹", "Não Atendido", "não  enquadrado 2", "N/A", "-", "", "Coberto", "descoberto", "Pendente*", "Em Apuração", "Não se aplica", "Enquadrada (nota)", "Atendido", "Não verificado", "talvez")
CATEGORIES = ("", "Assembleia", "Informes", "Relatórios")
SORTS = ("", "Informe Mensal", "Demonstrações Financeiras", "AGO/E", "Termo de Securitização", "Rating")
SPECIES = ("", "Ata", "Edital", "Data", "Fato Relevante")
NAMES = ("", "Informe  Mensal", "1º Aditamento", "Relatório do Agente Fiduciário", "Anúncio de Encerramento", "Termo de Securitização - Aditamento", "Relatório de Classificação de Risco")


def _chosen(texts: tuple[str, ...], by: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in texts]), (by % len(texts) + 1).cast("int"))


def _sql(texts: tuple[str, ...], by: str) -> str:
    return f"([{', '.join(repr(x) for x in texts)}])[{by} % {len(texts)} + 1]"


def _cases(tests: list[tuple[str, str]], otherwise: str = "NULL") -> str:
    return f"CASE {' '.join(f'WHEN {test} THEN {result!r}' for test, result in tests)} ELSE {otherwise} END"


def _strong(x: str) -> str:
    return _cases([(rf"regexp_matches({x}, '\batas?\b|nao instalacao')", "ata"), (rf"regexp_matches({x}, '\b(edital|convocacao|convocatoria)\b')", "edital"), (f"regexp_matches({x}, 'fatos? relevantes?')", "fato_relevante"), (rf"regexp_matches(replace({x}, 'proposta vinculante', ''), '\bproposta\b')", "proposta")])


def _weak(x: str) -> str:
    return _cases([(rf"regexp_matches({x}, '\bassembleias?\b|\bag[teo]s?\b')", "assembleia"), (rf"regexp_matches({x}, '\bcomunicados?\b|\bnotificacao\b|\baviso aos? (titulares|investidores)\b')", "comunicado")])


def _plain(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(strip_accents({x})), '[_\-.()\[\]/]+', ' ', 'g'), '\s+', ' ', 'g'))"


@query(rf"""
WITH o AS (SELECT o_orderkey, {_plain(_sql(TITLES, "o_orderkey") + " || ' ' || " + _sql(ADDED, "o_custkey"))} AS t, {_plain(_sql(TABS, "(o_orderkey // 14)"))} AS c FROM orders)
SELECT o_orderkey, CASE WHEN regexp_matches(t || ' ' || c, '\bprotocolo\b') THEN '' ELSE coalesce({_strong("t")}, CASE WHEN regexp_matches(t || ' | ' || c, 'relatorio|\bdfs?\b|\bprospecto\b|\brating\b|encerramento da oferta') THEN '' END, {_weak("t")}, {_strong("c")}, {_weak("c")}, '') END AS kind FROM o""")
def listing_kinds(spark, sf_dir):
    """TXT-12: the kind of a listed paper by its title, then its tab."""
    key = F.col("o_orderkey")
    title = F.concat_ws(" ", _chosen(TITLES, key), _chosen(ADDED, F.col("o_custkey")))
    return table(spark, sf_dir, "orders").select("o_orderkey", portal.document_kind(title, _chosen(TABS, F.floor(key / 14))).alias("kind"))


def _rank(x: str) -> str:
    return "CASE " + " ".join(f"WHEN starts_with({x}, '{g}') THEN {k}" for k, g in enumerate(("vencimento antecipado", "recuperação judicial", "liquidação do patrimônio separado", "waiver", "repactuação/prorrogação"))) + " ELSE 99 END"


@query(f"""
WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem),
d AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS nth, CASE WHEN l_orderkey % 3 > 0 THEN {_sql(DECISIONS, "l_partkey")} END AS e, {_sql(TOPICS, "l_suppkey")} AS topic, {_sql(EXCERPTS, "l_partkey")} AS excerpt FROM l),
p(prefix, label, votes) AS (VALUES ('vencimento_antecipado_declarado', 'vencimento antecipado declarado', false), ('vencimento_antecipado_nao_declarado', 'vencimento antecipado não declarado', false), ('recuperacao_judicial', 'recuperação judicial', true), ('liquidacao_patrimonio', 'liquidação do patrimônio separado', true), ('waiver', 'waiver', true), ('prorrogacao_repactuacao', 'repactuação/prorrogação', true)),
decided AS (SELECT l_orderkey, label || CASE WHEN votes AND regexp_matches(e, '^' || prefix || '_*aprovado') THEN ' (aprovado)' WHEN votes AND regexp_matches(e, '^' || prefix || '_*rejeitado') THEN ' (rejeitado)' ELSE '' END AS event, 'decisão' AS origin, nth FROM d JOIN p ON starts_with(e, prefix)),
settled AS (SELECT l_orderkey FROM decided UNION SELECT l_orderkey FROM d WHERE e NOT IN ('nao_instalada', 'assembleia_suspensa')),
told AS (SELECT l_orderkey, CASE topic WHEN 'waiver' THEN 'waiver' WHEN 'vencimento_antecipado' THEN 'vencimento antecipado' WHEN 'prorrogacao_repactuacao' THEN 'repactuação/prorrogação' WHEN 'inadimplencia_devedor' THEN CASE WHEN excerpt <> 'atraso da parcela' THEN 'recuperação judicial' END END AS event, 'texto' AS origin, nth FROM d WHERE l_orderkey NOT IN (SELECT l_orderkey FROM settled)),
u AS (SELECT l_orderkey, event, origin, min(nth) AS nth FROM (SELECT * FROM decided UNION ALL SELECT * FROM told) WHERE event IS NOT NULL GROUP BY ALL)
SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_rank("event")}, nth) AS place, event, origin FROM u""")
def grave_minutes(spark, sf_dir):
    """TXT-12: the grave events of minutes, what was decided before what is only discussed."""
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    minutes = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("l"))
    decisions = F.when(F.col("l_orderkey") % 3 > 0, F.transform("l", lambda x: _chosen(DECISIONS, x["l_partkey"])))
    topics = F.transform("l", lambda x: F.struct(_chosen(TOPICS, x["l_suppkey"]).alias("topic"), _chosen(EXCERPTS, x["l_partkey"]).alias("excerpt")))
    found = minutes.select("l_orderkey", portal.grave_events(decisions, topics).alias("g"))
    events = found.select("l_orderkey", F.posexplode("g.events").alias("at", "event"), F.col("g.origin").alias("origin"))
    return events.select("l_orderkey", (F.col("at") + 1).cast("long").alias("place"), "event", "origin")


@query(rf"""
WITH o AS (SELECT o_orderkey, lower({_sql(CELLS, "o_orderkey")}) AS x FROM orders), k AS (SELECT o_orderkey, x, regexp_replace(x, '\s+', ' ', 'g') AS c, trim(regexp_replace(regexp_replace(x, '\s+', ' ', 'g'), '[\d¹²³⁴⁵*]+$', '')) AS v FROM o)
SELECT o_orderkey, CASE WHEN regexp_matches(x, '^(desenquadrad|não atendido)|^descoberto$') THEN 'nao_atendido' WHEN regexp_matches(x, '^enquadrad') OR x IN ('atendido', 'coberto') THEN 'atendido' ELSE '' END AS bari,
 CASE WHEN v IN ('', '-') THEN '' WHEN v = 'enquadrado' THEN 'atendido' WHEN v IN ('desenquadrada', 'não enquadrado') THEN 'nao_atendido' WHEN v IN ('n/a', 'não se aplica') THEN 'nao_se_aplica' WHEN v IN ('não verificado', 'pendente', 'em apuração') THEN 'nao_verificado' ELSE 'outro' END AS vert,
 CASE WHEN c IN ('', '-') THEN '' WHEN c = 'n/a' THEN 'nao_se_aplica' WHEN split_part(c, ' ', 1) IN ('enquadrado', 'enquadrada') THEN 'atendido' WHEN split_part(c, ' ', 1) IN ('desenquadrado', 'desenquadrada') THEN 'nao_atendido' ELSE 'outro' END AS canal,
 CASE WHEN c IN ('', '-') THEN '' WHEN c = 'atendido' THEN 'atendido' WHEN c = 'não atendido' THEN 'nao_atendido' WHEN c = 'não verificado' THEN 'nao_verificado' WHEN c = 'não se aplica' THEN 'nao_se_aplica' ELSE 'outro' END AS opea FROM k""")
def grid_statuses(spark, sf_dir):
    """TXT-15: a status cell as each house reads it."""
    cell = _chosen(CELLS, F.col("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", *[portal.grid_status(cell, house).alias(house) for house in ("bari", "vert", "canal", "opea")])


def _category(x: str) -> str:
    tests = [("Termo de Securitização", "termo"), ("Aditamento", "aditamento"), ("Informe Mensal", "informe|mensal"), ("Ata/Edital", r"edital|\b(ata|ago/e|ago|age)\b"), ("Fato Relevante", "fato relevante"), ("Relatório Agente Fiduciário", "agente fiduciario"), ("Relatório de Rating", "rating"), ("Anúncio de Encerramento", "encerramento")]
    return _cases([(f"regexp_matches({x}, '{pattern}')", name) for name, pattern in tests], "'Outro'")


@query(rf"""
WITH o AS (SELECT o_orderkey, {_sql(CATEGORIES, "o_custkey")} AS c, {_sql(SORTS, "o_orderkey")} AS k, {_sql(SPECIES, "(o_orderkey // 6)")} AS s, {_sql(NAMES, "o_orderkey")} AS n FROM orders),
f AS (SELECT *, lower(strip_accents(c || ' ' || k || ' ' || s || ' ' || n)) AS x FROM o),
roles AS (SELECT o_orderkey, 1 AS place, 'type' AS role, lower(strip_accents(k)) AS x FROM o UNION ALL SELECT o_orderkey, 2, 'name', lower(strip_accents(n)) FROM o UNION ALL SELECT o_orderkey, 3, 'species', lower(strip_accents(s)) FROM o),
rules(nth, rule_id, category, verified, role, pattern) AS (VALUES (1, 'IM-01', 'Informe Mensal', true, 'tn', '\binforme\s+mensal\b'), (2, 'ATA-ESP-01', 'Ata/Edital', true, 's', '\bata\b'), (3, 'EDT-ESP-01', 'Ata/Edital', true, 's', '\bedital\b'), (4, 'ADT-01', 'Aditamento', false, 'tns', '\baditamento\b'), (5, 'TS-01', 'Termo de Securitização', false, 'tns', '\btermo\s+de\s+securitizacao\b'), (6, 'FR-01', 'Fato Relevante', false, 'tns', '\bfato\s+relevante\b'), (7, 'AF-01', 'Relatório Agente Fiduciário', false, 'tns', '\brelatorio\s+do\s+agente\s+fiduciario\b'), (8, 'RT-01', 'Relatório de Rating', false, 'tns', '\brelatorio\s+de\s+classificacao\s+de\s+risco\b'), (9, 'AE-01', 'Anúncio de Encerramento', false, 'tns', '\banuncio\s+de\s+encerramento\b')),
hits AS (SELECT o_orderkey, nth, rule_id, category, verified FROM roles JOIN rules ON contains(rules.role, substr(roles.role, 1, 1)) AND regexp_matches(x, pattern) AND NOT (rule_id = 'TS-01' AND contains(x, 'aditamento'))),
h AS (SELECT o_orderkey, count(DISTINCT category) FILTER (verified) AS few, arg_min(category, nth) FILTER (verified) AS one, arg_min(rule_id, nth) FILTER (verified) AS id, count(DISTINCT category) AS many, arg_min(category, nth) AS any_one FROM hits GROUP BY 1)
SELECT o_orderkey, CASE WHEN k LIKE 'Demonstra%' THEN 'Outro' ELSE {_category("x")} END AS category, CASE WHEN k NOT LIKE 'Demonstra%' AND few = 1 THEN one ELSE 'Outro' END AS strict, CASE WHEN k LIKE 'Demonstra%' THEN 'DF-VETO-01' WHEN few = 1 THEN id END AS rule_id, coalesce(k NOT LIKE 'Demonstra%' AND few > 1, false) AS ambiguous, CASE WHEN k NOT LIKE 'Demonstra%' AND many = 1 THEN any_one ELSE 'Outro' END AS wide
FROM f LEFT JOIN h USING (o_orderkey)""")
def filing_categories(spark, sf_dir):
    """TXT-01, TXT-02: the category of a filing by the ordered rules, by the strict ones, and by those not yet seen at work."""
    key = F.col("o_orderkey")
    category, kind, species, name = _chosen(CATEGORIES, F.col("o_custkey")), _chosen(SORTS, key), _chosen(SPECIES, F.floor(key / 6)), _chosen(NAMES, key)
    found = table(spark, sf_dir, "orders").select("o_orderkey", portal.filing_category(category, kind, species, name).alias("category"), portal.strict_filing_category(kind, species, name).alias("s"), portal.strict_filing_category(kind, species, name, True).alias("w"))
    return found.select("o_orderkey", "category", F.col("s.category").alias("strict"), "s.rule_id", "s.ambiguous", F.col("w.category").alias("wide"))


@query("""
WITH o AS (SELECT o_orderkey, o_custkey, 'R$ 1.' || lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') || ',' || lpad(CAST(o_custkey % 100 AS VARCHAR), 2, '0') AS a FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN 'Março/2024' ELSE '' END AS month, CASE WHEN o_custkey % 3 > 0 THEN a ELSE '' END AS credits, CASE WHEN o_orderkey % 5 > 0 THEN o_custkey % 3 + 1 ELSE 0 END AS series, CASE WHEN o_orderkey % 5 > 0 THEN a || '0919' END AS last_price,
 o_orderkey % 4 + o_custkey % 3 AS items, o_custkey % 3 AS not_adherent, CASE WHEN o_custkey % 4 > 0 THEN 100000 + 100 * (o_orderkey % 1000) + o_custkey % 100 + CASE WHEN o_custkey % 4 > 1 THEN 2050 ELSE 0 END END AS cents FROM o""")
def monthly_reports(spark, sf_dir):
    """SCAN-22: month, prices by series, credits, verdicts and balances by class of monthly reports."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    amount = F.concat(F.lit("R$ 1."), F.lpad((key % 1000).cast("string"), 3, "0"), F.lit(","), F.lpad((customer % 100).cast("string"), 2, "0"))
    prices = F.array_join(F.transform(F.sequence(F.lit(1), (customer % 3 + 1).cast("int")), lambda s: F.concat(s.cast("string"), F.lit("ª Série - 190ª Emissão: "), amount, F.lit("0919"))), "\n")
    head = F.when(key % 5 > 0, F.concat(F.lit("Relatório de Gestão - Março/2024\nSaldo do Valor Nominal Unitário\n"), prices)).otherwise("Outro relatório")
    credits = F.when(customer % 3 > 0, F.concat(F.lit("\nValor atualizado de todos os Créditos em 31/03\n\n  "), amount)).otherwise("\n9ª Série: fim")
    verdicts = F.concat(F.repeat(F.lit("Aderente\n"), (key % 4).cast("int")), F.repeat(F.lit("Não Aderente\n"), (customer % 3).cast("int")))
    balances = F.when(customer % 4 > 0, F.concat(F.lit("Sênior "), amount, F.when(customer % 4 > 1, " Mezanino R$ 20,50").otherwise(""))).otherwise("")
    texts = table(spark, sf_dir, "orders").select("o_orderkey", portal.management_report(F.concat(head, credits)).alias("m"), portal.follow_up_totals(F.concat(verdicts, balances)).alias("f"))
    return texts.select("o_orderkey", "m.month", "m.credits", F.size("m.unit_prices").cast("long").alias("series"), F.try_element_at("m.unit_prices.price", F.lit(-1)).alias("last_price"), "f.items", "f.not_adherent", (F.col("f.total") * 100).cast("long").alias("cents"))


@query(r"""
WITH p AS (SELECT page_id, 'https://a.b/public/storage/Arquivo/' || CAST(1700000000 + page_id % 7 AS VARCHAR) AS base, page_id % 3 AS k FROM pages)
SELECT page_id, 1700000000 + page_id % 7 AS uploaded, CASE k WHEN 0 THEN 'Março-Relatorio Mensal.pdf' ELSE 'Acompanhamento Mensal+' || CAST(page_id AS VARCHAR) || '.pdf' END AS name, CASE k WHEN 0 THEN 'gestao' ELSE 'acompanhamento' END AS kind FROM p WHERE k < 2""")
def report_links(spark, sf_dir):
    """SCAN-22: the monthly reports that a page links to, each once, with stamp, name and kind."""
    base = F.concat(F.lit('<a href="https://a.b/public/storage/Arquivo/'), (1700000000 + F.col("page_id") % 7).cast("string"))
    name = _chosen(("Mar%C3%A7o-Relatorio Mensal.pdf", "", "Termo.pdf"), F.col("page_id"))
    link = F.concat(base, F.when(name == "", F.concat(F.lit("Acompanhamento Mensal+"), F.col("page_id").cast("string"), F.lit(".pdf"))).otherwise(name), F.lit('">'))
    found = table(spark, sf_dir, "pages").select("page_id", F.explode(portal.report_links(F.concat(link, "html", link))).alias("x"))
    return found.select("page_id", "x.uploaded", "x.name", "x.kind")
