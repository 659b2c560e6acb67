"""Text rules over documents, pages and conversations (TXT-*, SCAN-22)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import fold
from ..operators import excerpts, minutes, term_texts, terms, text_rules
from ..sources.tables import parts, table
from .registry import query

CATEGORIES = [("table", r" \| "), ("shout", r"!! "), ("secret", r"(?i)token|password"), ("german", r"(^|\s)(und|der|die)(\s|$)"), ("french", r"(^|\s)(les|des|une)(\s|$)")]
CATEGORY_SQL = r"""CASE WHEN regexp_matches(text, ' \| ') THEN 'table' WHEN regexp_matches(text, '!! ') THEN 'shout' WHEN regexp_matches(text, '(?i)token|password') THEN 'secret' WHEN regexp_matches(text, '(^|\s)(und|der|die)(\s|$)') THEN 'german' WHEN regexp_matches(text, '(^|\s)(les|des|une)(\s|$)') THEN 'french' ELSE 'other' END"""


def _dealt(orders):
    """Orders dealt evenly over the tasks that write and read their texts: files have few splits, and a document's rows then need no other shuffle."""
    return orders.repartition(parts(orders, 100_000), "o_orderkey")


@query(f"SELECT doc_id, {CATEGORY_SQL} AS category FROM documents")
def category_rules(spark, sf_dir):
    """TXT-01: the first rule that is met."""
    return table(spark, sf_dir, "documents").select("doc_id", text_rules.first_category(F.col("text"), CATEGORIES).alias("category"))


@query(r"""
WITH f AS (SELECT doc_id, text, (regexp_matches(text, ' \| '))::INT AS a, (regexp_matches(text, '!! '))::INT AS b, (regexp_matches(text, '(?i)token|password'))::INT AS c, (regexp_matches(text, '(^|\s)(und|der|die)(\s|$)'))::INT AS d, (regexp_matches(text, '(^|\s)(les|des|une)(\s|$)'))::INT AS e FROM documents)
SELECT doc_id, CASE WHEN regexp_matches(text, '\$\$\$') THEN 'other' WHEN a + b + c + d + e > 1 THEN 'ambiguous' WHEN a = 1 THEN 'table' WHEN b = 1 THEN 'shout' WHEN c = 1 THEN 'secret' WHEN d = 1 THEN 'german' WHEN e = 1 THEN 'french' ELSE 'other' END AS category FROM f""")
def strict_categories(spark, sf_dir):
    """TXT-02: a veto, then exactly one category."""
    return table(spark, sf_dir, "documents").select("doc_id", text_rules.strict_category(F.col("text"), CATEGORIES, r"\$\$\$").alias("category"))


@query(f"SELECT lang, {CATEGORY_SQL} AS category, count(*) AS n FROM documents GROUP BY 1, 2")
def reclassification_preview(spark, sf_dir):
    """AGG-10: old category against new, counted."""
    return table(spark, sf_dir, "documents").groupBy("lang", text_rules.first_category(F.col("text"), CATEGORIES).alias("category")).agg(F.count("*").alias("n"))


@query("""SELECT doc_id, substr(text, greatest(1, strpos(text, 'token') - 80), least(strpos(text, 'token') - 1, 80) + 120) AS excerpt FROM documents WHERE strpos(text, 'token') > 0""")
def topic_excerpt(spark, sf_dir):
    """TXT-04: the text around a topic's first mention."""
    return table(spark, sf_dir, "documents").select("doc_id", text_rules.topic_excerpt(F.col("text"), "token").alias("excerpt")).where("excerpt is not null")


@query(r"""SELECT conv_id, turn, count(*) AS sentences FROM (SELECT conv_id, turn, unnest(string_split(text, E'\n')) AS s FROM conversations) WHERE regexp_matches(s, '(?i)(^|\s)(and|und|et|y)(\s|$)') GROUP BY 1, 2""")
def clause_lines(spark, sf_dir):
    """TXT-10: lines that hold a pattern, by turn."""
    turns = table(spark, sf_dir, "conversations").withColumn("k", F.struct("conv_id", "turn"))
    found = text_rules.clause_lines(turns, "k", "text", r"(?i)(^|\s)(and|und|et|y)(\s|$)")
    return found.groupBy("k.conv_id", "k.turn").agg(F.count("*").alias("sentences"))


@query(r"""
WITH c AS (SELECT doc_id, unnest(regexp_extract_all(text, '\d{1,3}(?:\.\d{1,3}){3}')) AS candidate, 2 AS strength FROM documents UNION ALL SELECT doc_id, unnest(regexp_extract_all(text, '\d{12,19}')), 1 FROM documents)
SELECT doc_id, candidate, CAST(max(strength) AS INTEGER) AS strength FROM c GROUP BY 1, 2""")
def term_candidates(spark, sf_dir):
    """TXT-07: candidates by pattern, the strongest kept."""
    return text_rules.term_candidates(table(spark, sf_dir, "documents"), "doc_id", "text", [(2, r"\d{1,3}(?:\.\d{1,3}){3}"), (1, r"\d{12,19}")])


@query(r"""SELECT doc_id, regexp_extract(text, '(?s)token.{0,20}?([0-9a-f]{16,})', 1) AS value FROM documents WHERE text LIKE '%token%'""")
def near_anchors(spark, sf_dir):
    """TXT-08: the value next to an anchor."""
    return table(spark, sf_dir, "documents").where(F.col("text").contains("token")).select("doc_id", text_rules.near_anchor(F.col("text"), "token", "[0-9a-f]{16,}", 20).alias("value"))


@query("""
WITH p AS (SELECT conv_id, turn FROM conversations WHERE role = 'assistant' AND text LIKE '%a%'), e AS (SELECT conv_id, max(turn) - 3 AS expected FROM conversations GROUP BY 1)
SELECT e.conv_id, coalesce(bool_or(abs(turn - expected) <= 1), false) AS found FROM e LEFT JOIN p ON p.conv_id = e.conv_id GROUP BY 1""")
def near_page_recall(spark, sf_dir):
    """TXT-11: whether any page found lies within a tolerance of the expected one."""
    turns = table(spark, sf_dir, "conversations")
    hit = (F.col("role") == "assistant") & F.col("text").contains("a")
    pages = turns.groupBy("conv_id").agg(F.collect_list(F.when(hit, F.col("turn"))).alias("p"), (F.max("turn") - 3).alias("expected"))
    return pages.select("conv_id", text_rules.page_recall(F.col("p"), F.col("expected"), 1).alias("found"))


@query(r"""SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title, len(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS links FROM pages""")
def html_links(spark, sf_dir):
    """SCAN-12, SCAN-22: titles and links of pages."""
    links = F.regexp_extract_all("html", F.lit(r'<a [^>]*href="([^"]*)"'))
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title"), F.size(links).cast("long").alias("links"))


@query("""
WITH o AS (SELECT o_orderkey AS doc_id, o_orderkey % 6 AS k, o_orderkey % 90 + 1 AS n FROM orders)
SELECT doc_id, CASE k WHEN 0 THEN 'divida_liquida_ebitda' WHEN 1 THEN 'razao_garantia' WHEN 2 THEN 'ltv' WHEN 3 THEN 'liquidez_corrente' ELSE 'ebitda_despesa_financeira' END AS item, CASE WHEN k = 4 THEN 'sem_limite' ELSE 'com_limite' END AS status,
 CASE k WHEN 0 THEN '<=' WHEN 1 THEN '>=' WHEN 2 THEN '<=' WHEN 3 THEN '>' END AS operator, CASE WHEN k <> 4 THEN CAST(n AS DOUBLE) + CASE WHEN k = 0 THEN 0.5 ELSE 0 END END AS "limit", CASE k WHEN 0 THEN 'x' WHEN 1 THEN '%' WHEN 2 THEN '%' WHEN 3 THEN 'x' END AS unit, CASE k WHEN 0 THEN 'trimestralmente' WHEN 1 THEN 'mensal' ELSE '' END AS period, CASE WHEN k = 1 THEN 2 ELSE 1 END AS page FROM o WHERE k < 5""")
def covenant_limits(spark, sf_dir):
    """TXT-06: covenants with operator, limit, unit and period; a denied comparison turns round."""
    k, n = F.col("o_orderkey") % 6, (F.col("o_orderkey") % 90 + 1).cast("string")
    first = (
        F.when(k == 0, F.concat(F.lit("A Devedora manterá. A Dívida Líquida / EBITDA, apurada trimestralmente, não poderá ser superior a "), n, F.lit(",5x. Outras regras.")))
        .when(k == 1, "A Razão de Garantia será verificada. Texto solto.")
        .when(k == 2, F.concat(F.lit("O LTV terá máximo de "), n, F.lit("%; e\nmais")))
        .when(k == 3, F.concat(F.lit("Índice de Liquidez Corrente superior a "), n, F.lit(" vezes.")))
        .when(k == 4, "EBITDA / Despesas Financeiras será informado.")
        .otherwise("Nada consta.")
    )
    second = F.when(k == 1, F.concat(F.lit("Mensal: a Razão Mínima de Garantia deve ser igual ou superior a "), n, F.lit("% do saldo."))).otherwise("Fim.")
    page = F.inline(F.array(F.struct(F.lit(1).alias("page"), first.alias("text")), F.struct(F.lit(2).alias("page"), second.alias("text"))))
    orders = _dealt(table(spark, sf_dir, "orders").select("o_orderkey"))
    return text_rules.covenant_terms(orders.select(F.col("o_orderkey").alias("doc_id"), page))


@query("""
WITH o AS (SELECT o_orderkey AS doc_id, o_orderkey % 5 AS k, o_custkey % 100 AS n FROM orders)
SELECT doc_id, 'fianca' AS item, CASE k WHEN 0 THEN 'presente' WHEN 1 THEN 'citada' ELSE 'negada' END AS status, CASE WHEN k = 0 THEN n || ',00%' ELSE '' END AS amounts, 1 AS page FROM o WHERE k < 3
UNION ALL SELECT doc_id, 'coobrigacao', 'negada', '', 2 FROM o WHERE k <> 4 UNION ALL SELECT doc_id, 'alienacao_fiduciaria_imovel', 'citada', 'R$ 1.250,00; ' || n % 90 || '%', 2 FROM o WHERE k = 3""")
def guarantee_statuses(spark, sf_dir):
    """TXT-06: guarantees that a contract has, cites or denies; lists of the trustee's other issues are not read."""
    k, n = F.col("o_orderkey") % 5, (F.col("o_custkey") % 100).cast("string")
    first = (
        F.when(k == 0, F.concat(F.lit("A Fiança dos sócios da Devedora, solidária e irrevogável, garante "), n, F.lit(",00% do saldo, e a Fiança dos avalistas garante o restante.")))
        .when(k == 1, "A Fiança será prestada pelos sócios da Devedora em caráter solidário e irrevogável até o fim. Não haverá outra Fiança na Emissão.")
        .when(k == 2, "Os títulos não contam com Fiança.")
        .when(k == 4, "Emissão: 316 Adimplente Garantias: Fiança, Penhor\nEmissão: 317 Inadimplente Garantias: Hipoteca, Aval. Não há coobrigação.")
        .otherwise("Sem mais.")
    )
    second = F.when(k == 3, F.concat(F.lit("A Alienação Fiduciária de Imóvel de R$ 1.250,00 responde por "), n.cast("long") % 90, F.lit("% das obrigações garantidas da Devedora. (xxiv) Coobrigação da Emissora. Não há."))).when(k != 4, "(xxiv) Coobrigação da Emissora. Não há. Outras regras desta cláusula valem para todos os títulos.").otherwise("fim")
    texts = F.posexplode(F.array(first, second)).alias("page", "text")
    pages = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), texts).withColumn("page", F.col("page") + 1)
    return text_rules.guarantee_terms(pages).drop("sentence")


@query("""
WITH p AS (SELECT o_orderkey AS doc_id, unnest(range(1, 7)) AS page, o_orderkey % 3 AS k FROM orders)
SELECT doc_id, page, page = 1 AS is_toc, page = 2 AND k = 0 AS is_glossary, page >= 5 AND k < 2 AS is_annex FROM p""")
def contract_pages(spark, sf_dir):
    """TXT-09: tables of contents, glossaries and annexes of contracts."""
    k = F.col("o_orderkey") % 3
    toc = "\n".join(f"{i}. Cláusula ........ {i}" for i in range(1, 7))
    terms = "\n".join(f"“Termo {i}”   significa a coisa {i}" for i in range(5))
    texts = F.array(F.lit(toc), F.when(k == 0, terms).otherwise("“Termo” significa pouco"), F.lit("ANEXO I\ncedo demais"), F.lit("corpo"), F.when(k < 2, "ANEXO II\nFluxo").otherwise("corpo"), F.lit("fim"))
    pages = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.posexplode(texts).alias("at", "text"))
    return text_rules.page_kinds(pages.select("doc_id", (F.col("at") + 1).alias("page"), "text"))


@query("""
WITH o AS (SELECT o_orderkey AS doc_id, o_orderkey % 3 AS k FROM orders), r AS (SELECT doc_id, k, unnest([1, 2, 3, 4]) AS n FROM o)
SELECT doc_id, n, CASE n WHEN 1 THEN 'clause' WHEN 2 THEN CASE WHEN k = 0 THEN 'definition' ELSE 'body' END WHEN 3 THEN CASE WHEN k = 1 THEN 'annex' ELSE 'clause' END ELSE 'toc' END AS kind, CASE WHEN n < 3 THEN 'CLÁUSULA 1 - Objeto' WHEN k = 1 THEN 'ANEXO I' ELSE '2.1 Prazo' END AS clause FROM r""")
def contract_lines(spark, sf_dir):
    """TXT-09: the kind of each line of a contract and the clause that it lies in."""
    k = F.col("o_orderkey") % 3
    text = F.concat(F.lit("CLÁUSULA 1 - Objeto\n"), F.when(k == 0, "“Agente”: o agente").otherwise("o agente"), F.lit("\n"), F.when(k == 1, "ANEXO I").otherwise("2.1 Prazo"), F.lit("\nfim ........ 12"))
    found = text_rules.contract_sections(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), text.alias("text")))
    return found.select("doc_id", (F.col("line") + 1).alias("n"), "kind", "clause")


@query("""
WITH o AS (SELECT o_orderkey AS doc_id, o_orderkey % 4 AS k FROM orders)
SELECT doc_id, CASE k WHEN 0 THEN 'approved, rejected' WHEN 1 THEN 'suspended' WHEN 2 THEN 'no_quorum' ELSE '' END AS outcomes FROM o""")
def minute_decisions(spark, sf_dir):
    """TXT-05, in part: outcomes by sentence, the negated verb before the plain one."""
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, "Foi aprovada a emissão. Não foi aprovado o aditamento.").when(k == 1, "A assembleia foi suspensa.").when(k == 2, "Por falta de quórum, encerrou-se.").otherwise("Nada mais havendo.")
    found = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), fold(text).alias("t"))
    return found.select("doc_id", F.array_join(F.transform(text_rules.decisions(F.col("t")), lambda x: x["outcome"]), ", ").alias("outcomes"))


#: Decisions of made minutes with the status and the events that they have.
DECISIONS = [
    ("Os Titulares dos CRA presentes, representativos de 73,87% dos CRA em Circulação aprovam a concessão do Waiver, nenhum dos Titulares se abstiveram e nenhum dos Titulares dos CRA presentes rejeitaram. Os Titulares aprovaram a não declaração do vencimento antecipado do CDCA e, consequentemente, a não realização do resgate antecipado dos CRA.", "aprovada", "waiver_aprovado,vencimento_antecipado_nao_declarado"),
    ("Caso aprovado o item (i), a Securitizadora fica autorizada. Os Titulares não aprovaram a declaração do vencimento antecipado das CPR-F.", "rejeitada", "vencimento_antecipado_nao_declarado"),
    ("OsTitularesdosCRArepresentando80%dosCRAemCirculacaoaprovaramadecretacaodoVencimentoAntecipadodasCPR-F.", "aprovada", "vencimento_antecipado_declarado"),
    ("Os Titulares aprovaram a prorrogação da data de vencimento. Os Titulares rejeitaram a substituição do agente fiduciário.", "mista", "prorrogacao_repactuacao_aprovado,troca_prestador_rejeitado"),
    ("Os Titulares, por unanimidade, decidiram por aprovar todas as matérias constantes na Ordem do Dia.", "aprovada", "vencimento_antecipado_nao_declarado_em_bloco,waiver_aprovado_em_bloco"),
    ("Os Titulares deliberaram por suspender a votação dos itens da ordem do dia com reabertura marcada para 24/03.", "suspensa", "assembleia_suspensa"),
    ("Em vista da ausência do quórum mínimo para deliberação das matérias, a Securitizadora observará os trâmites.", "sem_quorum_para_deliberar", "sem_quorum_para_deliberar"),
    ("O Titular dos CRA detentor de 100% dos CRA em Circulação manifestou a abstenção ao direito de voto sobre a totalidade das matérias.", "abstencao", "titulares_se_abstiveram"),
    ("Os Titulares aprovaram a realização de aporte de recursos pelos Titulares dos CRA.", "aprovada", "aporte_titulares_aprovado"),
    ("Os Titulares discutiram as matérias e pediram novas informações à Devedora.", "sem_decisao_identificada", ""),
]
_CASES = ", ".join(f"({n}, '{status}', '{events}')" for n, (_, status, events) in enumerate(DECISIONS))


@query(f"SELECT doc_id, 'ata' AS kind, c.status AS status, c.events AS events, length(c.events) > 0 AS has_excerpts FROM documents, (VALUES {_CASES}) c(n, status, events) WHERE doc_id % {len(DECISIONS)} = c.n")
def assembly_decisions(spark, sf_dir):
    """TXT-05: minutes whose header and closing hold the whole text of a document; only the decision section counts."""
    head = "ATA DA ASSEMBLEIA ESPECIAL DE TITULARES DOS CRA DA 190ª EMISSÃO\n4. PRESENÇA: Titulares dos CRA representando 73%.\n"
    agenda = "\n5. ORDEM DO DIA: Deliberar sobre: (i) Aprovar a concessão de waiver prévio; (ii) Aprovar a não declaração do vencimento antecipado do CDCA.\n6. DELIBERAÇÕES: "
    closing = "\n7. DISPOSIÇÕES FINAIS: autorização para que sejam celebrados instrumentos relacionados à matéria aqui aprovada.\n"
    own = F.coalesce("text", F.lit(""))
    decision = F.get(F.array(*[F.lit(d) for d, _, _ in DECISIONS]), (F.col("doc_id") % len(DECISIONS)).cast("int"))
    text = F.concat(F.lit(head), own, F.lit(agenda), decision, F.lit(closing), own)
    found = minutes.assembly_outcomes(table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", text.alias("minutes")), "minutes")
    event = F.transform("decisions", lambda d: d["event"])
    shown = F.forall("decisions", lambda d: F.length(d["excerpt"]) > 40) & (F.size("decisions") > 0)
    return found.select("doc_id", "kind", "status", F.array_join(event, ",").alias("events"), shown.alias("has_excerpts"))


@query("""
WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, max(CAST(l_shipdate AS DATE)) AS due, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS paid, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2),
o AS (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS day, o_custkey AS c FROM orders WHERE o_orderkey IN (SELECT k FROM l)),
t AS (SELECT k, sum(paid) AS paid, CAST(sum(q) AS BIGINT) AS q, max(CASE WHEN n % 2 = 1 THEN 1 ELSE 0 END) = 1 AS odd, arg_min(paid, n) AS p1, arg_min(q, n) AS q1, list(paid) AS each, list(q) AS qs FROM l GROUP BY 1),
d AS (SELECT k, list(DISTINCT due) FILTER (WHERE n % 2 = 1) AS own, list(DISTINCT due) FILTER (WHERE n = 2 AND k % 4 = 0) AS backing FROM l GROUP BY 1)
SELECT k AS asset, 'emissao' AS field, 'sem_dado_cvm' AS outcome, '' AS market FROM o WHERE k % 11 = 0
UNION ALL SELECT k, 'data_emissao', CASE WHEN k % 5 = 0 THEN 'sem_valor_no_termo' WHEN k % 3 = 0 THEN 'diverge' ELSE 'concorda' END, CAST(day AS VARCHAR) FROM o WHERE k % 11 > 0
UNION ALL SELECT l.k, 'vencimento S' || n, CASE WHEN own IS NOT NULL AND list_contains(own, due) THEN 'concorda' WHEN backing IS NOT NULL AND list_contains(backing, due) THEN 'informe_usa_data_do_lastro' WHEN own IS NULL AND backing IS NULL THEN 'sem_valor_no_termo' ELSE 'diverge' END, CAST(due AS VARCHAR) FROM l JOIN d USING (k) WHERE l.k % 11 > 0
UNION ALL SELECT t.k, 'valor_total', CASE WHEN t.k % 3 = 1 OR len(list_filter(each, lambda x: abs(paid * 1.2 - x) <= x * 0.01)) > 0 THEN 'concorda' ELSE 'diverge' END, CAST(paid AS VARCHAR) FROM t WHERE t.k % 11 > 0
UNION ALL SELECT t.k, 'quantidade', CASE WHEN t.k % 2 = 1 OR len(list_filter(qs, lambda x: x <> q + 1)) = 0 THEN 'concorda' ELSE 'diverge' END, CAST(q AS VARCHAR) FROM t WHERE t.k % 11 > 0
UNION ALL SELECT o.k, 'devedor', CASE WHEN o.k % 6 > 3 THEN 'sem_valor_no_termo' WHEN o.k % 6 = 3 THEN 'diverge' ELSE 'concorda' END, CAST(c AS VARCHAR) FROM o WHERE o.k % 11 > 0 AND o.k % 7 > 0
UNION ALL SELECT l.k, 'remuneracao S' || n, CASE WHEN l.k % 2 = 0 THEN 'sem_valor_no_termo' WHEN n = 1 THEN 'concorda' ELSE 'diverge' END, 'r' || n FROM l WHERE l.k % 11 > 0 AND n <> 2""")
def terms_against_market(spark, sf_dir):
    """RULE-17: candidates of terms and amendments against the market's series, a verdict for each field."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("asset"), F.col("l_linenumber").alias("n")).agg(F.max(F.to_date("l_shipdate")).cast("string").alias("due"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("paid_in"), F.sum("l_quantity").cast("decimal(18,0)").alias("quantity"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("asset"), F.to_date("o_orderdate").alias("day"), F.col("o_custkey").cast("string").alias("debtor")).join(lines.select("asset").distinct(), "asset")
    k = F.col("asset")
    totals = lines.groupBy("asset").agg(F.sum("paid_in").alias("paid"), F.sum("quantity").alias("q"))
    made = orders.join(totals, "asset")
    one = lambda field, value, rank=0, strength=0, page=1: F.struct(F.lit(field).alias("field"), value.cast("string").alias("value"), F.lit(rank).alias("doc_rank"), F.lit(strength).alias("strength"), F.lit(page).alias("page"))
    some = F.array(
        F.when(k % 5 > 0, one("data_emissao", F.date_add("day", F.when(k % 3 == 0, 1).otherwise(0)), page=2)),
        F.when(k % 5 > 0, one("data_emissao", F.lit("1900-01-01"), page=5)),
        F.when(k % 5 > 0, one("data_emissao", F.lit("1900-01-02"), rank=1)),
        one("valor_total", F.col("paid") * F.when(k % 3 == 1, F.lit("1.005")).otherwise(F.lit("1.2")).cast("decimal(4,3)"), rank=1),
        one("valor_total", F.lit("1"), rank=1, strength=1),
        one("quantidade", F.col("q") + F.when(k % 2 == 1, 0).otherwise(1)),
        F.when(k % 2 == 1, one("remuneracao", F.lit("taxa=5"))),
        F.when(k % 6 < 4, one("devedor", F.when(k % 6 == 3, "x").otherwise(F.col("debtor")))),
    )
    due = lambda field, strength=0: F.struct(F.lit(field).alias("field"), F.col("due").alias("value"), F.lit(0).alias("doc_rank"), F.lit(strength).alias("strength"), F.lit(3).alias("page"))
    odd = F.col("n") % 2 == 1
    found = made.select("asset", F.inline(F.array_compact(some))).unionByName(lines.select("asset", F.inline(F.array_compact(F.array(F.when(odd, due("data_vencimento")), F.when(odd, due("data_vencimento", 1)), F.when((F.col("n") == 2) & (k % 4 == 0), due("data_vencimento_lastro")))))))
    candidates = found.withColumn("doc", F.concat(F.when(F.col("doc_rank") == 0, "T").otherwise("A"), k.cast("string")))
    rates = F.when(F.col("n") == 1, F.array(F.lit("mult=100"), F.lit("taxa=5"))).when(F.col("n") == 2, F.array(F.lit("mult=100"))).otherwise(F.array(F.lit("taxa=6")))
    series = lines.join(orders, "asset").where(k % 11 > 0).select("asset", F.col("day").cast("string").alias("issued"), F.concat(F.lit("S"), "n").alias("series"), "due", "paid_in", "quantity", F.concat(F.lit("r"), "n").alias("rate"), rates.alias("rate_numbers"))
    return terms.term_verdicts(candidates, series, orders.where(k % 7 > 0).select("asset", "debtor")).select("asset", "field", "outcome", "market")


#: Conversations as contracts: turns are pages, an assistant's second turn defines, some third turns hold a labelled item, some have an annex.
PAGES_SQL = r"""
p AS (SELECT conv_id // 4 AS asset, conv_id AS doc, turn + 1 AS page, CASE WHEN turn % 3 = 1 THEN '“' || role || '”: o papel' || chr(10) || text WHEN turn % 3 = 2 AND conv_id % 2 = 0 THEN '(iv) Do and: prazo' || chr(10) || text WHEN turn = 5 AND conv_id % 5 = 0 THEN 'ANEXO II' || chr(10) || text ELSE text END AS text FROM conversations),
a AS (SELECT *, page >= 6 AND doc % 10 = 5 AND bool_or(page = 6) OVER (PARTITION BY doc) AS is_annex FROM p),
h AS (SELECT *, len(regexp_extract_all(text, 'assistant|\band\b')) AS n, starts_with(text, '“assistant”: ') AS defines, starts_with(text, '(iv) Do and: ') AS label FROM a),
k AS (SELECT * FROM h WHERE n > 0),
d AS (SELECT * FROM k WHERE defines QUALIFY row_number() OVER (PARTITION BY asset ORDER BY is_annex, doc DESC, page) = 1),
r AS (SELECT k.* FROM k LEFT JOIN d ON k.asset = d.asset AND k.doc = d.doc AND k.page = d.page WHERE d.asset IS NULL),
c AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY asset ORDER BY is_annex, NOT label, n DESC, doc DESC, page) = 1),
s AS (SELECT c.asset, any_value(c.doc) AS doc, any_value(c.page) AS page, any_value(c.is_annex) AS is_annex, list(r.page) AS ps FROM c JOIN r ON r.asset = c.asset AND r.doc = c.doc AND r.is_annex = c.is_annex GROUP BY 1),
u AS (SELECT *, len(list_filter([1, 2, 3, 4, 5], lambda x: len(list_filter(ps, lambda y: y BETWEEN page - x AND page - 1)) = x)) AS b, len(list_filter([1, 2, 3, 4, 5], lambda x: len(list_filter(ps, lambda y: y BETWEEN page + 1 AND page + x)) = x)) AS f FROM s),
o AS (SELECT asset, 'definicao' AS kind, doc, page, is_annex, page AS first_page, page AS last_page FROM d
 UNION ALL SELECT asset, 'clausula', doc, page, is_annex, page - least(b, greatest(3, 5 - f)), page + least(f, 5 - least(b, greatest(3, 5 - f))) FROM u)"""


def _contract_hits(spark, sf_dir):
    turn, text = F.col("turn"), F.col("text")
    text = (
        F.when(turn % 3 == 1, F.concat(F.lit("“"), "role", F.lit("”: o papel\n"), text))
        .when((turn % 3 == 2) & (F.col("conv_id") % 2 == 0), F.concat(F.lit("(iv) Do and: prazo\n"), text))
        .when((turn == 5) & (F.col("conv_id") % 5 == 0), F.concat(F.lit("ANEXO II\n"), text))
        .otherwise(text)
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    turns = turns.repartition(parts(turns, 20_000), "conv_id")
    pages = turns.select(F.expr("conv_id div 4").alias("asset"), F.col("conv_id").alias("doc"), F.col("conv_id").alias("doc_rank"), (turn + 1).alias("page"), F.lit(False).alias("ocr"), text.alias("text"))
    return excerpts.page_hits(pages, {"agente": ["assistant", r"\band\b"]})


@query(f"WITH {PAGES_SQL} SELECT asset, kind, doc, page, first_page, last_page FROM o")
def field_excerpts(spark, sf_dir):
    """TXT-09: the definition and the clause of a field, chosen among all pages of an asset's contracts."""
    return excerpts.chosen_excerpts(_contract_hits(spark, sf_dir)).select("asset", "kind", "doc", "page", "first_page", "last_page")


@query(f"""WITH {PAGES_SQL}, b AS (SELECT asset, bool_or(NOT is_annex) AS has_body FROM o GROUP BY 1),
e AS (SELECT k.asset, CASE WHEN k.is_annex AND has_body THEN 'anexo' ELSE 'outra' END AS kind, k.doc, k.page, (SELECT count(*) FROM k t WHERE t.asset = k.asset) AS pages FROM k LEFT JOIN b ON b.asset = k.asset WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.asset = k.asset AND o.doc = k.doc AND k.page BETWEEN o.first_page AND o.last_page))
SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY asset, kind ORDER BY doc, page) <= 8""")
def field_references(spark, sf_dir):
    """TXT-09: the first eight other pages that name the field, those of annexes apart."""
    hits = _contract_hits(spark, sf_dir)
    return excerpts.other_references(hits, excerpts.chosen_excerpts(hits)).drop("field")


@query(r"""
WITH o AS (SELECT o_custkey AS asset, o_orderkey AS doc, o_orderkey % 3 AS k, strftime(o_orderdate, '%Y-%m-%d') AS issued, strftime(o_orderdate + INTERVAL 900 DAY, '%Y-%m-%d') AS due, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS total, CAST(o_custkey + 1000 AS VARCHAR) AS n FROM orders)
SELECT asset, doc, 'data_emissao' AS field, 0 AS strength, 1 AS page, issued AS value FROM o UNION ALL SELECT asset, doc, 'valor_total', 0, 1, total FROM o
UNION ALL SELECT asset, doc, 'quantidade', CASE WHEN k = 2 THEN 1 ELSE 0 END, 1, n FROM o
UNION ALL SELECT asset, doc, CASE WHEN k = 0 THEN 'data_vencimento_lastro' ELSE 'data_vencimento' END, CASE WHEN k = 1 THEN 1 ELSE 0 END, 2, due FROM o
UNION ALL SELECT asset, doc, 'remuneracao', 0, 2, 'taxa=' || (doc % 20 + 1) FROM o UNION ALL SELECT asset, doc, 'remuneracao', 0, 2, 'mult=' || (asset % 50 + 60) FROM o WHERE k = 1
UNION ALL SELECT asset, doc, 'devedor', 0, 1, CASE WHEN doc % 2 = 0 THEN '11222333000181' ELSE '01486546000167' END FROM o WHERE doc % 5 <> 0""")
def term_value_candidates(spark, sf_dir):
    """TXT-07, TXT-08: what a term says of its dates, amounts, rates and debtors, read from its pages."""
    k, text = F.col("o_orderkey") % 3, lambda *x: F.concat(*[F.lit(c) if isinstance(c, str) else c for c in x])
    day = lambda c: F.date_format(c, "dd/MM/yyyy")
    due = F.col("o_orderdate") + F.expr("interval 900 days")
    first = text(
        "1.1 A Data de\nEmissão dos CRA é ", day(F.col("o_orderdate")), ". 1.2 O valor total da  Emissão é de R$ ", F.translate(F.format_number("o_totalprice", 2), ",.", ".,"), " (reais).\n1.3 ",
        F.when(k == 2, "São ").otherwise("Serão emitidos "), (F.col("o_custkey") + 1000).cast("string"), " (mil e tantos) CRA. “Devedora”: a sociedade com sede",
    )
    number = F.when(F.col("o_orderkey") % 5 == 0, "11.222.333/0001-82").when(F.col("o_orderkey") % 2 == 0, "11.222.333/0001-81").otherwise("01.486.546/0001-67")
    second = text(
        "na cidade, CNPJ ", number, ". ", F.when(k == 0, text("Com lastro em debêntures, vencendo, portanto, em ", day(due))).when(k == 1, text("Data de Vencimento dos CRA, qual seja, ", day(due))).otherwise(text("os CRA, vencendo em ", day(due))),
        ". Os juros remuneratórios são de ", F.when(k == 1, text((F.col("o_custkey") % 50 + 60).cast("string"), "% da Taxa DI e sobretaxa de ")).otherwise(""), (F.col("o_orderkey") % 20 + 1).cast("string"), "% ao ano.",
    )
    orders = _dealt(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"))
    pages = orders.select(F.col("o_custkey").alias("asset"), F.col("o_orderkey").alias("doc"), F.lit(0).alias("doc_rank"), F.posexplode(F.array(first, second)).alias("page", "text")).withColumn("page", F.col("page") + 1)
    return term_texts.term_candidates(pages).drop("doc_rank")
