"""Decision rules on the benchmark tables (RULE-*, MATCH-*, PROJ-02, EAV-02, EAV-04, EAV-07, UPS-05, AGG-23, AGG-24, SCAN-16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import observations, proposals, text_rules, versions
from ..sources.tables import table
from .registry import query
from .texts import CATEGORIES, CATEGORY_SQL


@query("""SELECT o_orderkey, o_totalprice - 50000 > 0 AND CAST(o_orderdate AS DATE) + 900 >= DATE '1998-06-01' AND (1998 * 12 + 6) - (year(o_orderdate) * 12 + month(o_orderdate)) >= 2 AS stale FROM orders""")
def stale_filings(spark, sf_dir):
    """RULE-02."""
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", proposals.stale_filing(day, F.lit("1998-06-01").cast("date"), F.col("o_totalprice") - 50000, F.date_add(day, 900)).alias("stale"))


STATEMENTS_SQL = """s AS (SELECT o_custkey AS k, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS reference, o_orderkey AS version, o_orderkey % 5 AS op, CAST(o_orderdate AS DATE) + 20 AS delivered FROM orders)"""


def _statements(spark, sf_dir):
    op = F.col("o_orderkey") % 5
    opinion = F.when(op == 0, "Sem Ressalva").when(op == 1, "Opinião com ressalva ").when(op == 2, "Adversa").when(op == 3, "Abstenção de opinião parcial").otherwise("n/d")
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("reference"), F.col("o_orderkey").alias("version"), opinion.alias("opinion"), F.date_add(F.to_date("o_orderdate"), 20).alias("delivered"))


@query(f"""
WITH {STATEMENTS_SQL}, b AS (SELECT k, reference, arg_max(op, version) AS op, arg_max(delivered, version) AS delivered FROM s GROUP BY 1, 2),
v AS (SELECT *, CASE op WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 3 END AS sev FROM b), w AS (SELECT *, row_number() OVER x AS nth, lead(sev) OVER x AS before FROM v WINDOW x AS (PARTITION BY k ORDER BY reference DESC))
SELECT k, concat_ws('; ', CASE WHEN sev = 2 THEN 'df_com_ressalva' END, CASE WHEN sev = 3 THEN 'df_abstencao_ou_adversa' END, CASE WHEN sev > before THEN 'opiniao_piorou' END, CASE WHEN datediff('day', reference, delivered) > 90 THEN 'df_entregue_apos_prazo' END) AS signals FROM w WHERE nth = 1""")
def statement_signals(spark, sf_dir):
    """RULE-11: the newest statement's opinion, whether it worsened, and late delivery."""
    return proposals.statement_signals(_statements(spark, sf_dir), "k").select("k", F.array_join("signals", "; ").alias("signals"))


@query(f"""
WITH {STATEMENTS_SQL} SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0 AND DATE '1992-01-01' + CAST(c_custkey % 3000 AS INTEGER) <= DATE '2000-12-01' AND NOT EXISTS (SELECT 1 FROM s WHERE s.k = c_custkey AND date_trunc('month', reference) >= DATE '2000-12-01')""")
def no_recent_statement(spark, sf_dir):
    """RULE-12: live emissions without a statement in fifteen months."""
    live = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("balance"), F.date_add(F.lit("1992-01-01").cast("date"), (F.col("c_custkey") % 3000).cast("int")).alias("issued"))
    return proposals.without_recent(live, _statements(spark, sf_dir), "k", F.lit("2002-03-15").cast("date")).select("k")


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey < max(o_orderkey) OVER (PARTITION BY o_custkey, date_trunc('quarter', o_orderdate)) THEN 'nao_usar_substituida' WHEN o_orderstatus = 'F' THEN 'aprovar' ELSE 'decidir' END AS action FROM orders""")
def report_proposals(spark, sf_dir):
    """RULE-20: approve, decide or superseded."""
    orders = table(spark, sf_dir, "orders").withColumn("month", F.date_trunc("quarter", "o_orderdate"))
    status = F.when(F.col("o_orderstatus") == "F", "valid").otherwise("warning")
    return proposals.review_proposals(orders, ["o_custkey"], F.col("month"), F.col("o_orderkey"), status).select("o_orderkey", "action")


@query("""
WITH g AS (SELECT l_orderkey, list(DISTINCT CASE WHEN l_returnflag = 'R' THEN 'Em atraso' ELSE 'Adimplente' END) AS s, max(CASE WHEN l_linenumber > 1 THEN CASE WHEN l_tax < 0.04 THEN 0 ELSE l_tax END END) AS a FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN list_contains(s, 'Em atraso') AND coalesce(a, 0) = 0 THEN 'late_without_amounts' WHEN len(s) = 1 AND list_contains(s, 'Adimplente') AND coalesce(a, 0) <> 0 THEN 'amounts_without_late' END AS finding FROM g""")
def delinquency_status(spark, sf_dir):
    """RULE-06: a status against the amounts that should go with it."""
    late = F.when(F.col("l_returnflag") == "R", proposals.LATE).otherwise(proposals.IN_TIME)
    amount = F.when(F.col("l_linenumber") > 1, F.when(F.col("l_tax") < 0.04, 0.0).otherwise(F.col("l_tax")))
    found = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(late).alias("s"), F.collect_set(amount).alias("a"))
    return found.select("l_orderkey", proposals.status_against_delinquency(F.col("s"), F.col("a")).alias("finding"))


@query("""
WITH g AS (SELECT l_orderkey, max(CASE WHEN l_tax > 0.07 THEN 2 WHEN l_tax > 0.05 THEN 1 ELSE 0 END) AS v, max(CASE WHEN l_discount > 0.09 THEN 2 WHEN l_discount > 0.08 THEN 1 ELSE 0 END) AS f, CASE WHEN l_orderkey % 11 = 0 THEN 'XML_TOO_LARGE' END AS code FROM lineitem GROUP BY 1)
SELECT l_orderkey, CASE WHEN code IS NOT NULL THEN 'failed' WHEN greatest(v, f) = 2 THEN 'invalid' WHEN greatest(v, f) = 1 THEN 'warning' ELSE 'valid' END AS status, code FROM g""")
def validation_statuses(spark, sf_dir):
    """RULE-21: by the worst value or finding; a refused run keeps its code."""
    kind = lambda c, bad, warn: F.when(F.col(c) > bad, "invalid").when(F.col(c) > warn, "warning").otherwise("valid")
    found = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(kind("l_tax", 0.07, 0.05)).alias("v"), F.collect_set(kind("l_discount", 0.09, 0.08)).alias("f"))
    code = F.when(F.col("l_orderkey") % 11 == 0, "XML_TOO_LARGE")
    return found.select("l_orderkey", proposals.validation_status(F.col("v"), F.col("f"), code).alias("r")).select("l_orderkey", "r.*")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS code, p_name AS name, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE '' END AS size, '' AS rate FROM part""")
def export_columns(spark, sf_dir):
    """PROJ-02: a fixed list of columns with a default; the identity's own code wins over a field of that name."""
    fields = F.map_from_arrays(F.array(F.lit("name"), F.lit("code"), F.lit("size")), F.array(F.col("p_name"), F.lit("other"), F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string"))))
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("code"), fields.alias("fields"))
    return proposals.fixed_columns(rows, ["code"], "fields", ["code", "name", "size", "rate"])


@query("""SELECT o_orderpriority AS label, CASE o_orderpriority WHEN '1-URGENT' THEN 'urgente' WHEN '2-HIGH' THEN 'alta' WHEN '5-LOW' THEN 'baixa' END AS name, count(*) AS n FROM orders GROUP BY 1, 2""")
def mapped_labels(spark, sf_dir):
    """MAP-01: labels by a fixed dictionary; others have no name."""
    name = proposals.mapped(F.col("o_orderpriority"), {"1-URGENT": "urgente", "2-HIGH": "alta", "5-LOW": "baixa"})
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("label"), name.alias("name")).agg(F.count("*").alias("n"))


@query("""
WITH w AS (SELECT p_partkey, CAST(p_size AS VARCHAR) AS quantidade, CAST(p_retailprice AS VARCHAR) AS valor_nominal, p_brand AS marca FROM part)
SELECT p_partkey, field_name, count(*) AS n, CASE field_name WHEN 'quantidade' THEN 'unidades' WHEN 'valor_nominal' THEN 'BRL' END AS unit FROM (UNPIVOT w ON quantidade, valor_nominal, marca INTO NAME field_name VALUE value) GROUP BY 1, 2""")
def observed_units(spark, sf_dir):
    """EAV-02: observations of mapped labels with the unit that the field declares."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("quantidade"), F.col("p_retailprice").alias("valor_nominal"), F.col("p_brand").alias("marca"))
    long = proposals.with_units(observations.to_long(part, ["p_partkey"], ["quantidade", "valor_nominal", "marca"]), {"quantidade": "unidades", "valor_nominal": "BRL"})
    return long.groupBy("p_partkey", "field_name", "unit").agg(F.count("*").alias("n"))


@query("""
WITH t AS (SELECT year(l_shipdate) AS y, CAST(sum(CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS DECIMAL(18,2)) END) AS DOUBLE) AS qa, CAST(sum(CASE WHEN l_returnflag = 'N' THEN CAST(l_quantity AS DECIMAL(18,2)) END) AS DOUBLE) AS qn, CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS DECIMAL(18,2)) END) AS DOUBLE) AS qr, max(CASE WHEN l_returnflag = 'A' THEN l_tax END) AS ta, max(CASE WHEN l_returnflag = 'N' THEN l_tax END) AS tn, max(CASE WHEN l_returnflag = 'R' THEN l_tax END) AS tr FROM lineitem GROUP BY 1) SELECT * FROM t""")
def indicator_series(spark, sf_dir):
    """EAV-04: two indicators of each report, a column for every series that is there; the pivot finds the series itself."""
    lines = table(spark, sf_dir, "lineitem").withColumn("y", F.year("l_shipdate").cast("long"))
    indicators = {"q": F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double"), "t": F.max("l_tax")}
    return observations.indicator_series(lines, "y", "l_returnflag", indicators)


@query("""
WITH s AS (SELECT s_suppkey AS id, s_nationkey AS parent, 'l' || (s_suppkey % 7) AS label, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 5 END AS sub FROM supplier),
r AS (SELECT c_custkey AS row_id, c_nationkey AS parent, 'l' || (c_custkey % 9) AS label, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 6 END AS sub FROM customer),
a AS (SELECT parent, label, min(id) AS i FROM s GROUP BY 1, 2), b AS (SELECT parent, sub, min(id) AS i FROM s WHERE sub IS NOT NULL GROUP BY 1, 2)
SELECT row_id, CASE WHEN a.i <> b.i THEN NULL ELSE coalesce(a.i, b.i) END AS series_id, CASE WHEN a.i <> b.i THEN 'conflict' WHEN a.i IS NOT NULL AND b.i IS NOT NULL THEN 'both' WHEN a.i IS NOT NULL THEN 'label' WHEN b.i IS NOT NULL THEN 'subclass' ELSE 'new' END AS outcome
FROM r LEFT JOIN a ON a.parent = r.parent AND a.label = r.label LEFT JOIN b ON b.parent = r.parent AND b.sub = r.sub""")
def series_resolution(spark, sf_dir):
    """EAV-07: a series by its parent and label, or by its subclass id; disagreement is a conflict."""
    k = F.col("s_suppkey")
    series = table(spark, sf_dir, "supplier").select(k.alias("series_id"), F.col("s_nationkey").alias("parent"), F.concat(F.lit("l"), k % 7).alias("label_key"), F.when(k % 2 == 0, k % 5).alias("subclass_id"))
    c = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(c.alias("row_id"), F.col("c_nationkey").alias("parent"), F.concat(F.lit("l"), c % 9).alias("label_key"), F.when(c % 3 > 0, c % 6).alias("subclass_id"))
    return proposals.resolve_series(rows, series)


@query("""
WITH v AS (SELECT DISTINCT o_custkey AS k, o_orderpriority AS sha256, year(o_orderdate) AS y FROM orders), e AS (SELECT k, sha256, max(y) AS y FROM v GROUP BY 1, 2)
SELECT k, sha256, y, row_number() OVER (PARTITION BY k ORDER BY y DESC, sha256 DESC) = 1 AS is_current FROM e""")
def current_versions(spark, sf_dir):
    """UPS-05: versions added once by content, the newest of each document marked current."""
    v = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("sha256")).agg(F.max(F.year("o_orderdate").cast("long")).alias("y"))
    return proposals.mark_current(v.where("y < 1997"), v.where("y >= 1997").unionByName(v.where("y >= 1999")), ["k"], ["y", "sha256"])


@query("""
WITH o AS (SELECT o_orderkey AS id, o_custkey AS issuer, [o_orderkey % 4000, o_orderkey % 3000 + 100000] AS keys FROM orders), t AS (SELECT s_suppkey * 31 % 4000 AS key, s_suppkey AS instrument, s_suppkey * 3 AS issuer FROM supplier UNION ALL SELECT s_suppkey * 17 % 3000 + 100000, s_suppkey, s_suppkey * 3 FROM supplier),
m AS (SELECT id, count(DISTINCT instrument) AS n, min(instrument) AS i, bool_or(e.issuer <> t.issuer) AS other FROM (SELECT id, issuer, unnest(keys) AS key FROM o) e JOIN t ON t.key = e.key GROUP BY 1),
r AS (SELECT o.id, m.i, CASE WHEN o.issuer % 10 = 0 THEN 'issuer_not_found' WHEN n > 1 THEN 'conflicting_candidates' WHEN n IS NULL THEN 'no_candidate' WHEN other THEN 'issuer_mismatch' ELSE 'one_candidate' END AS reason FROM o LEFT JOIN m ON m.id = o.id)
SELECT id, CASE WHEN reason = 'one_candidate' THEN i END AS instrument_id, CASE reason WHEN 'issuer_not_found' THEN 'review' WHEN 'no_candidate' THEN 'created' WHEN 'one_candidate' THEN 'matched' ELSE 'blocked' END AS action, reason FROM r""")
def instrument_import(spark, sf_dir):
    """MATCH-05: the issuer first, then the one candidate by any identifier, blocked if it is another issuer's."""
    k, s = F.col("o_orderkey"), F.col("s_suppkey")
    records = table(spark, sf_dir, "orders").select(k.alias("id"), F.col("o_custkey").alias("issuer"), F.array(k % 4000, k % 3000 + 100000).alias("keys"))
    issuers = table(spark, sf_dir, "customer").where("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("issuer"))
    pairs = F.inline(F.array(F.struct((s * 31 % 4000).alias("key")), F.struct((s * 17 % 3000 + 100000).alias("key"))))
    identifiers = table(spark, sf_dir, "supplier").select(s.alias("instrument_id"), (s * 3).alias("issuer"), pairs)
    return proposals.import_instruments(records, issuers, identifiers)


@query("""
WITH f AS (SELECT c_nationkey * 10 + c_custkey % 10 AS cnpj, 'FUND ' || (c_nationkey % 5 + CASE WHEN c_custkey % 61 = 0 THEN 1 ELSE 0 END) AS name, CASE WHEN c_custkey % 53 = 0 THEN 'x' ELSE 'y' END AS type, CASE WHEN c_custkey % 47 = 0 THEN 'closed' ELSE 'normal' END AS status FROM customer),
p AS (SELECT s_nationkey * 10 + s_suppkey % 10 AS fund, s_suppkey % 20 AS cnpj, 'PROVIDER ' || (s_suppkey % 20 + CASE WHEN s_suppkey % 37 = 0 THEN 1 ELSE 0 END) AS name FROM supplier),
a AS (SELECT cnpj AS key, min(name) AS name, CASE WHEN NOT bool_and(status = 'normal') THEN 'not_in_operation' WHEN count(DISTINCT name) > 1 THEN 'names_diverge' WHEN count(DISTINCT type) > 1 THEN 'types_diverge' ELSE 'resolved' END AS outcome FROM f GROUP BY 1)
SELECT 'fund' AS kind, key, name, outcome FROM a UNION ALL SELECT 'provider', cnpj, min(name), CASE WHEN count(DISTINCT name) = 1 THEN 'resolved' ELSE 'names_diverge' END FROM p WHERE fund IN (SELECT key FROM a WHERE outcome = 'resolved') GROUP BY 2""")
def fund_import_phases(spark, sf_dir):
    """MATCH-06: funds in normal operation whose rows agree, then the providers of those."""
    c, s = F.col("c_custkey"), F.col("s_suppkey")
    funds = table(spark, sf_dir, "customer").select(
        (F.col("c_nationkey") * 10 + c % 10).alias("cnpj"),
        F.concat(F.lit("FUND "), F.col("c_nationkey") % 5 + F.when(c % 61 == 0, 1).otherwise(0)).alias("name"),
        F.when(c % 53 == 0, "x").otherwise("y").alias("type"),
        F.when(c % 47 == 0, "closed").otherwise("normal").alias("status"),
    )
    providers = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") * 10 + s % 10).alias("fund"), (s % 20).alias("cnpj"), F.concat(F.lit("PROVIDER "), s % 20 + F.when(s % 37 == 0, 1).otherwise(0)).alias("name"))
    return proposals.fund_phases(funds, providers)


@query("""WITH m AS (SELECT l_partkey AS k, list(CAST(l_extendedprice AS DOUBLE)) AS v, CAST(median(l_extendedprice) AS DOUBLE) AS t FROM lineitem GROUP BY 1) SELECT k, len(list_filter(v, lambda x: abs(x - t * 1.2) <= 0.01 * abs(t * 1.2))) > 0 AS agrees FROM m""")
def any_value_within(spark, sf_dir):
    """JOIN-18: a total is met if any of the values found lies within one percent."""
    found = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.collect_list("l_extendedprice").alias("v"), F.median("l_extendedprice").alias("t"))
    return found.select("k", proposals.any_within(F.col("v"), F.col("t") * 1.2).alias("agrees"))


@query("""SELECT l_partkey, count(*) AS open_conflicts FROM (SELECT l_partkey, l_suppkey FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_returnflag) > 1) GROUP BY 1""")
def open_conflicts(spark, sf_dir):
    """AGG-23: open conflicts of each instrument."""
    return observations.conflicting_keys(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"], "l_returnflag").groupBy("l_partkey").agg(F.count("*").alias("open_conflicts"))


@query("""
WITH t AS (SELECT c_custkey AS k, 'informe' AS source, 'saldo' AS text FROM customer WHERE c_acctbal < 0 UNION ALL SELECT o_custkey, 'atas', o_orderpriority FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_custkey, 'df', 'ressalva' FROM orders WHERE o_totalprice > 300000)
SELECT k, string_agg(DISTINCT source, ' + ' ORDER BY source) AS sources, count(DISTINCT source) AS n_sources, string_agg(DISTINCT '[' || source || '] ' || text, ' | ' ORDER BY '[' || source || '] ' || text) AS signals FROM t GROUP BY 1""")
def merged_alerts(spark, sf_dir):
    """AGG-24: alerts of several sources, put together by asset."""
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return proposals.merged_signals(
        {
            "informe": customer.where("c_acctbal < 0").select(F.col("c_custkey").alias("k"), F.lit("saldo").alias("text")),
            "atas": orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("text")),
            "df": orders.where("o_totalprice > 300000").select(F.col("o_custkey").alias("k"), F.lit("ressalva").alias("text")),
        },
        "k",
    )


@query("""SELECT o_orderkey, nullif(concat_ws(', ', CASE WHEN o_orderkey % 7 = 0 THEN 'date' END, CASE WHEN o_orderkey % 5 = 0 THEN 'amount' END), '') AS error FROM orders""")
def bad_rows(spark, sf_dir):
    """SCAN-16: rows that don't convert become error records that name their fields."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(k % 7 == 0, "31/13/2020").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("date"), F.when(k % 5 == 0, "1,5").otherwise(F.col("o_totalprice").cast("string")).alias("amount"))
    return proposals.good_and_bad(rows, {"date": "date", "amount": "numeric"}, "o_orderkey")


@query("""SELECT l_orderkey, arg_min(l_returnflag, l_linenumber * 1000000 + l_partkey) AS first_value FROM lineitem GROUP BY 1""")
def first_in_file(spark, sf_dir):
    """WIN-13: the first row in file order wins; of rows at one position that which the file holds first."""
    position = F.col("l_linenumber") * 1000000 + F.col("l_partkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", position.alias("position"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return versions.first_rows(lines, ["l_orderkey"], [F.col("position"), F.col("file"), F.col("row")]).select("l_orderkey", F.col("l_returnflag").alias("first_value"))


@query("""
WITH l AS (SELECT o_custkey AS k, max(o_orderkey) AS id, arg_max(o_orderstatus, o_orderkey) AS seen FROM orders GROUP BY 1)
SELECT k, id AS observation_id, seen, seen = CASE WHEN k % 2 = 0 THEN 'F' ELSE 'O' END AS is_source FROM l""")
def value_provenance(spark, sf_dir):
    """WIN-16: the last observation of each asset, and whether the asset's value comes from it."""
    last = versions.first_rows(table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderkey").desc()])
    held = F.when(F.col("o_custkey") % 2 == 0, "F").otherwise("O")
    return last.select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("observation_id"), F.col("o_orderstatus").alias("seen"), (F.col("o_orderstatus") == held).alias("is_source"))


@query("""
WITH x AS (SELECT l_orderkey, l_returnflag AS v, min(l_linenumber * 1000000 + l_partkey) AS place FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, array_to_string(list_transform(list_sort(list(struct_pack(place := place, v := v)) FILTER (WHERE v IS NOT NULL)), lambda p: p.v), ',') AS kept FROM x GROUP BY 1""")
def distinct_in_order(spark, sf_dir):
    """ARR-01: repeated values go, the order of their first places stays."""
    held = F.array_sort(F.collect_list(F.struct((F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("at"), F.col("l_returnflag").alias("v"))))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(held.alias("h")).select("l_orderkey", F.array_join(F.array_distinct(F.col("h.v")), ",").alias("kept"))


@query(f"SELECT doc_id, CASE WHEN lang = 'de' THEN 'german' WHEN lang = 'fr' THEN 'french' ELSE 'other' END AS old_category, {CATEGORY_SQL} AS new_category FROM documents WHERE {CATEGORY_SQL} <> CASE WHEN lang = 'de' THEN 'german' WHEN lang = 'fr' THEN 'french' ELSE 'other' END")
def reclassified_documents(spark, sf_dir):
    """TXT-03: the rows that a reclassification would change, old category and new."""
    old = F.when(F.col("lang") == "de", "german").when(F.col("lang") == "fr", "french").otherwise("other")
    rows = table(spark, sf_dir, "documents").select("doc_id", old.alias("old_category"), text_rules.first_category(F.col("text"), CATEGORIES).alias("new_category"))
    return rows.where("old_category <> new_category")


@query("""SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY""")
def accepted_snapshot(spark, sf_dir):
    """MATCH-12: a snapshot that is not older than the one applied last passes; an older one is an error."""
    orders = table(spark, sf_dir, "orders")
    newest = orders.agg(F.max("o_orderdate")).scalar()
    snapshot = orders.where(F.col("o_orderdate") >= newest - F.expr("interval 30 days"))
    applied = orders.where("o_orderdate < timestamp'1998-01-01'")
    return proposals.refuse_older(snapshot, applied, "o_orderdate").select("o_orderkey", "o_orderstatus")


@query("""
WITH t AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS source, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE CAST(CAST(l_discount * 100 AS BIGINT) % 3 AS VARCHAR) END AS mult, CAST(CAST(l_tax * 100 AS BIGINT) % 2 AS VARCHAR) AS taxa FROM lineitem),
a AS (SELECT k, count(DISTINCT source) AS n, count(DISTINCT mult || '|' || taxa) AS d, count(DISTINCT nullif(mult, '')) AS m, count(DISTINCT taxa) AS t FROM t GROUP BY 1)
SELECT k, CASE WHEN n < 2 THEN 'uma_fonte' WHEN d = 1 THEN 'concordam' WHEN m > 1 OR t > 1 THEN 'divergem' ELSE 'compativeis' END AS verdict FROM a""")
def rate_verdicts(spark, sf_dir):
    """RULE-16: rates of several documents, slot by slot."""
    mult = F.when(F.col("l_linenumber") % 3 != 0, F.concat(F.lit("mult="), (F.col("l_discount") * 100).cast("long") % 3))
    taxa = F.concat(F.lit("taxa="), (F.col("l_tax") * 100).cast("long") % 2)
    tokens = F.filter(F.array(mult, taxa), lambda x: x.isNotNull())
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("source"), tokens.alias("tokens")).distinct()
    return proposals.document_verdicts(rows, ["k"], True)


@query("""
WITH t AS (SELECT o_custkey AS k, o_orderkey AS source, CASE o_orderkey % 40 WHEN 1 THEN ['w=A'] WHEN 2 THEN ['w=B', 'w=C'] WHEN 3 THEN NULL ELSE ['w=A', 'w=B'] END AS s FROM orders),
g AS (SELECT k, count(s) AS n, bool_or(s = ['w=A']) AS a, bool_or(s = ['w=A', 'w=B']) AS ab, bool_or(s = ['w=B', 'w=C']) AS bc FROM t GROUP BY 1)
SELECT k, CASE WHEN n < 2 THEN 'uma_fonte' WHEN CAST(coalesce(a, false) AS INT) + CAST(coalesce(ab, false) AS INT) + CAST(coalesce(bc, false) AS INT) = 1 THEN 'concordam' WHEN bc THEN 'divergem' ELSE 'compativeis' END AS verdict FROM g""")
def name_verdicts(spark, sf_dir):
    """RULE-16: names of several documents, one holding the words of the other."""
    k = F.col("o_orderkey") % 40
    words = lambda *x: F.array(*[F.lit(w) for w in x])
    tokens = F.when(k == 1, words("w=A")).when(k == 2, words("w=B", "w=C")).when(k == 3, None).otherwise(words("w=A", "w=B"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("source"), tokens.alias("tokens"))
    return proposals.document_verdicts(rows, ["k"], False)


@query("""
WITH f AS (SELECT l_orderkey AS k, CASE WHEN l_suppkey % 9 <> 0 THEN 'c' || (l_suppkey % 3) END AS cnpj FROM lineitem), a AS (SELECT k, count(*) FILTER (cnpj IS NULL) AS bad, count(DISTINCT cnpj) AS n, min(cnpj) AS c FROM f GROUP BY 1),
r AS (SELECT k, CASE WHEN bad = 0 AND n = 1 THEN c END AS cnpj, CASE WHEN bad > 0 THEN 'cnpj_invalido_na_fonte' WHEN n > 1 THEN 'conflito' END AS reason FROM a)
SELECT k, cnpj, reason, CASE WHEN cnpj IS NULL THEN NULL WHEN k % 3 = 0 THEN 'applied' WHEN cnpj = 'c' || (k % 3) THEN 'confirmed' ELSE 'conflict' END AS decision FROM r""")
def issuer_resolution(spark, sf_dir):
    """RULE-14: the issuer that all filings name, and what becomes of it."""
    filings = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.when(F.col("l_suppkey") % 9 != 0, F.concat(F.lit("c"), F.col("l_suppkey") % 3)).alias("cnpj"))
    stored = F.when(F.col("k") % 3 == 0, " ").otherwise(F.concat(F.lit("c"), F.col("k") % 3))
    return proposals.resolved_issuers(filings, "k").withColumn("decision", proposals.resolution_decision(F.col("cnpj"), stored, True))


@query("""
WITH p AS (SELECT l_orderkey AS k, l_linenumber AS t, CASE WHEN l_suppkey % 8 <> 0 THEN 'd' || (l_suppkey % 2) END AS c, CASE WHEN l_discount < 0.02 THEN NULL WHEN l_discount < 0.04 THEN 0.5 ELSE 1.0 END AS s FROM lineitem),
w AS (SELECT *, t = max(t) OVER (PARTITION BY k) AS last FROM p),
a AS (SELECT k, count(DISTINCT CASE WHEN s > 0 THEN c END) AS n, min(CASE WHEN s > 0 THEN c END) AS c, count(*) FILTER (s > 0 AND c IS NULL) AS bad, count(*) FILTER (s > 0 AND last) AS nl, count(*) FILTER (s > 0 AND c IS NULL AND last) AS bl, max(CASE WHEN last AND c IS NOT NULL AND s > 0 THEN s END) AS s FROM w GROUP BY 1),
r AS (SELECT k, c, CASE WHEN n = 0 THEN CASE WHEN bad > 0 THEN 'cnpj_invalido_na_fonte' ELSE 'sem_devedor_informado' END WHEN n > 1 THEN 'varios_devedores' WHEN nl = 0 THEN 'sem_devedor_informado' WHEN bl > 0 OR s IS NULL OR s < 1 THEN 'devedor_parcial' END AS reason FROM a)
SELECT k, CASE WHEN reason IS NULL THEN c END AS cnpj, reason FROM r""")
def debtor_resolution(spark, sf_dir):
    """RULE-14: the one debtor of all filings, whole in the newest, or the reason why there is none."""
    share = F.when(F.col("l_discount") < 0.02, None).when(F.col("l_discount") < 0.04, 0.5).otherwise(1.0)
    parties = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("t"), F.when(F.col("l_suppkey") % 8 != 0, F.concat(F.lit("d"), F.col("l_suppkey") % 2)).alias("cnpj"), share.alias("share"))
    return proposals.resolved_debtors(parties, "k", "t")


@query("""
WITH l AS (SELECT l_orderkey AS doc, l_linenumber AS n, CAST(l_quantity AS DECIMAL(28,8)) AS q, CAST(round(l_tax * 100) AS DECIMAL(28,8)) AS t FROM lineitem),
b AS (SELECT doc, n, sum(q - t) AS s FROM l GROUP BY 1, 2), d AS (SELECT doc, sum(s) AS s FROM b GROUP BY 1)
SELECT doc, 'r' AS container, CAST(declared AS DOUBLE) AS declared, CAST(s AS DOUBLE) AS leaf_sum, 0 AS block FROM (SELECT doc, s, s + CASE WHEN doc % 4 = 0 THEN 1 ELSE 0 END AS declared FROM d) WHERE declared <> s
UNION ALL SELECT doc, 'r/i', CAST(declared AS DOUBLE), CAST(s AS DOUBLE), n FROM (SELECT doc, n, s, s + CASE WHEN n = 2 THEN 5 ELSE 0 END AS declared FROM b) WHERE declared <> s""")
def container_totals(spark, sf_dir):
    """AGG-14: declared totals against the leaves of their container, one level and two, signs inverted where declared."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("decimal(28,8)").alias("q"), F.round(F.col("l_tax") * 100).cast("decimal(28,8)").alias("t"))
    leaf = lambda path, column: F.struct(F.lit(path).alias("xml_path"), F.array(F.lit(0), F.col("n").cast("int")).alias("chain"), F.col(column).cast("string").alias("raw_text"))
    leaves = lines.select("doc", F.inline(F.array(leaf("r/i/q", "q"), leaf("r/i/t", "t"))))
    sums = lines.groupBy("doc", "n").agg(F.sum(F.col("q") - F.col("t")).alias("s"))
    total = lambda df, path, chain, extra: df.select("doc", F.lit(path).alias("xml_path"), chain.alias("chain"), (F.col("s") + F.when(extra, F.col("extra")).otherwise(0)).cast("string").alias("raw_text"))
    inner = total(sums.withColumn("extra", F.lit(5)), "r/i/@total", F.array(F.lit(0), F.col("n").cast("int")), F.col("n") == 2)
    outer = total(sums.groupBy("doc").agg(F.sum("s").alias("s")).withColumn("extra", F.lit(1)), "r/@total", F.array(F.lit(0)), F.col("doc") % 4 == 0)
    found = proposals.totals_consistency(leaves.unionByName(inner).unionByName(outer), "doc", ["r/i/t"])
    return found.select("doc", "container", F.col("declared").cast("double").alias("declared"), F.col("leaf_sum").cast("double").alias("leaf_sum"), F.coalesce(F.try_element_at("chain", F.lit(2)), F.lit(0)).alias("block"))


@query("""
WITH e AS (SELECT l_partkey AS code, year(l_shipdate) AS y, max(l_quantity) AS value FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2), m AS (SELECT l_partkey AS code, year(l_shipdate) AS y, max(l_quantity) AS value FROM lineitem WHERE l_returnflag = 'R' AND l_partkey % 3 > 0 GROUP BY 1, 2),
n AS (SELECT DISTINCT code, code AS alias FROM e UNION SELECT p_partkey, p_partkey + 1 FROM part WHERE p_partkey % 2 = 0)
SELECT e.code, e.y, CASE WHEN count(m.value) = 0 THEN 'no_row' WHEN bool_or(abs(m.value - e.value) <= 0.01 * greatest(1.0, abs(e.value))) THEN 'equal' ELSE 'different' END AS outcome FROM e JOIN n ON n.code = e.code LEFT JOIN m ON m.code = n.alias AND m.y = e.y GROUP BY 1, 2""")
def extracted_by_alias(spark, sf_dir):
    """JOIN-14: extracted values against the market's, of a code or any of its aliases."""
    side = lambda flag: table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag).groupBy(F.col("l_partkey").alias("code"), F.year("l_shipdate").cast("long").alias("y")).agg(F.max("l_quantity").alias("value"))
    aliases = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("code"), (F.col("p_partkey") + 1).alias("alias"))
    return proposals.against_market(side("A"), side("R").where("code % 3 > 0"), aliases, ["y"])
