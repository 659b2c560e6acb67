"""Registrations in force, statuses compared, flags weighed, keys of siblings, appends with their conflicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import market, observations, registrations
from ..sources.tables import table
from .registry import query


@query("""
WITH r AS (SELECT CASE WHEN o_custkey % 11 > 0 THEN o_custkey END AS owner, o_orderkey, o_orderstatus <> 'F' AS open, year(o_orderdate) AS y, o_orderkey % 90 <> 0 AS consistent, o_orderkey % 70 <> 7 AS dated, o_orderkey % 3 > 0 AS scoped FROM orders),
n AS (SELECT *, rank() OVER (PARTITION BY owner ORDER BY open DESC, y DESC) AS rk FROM r WHERE owner IS NOT NULL),
g AS (SELECT owner, count(*) AS n_rows, bool_and(consistent) AS consistent, bool_and(dated) AS dated, count(*) FILTER (rk = 1) AS best, bool_or(scoped) FILTER (rk = 1) AS scoped, min(o_orderkey) FILTER (rk = 1) AS id FROM n GROUP BY 1 HAVING bool_or(scoped)),
d AS (SELECT *, CASE WHEN NOT consistent THEN 'inconsistent' WHEN NOT dated THEN 'invalid_date' WHEN best > 1 THEN 'tie' WHEN NOT scoped THEN 'other_type' ELSE 'chosen' END AS reason FROM g)
SELECT owner, n_rows, reason, CASE WHEN reason = 'chosen' THEN id END AS record FROM d UNION ALL SELECT NULL, 1, 'invalid_id', NULL FROM r WHERE owner IS NULL AND scoped""")
def registration_choice(spark, sf_dir):
    """RULE-15: the registration in force of each owner, or the first reason against one."""
    rows = table(spark, sf_dir, "orders").withColumn("owner", F.when(F.col("o_custkey") % 11 > 0, F.col("o_custkey")))
    key = F.col("o_orderkey")
    return registrations.current_registrations(rows, "owner", "o_orderkey", F.col("o_orderstatus") == "F", F.year("o_orderdate"), key % 90 != 0, key % 70 != 7, key % 3 > 0)


@query("""
WITH c AS (SELECT o_orderkey AS class_id, o_custkey AS fund_id, o_orderkey % 2 AS scope FROM orders), f AS (SELECT c_custkey AS fund_id, c_custkey % 2 AS scope FROM customer WHERE c_custkey % 4 > 0)
SELECT class_id, c.fund_id, CASE WHEN f.fund_id IS NULL THEN 'fund_not_chosen' ELSE 'chosen' END AS reason, f.fund_id IS NOT NULL AND c.scope <> f.scope AS differs FROM c LEFT JOIN f USING (fund_id)""")
def classes_of_funds(spark, sf_dir):
    """RULE-15: classes whose fund was chosen, and pairs whose scopes differ."""
    classes = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("class_id"), F.col("o_custkey").alias("fund_id"), (F.col("o_orderkey") % 2).alias("scope"))
    funds = table(spark, sf_dir, "customer").where("c_custkey % 4 > 0").select(F.col("c_custkey").alias("fund_id"), (F.col("c_custkey") % 2).alias("scope"))
    return registrations.classes_of_chosen_funds(classes, funds)


@query("""
WITH s AS (SELECT l_orderkey AS operation, CASE WHEN l_orderkey % 3 = 0 THEN 'Default' ELSE 'Ativa' END AS status, l_linenumber AS place, l_partkey AS code FROM lineitem),
m AS (SELECT l_partkey AS code, max({'r': l_shipdate, 's': CASE l_returnflag WHEN 'R' THEN 'Em Atraso' WHEN 'A' THEN 'Adimplente' ELSE '' END}) AS newest FROM lineitem WHERE l_partkey % 5 > 0 GROUP BY 1),
j AS (SELECT s.*, coalesce(newest.s, 'sem dado na CVM') AS situation FROM s LEFT JOIN m USING (code)),
g AS (SELECT operation, min(status) AS status, count(DISTINCT code) AS n_codes, bool_or(situation = 'Em Atraso') AS late, min({'p': place, 'c': code, 's': situation}) AS f FROM j GROUP BY 1)
SELECT operation, status, n_codes, late, CASE WHEN late THEN 'Em atraso' WHEN f.s = '' THEN 'vazio' ELSE f.s END AS situation, status = 'Default' AND NOT late AS divergent FROM g""")
def portal_operations(spark, sf_dir):
    """RULE-18: a portal's status of an operation against the newest filings of its series."""
    lines = table(spark, sf_dir, "lineitem")
    status = F.when(F.col("l_orderkey") % 3 == 0, "Default").otherwise("Ativa")
    series = lines.select(F.col("l_orderkey").alias("operation"), status.alias("status"), F.col("l_linenumber").alias("place"), F.col("l_partkey").alias("code"))
    situation = F.when(F.col("l_returnflag") == "R", "Em Atraso").when(F.col("l_returnflag") == "A", "Adimplente").otherwise("")
    filings = lines.where("l_partkey % 5 > 0").select(F.col("l_partkey").alias("code"), F.col("l_shipdate").alias("reference"), situation.alias("situation"))
    return market.portal_against_market(series, filings).select("operation", "status", F.size("codes").cast("long").alias("n_codes"), "late", "situation", "divergent")


@query("""
WITH f AS (SELECT l_orderkey, bool_or(l_returnflag = 'R')::INT * 5 + bool_or(l_returnflag = 'A' AND l_tax > 0.07)::INT * 4 + bool_or(l_linestatus = 'F' AND l_discount < 0.01)::INT * 3 + bool_or(day(l_shipdate) > 28)::INT * 2 + bool_or(l_partkey % 37 = 0)::INT * 3 + bool_or(l_partkey % 13 = 0)::INT + bool_or(l_suppkey % 7 = 0)::INT + bool_or(l_suppkey % 11 = 0)::INT * 2 + bool_or(l_quantity > 48)::INT * 3 + bool_or(l_tax < 0.01)::INT * 3 AS score, count(*) AS n_series FROM lineitem GROUP BY 1)
SELECT l_orderkey, n_series, score FROM f""")
def weighed_flags(spark, sf_dir):
    """RULE-03: each distinct review flag of an emission counts its fixed weight once."""
    line = table(spark, sf_dir, "lineitem")
    found = market.flags(
        {
            "em_atraso": F.col("l_returnflag") == "R",
            "vencido_com_saldo_adimplente": (F.col("l_returnflag") == "A") & (F.col("l_tax") > 0.07),
            "informe_defasado": (F.col("l_linestatus") == "F") & (F.col("l_discount") < 0.01),
            "vencimento_fora_mes_base": F.dayofmonth("l_shipdate") > 28,
            "isin_repetido": F.col("l_partkey") % 37 == 0,
            "serie_sem_isin": F.col("l_partkey") % 13 == 0,
            "identificador_duplicado": F.col("l_suppkey") % 7 == 0,
            "isin_invalido": F.col("l_suppkey") % 11 == 0,
            "saldo_incompativel": F.col("l_quantity") > 48,
            "situacao_mista_na_classe": F.col("l_tax") < 0.01,
        }
    )
    return market.score_by_flags(line.withColumn("flags", found), "l_orderkey", "flags", F.lit(0), market.WEIGHTS).select("l_orderkey", "n_series", "score")


@query("""
WITH v AS (SELECT l_orderkey, l_linenumber, 'serie' AS leaf, CASE WHEN l_partkey % 5 = 0 THEN ' ' ELSE 'S' || (l_partkey % 4) END AS value FROM lineitem WHERE l_suppkey % 3 > 0 UNION ALL SELECT l_orderkey, l_linenumber, 'classe', l_returnflag FROM lineitem WHERE l_suppkey % 2 > 0 UNION ALL SELECT l_orderkey, l_linenumber, 'saldo', CAST(l_suppkey AS VARCHAR) FROM lineitem),
s AS (SELECT l_orderkey, l_linenumber, min(value) FILTER (leaf = 'serie' AND trim(value) <> '') AS serie, min(value) FILTER (leaf = 'classe') AS classe FROM v GROUP BY 1, 2)
SELECT l_orderkey, l_linenumber, leaf, value, coalesce(serie, classe) AS instance_key, count(*) OVER (PARTITION BY l_orderkey, leaf, coalesce(serie, classe)) AS repeats FROM v JOIN s USING (l_orderkey, l_linenumber)""")
def leaf_instances(spark, sf_dir):
    """EAV-06: leaves with their block's key, from the series leaf or else the class leaf, and how often each repeats."""
    leaf = lambda name, value, there: F.when(there, F.struct(F.lit(name).alias("leaf"), value.alias("value")))
    serie = F.when(F.col("l_partkey") % 5 == 0, " ").otherwise(F.concat(F.lit("S"), (F.col("l_partkey") % 4).cast("string")))
    found = F.array(leaf("serie", serie, F.col("l_suppkey") % 3 > 0), leaf("classe", F.col("l_returnflag"), F.col("l_suppkey") % 2 > 0), leaf("saldo", F.col("l_suppkey").cast("string"), F.lit(True)))
    leaves = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.inline(F.filter(found, lambda x: x.isNotNull())))
    return observations.sibling_keys(leaves, ["l_orderkey"], "l_linenumber", "leaf", "value", ["serie", "classe"])


@query("""
WITH o AS (SELECT o_custkey AS k, o_orderkey AS id, o_orderpriority AS source, CASE WHEN o_orderkey % 17 > 0 THEN o_orderstatus END AS value, o_orderkey % 10 = 0 AS late FROM orders),
a AS (SELECT * FROM o n WHERE late AND NOT EXISTS (SELECT 1 FROM o s WHERE s.k = n.k AND s.source = n.source AND s.value IS NOT DISTINCT FROM n.value AND (NOT s.late OR s.id < n.id))),
p AS (SELECT a.id AS new_id, s.id AS other_id, row_number() OVER (PARTITION BY a.id ORDER BY s.late DESC, s.id DESC) AS nth FROM a JOIN (SELECT * FROM o WHERE NOT late UNION ALL SELECT * FROM a) s ON s.k = a.k AND s.value IS DISTINCT FROM a.value AND (NOT s.late OR s.id < a.id))
SELECT a.id, other_id FROM a LEFT JOIN (SELECT * FROM p WHERE nth = 1) ON new_id = a.id""")
def append_conflicts(spark, sf_dir):
    """SINK-03: the rows that a batch appends, each with the newest row of its subject that says otherwise."""
    value = F.when(F.col("o_orderkey") % 17 > 0, F.col("o_orderstatus"))
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("source"), value.alias("value"))
    appended, conflicts = observations.append_with_conflicts(o.where("id % 10 = 0"), o.where("id % 10 <> 0"), ["k"], ["k", "source", "value"], "id", "value")
    return appended.join(conflicts, F.col("id") == F.col("new_id"), "left").select("id", "other_id")
