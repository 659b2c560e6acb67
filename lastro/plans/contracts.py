"""Contract rules on the orders as facts, the customers as parameters and the line items as reports (RULE-09, RULE-10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import contracts
from ..sources.tables import table
from .registry import query

#: facts: a quarter's orders by status; parameters: two minimums and a ratio for each customer; amounts: a month's lines.
FACTS_SQL = """
f AS (SELECT o_custkey AS asset, CASE o_orderstatus WHEN 'O' THEN 'carteira' WHEN 'F' THEN 'caixa' ELSE 'divida' END AS name, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS date, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DECIMAL(28,8)) AS value, CASE WHEN o_orderkey % 2 = 0 THEN 1000 ELSE 1 END AS factor, o_orderkey AS source FROM orders),
one AS (SELECT asset, date, name, arg_min(value, source) AS value, arg_min(value * factor, source) AS scaled FROM f GROUP BY 1, 2, 3),
wide AS (SELECT asset, date, max(CASE WHEN name = 'carteira' THEN value END) AS carteira, max(CASE WHEN name = 'caixa' THEN value END) AS caixa, max(CASE WHEN name = 'divida' THEN value END) AS divida, max(CASE WHEN name = 'carteira' THEN scaled END) AS carteira_s FROM one GROUP BY 1, 2)
"""


def _facts(spark, sf_dir):
    name = F.when(F.col("o_orderstatus") == "O", "carteira").when(F.col("o_orderstatus") == "F", "caixa").otherwise("divida")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("asset"),
        name.alias("name"),
        F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("date"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("value"),
        F.when(F.col("o_orderkey") % 2 == 0, "BRL_mil").otherwise("BRL").alias("unit"),
        F.col("o_orderkey").alias("source"),
    )


def _parameters(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(
        k.alias("asset"),
        F.inline(
            F.array(
                F.struct(F.when(k % 2 == 0, "minimo_a").otherwise("sem_uso").alias("name"), F.lit("90000").alias("value"), F.lit("1992-01-01").alias("valid_from"), F.lit("1995-12-31").alias("valid_to")),
                F.struct(F.lit("minimo_b").alias("name"), F.lit("150000").alias("value"), F.lit("1994-01-01").alias("valid_from"), F.lit(None).cast("string").alias("valid_to")),
                F.struct(F.lit("razao_1").alias("name"), F.lit("1.1").alias("value"), F.lit(None).cast("string").alias("valid_from"), F.lit(None).cast("string").alias("valid_to")),
                F.struct(F.lit("razao_2").alias("name"), F.lit("1.3").alias("value"), F.lit(None).cast("string").alias("valid_from"), F.lit(None).cast("string").alias("valid_to")),
                F.struct(F.lit("prazo").alias("name"), F.concat(F.lit("199"), F.pmod(k, F.lit(10)), F.lit("-06-30")).alias("value"), F.lit(None).cast("string").alias("valid_from"), F.lit(None).cast("string").alias("valid_to")),
                F.struct(F.when(k % 3 == 0, "serie_1").otherwise("serie_2").alias("name"), F.concat((k % 4).cast("string"), F.lit(".0")).alias("value"), F.lit(None).cast("string").alias("valid_from"), F.lit(None).cast("string").alias("valid_to")),
            )
        ),
    )
    return rows.withColumns({"valid_from": F.col("valid_from").cast("date"), "valid_to": F.col("valid_to").cast("date")})


def _amounts(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("asset"), F.date_format("l_shipdate", "yyyy-MM").alias("month"), F.col("l_linestatus").alias("path"))
    return lines.agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("string").alias("value"), F.when(F.max("l_tax") > 0.07, "unknown").otherwise("units").alias("scale"), F.max("l_linenumber").alias("instance_key"))


def _numeric(found):
    return found.withColumns({"value": F.round(F.col("value").cast("double"), 4), "expected": F.col("expected").cast("double")})


@query(f"""
WITH {FACTS_SQL},
d AS (SELECT DISTINCT asset, date FROM f WHERE month(date) IN (1, 7)),
v AS (SELECT d.asset, d.date, CASE WHEN d.asset % 2 = 0 AND d.date BETWEEN DATE '1992-01-01' AND DATE '1995-12-31' THEN 90000 WHEN d.date >= DATE '1994-01-01' THEN 150000 END AS m, CASE WHEN d.asset % 2 = 0 AND d.date BETWEEN DATE '1992-01-01' AND DATE '1995-12-31' THEN carteira ELSE carteira + caixa END AS s FROM d JOIN wide w ON w.asset = d.asset AND w.date = d.date)
SELECT asset, 'cessao' AS rule, strftime(date, '%Y-%m') AS month, s >= m AS compliant, CASE WHEN m IS NOT NULL THEN CAST(s AS DOUBLE) END AS value, CAST(m AS DOUBLE) AS expected FROM v WHERE m IS NULL OR s IS NOT NULL
UNION ALL SELECT asset, 'razao', strftime(date, '%Y-%m'), carteira + caixa >= CASE WHEN month(date) <= 8 THEN 1.1 ELSE 1.3 END * divida, round(CAST(carteira + caixa AS DOUBLE) / CAST(divida AS DOUBLE), 4), CASE WHEN month(date) <= 8 THEN 1.1 ELSE 1.3 END FROM wide WHERE carteira IS NOT NULL AND caixa IS NOT NULL AND divida IS NOT NULL
UNION ALL SELECT asset, 'minimo', strftime(date, '%Y-%m'), CASE WHEN date >= DATE '1994-01-01' THEN carteira_s >= 150000 END, CAST(carteira_s AS DOUBLE), CASE WHEN date >= DATE '1994-01-01' THEN 150000 END FROM wide WHERE carteira IS NOT NULL""")
def contract_minimums(spark, sf_dir):
    """RULE-09, RULE-10: the least assignment by variants, the guarantee ratio by part of the year, the least sum in a unit."""
    rules = [
        {"id": "cessao", "type": "cessao_fiduciaria_minima", "months": ["01", "07"], "variants": [{"parameter": "minimo_a", "facts": ["carteira"]}, {"parameter": "minimo_b", "facts": ["carteira", "caixa"]}]},
        {"id": "razao", "type": "razao_garantia_minima", "numerator_facts": ["carteira", "caixa"], "denominator_fact": "divida", "parameters": {"01-08": "razao_1", "09-12": "razao_2"}},
        {"id": "minimo", "type": "fact_minimum", "facts": ["carteira"], "parameter": "minimo_b"},
    ]
    found = contracts.contract_alerts(rules, _facts(spark, sf_dir), _parameters(spark, sf_dir), _amounts(spark, sf_dir))
    return _numeric(found).drop("instance_key")


AMOUNTS_SQL = """a AS (SELECT l_suppkey AS asset, strftime(l_shipdate, '%Y-%m') AS month, l_linestatus AS path, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS value, CASE WHEN max(l_tax) > 0.07 THEN 'unknown' ELSE 'units' END AS scale, max(l_linenumber) AS instance_key FROM lineitem GROUP BY 1, 2, 3)"""


@query(f"""
WITH {AMOUNTS_SQL}, p AS (SELECT o_custkey AS asset, strftime(o_orderdate, '%Y-%m') AS month, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS paid FROM orders WHERE o_orderkey % 3 > 0 GROUP BY 1, 2),
s AS (SELECT o_custkey AS asset, CAST(year(o_orderdate) AS VARCHAR) AS year FROM orders WHERE o_orderkey % 3 = 0), y AS (SELECT asset, substr(month, 1, 4) AS year, sum(value) AS v FROM a WHERE path = 'F' AND scale <> 'unknown' GROUP BY 1, 2)
SELECT a.asset, 'pagamentos' AS rule, a.month, abs(value - coalesce(paid, 0)) <= 60000 AS compliant, CAST(coalesce(paid, 0) AS DOUBLE) AS value, CAST(value AS DOUBLE) AS expected FROM a LEFT JOIN p ON p.asset = a.asset AND p.month = a.month WHERE path = 'F' AND scale <> 'unknown' AND a.month IN ('1996-03', '1997-05', '1998-08')
UNION ALL SELECT s.asset, 'declaracao', s.year || '-12', coalesce(v, 0) = 0, CAST(coalesce(v, 0) AS DOUBLE), 0 FROM s LEFT JOIN y ON y.asset = s.asset AND y.year = s.year""")
def contract_payments(spark, sf_dir):
    """RULE-09: payments announced against those reported, and a trustee's statement of none against the year's reports."""
    rules = [
        {"id": "pagamentos", "type": "payment_reconciliation", "fact": "pago", "informe_path": "F", "coverage_months": ["1996-03", "1997-05", "1998-08"], "tolerance_brl": "60000"},
        {"id": "declaracao", "type": "trustee_payment_statement", "fact": "af", "informe_path": "F"},
    ]
    none = F.col("o_orderkey") % 3 == 0
    facts = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("asset"), F.when(none, "af").otherwise("pago").alias("name"), F.to_date("o_orderdate").alias("date"), F.when(none, "nenhum").otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("value"), F.lit("BRL").alias("unit"), F.col("o_orderkey").alias("source"))
    return _numeric(contracts.contract_alerts(rules, facts, _parameters(spark, sf_dir), _amounts(spark, sf_dir))).drop("instance_key")


@query(f"""
WITH {AMOUNTS_SQL}, p AS (SELECT c_custkey AS asset, '199' || (c_custkey % 10) || '-06-30' AS due FROM customer),
proof AS (SELECT DISTINCT o_custkey AS asset FROM orders WHERE o_orderstatus = 'P' AND CAST(date_trunc('quarter', o_orderdate) AS DATE) = DATE '1996-04-01'),
n AS (SELECT asset, max(month) AS month FROM a GROUP BY 1), r AS (SELECT a.* FROM a JOIN n USING (asset, month) WHERE path = 'O')
SELECT p.asset, 'prazos' AS rule, substr(due, 1, 7) AS month, 'prazo' AS instance_key, proof.asset IS NOT NULL AS compliant, CAST(datediff('day', DATE '1995-03-01', CAST(due AS DATE)) AS VARCHAR) AS value, due AS expected FROM p LEFT JOIN proof ON proof.asset = p.asset WHERE proof.asset IS NOT NULL OR datediff('day', DATE '1995-03-01', CAST(due AS DATE)) <= 200
UNION ALL SELECT o_custkey, 'sinal', strftime(date_trunc('quarter', o_orderdate), '%Y-%m'), 'divida', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) NOT LIKE 'x', CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR), '150000' FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT r.asset, 'cadastro', r.month, 'Taxa:' || instance_key, instance_key = r.asset % 4, CAST(instance_key AS VARCHAR), (r.asset % 4) || '.0' FROM r JOIN customer ON c_custkey = r.asset WHERE (r.asset % 3 = 0 AND instance_key = 1) OR (r.asset % 3 <> 0 AND instance_key = 2)""")
def contract_deadlines(spark, sf_dir):
    """RULE-09: deadlines proved, overdue or near; facts that contradict an obligation; registry values against the terms."""
    rules = [
        {"id": "prazos", "type": "obligation_deadlines", "today": "1995-03-01", "warn_days": 200, "obligations": [{"parameter": "prazo", "label": "Registro", "fulfilled_by_fact": {"fact": "divida", "reference_date": "1996-04-01"}}]},
        {"id": "sinal", "type": "fact_flag", "facts": ["divida"], "parameter": "minimo_b", "alert_values": [" NAO "]},
    ]
    registry = [{"id": "cadastro", "type": "informe_registry_vs_terms", "comparisons": [{"informe_path": "O", "parameter": "serie_{n}", "kind": "number", "label": "Taxa"}]}]
    amounts = _amounts(spark, sf_dir)
    # the registry's value is the number of the report's last line
    newest = amounts.withColumn("value", F.col("instance_key").cast("string"))
    parameters = _parameters(spark, sf_dir)
    return contracts.contract_alerts(rules, _facts(spark, sf_dir), parameters, amounts).unionByName(contracts.contract_alerts(registry, _facts(spark, sf_dir), parameters, newest))
