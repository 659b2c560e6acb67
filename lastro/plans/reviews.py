"""Requested ids, audits, proposals, golden sets and report rows (SORT-09, AUD-01, RULE-22, RULE-24, MATCH-13, SCAN-06, SCAN-08 to SCAN-10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import review
from ..sources.tables import parts, table
from .registry import query


@query("""
SELECT key, CASE WHEN c_custkey IS NULL THEN 'unknown' WHEN c_mktsegment = 'BUILDING' THEN 'selected' ELSE 'other_owner' END AS status
FROM (SELECT DISTINCT CAST(o_custkey * 2 AS VARCHAR) AS key FROM orders) LEFT JOIN customer ON key = CAST(c_custkey AS VARCHAR)""")
def requested_ids(spark, sf_dir):
    """SORT-09: ids asked for by name, each with the reason it is or isn't selected."""
    asked = table(spark, sf_dir, "orders").select(F.concat(F.lit(" "), (F.col("o_custkey") * 2).cast("string")).alias("key"))
    return review.explicit_ids(asked, table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "key"), "key", F.col("c_mktsegment") == "BUILDING")


@query("""
WITH b AS (SELECT c_custkey, to_json({'c_mktsegment': c_mktsegment})::VARCHAR AS before_json FROM customer WHERE c_nationkey < 20),
a AS (SELECT c_custkey, to_json({'c_mktsegment': CASE WHEN c_nationkey % 3 = 0 THEN lower(c_mktsegment) ELSE c_mktsegment END})::VARCHAR AS after_json FROM customer WHERE c_nationkey >= 5)
SELECT c_custkey, 'customer' AS entity_type, CASE WHEN before_json IS NULL THEN 'create' WHEN after_json IS NULL THEN 'remove' ELSE 'update' END AS action, before_json, after_json
FROM b FULL JOIN a USING (c_custkey) WHERE before_json IS DISTINCT FROM after_json""")
def audit_log(spark, sf_dir):
    """AUD-01: before and after of every changed row."""
    c = table(spark, sf_dir, "customer")
    segment = F.when(F.col("c_nationkey") % 3 == 0, F.lower("c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("c_mktsegment")
    return review.audit_rows(c.where("c_nationkey < 20").select("c_custkey", "c_mktsegment"), c.where("c_nationkey >= 5").select("c_custkey", segment), ["c_custkey"], "Customer")


@query("""
WITH r AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderstatus <> 'P' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
p AS (SELECT c_custkey, max(c_mktsegment) AS v FROM customer WHERE c_nationkey % 2 = 0 GROUP BY 1)
SELECT o_custkey AS asset_id, o_orderkey AS report_id, d AS reference_date, l_linenumber AS instance_key, max(l_returnflag) AS flag, max(l_linestatus) AS line_status,
  CASE WHEN l_linenumber = 1 THEN max(v) END AS approved_class, FALSE AS ambiguous
FROM r JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN p ON o_custkey = c_custkey GROUP BY 1, 2, 3, 4""")
def series_from_latest_report(spark, sf_dir):
    """RULE-22: the series of each asset's latest current report."""
    reports = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("asset_id"), F.col("o_orderkey").alias("report_id"), F.to_date("o_orderdate").alias("reference_date"), (F.col("o_orderstatus") != "P").alias("is_current"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("report_id"), F.col("l_linenumber").alias("instance_key"), "l_returnflag", "l_linestatus")
    leaves = lines.unpivot(["report_id", "instance_key"], ["l_returnflag", "l_linestatus"], "xml_path", "raw_text")
    # two leaves a line, in as many parts as they need: what a task sorts to find the latest reports does not grow with them
    leaves = leaves.repartition(2 * parts(lines), "report_id")
    parameters = table(spark, sf_dir, "customer").where("c_nationkey % 2 = 0").select(F.col("c_custkey").alias("asset_id"), F.lit(1).alias("instance_key"), F.col("c_mktsegment").alias("value"))
    return review.series_proposals(reports, leaves, {"flag": "l_returnflag", "line_status": "l_linestatus"}, parameters)


@query("""
WITH o AS (SELECT l_orderkey AS k, max(l_linestatus) AS status, count(*) AS n FROM lineitem GROUP BY 1)
SELECT o_orderkey AS k, concat_ws(',', CASE WHEN o_orderkey % 7 + 1 IS DISTINCT FROM n THEN 'lines' END, CASE WHEN o_orderkey % 2 = 0 AND o.status IS DISTINCT FROM 'F' THEN 'status' END) AS problems FROM orders LEFT JOIN o ON o_orderkey = k""")
def golden_set_check(spark, sf_dir):
    """RULE-24: frozen values against observed ones."""
    golden = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 2 == 0, "F").alias("status"), (F.col("o_orderkey") % 7 + 1).alias("lines"))
    seen = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_linestatus").alias("status"), F.count("*").alias("lines"))
    return review.golden_divergences(golden, seen, ["k"], ["status", "lines"]).select("k", F.concat_ws(",", "problems").alias("problems"))


@query("""
SELECT c_nationkey, count(*) AS items, count(*) FILTER (c_custkey % 50 > 0) AS approved, count(*) FILTER (c_custkey % 50 = 0) AS pending,
  concat_ws(',', CASE WHEN NOT bool_or(c_mktsegment = 'BUILDING') THEN 'BUILDING' END, CASE WHEN NOT bool_or(c_mktsegment = 'MACHINERY') THEN 'MACHINERY' END, 'RARE') AS missing,
  bool_and(c_custkey % 50 > 0) AND bool_or(c_mktsegment = 'BUILDING') AND bool_or(c_mktsegment = 'MACHINERY') AS publishable
FROM customer GROUP BY 1""")
def golden_set_coverage(spark, sf_dir):
    """RULE-24: reviewed items and cases of each layout."""
    items = table(spark, sf_dir, "customer").select("c_nationkey", F.when(F.col("c_custkey") % 50 > 0, "approved").otherwise("pending").alias("review_status"), F.array("c_mktsegment").alias("case_types"))
    return review.golden_coverage(items, ["c_nationkey"], ["BUILDING", "MACHINERY", "RARE"], ["RARE"]).withColumn("missing", F.concat_ws(",", "missing"))


@query("""SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderkey % 4 < 2 GROUP BY 1 HAVING count(DISTINCT o_orderkey) = 1""")
def only_described_asset(spark, sf_dir):
    """MATCH-13: the one text that names an asset, by ISIN or by code without another ISIN."""
    number = F.lpad(F.col("o_custkey").cast("string"), 9, "0")
    isin, code = F.concat(F.lit("BR"), number, F.lit("1")), F.concat(F.lit("C"), F.col("o_custkey"))
    kind = F.col("o_orderkey") % 4
    text = F.when(kind == 0, F.concat(F.lit("series of br"), number, F.lit("1;"))).when(kind == 1, F.concat(F.lit("emission/"), code, F.lit("-2")))
    text = text.when(kind == 2, F.concat(F.lit("emission X"), code)).otherwise(F.concat(code, F.lit(" BRXXXXXXXXX7")))
    return review.only_candidate(table(spark, sf_dir, "orders").where(review.describes_asset(text, isin, code)), "o_custkey", "o_orderkey")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey, l_linenumber) AS line_order FROM lineitem WHERE l_returnflag = 'R'""")
def fund_quota_positions(spark, sf_dir):
    """SCAN-09: the positions of one kind, numbered within holder and investee."""
    return review.position_lines(table(spark, sf_dir, "lineitem"), "l_returnflag", "R", ["l_suppkey", "l_partkey"], ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "l_partkey", "line_order")


@query("""SELECT c_custkey, c_nationkey, CASE WHEN c_nationkey < 10 THEN c_mktsegment END AS c_mktsegment FROM customer""")
def registry_scope(spark, sf_dir):
    """SCAN-06: rows out of scope keep their selection columns only."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return review.mask_out_of_scope(rows, F.col("c_nationkey") < 10, ["c_custkey", "c_nationkey"])


@query("""
SELECT o_custkey, last_day(CAST(o_orderdate AS DATE)) AS competence, count(*) AS n, CASE WHEN day(o_orderdate) <> 1 THEN 'not_first_day' WHEN count(*) > 1 THEN 'repeated' ELSE 'ok' END AS status
FROM orders GROUP BY o_custkey, o_orderdate""")
def monthly_competence(spark, sf_dir):
    """SCAN-08: reference days, month ends and repeated keys."""
    return review.competence(table(spark, sf_dir, "orders"), "o_orderdate", ["o_custkey"])


@query("""
SELECT o_custkey, o_orderkey, o_orderstatus FROM orders o WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
AND o_orderkey = (SELECT max(o_orderkey) FROM orders m WHERE m.o_custkey = o.o_custkey)""")
def filings_of_wanted(spark, sf_dir):
    """SCAN-10: the latest version of the filings that cite a wanted code."""
    wanted = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return review.filings_citing(table(spark, sf_dir, "orders"), wanted, "o_custkey", ["o_custkey"], "o_orderkey").select("o_custkey", "o_orderkey", "o_orderstatus")
