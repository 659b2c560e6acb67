"""Aggregations and domain rules (AGG-*, RULE-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import values
from ..operators import market
from ..sources.tables import parts, table
from ..streaming import windows
from .registry import query

FLAG_WEIGHTS = {"returned": 5, "discounted": 3, "taxed": 2, "large": 1}


@query("""
WITH c AS (SELECT date_trunc('month', o_orderdate) AS m, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1), p AS (SELECT *, lag(n) OVER (ORDER BY m) AS b FROM c)
SELECT strftime(coalesce(max(CASE WHEN n >= 0.9 * b THEN m END), min(m)), '%Y-%m-%d') AS reference_month FROM p""")
def reference_month(spark, sf_dir):
    """AGG-01, AGG-03."""
    orders = table(spark, sf_dir, "orders").withColumn("m", F.trunc("o_orderdate", "month"))
    return market.reference_month(orders, "m", "o_custkey").select(F.date_format("reference_month", "yyyy-MM-dd").alias("reference_month"))


@query("""SELECT o_custkey, strftime(max(o_orderdate), '%Y-%m-%d') AS last_date, strftime(min(o_orderdate), '%Y-%m-%d') AS first_date FROM orders GROUP BY 1""")
def first_and_last_dates(spark, sf_dir):
    """AGG-02."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(day(F.max("o_orderdate")).alias("last_date"), day(F.min("o_orderdate")).alias("first_date"))


@query("""
WITH s AS (SELECT l_orderkey AS k, count(*) AS n_series, sum(CASE WHEN l_extendedprice > 20 * l_quantity * 100 THEN 0 ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END) AS balance,
 bool_or(l_returnflag = 'R') AS a, bool_or(l_discount > 0.08) AS b, bool_or(l_tax > 0.07) AS c, bool_or(l_quantity > 48) AS d FROM lineitem GROUP BY 1)
SELECT k, n_series, CAST(balance AS DOUBLE) AS balance, CAST(CASE WHEN a THEN 5 ELSE 0 END + CASE WHEN b THEN 3 ELSE 0 END + CASE WHEN c THEN 2 ELSE 0 END + CASE WHEN d THEN 1 ELSE 0 END AS INTEGER) AS score FROM s""")
def emission_ranking(spark, sf_dir):
    """AGG-04, RULE-01, RULE-03, NUM-03: trusted balance and score of distinct flags, in one aggregate."""
    flags = market.flags({"returned": F.col("l_returnflag") == "R", "discounted": F.col("l_discount") > 0.08, "taxed": F.col("l_tax") > 0.07, "large": F.col("l_quantity") > 48})
    rows = table(spark, sf_dir, "lineitem").withColumn("flags", flags).withColumn("paid_in", F.col("l_quantity") * 100)
    balance = values.trusted_balance(F.col("l_extendedprice").cast("decimal(18,2)"), F.col("paid_in"))
    found = market.score_by_flags(rows, "l_orderkey", "flags", balance, FLAG_WEIGHTS)
    return found.select(F.col("l_orderkey").alias("k"), "n_series", F.col("balance").cast("double").alias("balance"), "score")


@query("""SELECT l_orderkey, bool_or(l_returnflag = 'R') AND bool_or(l_returnflag = 'N') AS mixed FROM lineitem GROUP BY 1""")
def mixed_status(spark, sf_dir):
    """AGG-05."""
    s = F.collect_set("l_returnflag")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg((F.array_contains(s, "R") & F.array_contains(s, "N")).alias("mixed"))


@query("""SELECT l_partkey, count(DISTINCT l_suppkey) AS owners, CASE WHEN count(DISTINCT l_suppkey % 5) > 1 THEN 'conflict' ELSE 'alias' END AS kind FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1""")
def repeated_identifier(spark, sf_dir):
    """AGG-06."""
    found = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("owners"), F.countDistinct(F.col("l_suppkey") % 5).alias("issuers"))
    return found.where("owners > 1").select("l_partkey", "owners", F.when(F.col("issuers") > 1, "conflict").otherwise("alias").alias("kind"))


@query("""
WITH l AS (SELECT * FROM (SELECT l_suppkey AS debtor, l_orderkey AS certificate, CAST(l_discount * 1000 AS DECIMAL(14,2)) AS share, row_number() OVER (PARTITION BY l_suppkey, l_orderkey ORDER BY l_linenumber, l_partkey, l_discount) AS rn FROM lineitem) WHERE rn = 1),
v AS (SELECT debtor, CASE WHEN share > 1 AND share <= 100 THEN share / 100 WHEN share > 0 AND share <= 1 THEN share END AS s, CAST(o_totalprice AS DECIMAL(18,2)) AS b, o_orderstatus = 'F' AS late FROM l JOIN orders ON certificate = o_orderkey)
SELECT debtor, count(*) AS n_certificates, count(*) FILTER (late) AS n_late, count(*) FILTER (s IS NULL) AS n_invalid_share, round(coalesce(sum(CAST(s AS DOUBLE) * CAST(b AS DOUBLE)), 0), 2) AS exposure, count(*) FILTER (late) > 0 AND count(*) FILTER (late) < count(*) AS contagion FROM v GROUP BY 1""")
def exposure_contagion(spark, sf_dir):
    """AGG-07, NUM-02: the first link of a pair counts; shares over 1 are percentages; contagion is some late, not all."""
    links = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("debtor"), F.col("l_orderkey").alias("certificate"), (F.col("l_discount") * 1000).cast("decimal(14,2)").alias("share"), F.struct("l_linenumber", "l_partkey", "l_discount").alias("position"))
    certificates = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("certificate"), F.col("o_totalprice").cast("decimal(18,2)").alias("balance"), (F.col("o_orderstatus") == "F").alias("late"))
    found = market.exposure(links, certificates)
    return found.select("debtor", "n_certificates", "n_late", "n_invalid_share", F.round(F.col("exposure").cast("double"), 2).alias("exposure"), "contagion")


@query("""
WITH d AS (SELECT l_suppkey AS k, datediff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS delay, l_returnflag = 'R' AS returned, CAST(l_extendedprice AS DECIMAL(18,2)) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT k, median(delay) AS median_delay, round(100.0 * count(*) FILTER (delay > 60) / count(*), 4) AS pct_late, round(100.0 * count(*) FILTER (returned) / count(*), 4) AS per_100, CAST(sum(v) AS DOUBLE) AS balance FROM d GROUP BY 1""")
def issuer_scorecard(spark, sf_dir):
    """AGG-08, DATE-03: median delay, share late and restated, balances, in one pass."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.select(F.col("l_suppkey").alias("k"), F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate")).alias("delay"), (F.col("l_returnflag") == "R").alias("returned"), F.col("l_extendedprice").cast("decimal(18,2)").alias("v"))
    per_100 = lambda c: F.round(F.lit(100.0) * F.count_if(c) / F.count("*"), 4)
    return rows.groupBy("k").agg(F.median("delay").alias("median_delay"), per_100(F.col("delay") > 60).alias("pct_late"), per_100(F.col("returned")).alias("per_100"), F.sum("v").cast("double").alias("balance"))


@query("""
SELECT p_brand, t.l_returnflag, CASE WHEN coalesce(a, 0) > 0 THEN 'approved' WHEN coalesce(p, 0) > 0 THEN 'pending' ELSE 'missing' END AS status
FROM (SELECT DISTINCT p_brand FROM part) b CROSS JOIN (VALUES ('A'),('N'),('R')) t(l_returnflag) LEFT JOIN
(SELECT p_brand AS b2, l_returnflag AS f2, count(*) FILTER (l_quantity = 50 AND l_tax = 0.08) AS a, count(*) FILTER (l_quantity = 49 AND l_tax = 0.08) AS p FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2) c ON b2 = p_brand AND f2 = t.l_returnflag""")
def covered_fields(spark, sf_dir):
    """AGG-09: every asset and field, a status by precedence; the fields are a fixed short list."""
    lines = table(spark, sf_dir, "lineitem")
    grid = table(spark, sf_dir, "part").select("p_brand").distinct().withColumn("l_returnflag", F.explode(F.array(*[F.lit(f) for f in "ANR"])))
    counts = lines.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand", "l_returnflag").agg(F.count_if((F.col("l_quantity") == 50) & (F.col("l_tax") == 0.08)).alias("a"), F.count_if((F.col("l_quantity") == 49) & (F.col("l_tax") == 0.08)).alias("p"))
    status = F.when(F.col("a") > 0, "approved").when(F.col("p") > 0, "pending").otherwise("missing")
    return grid.join(counts, ["p_brand", "l_returnflag"], "left").select("p_brand", "l_returnflag", status.alias("status"))


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2""")
def status_counts(spark, sf_dir):
    """AGG-10, AGG-11."""
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("""SELECT l_orderkey, string_agg(DISTINCT l_returnflag || l_linestatus, ' ; ' ORDER BY l_returnflag || l_linestatus) AS findings FROM lineitem GROUP BY 1""")
def findings_text(spark, sf_dir):
    """AGG-12."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set(F.concat("l_returnflag", "l_linestatus"))), " ; ").alias("findings"))


@query("""
WITH m AS (SELECT *, median(value) OVER (PARTITION BY event_type) AS md, count(value) OVER (PARTITION BY event_type) AS n FROM events), d AS (SELECT *, median(abs(value - md)) OVER (PARTITION BY event_type) AS mad FROM m)
SELECT event_id, event_type, round(abs(value - md) / (1.4826 * mad), 6) AS z FROM d WHERE n >= 12 AND mad > 0 AND abs(value - md) / (1.4826 * mad) > 5""")
def robust_outliers(spark, sf_dir):
    """AGG-13, RULE-07."""
    found = market.outliers(table(spark, sf_dir, "events"), "event_type", "value", 5)
    return found.select("event_id", "event_type", F.round("z", 6).alias("z"))


@query("""
SELECT l_orderkey, CAST(sum(CASE WHEN l_returnflag = 'R' THEN -CAST(l_extendedprice AS DECIMAL(18,2)) ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END) AS DOUBLE) AS leaf_sum,
 abs(CAST(sum(CASE WHEN l_returnflag = 'R' THEN -CAST(l_extendedprice AS DECIMAL(18,2)) ELSE CAST(l_extendedprice AS DECIMAL(18,2)) END) AS DOUBLE) - o_totalprice) <= 0.01 * greatest(1.0, abs(o_totalprice)) / 100 AS agrees FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey, o_totalprice""")
def declared_totals(spark, sf_dir):
    """AGG-14, NUM-05: declared totals against the sum of their leaves, signs inverted where declared."""
    v = F.col("l_extendedprice").cast("decimal(18,2)")
    sums = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(F.when(F.col("l_returnflag") == "R", -v).otherwise(v)).cast("double").alias("leaf_sum"))
    joined = sums.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select("l_orderkey", "leaf_sum", values.within_tolerance(F.col("leaf_sum"), F.col("o_totalprice")).alias("agrees"))


@query("""SELECT l_orderkey, round(arg_min(l_extendedprice, l_linenumber * 1000000 + l_partkey + l_extendedprice / 10000000) / CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE), 6) AS ratio FROM lineitem GROUP BY 1""")
def scale_ratio(spark, sf_dir):
    """AGG-15: the first value over the sum of all."""
    first = F.min_by("l_extendedprice", F.col("l_linenumber") * 1000000 + F.col("l_partkey") + F.col("l_extendedprice") / 10000000)
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.round(first / F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double"), 6).alias("ratio"))


@query("""
WITH m AS (SELECT o_custkey, date_trunc('month', o_orderdate) AS mo, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS v FROM orders GROUP BY 1, 2)
SELECT a.o_custkey, strftime(a.mo, '%Y-%m-%d') AS month, CAST(sum(b.v) AS DOUBLE) AS trailing FROM m a JOIN m b ON a.o_custkey = b.o_custkey AND b.mo BETWEEN a.mo - INTERVAL 11 MONTH AND a.mo GROUP BY 1, 2""")
def trailing_year(spark, sf_dir):
    """AGG-16, DATE-02: the sum over the trailing twelve months, as a range frame over the month number."""
    from pyspark.sql import Window

    months = table(spark, sf_dir, "orders").groupBy("o_custkey", F.trunc("o_orderdate", "month").alias("m")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("v"))
    w = Window.partitionBy("o_custkey").orderBy(values.month_index(F.col("m"))).rangeBetween(-11, 0)
    return months.select("o_custkey", F.date_format("m", "yyyy-MM-dd").alias("month"), F.sum("v").over(w).cast("double").alias("trailing"))


@query("""SELECT CASE WHEN d <= 0 THEN 'in_time' WHEN d <= 30 THEN 'to_30' WHEN d <= 90 THEN 'to_90' ELSE 'over_90' END AS band, count(*) AS n FROM (SELECT datediff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1""")
def delay_bands(spark, sf_dir):
    """AGG-17."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    d = F.datediff(F.to_date("l_shipdate"), F.to_date("o_orderdate"))
    return rows.groupBy(market.band(d, [0, 30, 90], ["in_time", "to_30", "to_90", "over_90"]).alias("band")).agg(F.count("*").alias("n"))


@query("""SELECT event_type, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 6) AS recall, count(*) AS n FROM events GROUP BY 1""")
def field_recall(spark, sf_dir):
    """AGG-18."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg(F.when(F.col("value") > 50, 1.0).otherwise(0.0)), 6).alias("recall"), F.count("*").alias("n"))


@query("""SELECT l_partkey, count(DISTINCT l_orderkey) AS files, min(l_linenumber) AS least, max(l_linenumber) AS most, bool_or(l_tax > 0.07) AS any_flag FROM lineitem GROUP BY 1""")
def file_summaries(spark, sf_dir):
    """AGG-19."""
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_orderkey").alias("files"), F.min("l_linenumber").alias("least"), F.max("l_linenumber").alias("most"), F.bool_or(F.col("l_tax") > 0.07).alias("any_flag"))


@query("""SELECT l_orderkey, l_suppkey, count(DISTINCT l_returnflag || '|' || l_linestatus) = 1 AS consistent FROM lineitem GROUP BY 1, 2""")
def consistent_registrations(spark, sf_dir):
    """AGG-21: all rows equal outside the role columns; struct equality is null-safe."""
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg((F.countDistinct(F.struct("l_returnflag", "l_linestatus")) == 1).alias("consistent"))


@query("""SELECT o_custkey, CASE WHEN count(*) FILTER (o_totalprice > 450000) > 0 THEN 'invalid' WHEN count(*) FILTER (o_totalprice > 350000) > 0 THEN 'warning' ELSE 'valid' END AS status FROM orders GROUP BY 1""")
def report_status(spark, sf_dir):
    """AGG-22."""
    p = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(market.quality_status(F.count_if(p > 450000), F.count_if(p > 350000)).alias("status"))


@query("""
SELECT 'negative_balance' AS rule, 'error' AS severity, CAST(c_custkey AS VARCHAR) AS row_id FROM customer WHERE c_acctbal < 0
UNION ALL SELECT 'no_orders', 'warning', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'shipped_before_order', 'error', CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate
UNION ALL SELECT 'stale', 'warning', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1995-06-01'""")
def quality_checks_union(spark, sf_dir):
    """FILT-06, FILT-07, in the form of RULE-08's rows: one DataFrame a rule, put together."""
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    idle = customer.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate")
    # both sides in as many parts as the lines need, so that what a task sorts does not grow with them
    n = parts(lines)
    lines = lines.repartition(n, "l_orderkey").join(orders.select("o_orderkey", "o_orderdate").repartition(n, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    found = [
        market.issue(customer, "negative_balance", "error", F.col("c_custkey"), F.col("c_acctbal") < 0),
        market.issue(idle, "no_orders", "warning", F.col("c_custkey"), F.lit(True)),
        market.issue(lines, "shipped_before_order", "error", F.col("l_orderkey") * 10 + F.col("l_linenumber"), F.col("l_shipdate") < F.col("o_orderdate")),
        market.issue(orders, "stale", "warning", F.col("o_orderkey"), (F.col("o_orderstatus") == "O") & (F.col("o_orderdate") < F.lit("1995-06-01").cast("timestamp"))),
    ]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


@query("""
WITH a AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 9 <> 0 THEN c_nationkey END AS issuer FROM customer)
SELECT 'DEBENTURE_WITHOUT_ISSUER' AS rule, 'warning' AS severity, CAST(id AS VARCHAR) AS row_id FROM a WHERE issuer IS NULL
UNION ALL SELECT 'DEBENTURE_WITHOUT_OBSERVATIONS', 'warning', CAST(id AS VARCHAR) FROM a WHERE id NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'NON_POSITIVE_FINANCIAL_VALUE', 'critical', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 4 < 2 AND o_totalprice - 20000 <= 0
UNION ALL SELECT 'SUSPECT_OBSERVATION', 'warning', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderpriority LIKE '%5%' OR o_orderpriority LIKE '%LOW%'
UNION ALL SELECT 'STALE_CURRENT_OBSERVATION', 'warning', CAST(max(o_orderkey) AS VARCHAR) FROM orders GROUP BY o_custkey HAVING arg_max(o_orderdate, o_orderkey) < TIMESTAMP '1996-01-01'
UNION ALL SELECT 'OPEN_DATA_CONFLICT', 'critical', CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal < 0
UNION ALL SELECT 'FAILED_COLLECTION', 'warning', CAST(n_nationkey AS VARCHAR) FROM nation WHERE n_regionkey = 2""")
def debenture_quality(spark, sf_dir):
    """RULE-08: the seven quality checks."""
    orders = table(spark, sf_dir, "orders")
    assets = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 9 != 0, F.col("c_nationkey")).alias("issuer_id"))
    suspect = F.col("o_orderpriority").contains("5") | F.col("o_orderpriority").contains("LOW")
    observations = orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("asset_id"),
        F.when(F.col("o_orderkey") % 4 == 0, "valor_nominal").when(F.col("o_orderkey") % 4 == 1, "quantidade_emitida").otherwise("taxa").alias("field_name"),
        F.when(F.col("o_orderstatus") == "P", "text").otherwise("numeric").alias("value_type"),
        (F.col("o_totalprice") - 20000).alias("value_numeric"),
        F.when(suspect, "suspect").otherwise("confirmed").alias("confidence"),
    )
    current = orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("id"), F.max_by("o_orderdate", "o_orderkey").alias("observed_at"))
    conflicts = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.when(F.col("s_acctbal") < 0, "open").otherwise("resolved").alias("status"))
    runs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), F.when(F.col("n_regionkey") == 2, "failed").otherwise("done").alias("status"))
    return market.debenture_quality(assets, observations, current, conflicts, runs, F.lit("1996-01-01").cast("timestamp"))


@query("""
WITH s AS (SELECT s_nationkey, CAST(sum(CASE WHEN s_acctbal < 0 THEN 1 ELSE 0 END) AS BIGINT) AS c, count(*) FILTER (s_acctbal BETWEEN 0 AND 3000) AS w FROM supplier GROUP BY 1)
SELECT s_nationkey, CASE WHEN c > 0 THEN 'critical' WHEN w > 0 THEN 'attention' ELSE 'healthy' END AS status FROM s""")
def quality_health(spark, sf_dir):
    """RULE-08: a report's status from its counts of problems."""
    b = F.col("s_acctbal")
    return table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(market.health(F.count_if(b < 0), F.count_if(b.between(0, 3000))).alias("status"))


@query("""
WITH f AS (SELECT c_custkey, c_acctbal < -900 AS a, c_acctbal < 0 AS l, coalesce(n, 0) AS n, c_acctbal BETWEEN 0 AND 900 AS q, c_mktsegment = 'BUILDING' AS g FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = c_custkey)
SELECT c_custkey, CAST(CASE WHEN a THEN 1 WHEN l THEN 2 WHEN n > 18 OR q THEN 3 WHEN g THEN 4 ELSE 5 END AS INTEGER) AS level,
 concat_ws(' ; ', CASE WHEN a THEN 'ata' WHEN l THEN 'atraso' END, CASE WHEN n > 18 THEN 'atas_recentes' END, CASE WHEN q THEN 'df' END, CASE WHEN g THEN 'ranking' END) AS reasons FROM f""")
def watch_level(spark, sf_dir):
    """RULE-13, RULE-19: the watch level, and all reasons from the level's own on."""
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    b = F.col("c_acctbal")
    joined = table(spark, sf_dir, "customer").join(n, F.col("c_custkey") == F.col("o_custkey"), "left")
    found = market.watch_reasons({"ata": b < -900}, {"atraso": b < 0}, {"atas_recentes": F.col("n") > 18, "df": b.between(0, 900)}, {"ranking": F.col("c_mktsegment") == "BUILDING"})
    return joined.select("c_custkey", found["level"].alias("level"), F.array_join(found["reasons"], " ; ").alias("reasons"))


@query("""
WITH t AS (SELECT o_custkey AS k, o_orderkey AS m, CASE o_orderkey % 3 WHEN 0 THEN 'adimplente' WHEN 1 THEN 'em atraso' ELSE '' END AS s, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'br' || lower(left(o_orderpriority, 1)) END AS r, strftime(o_orderdate, '%Y-%m') AS d, o_orderkey % 7 AS q, CAST(floor(o_totalprice / 1000) AS BIGINT) - 100 AS b0 FROM orders),
u AS (SELECT *, CASE WHEN b0 < 0 THEN 0 ELSE b0 END AS b, lag(s) OVER w AS ps, lag(r) OVER w AS pr, lag(d) OVER w AS pd, lag(q) OVER w AS pq, lag(CASE WHEN b0 < 0 THEN 0 ELSE b0 END) OVER w AS pb, lag(m) OVER w AS pm FROM t WINDOW w AS (PARTITION BY k ORDER BY m)),
e AS (SELECT k, m, pm, unnest(list_filter([CASE WHEN ps = 'adimplente' AND s = 'em atraso' THEN 'entrou_em_atraso' END, CASE WHEN ps = 'em atraso' AND s = 'adimplente' THEN 'saiu_do_atraso' END, CASE WHEN pr <> '' AND r <> '' AND pr <> r THEN 'rating_mudou' END, CASE WHEN pd <> d THEN 'vencimento_mudou' END, CASE WHEN pq > 1 AND q > 1 AND pq <> q THEN 'taxa_mudou' END, CASE WHEN pb > 0 AND b = 0 THEN 'saldo_zerou' END, CASE WHEN pb > 0 AND b <> 0 AND CAST(pb - b - 5 AS DOUBLE) / pb > 0.1 THEN 'saldo_caiu_sem_amortizacao' END], lambda x: x IS NOT NULL)) AS event FROM u WHERE pm IS NOT NULL)
SELECT k, m AS month, pm AS previous_month, event FROM e""")
def series_events(spark, sf_dir):
    """RULE-05: the seven events of a series between two reported months."""
    k = F.col("o_orderkey")
    balance = F.floor(F.col("o_totalprice") / 1000) - 100
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("k"),
        k.alias("month"),
        F.when(k % 3 == 0, " Adimplente").when(k % 3 == 1, "Em  atraso").otherwise("").alias("status"),
        F.when(k % 4 == 0, "Não há").otherwise(F.concat(F.lit("br"), F.substring("o_orderpriority", 1, 1))).alias("rating"),
        F.date_format("o_orderdate", "yyyy-MM").alias("due"),
        F.when(k % 7 < 2, "a definir").otherwise(F.concat(F.lit("CDI + "), k % 7, F.lit(",001% a.a."))).alias("rate"),
        F.when(balance < 0, "0").otherwise(balance.cast("string")).alias("balance"),
        F.lit("5").alias("amortised"),
    )
    return market.series_events(rows, ["k"], "month")


@query("""
WITH m AS (SELECT o_orderkey, [CAST(o_custkey AS VARCHAR), CAST(o_custkey + 1000000 AS VARCHAR)] AS codes, strftime(o_orderdate, '%Y-%m') AS month, o_orderkey % 5 AS g, o_orderstatus AS st, 1 AS one FROM orders WHERE NOT (o_orderkey % 7 = 0 AND o_orderstatus = 'O')),
x AS (SELECT *, unnest(codes) AS code, unnest([1, 2]) AS place FROM m)
SELECT code, CASE WHEN place = 1 THEN 'BR' || o_orderkey ELSE '' END AS isin, coalesce(c_name, '') AS issuer, coalesce(c_mktsegment, 'fonte') AS debtor, month, CASE g WHEN 0 THEN 'fundo' WHEN 1 THEN 'covenant' WHEN 2 THEN 'garantia' ELSE 'obrigacao' END AS item_group,
 CASE g WHEN 0 THEN 'Saldo do Fundo' WHEN 1 THEN 'Indicadores · Índice de cobertura' WHEN 2 THEN 'Cessão fiduciária' ELSE 'Envio de relatório' END AS item, CASE WHEN o_orderkey % 7 = 0 THEN '' ELSE '1,20 ou mais' END AS required, CASE WHEN st = 'O' THEN '' ELSE st END AS status
FROM x LEFT JOIN customer ON code = CAST(c_custkey AS VARCHAR)""")
def monthly_covenants(spark, sf_dir):
    """RULE-25: the monthly table of covenants, funds, guarantees and obligations of each certificate."""
    k, g = F.col("o_orderkey"), F.col("o_orderkey") % 5
    code = F.col("o_custkey").cast("string")
    monitors = table(spark, sf_dir, "orders").select(
        F.concat(code, F.lit("; "), (F.col("o_custkey") + 1000000).cast("string")).alias("codes"),
        F.concat(F.lit("BR"), k.cast("string")).alias("isins"),
        F.date_format("o_orderdate", "yyyy-MM").alias("month"),
        F.when(g == 0, "Fundo de reserva").otherwise("Item").alias("kind"),
        F.when(g == 1, "Indicadores").when(g == 2, "GARANTIAS").otherwise("").alias("group_title"),
        F.when(g == 0, "Saldo do Fundo").when(g == 1, "Índice de cobertura").when(g == 2, "Cessão fiduciária").otherwise("Envio de relatório").alias("item"),
        F.when(k % 7 == 0, "").otherwise("1,20").alias("reference"),
        F.when(k % 7 == 0, "").otherwise("ou mais").alias("condition_text"),
        F.lit("").alias("condition"),
        F.lit("").alias("measured"),
        F.when(F.col("o_orderstatus") == "O", "").otherwise(F.col("o_orderstatus")).alias("status"),
        F.lit("fonte").alias("debtor"),
    )
    registry = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("code"), F.lit("").alias("isin"), F.col("c_name").alias("issuer"), F.col("c_mktsegment").alias("debtor"))
    return market.monthly_covenants(monitors, registry).drop("measured")


@query("""
WITH c AS (SELECT l_orderkey AS k, count(DISTINCT l_suppkey) AS n, min(l_suppkey) AS s FROM lineitem GROUP BY 1)
SELECT k, CASE WHEN n > 2 THEN 'conflict' WHEN n = 2 THEN 'candidate' WHEN s % 2 = 0 THEN 'confirmed' ELSE 'applied' END AS decision FROM c""")
def identifier_resolution(spark, sf_dir):
    """A decision from the set of identifiers found."""
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set("l_suppkey").alias("v"))
    n, first = F.size("v"), F.array_min("v")
    return c.select("k", F.when(n > 2, "conflict").when(n == 2, "candidate").when(first % 2 == 0, "confirmed").otherwise("applied").alias("decision"))


@query("""
WITH r AS (SELECT o_custkey, o_orderkey, o_orderstatus <> 'F' AS open, o_orderdate, rank() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus <> 'F' THEN 0 ELSE 1 END, o_orderdate DESC) AS rk FROM orders), b AS (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS n FROM r WHERE rk = 1)
SELECT o_custkey, CASE WHEN n > 1 THEN 'tie' WHEN NOT open THEN 'cancelled' ELSE 'selected' END AS reason, min(o_orderkey) AS o_orderkey FROM b GROUP BY 1, 2""")
def current_registration(spark, sf_dir):
    """RULE-15: not cancelled first, newest date, with the reason of exclusion in a fixed order."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey")
    is_open = F.col("o_orderstatus") != "F"
    best = table(spark, sf_dir, "orders").withColumn("rk", F.rank().over(w.orderBy(is_open.desc(), F.col("o_orderdate").desc()))).where("rk = 1").withColumn("n", F.count("*").over(w))
    reason = F.when(F.col("n") > 1, "tie").when(~is_open, "cancelled").otherwise("selected")
    return best.groupBy("o_custkey", reason.alias("reason")).agg(F.min("o_orderkey").alias("o_orderkey"))


@query("""
SELECT l_orderkey, CASE WHEN count(*) = 1 THEN 'one_source' WHEN count(DISTINCT round(l_discount, 2)) = 1 THEN 'agree' WHEN max(l_discount) - min(l_discount) <= 0.0301 THEN 'compatible' ELSE 'diverge' END AS verdict FROM lineitem GROUP BY 1""")
def cross_document_verdict(spark, sf_dir):
    """Values of several documents, by their spread."""
    d = F.col("l_discount")
    verdict = F.when(F.count("*") == 1, "one_source").when(F.countDistinct(F.round(d, 2)) == 1, "agree").when(F.max(d) - F.min(d) <= 0.0301, "compatible").otherwise("diverge")
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(verdict.alias("verdict"))


@query("""
WITH m AS (SELECT l_orderkey, bool_or(l_returnflag = 'R') AS late FROM lineitem WHERE l_linenumber > 2 GROUP BY 1)
SELECT o_orderkey, late AS market_late, o_orderstatus = 'F' AS portal_late, CASE WHEN late IS NULL THEN 'not_in_market' WHEN late = (o_orderstatus = 'F') THEN 'agrees' ELSE 'differs' END AS outcome FROM orders LEFT JOIN m ON o_orderkey = l_orderkey""")
def portal_against_market(spark, sf_dir):
    """RULE-18: a portal's status against the market's; what only the portal has keeps its row."""
    late = table(spark, sf_dir, "lineitem").where("l_linenumber > 2").groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("market_late"))
    joined = table(spark, sf_dir, "orders").join(late, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    portal = F.col("o_orderstatus") == "F"
    outcome = F.when(F.col("market_late").isNull(), "not_in_market").when(F.col("market_late") == portal, "agrees").otherwise("differs")
    return joined.select("o_orderkey", "market_late", portal.alias("portal_late"), outcome.alias("outcome"))


@query("""SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY 1, 2""")
def hourly_events(spark, sf_dir):
    """STRM-00, an extension: the batch form of the windowed stream."""
    return windows.windowed_counts(table(spark, sf_dir, "events")).withColumn("total", F.col("total").cast("double"))
