"""Current values, versions, windows, top-k (WIN-*, SORT-*, LINE-01, SCAN-15)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import market, versions
from ..sources.tables import table
from .registry import query

PRIORITIES = "SELECT * FROM (VALUES ('1-URGENT',300,false),('2-HIGH',200,true),('3-MEDIUM',100,true),('4-NOT SPECIFIED',100,true),('5-LOW',50,true)) s(source_id,priority,active)"


@query(f"""
WITH s AS ({PRIORITIES})
SELECT o_custkey, o_orderkey, o_totalprice, priority FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY priority DESC, o_orderdate DESC, o_orderkey DESC) AS rn
  FROM orders JOIN s ON o_orderpriority = source_id WHERE active) WHERE rn = 1""")
def priority_current_value(spark, sf_dir):
    """WIN-01, JOIN-01: the current observation of each customer, by source priority; inactive sources are left out."""
    sources = spark.createDataFrame([("1-URGENT", 300, False), ("2-HIGH", 200, True), ("3-MEDIUM", 100, True), ("4-NOT SPECIFIED", 100, True), ("5-LOW", 50, True)], "source_id string, priority int, active boolean")
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "source_id")
    found = versions.current_values(orders, sources, ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()])
    return found.select("o_custkey", "o_orderkey", "o_totalprice", "priority")


@query("""
SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_linenumber DESC, l_shipdate DESC, l_orderkey DESC) AS rn FROM lineitem) WHERE rn = 1""")
def latest_version_filing(spark, sf_dir):
    """WIN-02: the row of the highest version of each filing."""
    order = [F.col(c).desc() for c in ("l_linenumber", "l_shipdate", "l_orderkey")]
    return versions.first_rows(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"], order).select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber")


@query("""
SELECT o_custkey, o_orderstatus, o_orderkey FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def latest_series_row(spark, sf_dir):
    """WIN-03, WIN-04: the newest row of each series, ties to the smallest key."""
    return versions.first_rows(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"], [F.col("o_orderdate").desc(), F.col("o_orderkey")]).select("o_custkey", "o_orderstatus", "o_orderkey")


@query("""
SELECT l_orderkey, l_linenumber, l_suppkey FROM (
  SELECT *, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC) AS r FROM lineitem) WHERE r = 1""")
def latest_version_rows(spark, sf_dir):
    """WIN-05: all rows of the newest version of each certificate."""
    return versions.rows_of_first(table(spark, sf_dir, "lineitem"), ["l_orderkey"], [F.col("l_shipdate").desc()]).select("l_orderkey", "l_linenumber", "l_suppkey")


@query("""
SELECT o_custkey, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS month, o_orderkey FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey, date_trunc('month', o_orderdate) ORDER BY o_totalprice DESC, o_orderkey DESC) AS rn
  FROM orders WHERE o_orderstatus = 'F') WHERE rn = 1""")
def approved_report(spark, sf_dir):
    """WIN-06: the current report of each asset and month: approved ones only, highest version."""
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").withColumn("month", F.date_format(F.trunc("o_orderdate", "month"), "yyyy-MM-dd"))
    return versions.first_rows(orders, ["o_custkey", "month"], [F.col("o_totalprice").desc(), F.col("o_orderkey").desc()]).select("o_custkey", "month", "o_orderkey")


@query("""
SELECT user_id, event_id, severity, previous_severity FROM (
  SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 ELSE 1 END AS severity,
    lag(CASE event_type WHEN 'error' THEN 3 WHEN 'purchase' THEN 2 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_severity FROM events)
WHERE severity > previous_severity""")
def opinion_worsened(spark, sf_dir):
    """WIN-07, RULE-11: statements whose opinion is worse than that of the statement before."""
    events = table(spark, sf_dir, "events").withColumn("severity", F.when(F.col("event_type") == "error", 3).when(F.col("event_type") == "purchase", 2).otherwise(1))
    return versions.previous(events, ["user_id"], ["ts", "event_id"], ["severity"], "previous_").where("severity > previous_severity").select("user_id", "event_id", "severity", "previous_severity")


@query("""
WITH m AS (SELECT user_id, date_trunc('day', ts) AS d, sum(CAST(value AS DECIMAL(18,2))) AS v FROM events GROUP BY 1, 2),
p AS (SELECT *, lag(d) OVER w AS pd, lag(v) OVER w AS pv FROM m WINDOW w AS (PARTITION BY user_id ORDER BY d))
SELECT user_id, strftime(d, '%Y-%m-%d') AS day, strftime(pd, '%Y-%m-%d') AS previous_day, CAST(v AS DOUBLE) AS value, CAST(pv AS DOUBLE) AS previous_value FROM p
WHERE pd IS NOT NULL AND pv > 0 AND (CAST(pv AS DOUBLE) - CAST(v AS DOUBLE)) / CAST(pv AS DOUBLE) > 0.1""")
def month_events(spark, sf_dir):
    """WIN-08, RULE-05: an unexplained drop of over 10% from the period reported before."""
    days = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("d")).agg(F.sum(F.col("value").cast("decimal(18,2)")).cast("double").alias("value"))
    found = market.month_changes(days, ["user_id"], "d", "value").where("dropped and previous_value > 0")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return found.select("user_id", day("d").alias("day"), day("previous_month").alias("previous_day"), "value", "previous_value")


@query("""
WITH m AS (SELECT o_custkey, year(o_orderdate) * 12 + month(o_orderdate) - 1 AS i, min(o_orderkey) AS first_order FROM orders GROUP BY 1, 2),
p AS (SELECT *, i - lag(i) OVER (PARTITION BY o_custkey ORDER BY i) AS months FROM m)
SELECT o_custkey, CAST(i AS INTEGER) AS month_index, CAST(months AS INTEGER) AS months FROM p WHERE months <> 1""")
def reporting_gaps(spark, sf_dir):
    """WIN-09, DATE-01: months that don't follow the month before."""
    months = table(spark, sf_dir, "orders").select("o_custkey", F.trunc("o_orderdate", "month").alias("m")).distinct()
    return market.gaps(months, ["o_custkey"], "m").select("o_custkey", (F.year("m") * 12 + F.month("m") - 1).alias("month_index"), "months")


@query("""
WITH w AS (SELECT o_custkey, o_orderkey, o_totalprice AS b, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders)
SELECT o_custkey, o_orderkey, round(p * 1.01 - 1000, 2) AS expected, abs(p * 1.01 - 1000 - b) > 50000 AS deviates FROM w WHERE p IS NOT NULL""")
def rolled_balance(spark, sf_dir):
    """WIN-10: the balance rolled forward against the reported one."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rolled = table(spark, sf_dir, "orders").withColumn("e", market.rolled("o_totalprice", F.lit(0.01), F.lit(1000), w)).where("e is not null")
    return rolled.select("o_custkey", "o_orderkey", F.round("e", 2).alias("expected"), (F.abs(F.col("e") - F.col("o_totalprice")) > 50000).alias("deviates"))


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber, string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) AS parties FROM lineitem GROUP BY 1, 2),
q AS (SELECT *, lag(parties) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS previous FROM p)
SELECT l_orderkey, l_linenumber, parties, previous FROM q WHERE previous IS NOT NULL AND parties <> previous""")
def party_set_changed(spark, sf_dir):
    """WIN-11: the set of parties differs from the period before."""
    sets = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.array_join(F.array_sort(F.collect_set(F.col("l_suppkey").cast("string"))), ",").alias("parties"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    return sets.withColumn("previous", F.lag("parties").over(w)).where("previous is not null and parties <> previous")


@query("""
SELECT l_orderkey, l_linenumber, l_quantity FROM (
  SELECT *, rank() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC) AS r FROM lineitem) WHERE r = 1
QUALIFY count(*) OVER (PARTITION BY l_orderkey) = 1""")
def best_without_tie(spark, sf_dir):
    """WIN-12: the best row of each key where it is the only best."""
    return versions.unique_first(table(spark, sf_dir, "lineitem"), ["l_orderkey"], [F.col("l_quantity").desc()]).select("l_orderkey", "l_linenumber", "l_quantity")


@query("""
WITH a AS (SELECT * FROM (VALUES ('PROMO',1),('STANDARD',2),('SMALL',3)) t(alias, alias_rank))
SELECT p_brand, p_partkey, alias FROM (
  SELECT p_brand, p_partkey, alias, row_number() OVER (PARTITION BY p_brand ORDER BY alias_rank, p_partkey) AS rn FROM part JOIN a ON p_type = alias) WHERE rn = 1""")
def preferred_indicator(spark, sf_dir):
    """WIN-14: the preferred name that a subject has, then the first row."""
    aliases = spark.createDataFrame([("PROMO", 1), ("STANDARD", 2), ("SMALL", 3)], "alias string, alias_rank int")
    return versions.first_rows(table(spark, sf_dir, "part").join(F.broadcast(aliases), F.col("p_type") == F.col("alias")), ["p_brand"], ["alias_rank", "p_partkey"]).select("p_brand", "p_partkey", "alias")


@query("""
SELECT l_orderkey, l_linenumber FROM (SELECT *, max(l_shipdate) OVER (PARTITION BY l_orderkey, l_suppkey) AS m FROM lineitem) WHERE l_shipdate = m""")
def latest_extraction_run(spark, sf_dir):
    """WIN-15: rows of the newest run of each version, without a correlated subquery."""
    newest = F.max("l_shipdate").over(Window.partitionBy("l_orderkey", "l_suppkey"))
    return table(spark, sf_dir, "lineitem").withColumn("m", newest).where("l_shipdate = m").select("l_orderkey", "l_linenumber")


@query("""
WITH c AS (SELECT 'p' || l_partkey AS code, l_shipdate, l_returnflag, l_orderkey, l_linenumber FROM lineitem UNION ALL SELECT 's' || l_suppkey, l_shipdate, l_returnflag, l_orderkey, l_linenumber FROM lineitem)
SELECT code, l_returnflag AS situation FROM (SELECT *, row_number() OVER (PARTITION BY code ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_returnflag DESC) AS rn FROM c) WHERE rn = 1""")
def latest_situation(spark, sf_dir):
    """WIN-17: the latest situation of every code, by either identifier, as one aggregate."""
    codes = F.explode(F.array(F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("s"), "l_suppkey")))
    rows = table(spark, sf_dir, "lineitem").select(codes.alias("code"), "l_shipdate", "l_returnflag", "l_orderkey", "l_linenumber")
    return rows.groupBy("code").agg(F.max(F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_returnflag")).getField("l_returnflag").alias("situation"))


@query("""
WITH m AS (SELECT * FROM (SELECT *, strftime(o_orderdate, '%Y-%m') AS mo, row_number() OVER (PARTITION BY o_custkey, strftime(o_orderdate, '%Y-%m') ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1),
h AS (SELECT *, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY mo) AS prev, row_number() OVER (PARTITION BY o_custkey ORDER BY mo DESC) AS back FROM m)
SELECT o_custkey, mo AS month, o_orderstatus AS status, coalesce(prev <> o_orderstatus, false) AS changed FROM h WHERE back <= 6""")
def emission_history(spark, sf_dir):
    """WIN-18: the last six months of each emission, each against the month before."""
    months = versions.first_rows(table(spark, sf_dir, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM")), ["o_custkey", "month"], ["o_orderdate", "o_orderkey"])
    found = versions.previous(months, ["o_custkey"], ["month"], ["o_orderstatus"])
    last = versions.first_rows(found, ["o_custkey"], [F.col("month").desc()], 6)
    return last.select("o_custkey", "month", F.col("o_orderstatus").alias("status"), F.coalesce(F.col("prev_o_orderstatus") != F.col("o_orderstatus"), F.lit(False)).alias("changed"))


@query("""
WITH r AS (SELECT o_orderstatus, o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000),
a AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus, o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS i FROM r),
b AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS k FROM a WHERE i <= 4)
SELECT o_orderstatus, o_custkey, o_orderkey FROM b WHERE k <= 15""")
def greedy_capped_topk(spark, sf_dir):
    """SORT-03: in rank order, at most 4 of an issuer and 15 of a kind."""
    rows = table(spark, sf_dir, "orders").where("o_totalprice > 100000")
    return versions.capped_top(rows, "o_orderstatus", "o_custkey", [F.col("o_totalprice").desc(), F.col("o_orderkey")], 15, 4).select("o_orderstatus", "o_custkey", "o_orderkey")


@query("""SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25""")
def ranking_top(spark, sf_dir):
    """SORT-01, SORT-02, SORT-06: the first rows of a ranking, one TakeOrderedAndProject."""
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc_nulls_last(), "o_orderkey").limit(25)


@query("""SELECT event_id, user_id FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 20""")
def event_page(spark, sf_dir):
    """FILT-04, FILT-12, SORT-04, SCAN-16: a page of a filtered history."""
    events = table(spark, sf_dir, "events").where("event_type = 'error' and ts >= timestamp'2024-01-05' and ts < timestamp'2024-01-20'")
    return events.orderBy(F.col("ts").desc(), F.col("event_id").desc()).offset(20).limit(50).select("event_id", "user_id")


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderdate <= TIMESTAMP '1998-01-01' ORDER BY o_orderpriority, o_orderkey LIMIT 1""")
def queue_head(spark, sf_dir):
    """SORT-05: the next due item of a queue."""
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'O' and o_orderdate <= timestamp'1998-01-01'").orderBy("o_orderpriority", "o_orderkey").limit(1).select("o_orderkey")


@query("""SELECT p_type, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY p_type ORDER BY (p_name LIKE '%red%') DESC, p_retailprice DESC, p_partkey DESC) AS rn FROM part) WHERE rn = 1""")
def sample_per_category(spark, sf_dir):
    """SORT-08: the best document of each category."""
    order = [F.col("p_name").contains("red").desc(), F.col("p_retailprice").desc(), F.col("p_partkey").desc()]
    return versions.first_rows(table(spark, sf_dir, "part"), ["p_type"], order).select("p_type", "p_partkey")


@query("""SELECT c_custkey, lower(c_name) AS name FROM customer ORDER BY lower(c_name), c_custkey LIMIT 20""")
def names_without_case(spark, sf_dir):
    """SORT-07."""
    return table(spark, sf_dir, "customer").select("c_custkey", F.lower("c_name").alias("name")).orderBy("name", "c_custkey").limit(20)


@query("""SELECT l_orderkey, l_linenumber, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY l_orderkey, l_linenumber) AS ordinal FROM lineitem) WHERE l_discount > 0.02""")
def holding_lines(spark, sf_dir):
    """LINE-01: a line's ordinal in its group, counted before lines without a value go."""
    w = Window.partitionBy("l_suppkey", "l_partkey").orderBy("l_orderkey", "l_linenumber")
    return table(spark, sf_dir, "lineitem").withColumn("ordinal", F.row_number().over(w).cast("long")).where("l_discount > 0.02").select("l_orderkey", "l_linenumber", "ordinal")


@query("""
WITH p AS (SELECT conv_id AS document_version_id, turn // 2 AS page_number, text, CASE turn % 2 WHEN 0 THEN 'native' ELSE 'ocr' END AS extractor FROM (SELECT conv_id, turn, CASE WHEN role = 'user' AND conv_id % 3 = 0 THEN ' ' ELSE text END AS text FROM conversations))
SELECT document_version_id, page_number, extractor FROM (SELECT *, row_number() OVER (PARTITION BY document_version_id, page_number ORDER BY CASE WHEN trim(text) <> '' THEN 0 ELSE 1 END, CASE WHEN extractor = 'ocr' THEN 1 ELSE 0 END, extractor) AS rn FROM p) WHERE rn = 1""")
def preferred_page_text(spark, sf_dir):
    """SCAN-15: native text, or recognised text where the native page is blank."""
    pages = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_version_id"), F.expr("turn div 2").alias("page_number"), F.when((F.col("role") == "user") & (F.col("conv_id") % 3 == 0), " ").otherwise(F.col("text")).alias("text"), F.when(F.col("turn") % 2 == 0, "native").otherwise("ocr").alias("extractor"))
    return versions.preferred_pages(pages).select("document_version_id", "page_number", "extractor")
