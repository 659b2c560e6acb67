"""Observations, comparisons, incremental state and set operations (EAV-*, CONF-*, STATE-*, CMP-*, UPS-*, SET-*, PROJ-*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import comparison, observations
from ..sources.tables import table
from .registry import query


@query("""
WITH w AS (SELECT p_partkey, p_brand, p_type, CAST(p_size AS VARCHAR) AS p_size FROM part)
SELECT p_partkey, field_name, value FROM (UNPIVOT w ON p_brand, p_type, p_size INTO NAME field_name VALUE value) WHERE trim(value) <> ''""")
def eav_unpivot(spark, sf_dir):
    """EAV-01."""
    return observations.to_long(table(spark, sf_dir, "part"), ["p_partkey"], ["p_brand", "p_type", "p_size"])


@query("""SELECT o_custkey, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS BIGINT) AS f, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS BIGINT) AS o, CAST(sum(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS BIGINT) AS p FROM orders GROUP BY 1""")
def eav_pivot(spark, sf_dir):
    """EAV-03: fixed columns from one pass."""
    found = table(spark, sf_dir, "orders").groupBy("o_custkey").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return found.select("o_custkey", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"))


@query("""SELECT o_custkey, max(CASE WHEN field_name = 'status' THEN value END) AS status, max(CASE WHEN field_name = 'priority' THEN value END) AS priority FROM (SELECT o_custkey, 'status' AS field_name, o_orderstatus AS value FROM orders UNION ALL SELECT o_custkey, 'priority', o_orderpriority FROM orders) GROUP BY 1""")
def eav_round_trip(spark, sf_dir):
    """EAV-01 then EAV-03."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return observations.to_wide(observations.to_long(rows, ["o_custkey"], ["status", "priority"]), ["o_custkey"], ["status", "priority"])


@query("""SELECT l_orderkey, party, share FROM (SELECT l_orderkey, l_suppkey AS party, l_discount AS share FROM lineitem UNION ALL SELECT l_orderkey, l_partkey, l_tax FROM lineitem) WHERE share > 0.05""")
def repeated_party_columns(spark, sf_dir):
    """EAV-05: numbered column pairs to rows, in one scan."""
    pairs = F.inline(F.array(F.struct(F.col("l_suppkey").alias("party"), F.col("l_discount").alias("share")), F.struct(F.col("l_partkey").alias("party"), F.col("l_tax").alias("share"))))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", pairs).where("share > 0.05")


@query("""
WITH k AS (SELECT conv_id, turn, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS instance_key FROM conversations)
SELECT conv_id, turn, instance_key, count(*) OVER (PARTITION BY conv_id, instance_key) AS repeats FROM k""")
def instance_keys(spark, sf_dir):
    """EAV-06: a leaf's key from its sibling in the block, and how often it repeats."""
    from pyspark.sql import Window

    here = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, 0)
    keyed = table(spark, sf_dir, "conversations").withColumn("instance_key", F.max(F.when(F.col("role") == "user", F.col("turn"))).over(here))
    return keyed.select("conv_id", "turn", "instance_key", F.count("*").over(Window.partitionBy("conv_id", "instance_key")).alias("repeats"))


@query("""
WITH c AS (SELECT l_partkey, l_suppkey, l_returnflag AS value, min(l_orderkey * 10 + l_linenumber) AS class_id, count(*) AS n_rows FROM lineitem GROUP BY 1, 2, 3)
SELECT *, count(*) OVER (PARTITION BY l_partkey, l_suppkey) AS n_classes FROM c QUALIFY count(*) OVER (PARTITION BY l_partkey, l_suppkey) > 1""")
def value_conflicts(spark, sf_dir):
    """CONF-01, CONF-04: the conflicting values of each key as classes of rows."""
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), "l_returnflag")
    return observations.conflicts(rows, ["l_partkey", "l_suppkey"], "id", "l_returnflag")


@query("""
WITH o AS (SELECT o_custkey AS k FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 2), e AS (SELECT o_custkey AS k, arg_max(o_orderpriority, o_orderkey) AS note, arg_max(CASE WHEN o_orderkey % 2 = 0 THEN 'resolved' ELSE 'ignored' END, o_orderkey) AS status FROM orders WHERE o_orderstatus = 'P' AND o_custkey % 3 > 0 GROUP BY 1)
SELECT o.k, coalesce(status, 'open') AS status, note FROM o LEFT JOIN e ON o.k = e.k""")
def conflict_lifecycle(spark, sf_dir):
    """CONF-03: a conflict is open until its newest event resolves or ignores it."""
    orders = table(spark, sf_dir, "orders").withColumn("k", F.col("o_custkey"))
    opened = orders.groupBy("k").agg(F.countDistinct("o_orderstatus").alias("n")).where("n > 2")
    events = orders.where("o_orderstatus = 'P' and k % 3 > 0").select("k", F.col("o_orderkey").alias("at"), F.when(F.col("o_orderkey") % 2 == 0, "resolved").otherwise("ignored").alias("status"), F.col("o_orderpriority").alias("note"))
    return observations.conflict_status(opened, events, ["k"])


@query("""
WITH o AS (SELECT o_custkey AS k, o_orderkey AS id, o_orderpriority AS source_id, o_orderstatus AS value FROM orders), n AS (SELECT * FROM o WHERE id % 10 = 0), s AS (SELECT * FROM o WHERE id % 10 <> 0)
SELECT id AS new_id, conflicting_value FROM (SELECT n.id, s.value AS conflicting_value, row_number() OVER (PARTITION BY n.k, n.source_id, n.id ORDER BY s.id DESC) AS rn FROM n JOIN s ON n.k = s.k WHERE n.source_id <> s.source_id AND n.value <> s.value) WHERE rn = 1""")
def other_source_conflict(spark, sf_dir):
    """CONF-02: the newest differing row of another source."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("source_id"), F.col("o_orderstatus").alias("value"))
    new, stored = o.where("id % 10 = 0"), o.where("id % 10 <> 0")
    return observations.other_source_conflict(new, stored, "k", "id", "id")


@query("""SELECT l_partkey, count(DISTINCT l_returnflag) AS n_values, count(*) AS n_rows FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1""")
def conflicting_keys(spark, sf_dir):
    """CONF-04, by key: how many values and rows."""
    return observations.conflicting_keys(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_returnflag")


@query("""SELECT DISTINCT l_suppkey, l_linenumber FROM lineitem n WHERE l_shipdate >= TIMESTAMP '2001-01-01' AND NOT EXISTS (SELECT 1 FROM lineitem s WHERE s.l_shipdate < TIMESTAMP '1995-03-01' AND s.l_suppkey = n.l_suppkey AND s.l_linenumber IS NOT DISTINCT FROM n.l_linenumber)""")
def idempotent_append(spark, sf_dir):
    """STATE-01, STATE-02, SINK-03, FILT-05: rows not stored before; nulls are equal."""
    rows = table(spark, sf_dir, "lineitem")
    new = rows.where("l_shipdate >= timestamp'2001-01-01'").select("l_suppkey", "l_linenumber")
    return observations.not_yet_stored(new, rows.where("l_shipdate < timestamp'1995-03-01'"), ["l_suppkey", "l_linenumber"])


@query("""
WITH h AS (SELECT o_custkey AS k, arg_max(o_orderstatus, o_orderkey) AS latest, list(DISTINCT o_orderstatus) AS older FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1), n AS (SELECT o_custkey AS k, arg_max(o_orderstatus, o_orderkey) AS value FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01' GROUP BY 1)
SELECT coalesce(h.k, n.k) AS k, latest, value AS new_value, CASE WHEN n.k IS NULL THEN 'vanished' WHEN h.k IS NULL THEN 'new' WHEN value = latest THEN 'equal' WHEN list_contains(older, value) THEN 'returns' ELSE 'changed' END AS status FROM h FULL JOIN n ON h.k = n.k""")
def restatements(spark, sf_dir):
    """CMP-02: against the latest value and all older ones."""
    orders = table(spark, sf_dir, "orders").withColumnsRenamed({"o_custkey": "k", "o_orderstatus": "value"})
    new = orders.where("o_orderdate >= timestamp'2001-01-01'").groupBy("k").agg(F.max_by("value", "o_orderkey").alias("value"))
    return comparison.restated(orders.where("o_orderdate < timestamp'1998-01-01'"), new, ["k"], "o_orderkey")


@query("""
WITH h AS (SELECT l_suppkey AS subject, l_linenumber AS field, arg_max(l_returnflag, l_orderkey * 1000000 + l_partkey) AS latest, list(DISTINCT l_returnflag) AS older FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY 1, 2),
n AS (SELECT l_suppkey AS subject, l_linenumber AS field, arg_max(l_returnflag, l_orderkey * 1000000 + l_partkey) AS value FROM lineitem WHERE l_orderkey % 97 = 1 AND l_suppkey % 4 > 0 GROUP BY 1, 2),
r AS (SELECT DISTINCT subject FROM n)
SELECT coalesce(h.subject, n.subject) AS subject, coalesce(h.field, n.field) AS field, latest, value AS new_value, CASE WHEN n.subject IS NULL THEN 'vanished' WHEN h.subject IS NULL THEN 'new' WHEN value = latest THEN 'equal' WHEN list_contains(older, value) THEN 'returns' ELSE 'changed' END AS status,
 CASE WHEN n.subject IS NULL THEN CASE WHEN h.subject IN (SELECT subject FROM r) THEN 'vazias' ELSE 'sem_linha' END END AS reason FROM h FULL JOIN n ON h.subject = n.subject AND h.field = n.field""")
def cell_restatements(spark, sf_dir):
    """CMP-02: every cell of a restated report, and why the vanished ones are missing."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("subject"), F.col("l_linenumber").alias("field"), "l_orderkey", F.col("l_returnflag").alias("value"), (F.col("l_orderkey") * 1000000 + F.col("l_partkey")).alias("at"))
    new = lines.where("l_orderkey % 97 = 1 and subject % 4 > 0").groupBy("subject", "field").agg(F.max_by("value", "at").alias("value"))
    return comparison.restated_cells(lines.where("l_orderkey % 3 = 0"), new, new, ["subject"], ["field"], "at")


@query("""
WITH o AS (SELECT o_custkey AS k, o_orderkey AS t, o_orderstatus AS cnpj, o_orderpriority AS name, o_orderkey % 3 AS share FROM orders),
h AS (SELECT * FROM o WHERE t % 5 <> 0), p AS (SELECT k, arg_max({'c': cnpj, 'n': name, 's': share}, t) AS was, list(DISTINCT {'c': cnpj, 'n': name, 's': share}) AS older FROM h GROUP BY 1),
n AS (SELECT k, arg_max({'c': cnpj, 'n': name, 's': share}, t) AS now FROM o WHERE t % 5 = 0 GROUP BY 1)
SELECT coalesce(p.k, n.k) AS k, CASE WHEN now IS NULL THEN 'saiu' WHEN was IS NULL THEN 'entrou' WHEN was = now THEN 'igual' WHEN list_contains(older, now) THEN 'volta' WHEN was.c <> now.c THEN 'cnpj_trocado' WHEN was.n <> now.n THEN 'nome_alterado' ELSE 'percentual_alterado' END AS status FROM p FULL JOIN n ON p.k = n.k""")
def party_status(spark, sf_dir):
    """CMP-03: parties that entered, left, came back or changed identifier, name or share."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("t"), F.col("o_orderstatus").alias("cnpj"), F.col("o_orderpriority").alias("name"), (F.col("o_orderkey") % 3).alias("share"))
    new = o.where("t % 5 = 0").groupBy("k").agg(F.max_by(F.struct("cnpj", "name", "share"), "t").alias("v")).select("k", "v.*")
    return comparison.party_changes(o.where("t % 5 <> 0"), new, ["k"], "t")


@query("""
WITH v AS (SELECT l_partkey AS k, year(l_shipdate) AS y, CAST(max(l_quantity) AS DECIMAL(28,8)) AS v FROM lineitem GROUP BY 1, 2), a AS (SELECT * FROM v WHERE y = 1999), b AS (SELECT * FROM v WHERE y = 2000),
j AS (SELECT coalesce(a.k, b.k) AS k, a.v AS x, b.v AS z FROM a FULL JOIN b ON a.k = b.k),
s AS (SELECT *, CASE WHEN x IS NULL OR z IS NULL THEN 'only_one_side' WHEN k % 7 = 0 THEN 'excluded_scale_unknown' WHEN x = z THEN 'unchanged' ELSE 'changed' END AS status FROM j)
SELECT k, status, CASE WHEN status IN ('changed', 'unchanged') THEN CAST(z - x AS DOUBLE) END AS absolute, CASE WHEN status IN ('changed', 'unchanged') AND x <> 0 THEN round(CAST(z - x AS DOUBLE) / CAST(x AS DOUBLE), 6) END AS relative FROM s""")
def period_comparison(spark, sf_dir):
    """CMP-04, NUM-04."""
    v = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("k"), F.year("l_shipdate").alias("y")).agg(F.max("l_quantity").cast("string").alias("v"))
    both = v.where("y = 1999").select("k", F.col("v").alias("x")).join(v.where("y = 2000").select("k", F.col("v").alias("z")), "k", "full_outer")
    found = comparison.period_change(F.col("x"), F.col("z"), F.col("k") % 7 != 0, F.lit(True))
    return both.select("k", found["status"].alias("status"), found["absolute"].cast("double").alias("absolute"), found["relative"].alias("relative"))


@query("""SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 1 UNION ALL SELECT k, v FROM (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1) WHERE k NOT IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1997)""")
def snapshot_merge(spark, sf_dir):
    """UPS-01: the new snapshot's rows and the old ones of other keys."""
    year = lambda y: table(spark, sf_dir, "orders").where(F.year("o_orderdate") == y).groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v"))
    return observations.merge_snapshot(year(1996), year(1997), ["k"])


@query("""
WITH o AS (SELECT DISTINCT o_custkey * 10 + o_custkey % 3 AS fingerprint, o_custkey AS alert_key FROM orders WHERE year(o_orderdate) = 1996), n AS (SELECT DISTINCT o_custkey * 10 + (o_custkey + o_custkey // 2) % 3 AS fingerprint, o_custkey AS alert_key FROM orders WHERE year(o_orderdate) = 1997),
j AS (SELECT coalesce(o.fingerprint, n.fingerprint) AS fingerprint, coalesce(n.alert_key, o.alert_key) AS alert_key, CASE WHEN o.fingerprint IS NOT NULL AND n.fingerprint IS NOT NULL THEN 'seen_again' WHEN n.fingerprint IS NOT NULL THEN 'new' ELSE 'open' END AS status FROM o FULL JOIN n ON o.fingerprint = n.fingerprint)
SELECT fingerprint, alert_key, CASE WHEN status = 'open' AND bool_or(status = 'new') OVER (PARTITION BY alert_key) THEN 'resolved' ELSE status END AS status FROM j""")
def alert_upsert(spark, sf_dir):
    """UPS-02."""
    orders = table(spark, sf_dir, "orders")
    alerts = lambda y, code: orders.where(F.year("o_orderdate") == y).select((F.col("o_custkey") * 10 + code).alias("fingerprint"), F.col("o_custkey").alias("alert_key")).distinct()
    return observations.alert_lifecycle(alerts(1996, F.col("o_custkey") % 3), alerts(1997, F.expr("(o_custkey + o_custkey div 2) % 3")))


@query("""
WITH o AS (SELECT c_custkey AS k, c_mktsegment AS a FROM customer WHERE c_custkey % 3 <> 0), n AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN ' ' WHEN c_custkey % 7 = 0 THEN 'CHANGED' ELSE c_mktsegment END AS a FROM customer WHERE c_custkey % 2 = 0)
SELECT coalesce(o.k, n.k) AS k, coalesce(nullif(trim(n.a), ''), o.a) AS a, CASE WHEN o.k IS NULL THEN 'inserted' WHEN n.k IS NOT NULL AND coalesce(nullif(trim(n.a), ''), o.a) IS DISTINCT FROM o.a THEN 'updated' ELSE 'unchanged' END AS outcome FROM o FULL JOIN n ON o.k = n.k""")
def asset_upsert(spark, sf_dir):
    """UPS-03: a blank never erases."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("a"))
    new = c.where("k % 2 = 0").withColumn("a", F.when(F.col("k") % 5 == 0, " ").when(F.col("k") % 7 == 0, "CHANGED").otherwise(F.col("a")))
    return observations.merge_blanks(c.where("k % 3 <> 0"), new, "k", ["a"])


TWO_KEYS = """WITH c AS (SELECT c_custkey AS k, 'A' || c_custkey AS a, 'B' || c_custkey AS b, c_mktsegment AS segment, c_name AS issue FROM customer), s AS (SELECT * FROM c WHERE k % 3 <> 0),
n AS (SELECT k, CASE k % 10 WHEN 0 THEN '' WHEN 1 THEN lower(a) WHEN 2 THEN NULL ELSE a END AS a, CASE k % 10 WHEN 0 THEN NULL WHEN 1 THEN 'B' || (k + 1) WHEN 3 THEN 'A' || k WHEN 4 THEN 'B' || (k // 40) ELSE ' ' || b END AS b, CASE WHEN k % 4 = 0 THEN ' ' ELSE segment || '!' END AS segment, CASE WHEN k % 14 = 0 THEN 'other' WHEN k % 6 = 0 THEN '' ELSE issue END AS issue FROM c WHERE k % 2 = 0 OR k % 5 = 1 OR k % 10 = 3),
u AS (SELECT k, nullif(upper(trim(a)), '') AS a, nullif(upper(trim(b)), '') AS b, segment, issue FROM n),
m AS (SELECT u.*, x.k AS xa, y.k AS xb, coalesce(x.k, y.k) AS row_id FROM u LEFT JOIN s x ON x.a = u.a LEFT JOIN s y ON y.b = u.b),
j AS (SELECT m.*, s.a AS sa, s.b AS sb, s.segment AS old_segment, s.issue AS old_issue, CASE WHEN m.a IS NULL AND m.b IS NULL THEN 'no_code' WHEN m.a = m.b THEN 'one_code_twice' WHEN xa <> xb THEN 'two_assets' WHEN s.k IS NOT NULL AND nullif(trim(m.issue), '') <> s.issue THEN 'another_issue' END AS reason FROM m LEFT JOIN s ON s.k = m.row_id),
g AS (SELECT *, row_id IS NOT NULL AND count(*) OVER (PARTITION BY row_id) > 1 OR row_id IS NULL AND (a IS NOT NULL AND count(*) OVER (PARTITION BY row_id IS NULL, a) > 1 OR b IS NOT NULL AND count(*) OVER (PARTITION BY row_id IS NULL, b) > 1) AS twice FROM j WHERE reason IS NULL)"""


def _two_keys(spark, sf_dir):
    k = F.col("k")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.lit("A"), "c_custkey").alias("a"), F.concat(F.lit("B"), "c_custkey").alias("b"), F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("issue"))
    code_a = F.when(k % 10 == 0, "").when(k % 10 == 1, F.lower("a")).when(k % 10 != 2, F.col("a"))
    code_b = F.when(k % 10 == 1, F.concat(F.lit("B"), k + 1)).when(k % 10 == 3, F.concat(F.lit("A"), k)).when(k % 10 == 4, F.concat(F.lit("B"), F.expr("k div 40"))).when(k % 10 != 0, F.concat(F.lit(" "), "b"))
    segment, issue = F.when(k % 4 == 0, " ").otherwise(F.concat("segment", F.lit("!"))), F.when(k % 14 == 0, "other").when(k % 6 == 0, "").otherwise(F.col("issue"))
    new = c.where("k % 2 = 0 or k % 5 = 1 or k % 10 = 3").select(k.alias("new_id"), code_a.alias("a"), code_b.alias("b"), segment.alias("segment"), issue.alias("issue"))
    return observations.upsert_by_two_keys(c.where("k % 3 <> 0").withColumnRenamed("k", "row_id"), new, "a", "b", ["segment", "issue"], ["issue"])


@query(TWO_KEYS + """ SELECT row_id, k AS new_id, coalesce(a, sa) AS a, coalesce(b, sb) AS b, coalesce(nullif(trim(segment), ''), old_segment) AS segment, coalesce(nullif(trim(issue), ''), old_issue) AS issue,
 CASE WHEN row_id IS NULL THEN 'inserted' WHEN coalesce(a, sa) = sa AND coalesce(b, sb) = sb AND coalesce(nullif(trim(segment), ''), old_segment) = old_segment THEN 'unchanged' ELSE 'updated' END AS outcome FROM g WHERE NOT twice
UNION ALL SELECT k, NULL, a, b, segment, issue, 'kept' FROM s WHERE k NOT IN (SELECT row_id FROM g WHERE NOT twice AND row_id IS NOT NULL)""")
def two_key_upsert(spark, sf_dir):
    """UPS-03: assets known by either of two codes; what can't be told goes to the refused rows."""
    return _two_keys(spark, sf_dir)[0]


@query(TWO_KEYS + " SELECT k AS new_id, reason FROM j WHERE reason IS NOT NULL UNION ALL SELECT k, 'claimed_twice' FROM g WHERE twice")
def two_key_refusals(spark, sf_dir):
    """UPS-03: new rows that are refused, and why."""
    return _two_keys(spark, sf_dir)[1]


@query("""
WITH h AS (SELECT o_custkey AS k, arg_max(o_orderstatus, o_orderkey) AS latest, list(DISTINCT o_orderstatus) AS older FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1), n AS (SELECT o_custkey AS k, arg_max(o_orderstatus, o_orderkey) AS value FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01' GROUP BY 1)
SELECT n.k, sha256('{"k":' || n.k || ',"value":"' || value || '","run":' || CASE WHEN h.k IS NOT NULL AND value <> latest AND list_contains(older, value) THEN '7' ELSE 'null' END || '}') AS hash FROM n LEFT JOIN h ON h.k = n.k""")
def observation_hashes(spark, sf_dir):
    """STATE-03: a value that returns gets the run into its hash, so it is stored again."""
    orders = table(spark, sf_dir, "orders").withColumnsRenamed({"o_custkey": "k", "o_orderstatus": "value"})
    new = orders.where("o_orderdate >= timestamp'2000-01-01'").groupBy("k").agg(F.max_by("value", "o_orderkey").alias("value"))
    found = comparison.restated(orders.where("o_orderdate < timestamp'1998-01-01'"), new, ["k"], "o_orderkey").where("new_value is not null")
    return found.select("k", observations.observation_hash([F.col("k"), F.col("new_value").alias("value")], F.col("status"), F.lit(7)).alias("hash"))


@query("""
WITH l AS (SELECT DISTINCT l_suppkey AS fund, year(l_shipdate) AS year, l_partkey AS asset, l_quantity AS amount FROM lineitem)
SELECT fund, year, asset, amount FROM l WHERE year = 1999 AND NOT EXISTS (SELECT 1 FROM lineitem s WHERE s.l_linenumber = 1 AND year(s.l_shipdate) = 1999 AND s.l_suppkey = fund AND s.l_partkey = asset AND s.l_quantity = amount)""")
def holdings_append(spark, sf_dir):
    """UPS-06: holdings of a fund and period that are not stored yet, each once."""
    rows = table(spark, sf_dir, "lineitem").where("year(l_shipdate) = 1999").select(F.col("l_suppkey").alias("fund"), F.year("l_shipdate").cast("long").alias("year"), F.col("l_partkey").alias("asset"), F.col("l_quantity").alias("amount"), "l_linenumber")
    keys = ["fund", "year", "asset", "amount"]
    return observations.not_yet_stored(rows.select(*keys), rows.where("l_linenumber = 1"), keys)


@query("""
WITH c AS (SELECT c_custkey AS k, 'h' || c_custkey AS sha256, 'i' || (c_custkey % 700) AS source_id, 's' || (c_custkey // 700) AS source, c_name AS title, c_mktsegment AS category FROM customer),
o AS (SELECT * FROM c WHERE k % 3 <> 0),
n AS (SELECT k, CASE WHEN k % 4 = 0 THEN sha256 ELSE sha256 || 'x' END AS sha256, source_id, source, CASE WHEN k % 5 = 0 THEN ' ' ELSE title || CASE WHEN k % 7 = 0 THEN '!' ELSE '' END END AS title, CASE WHEN k % 8 = 0 THEN 'Outro' ELSE category END AS category FROM c WHERE k % 2 = 0)
SELECT coalesce(n.source_id, o.source_id) AS source_id, coalesce(n.source, o.source) AS source, coalesce(n.sha256, o.sha256) AS sha256, coalesce(nullif(trim(n.title), ''), o.title) AS title,
 CASE WHEN n.category = 'Outro' AND o.category IS NOT NULL AND n.k % 16 <> 0 THEN o.category ELSE coalesce(n.category, o.category) END AS category,
 CASE WHEN o.k IS NULL THEN 'inserted' WHEN n.k IS NULL THEN 'unchanged' WHEN n.sha256 <> o.sha256 OR coalesce(nullif(trim(n.title), ''), o.title) <> o.title OR CASE WHEN n.category = 'Outro' AND n.k % 16 <> 0 THEN o.category ELSE n.category END <> o.category THEN 'updated' ELSE 'unchanged' END AS outcome
FROM o FULL JOIN n ON o.k = n.k""")
def document_upsert(spark, sf_dir):
    """UPS-04: by hash, else by source and id; blanks erase nothing and a category falls to the last one only on evidence."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(k.alias("k"), F.concat(F.lit("h"), k).alias("sha256"), F.concat(F.lit("i"), k % 700).alias("source_id"), F.concat(F.lit("s"), F.floor(k / 700)).alias("source"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("category"))
    new = c.where("k % 2 = 0").withColumns({
        "sha256": F.when(F.col("k") % 4 == 0, F.col("sha256")).otherwise(F.concat("sha256", F.lit("x"))),
        "title": F.when(F.col("k") % 5 == 0, " ").when(F.col("k") % 7 == 0, F.concat("title", F.lit("!"))).otherwise(F.col("title")),
        "category": F.when(F.col("k") % 8 == 0, "Outro").otherwise(F.col("category")),
    })
    return observations.upsert_documents(c.where("k % 3 <> 0"), new, "Outro", F.col("new_k") % 16 == 0)


@query("""SELECT DISTINCT y FROM (SELECT year(o_orderdate) AS y FROM orders UNION SELECT year(l_shipdate) FROM lineitem)""")
def competences(spark, sf_dir):
    """SET-01."""
    return table(spark, sf_dir, "orders").select(F.year("o_orderdate").cast("long").alias("y")).union(table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").cast("long"))).distinct()


@query("""
WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE year(o_orderdate) = 1996), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE year(o_orderdate) = 1997)
SELECT k, 'both' AS status FROM (SELECT k FROM a INTERSECT SELECT k FROM b) UNION ALL SELECT k, 'new' FROM (SELECT k FROM b EXCEPT SELECT k FROM a) UNION ALL SELECT k, 'gone' FROM (SELECT k FROM a EXCEPT SELECT k FROM b)""")
def set_new_gone(spark, sf_dir):
    """SET-02, SET-03: in one shuffle."""
    year = lambda y: table(spark, sf_dir, "orders").where(F.year("o_orderdate") == y).select(F.col("o_custkey").alias("k"))
    return comparison.membership(year(1996), year(1997), "k")


@query("""SELECT DISTINCT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50 UNION SELECT l_suppkey FROM lineitem WHERE l_tax = 0)""")
def known_identifiers(spark, sf_dir):
    """SET-04."""
    lines = table(spark, sf_dir, "lineitem")
    known = lines.where("l_quantity = 50").select(F.col("l_partkey").alias("p_partkey")).union(lines.where("l_tax = 0").select("l_suppkey"))
    return table(spark, sf_dir, "part").select("p_partkey").join(known, "p_partkey", "left_semi").distinct()


@query("""SELECT 'customer' AS kind, c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'supplier', s_nationkey, count(*) FROM supplier GROUP BY 2""")
def tagged_kinds(spark, sf_dir):
    """SET-05."""
    tagged = lambda name, column: table(spark, sf_dir, name).select(F.lit(name).alias("kind"), F.col(column).alias("nation"))
    return tagged("customer", "c_nationkey").unionByName(tagged("supplier", "s_nationkey")).groupBy("kind", "nation").agg(F.count("*").alias("n"))


@query("""SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem""")
def distinct_rows(spark, sf_dir):
    """SET-06."""
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").dropDuplicates()


@query("""
SELECT p_partkey, CASE WHEN len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 OR len(list_filter(b, lambda x: NOT list_contains(a, x))) = 0 THEN CASE WHEN len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 AND len(list_filter(b, lambda x: NOT list_contains(a, x))) = 0 THEN 'equal' ELSE 'subset' END WHEN len(list_intersect(a, b)) = 0 THEN 'disjoint' ELSE 'overlap' END AS relation
FROM (SELECT p_partkey, string_split(p_name, ' ') AS a, ['red', 'widget'] AS b FROM part)""")
def token_sets(spark, sf_dir):
    """SET-07."""
    a, b = F.split("p_name", " "), F.array(F.lit("red"), F.lit("widget"))
    return table(spark, sf_dir, "part").select("p_partkey", comparison.token_relation(a, b).alias("relation"))


@query("""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN p_brand WHEN 1 THEN CAST(p_size AS VARCHAR) ELSE CAST(p_size > 25 AS VARCHAR) END AS value FROM part""")
def typed_values(spark, sf_dir):
    """PROJ-01: the one value column that the type names."""
    kind = F.when(F.col("p_size") % 3 == 0, "text").when(F.col("p_size") % 3 == 1, "numeric").otherwise("boolean")
    rows = table(spark, sf_dir, "part").select("p_partkey", kind.alias("value_type"), F.col("p_brand").alias("value_text"), F.col("p_size").alias("value_numeric"), F.lit(None).cast("date").alias("value_date"), (F.col("p_size") > 25).alias("value_boolean"))
    return rows.select("p_partkey", observations.typed_value(F.col("value_type")).alias("value"))


@query("""
SELECT p.k, p.path, 'absent' AS state FROM (SELECT DISTINCT o_custkey AS k, path FROM orders, (VALUES ('F'),('O'),('P')) m(path)) p WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = p.k AND o.o_orderstatus = p.path)""")
def absent_paths(spark, sf_dir):
    """PROJ-05: mapped paths that a file lacks become rows; the mapping is a fixed short list."""
    orders = table(spark, sf_dir, "orders")
    mapped = orders.select(F.col("o_custkey").alias("k")).distinct().withColumn("path", F.explode(F.array(F.lit("F"), F.lit("O"), F.lit("P"))))
    return mapped.join(orders.select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("path")), ["k", "path"], "left_anti").withColumn("state", F.lit("absent"))


@query("""SELECT o_orderkey, try_cast(o_orderpriority[1:1] AS INTEGER) AS priority, try_cast(o_orderstatus AS INTEGER) AS bad FROM orders""")
def converted_columns(spark, sf_dir):
    """PROJ-03: by kind; what doesn't convert is null."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.substring("o_orderpriority", 1, 1).alias("priority"), F.col("o_orderstatus").alias("bad"))
    found = observations.convert(rows, {"o_orderkey": "integer", "priority": "integer", "bad": "integer"})
    return found.select("o_orderkey", F.col("priority").cast("int").alias("priority"), F.col("bad").cast("int").alias("bad"))
