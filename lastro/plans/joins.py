"""Joins, matching and relations (JOIN-*, MATCH-*, RULE-04)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import comparison, graph, market, matching, versions
from ..sources.tables import table
from .registry import query


@query("""SELECT c_custkey, n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) n ON c_nationkey = n_nationkey""")
def instrument_with_issuer(spark, sf_dir):
    """JOIN-02, JOIN-07: a left join whose condition filters the right side only."""
    n = table(spark, sf_dir, "nation").where("n_regionkey < 3")
    return table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name")


@query("""SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 200000)""")
def anti_without_children(spark, sf_dir):
    """JOIN-03, JOIN-05."""
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'P' and o_totalprice > 200000")
    return table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AND NOT EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = d.doc_id)""")
def double_anti(spark, sf_dir):
    """JOIN-04."""
    docs = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")
    return docs.join(table(spark, sf_dir, "conversations"), F.col("doc_id") == F.col("conv_id"), "left_anti")


@query("""SELECT l_orderkey, l_linenumber, c_custkey, s_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity >= 45 AND c_mktsegment = 'BUILDING'""")
def facts_versions_documents(spark, sf_dir):
    """JOIN-06, JOIN-08: a chain of inner joins; the optimiser orders and broadcasts by size."""
    lines = table(spark, sf_dir, "lineitem").where("l_quantity >= 45").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    customers = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    return lines.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "l_linenumber", "c_custkey", "s_name")


@query("""
WITH v AS (SELECT l_partkey AS k, strftime(l_shipdate, '%Y') AS y, max(l_quantity) AS value FROM lineitem GROUP BY 1, 2),
a AS (SELECT k, value FROM v WHERE y = '1996'), b AS (SELECT k, value FROM v WHERE y = '1997')
SELECT coalesce(a.k, b.k) AS k, a.value AS old_value, b.value AS new_value, CASE WHEN a.k IS NULL THEN 'new' WHEN b.k IS NULL THEN 'vanished' WHEN a.value = b.value THEN 'equal' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.k = b.k""")
def cell_status(spark, sf_dir):
    """JOIN-09, CMP-01: cells of two months side by side."""
    v = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("k"), F.year("l_shipdate").alias("y")).agg(F.max("l_quantity").alias("value"))
    return comparison.cell_status(v.where("y = 1996").select("k", "value"), v.where("y = 1997").select("k", "value"), ["k"])


@query("""
SELECT c_custkey, coalesce(p.c, r.c) AS kind, CASE WHEN p.c <> r.c THEN 'mixed' WHEN coalesce(p.c, r.c) IS NULL THEN 'none' ELSE 'one' END AS origin
FROM customer LEFT JOIN (SELECT n_nationkey AS k, n_name AS c FROM nation WHERE n_nationkey % 2 = 0) p ON c_nationkey = p.k
LEFT JOIN (SELECT n_nationkey AS k, r_name AS c FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 = 0) r ON c_nationkey = r.k""")
def fallback_lookup(spark, sf_dir):
    """JOIN-10, JOIN-19: the class's own type, else the fund's; mixed where both differ."""
    nation = table(spark, sf_dir, "nation")
    p = nation.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("pk"), F.col("n_name").alias("p"))
    r = nation.where("n_nationkey % 3 = 0").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("rk"), F.col("r_name").alias("r"))
    found = table(spark, sf_dir, "customer").join(p, F.col("c_nationkey") == F.col("pk"), "left").join(r, F.col("c_nationkey") == F.col("rk"), "left")
    kind = F.coalesce("p", "r")
    return found.select("c_custkey", kind.alias("kind"), F.when(F.col("p") != F.col("r"), "mixed").when(kind.isNull(), "none").otherwise("one").alias("origin"))


@query("""SELECT DISTINCT c_custkey, s_suppkey FROM customer, supplier WHERE round(c_acctbal) = round(s_acctbal) OR c_custkey = s_suppkey * 7""")
def or_match(spark, sf_dir):
    """JOIN-11: rows equal in either key, as two equal joins."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.round("c_acctbal").alias("cb"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.round("s_acctbal").alias("sb"), (F.col("s_suppkey") * 7).alias("s7"))
    return matching.either_key(c, s, [("cb", "sb"), ("c_custkey", "s7")], "c_custkey", "s_suppkey")


@query("""
WITH p AS (SELECT o_custkey AS k, o_orderkey, CAST(o_orderdate AS DATE) AS f, CAST(o_orderdate AS DATE) + 180 AS t FROM orders),
m AS (SELECT f.o_orderkey AS fact, f.o_custkey AS k, p.o_orderkey AS parameter FROM orders f JOIN p ON f.o_custkey = p.k AND CAST(f.o_orderdate AS DATE) BETWEEN p.f AND p.t)
SELECT fact, min(parameter) AS parameter, count(*) AS matches FROM m GROUP BY 1 HAVING count(*) = 1""")
def validity_join(spark, sf_dir):
    """JOIN-12: the one parameter in force on a fact's date, both ends included, by a sweep over each key's days."""
    day = F.to_date("o_orderdate")
    parameters = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("parameter"), day.alias("valid_from"), F.date_add(day, 180).alias("valid_to"))
    facts = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("fact"), day.alias("on"))
    return versions.only_in_force(facts, parameters, ["o_custkey"], "on", "parameter").where("matches = 1").select("fact", "parameter", "matches")


@query("""
SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '1998-06-15' AND (o_orderstatus = 'O' OR CAST(o_orderdate AS DATE) + 365 >= DATE '1998-06-15')""")
def relations_active_on(spark, sf_dir):
    """JOIN-13: relations valid at an instant; open where no end is known."""
    day = F.to_date("o_orderdate")
    relations = table(spark, sf_dir, "orders").select("o_orderkey", day.alias("valid_from"), F.when(F.col("o_orderstatus") != "O", F.date_add(day, 365)).alias("valid_to"))
    return graph.active_on(relations, F.lit("1998-06-15").cast("date")).select("o_orderkey")


@query("""
WITH x AS (SELECT l_partkey AS k, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS a FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), y AS (SELECT l_partkey AS k, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS b FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT x.k AS k, CASE WHEN y.k IS NULL THEN 'no_row' WHEN abs(CAST(a AS DOUBLE) - CAST(b AS DOUBLE)) <= 0.2 * greatest(1.0, abs(CAST(b AS DOUBLE))) THEN 'equal' ELSE 'different' END AS outcome FROM x LEFT JOIN y ON x.k = y.k""")
def extracted_against_market(spark, sf_dir):
    """NUM-05: extracted values against the market's, with a tolerance."""
    total = lambda flag, name: table(spark, sf_dir, "lineitem").where(F.col("l_returnflag") == flag).groupBy(F.col("l_partkey").alias("k")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias(name))
    found = total("A", "a").join(total("R", "b"), "k", "left")
    close = F.abs(F.col("a") - F.col("b")) <= 0.2 * F.greatest(F.lit(1.0), F.abs("b"))
    return found.select("k", F.when(F.col("b").isNull(), "no_row").when(close, "equal").otherwise("different").alias("outcome"))


@query("""
WITH c AS (SELECT l_orderkey AS asset, l_suppkey AS certificate FROM lineitem)
SELECT asset, CASE WHEN count(DISTINCT certificate) = 1 THEN min(certificate) END AS certificate, CASE WHEN count(DISTINCT certificate) = 1 THEN 'matched' ELSE 'blocked' END AS outcome FROM c GROUP BY 1""")
def single_certificate(spark, sf_dir):
    """JOIN-15: one certificate for an asset, refused where several."""
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("asset"), F.col("l_suppkey").alias("certificate"))
    return matching.single_match(c, "asset", "certificate")


@query("""
WITH h AS (SELECT DISTINCT l_suppkey AS issuer, l_orderkey AS isin, l_partkey AS certificate FROM lineitem)
SELECT issuer, isin, certificate, count(*) OVER (PARTITION BY issuer, isin) - 1 AS n_siblings FROM h QUALIFY count(*) OVER (PARTITION BY issuer, isin) > 1""")
def sibling_certificates(spark, sf_dir):
    """JOIN-16: certificates of one issuer one hop away through a shared ISIN, as groups with their members."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("issuer"), F.col("l_orderkey").alias("isin"), F.col("l_partkey").alias("certificate"))
    return graph.siblings(rows, ["issuer", "isin"], "certificate")


@query("""
WITH a AS (SELECT c_custkey, unnest([c_custkey * 3, c_custkey * 2, c_custkey]) AS alias, unnest([1, 2, 3]) AS place FROM customer), s AS (SELECT o_orderkey AS alias, o_totalprice AS total FROM orders)
SELECT c_custkey, arg_min(s.alias, place) AS alias, arg_min(total, place) AS total FROM a JOIN s ON a.alias = s.alias GROUP BY 1""")
def first_alias_with_statement(spark, sf_dir):
    """JOIN-17: the statement of the first alias code that has one."""
    codes = F.array(F.col("c_custkey") * 3, F.col("c_custkey") * 2, F.col("c_custkey"))
    stated = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("total"))
    return matching.first_alias(table(spark, sf_dir, "customer"), "c_custkey", codes, stated, "o_orderkey")


@query("""
WITH s AS (SELECT o_custkey AS k, CASE WHEN max(o_orderstatus) = 'P' THEN 'active' ELSE 'closed' END AS status FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1), r AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE year(o_orderdate) = 1997)
SELECT coalesce(s.k, r.k) AS k, CASE WHEN s.k IS NULL THEN 'created' WHEN r.k IS NOT NULL AND status = 'active' THEN 'kept' WHEN r.k IS NOT NULL AND status = 'closed' THEN 'reopened' WHEN status = 'active' THEN 'closed' ELSE 'unchanged' END AS outcome FROM s FULL JOIN r ON s.k = r.k""")
def relation_outcomes(spark, sf_dir):
    """JOIN-20, MATCH-04: what a complete snapshot does to the stored relations."""
    orders = table(spark, sf_dir, "orders").withColumn("k", F.col("o_custkey"))
    stored = orders.where("year(o_orderdate) = 1996").groupBy("k").agg(F.when(F.max("o_orderstatus") == "P", "active").otherwise("closed").alias("status"))
    return comparison.relation_outcomes(stored, orders.where("year(o_orderdate) = 1997").select("k").distinct(), ["k"], True)


@query("""
WITH i AS (SELECT DISTINCT o_custkey AS id, o_orderstatus AS type, CAST(floor(o_totalprice) AS BIGINT) AS value FROM orders), l AS (SELECT * FROM i WHERE id % 2 = 0), r AS (SELECT * FROM i WHERE id % 2 = 1),
pairs AS (SELECT DISTINCT l.id AS a, r.id AS b FROM l JOIN r USING (type, value)),
lt AS (SELECT id, type, list(value) AS vs FROM l GROUP BY 1, 2), rt AS (SELECT id, type, list(value) AS vs FROM r GROUP BY 1, 2)
SELECT a AS left_id, b AS right_id, CASE WHEN bool_and(list_has_any(lt.vs, rt.vs)) THEN 'matched' ELSE 'blocked' END AS outcome FROM pairs JOIN lt ON lt.id = a JOIN rt ON rt.id = b AND rt.type = lt.type GROUP BY 1, 2""")
def strong_identifiers(spark, sf_dir):
    """MATCH-01: pairs that share an identifier; a conflict in another type blocks them."""
    i = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderstatus").alias("type"), F.floor("o_totalprice").alias("value"), F.lit(False).alias("is_primary")).distinct()
    return matching.compare_identifiers(i.where("id % 2 = 0"), i.where("id % 2 = 1"))


@query("""
WITH c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 5 = 0 THEN 'SUPPLIER ' || lpad(CAST(c_custkey % 150 AS VARCHAR), 9, '0') WHEN c_custkey % 5 = 1 THEN 'TRADE ' || (c_custkey % 40) ELSE upper(replace(c_name, '#', ' ')) END AS n, CASE WHEN c_custkey % 5 = 2 THEN 'TRADE ' || (c_custkey % 60) WHEN c_custkey % 5 = 3 THEN 'SUPPLIER ' || lpad(CAST(c_custkey % 120 AS VARCHAR), 9, '0') ELSE '' END AS t FROM customer),
p AS (SELECT s_suppkey AS id2, upper(replace(s_name, '#', ' ')) AS n2, 'TRADE ' || (s_suppkey % 50) AS t2 FROM supplier),
m AS (SELECT id, id2, 70 AS score FROM c JOIN p ON n = n2 UNION ALL SELECT id, id2, 45 FROM c JOIN p ON t = t2 UNION ALL SELECT id, id2, 40 FROM c JOIN p ON n = t2 UNION ALL SELECT id, id2, 40 FROM c JOIN p ON t = n2),
b AS (SELECT id, max(score) AS score FROM m GROUP BY 1)
SELECT c.id, coalesce(b.score, 0) AS score, count(m.id2) AS n_candidates, min(m.id2) AS first_candidate FROM c LEFT JOIN b ON c.id = b.id LEFT JOIN m ON m.id = b.id AND m.score = b.score GROUP BY 1, 2""")
def name_match_score(spark, sf_dir):
    """MATCH-02: the best tier of equal names of each customer: legal, trade, crosswise, none."""
    k = F.col("c_custkey")
    supplier = lambda n: F.concat(F.lit("Supplier#"), F.lpad((k % n).cast("string"), 9, "0"))
    trade = lambda n: F.concat(F.lit("Trade-"), k % n)
    c = table(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 5 == 0, supplier(150)).when(k % 5 == 1, trade(40)).otherwise(F.col("c_name")).alias("name"), F.when(k % 5 == 2, trade(60)).when(k % 5 == 3, supplier(120)).otherwise("").alias("trade"))
    p = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.concat(F.lit("trade "), F.col("s_suppkey") % 50).alias("trade"))
    return matching.best_name_match(c, p)


@query("""
WITH e AS (SELECT s_suppkey AS entity_id, CASE WHEN s_suppkey % 4 <> 0 THEN CAST(s_suppkey * 3 AS VARCHAR) END AS cnpj, 'N' || (s_suppkey % 40) AS name, 'f' AS type FROM supplier), b AS (SELECT c_custkey AS id, CAST(c_custkey AS VARCHAR) AS cnpj, 'N' || (c_custkey % 60) AS name, 'f' AS type FROM customer)
SELECT id, m.entity_id, CASE WHEN m.entity_id IS NOT NULL THEN 'matched' WHEN n.n > 1 THEN 'blocked' WHEN n.n = 1 THEN 'review' ELSE 'created' END AS outcome
FROM b LEFT JOIN (SELECT cnpj, min(entity_id) AS entity_id FROM e WHERE cnpj IS NOT NULL GROUP BY 1) m ON b.cnpj = m.cnpj LEFT JOIN (SELECT name, type, count(*) AS n FROM e GROUP BY 1, 2) n ON b.name = n.name AND b.type = n.type""")
def issuer_import(spark, sf_dir):
    """MATCH-03: matched by identifier, review or blocked by name, else created."""
    e = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.when(F.col("s_suppkey") % 4 != 0, (F.col("s_suppkey") * 3).cast("string")).alias("cnpj"), F.concat(F.lit("N"), F.col("s_suppkey") % 40).alias("name"), F.lit("f").alias("type"))
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").cast("string").alias("cnpj"), F.concat(F.lit("N"), F.col("c_custkey") % 60).alias("name"), F.lit("f").alias("type"))
    return matching.import_decisions(b, e)


@query("""
WITH e AS (SELECT s_suppkey AS entity_id, CASE WHEN s_suppkey % 4 <> 0 THEN CAST(s_suppkey * 3 AS VARCHAR) END AS cnpj, 'N' || (s_suppkey % 40) AS name FROM supplier),
b AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE CAST(c_custkey // 3 AS VARCHAR) END AS cnpj, 'N' || (c_custkey // 4 + 20) AS name FROM customer),
g AS (SELECT *, id // 12 AS block FROM b),
k AS (SELECT g.*, (SELECT min(entity_id) FROM e WHERE e.cnpj = g.cnpj) AS by_id, n.entity_id AS by_name, n.cnpj AS name_cnpj FROM g LEFT JOIN (SELECT name, min(entity_id) AS entity_id, arg_min(struct_pack(c := cnpj), entity_id).c AS cnpj FROM e GROUP BY 1) n USING (name)),
o AS (SELECT * FROM k WHERE by_id IS NULL AND by_name IS NULL),
r AS (SELECT block, list(struct_pack(id := id, cnpj := cnpj, name := name) ORDER BY id) AS l FROM o GROUP BY 1),
m AS (SELECT unnest(list_reduce(list_prepend([NULL][:0], list_transform(l, lambda x: [x])), lambda a, x: CASE WHEN len(list_filter(a, lambda y: y.cnpj = x[1].cnpj OR y.name = x[1].name)) > 0 THEN a ELSE a || x END)) AS c FROM r)
SELECT k.id, CASE WHEN by_id IS NOT NULL OR mc.id IS NOT NULL THEN 'matched' WHEN by_name IS NOT NULL OR mn.id IS NOT NULL THEN CASE WHEN k.cnpj IS NOT NULL AND CASE WHEN by_name IS NOT NULL THEN name_cnpj ELSE mn.cnpj END IS NOT NULL THEN 'blocked' ELSE 'review' END ELSE 'created' END AS outcome,
 CASE WHEN by_id IS NOT NULL OR mc.id IS NOT NULL THEN by_id ELSE by_name END AS entity_id,
 CASE WHEN by_id IS NOT NULL THEN NULL WHEN mc.id IS NOT NULL THEN mc.id WHEN by_name IS NOT NULL THEN NULL ELSE coalesce(mn.id, k.id) END AS created_by
FROM k LEFT JOIN (SELECT c.id AS id, c.cnpj AS cnpj FROM m) mc ON mc.cnpj = k.cnpj AND mc.id < k.id LEFT JOIN (SELECT c.id AS id, c.cnpj AS cnpj, c.name AS name FROM m) mn ON mn.name = k.name AND mn.id < k.id""")
def ordered_import(spark, sf_dir):
    """MATCH-03: a batch imported row by row, in which created rows are candidates for later ones."""
    k = F.col("c_custkey")
    e = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.when(F.col("s_suppkey") % 4 != 0, (F.col("s_suppkey") * 3).cast("string")).alias("cnpj"), F.concat(F.lit("N"), F.col("s_suppkey") % 40).alias("name"), F.lit("f").alias("type"))
    b = table(spark, sf_dir, "customer").select(k.alias("id"), F.when(k % 6 != 0, F.expr("c_custkey div 3").cast("string")).alias("cnpj"), F.concat(F.lit("N"), F.expr("c_custkey div 4 + 20")).alias("name"), F.lit("f").alias("type"))
    return matching.import_in_order(b, e)


@query("""
SELECT n_regionkey AS region, CASE WHEN count(DISTINCT s_nationkey) = 0 THEN 'none' WHEN count(DISTINCT s_nationkey) = 1 THEN 'one' ELSE 'divergent' END AS outcome, count(*) AS providers
FROM nation JOIN supplier ON n_nationkey = s_nationkey WHERE s_acctbal > 5000 GROUP BY 1""")
def fund_consensus(spark, sf_dir):
    """AGG-20: one value, none or divergent."""
    joined = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    found = joined.groupBy(F.col("n_regionkey").alias("region")).agg(F.collect_set("s_nationkey").alias("v"), F.count("*").alias("providers"))
    return found.select("region", market.consensus(F.col("v")).alias("outcome"), "providers")


@query("""SELECT l_partkey, l_suppkey, min(l_orderkey * 10 + l_linenumber) AS first_line FROM lineitem WHERE l_partkey <> l_suppkey GROUP BY 1, 2""")
def party_pairs(spark, sf_dir):
    """MATCH-07."""
    rows = table(spark, sf_dir, "lineitem").withColumn("line", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return graph.first_pairs(rows, "l_partkey", "l_suppkey", "line")


@query("""SELECT s_nationkey, count(*) AS n, min(s_suppkey) AS first_id FROM supplier WHERE s_acctbal IS NOT NULL GROUP BY 1""")
def entities_by_type(spark, sf_dir):
    """MATCH-09."""
    return table(spark, sf_dir, "supplier").where("s_acctbal is not null").groupBy("s_nationkey").agg(F.count("*").alias("n"), F.min("s_suppkey").alias("first_id"))


@query("""
WITH o AS (SELECT o_custkey AS k, o_orderkey AS p, CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END AS a, CASE WHEN o_totalprice > 150000 THEN o_orderpriority END AS b FROM orders)
SELECT k, arg_max(a, CASE WHEN a IS NOT NULL THEN p END) AS a, arg_max(b, CASE WHEN b IS NOT NULL THEN p END) AS b FROM o GROUP BY 1""")
def provider_merge(spark, sf_dir):
    """MATCH-10: field by field, the value of the highest priority that has one."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("p"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("a"), F.when(F.col("o_totalprice") > 150000, F.col("o_orderpriority")).alias("b"))
    return matching.by_priority(o, "k", "p", ["a", "b"])


@query("""
WITH RECURSIVE s AS (SELECT CAST(l_suppkey AS VARCHAR) AS issuer, CAST(l_partkey AS VARCHAR) AS code, l_suppkey || '|' || l_partkey AS node, l_orderkey AS isin FROM lineitem),
e AS (SELECT DISTINCT a.node AS x, b.node AS y FROM s a JOIN s b ON a.issuer = b.issuer AND a.isin = b.isin AND a.node <> b.node),
r AS (SELECT x AS node, x AS label FROM e UNION SELECT r.node, e.y FROM r JOIN e ON r.label = e.x),
g AS (SELECT node, min(label) AS g FROM r GROUP BY 1),
n AS (SELECT s.issuer, s.code, coalesce(g.g, s.node) AS g, count(*) AS c FROM s LEFT JOIN g ON s.node = g.node GROUP BY 1, 2, 3)
SELECT issuer, code, first_value(code) OVER (PARTITION BY g ORDER BY c DESC, code) AS group_id FROM n""")
def alias_components(spark, sf_dir):
    """RULE-04: codes of one issuer that share an ISIN, over any number of hops, named by the most frequent code."""
    text = lambda c: F.col(c).cast("string")
    return graph.alias_groups(table(spark, sf_dir, "lineitem").select(text("l_suppkey").alias("issuer"), text("l_partkey").alias("code"), text("l_orderkey").alias("isin")))


@query("""
WITH s AS (SELECT l_suppkey AS issuer, l_partkey AS code, l_partkey % 50 AS number, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE CAST(l_orderkey % 500 AS VARCHAR) END AS isin, CAST(l_shipdate AS DATE) AS date FROM lineitem),
k AS (SELECT * FROM s WHERE isin <> '' QUALIFY row_number() OVER (PARTITION BY issuer, isin ORDER BY date DESC, code, number) = 1)
SELECT issuer, code, number, isin, strftime(date, '%Y-%m-%d') AS date FROM k UNION ALL SELECT issuer, code, number, isin, strftime(date, '%Y-%m-%d') FROM s WHERE isin = '' AND NOT EXISTS (SELECT 1 FROM s t WHERE t.isin <> '' AND t.issuer = s.issuer AND t.number = s.number)""")
def series_without_placeholders(spark, sf_dir):
    """RULE-04: placeholder rows of a series that has an ISIN go; one row for each ISIN, the newest."""
    isin = F.when(F.col("l_linenumber") % 3 == 0, "").otherwise((F.col("l_orderkey") % 500).cast("string"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("issuer"), F.col("l_partkey").alias("code"), (F.col("l_partkey") % 50).alias("number"), isin.alias("isin"), F.to_date("l_shipdate").alias("date"))
    return graph.without_placeholders(rows).withColumn("date", F.date_format("date", "yyyy-MM-dd"))


@query("""SELECT count(*) AS n, max(o_orderdate) = (SELECT max(o_orderdate) FROM orders) AS is_latest FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders)""")
def snapshot_monotonic(spark, sf_dir):
    """SCAN-17: only the latest competence is read."""
    orders = table(spark, sf_dir, "orders")
    newest = orders.agg(F.max("o_orderdate").alias("newest"))
    return orders.join(F.broadcast(newest), F.col("o_orderdate") == F.col("newest")).agg(F.count("*").alias("n"), (F.max("o_orderdate") == F.max("newest")).alias("is_latest"))
