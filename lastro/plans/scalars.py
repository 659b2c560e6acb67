"""Filters and scalar functions (FILT-*, STR-*, NUM-*, DATE-*, JSON-01, MAP-01, HASH-01)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identifiers, json_walk, text, values
from ..sources import guard
from ..sources.scratch import new_folder
from ..sources.tables import table
from .registry import query


@query("""SELECT c_custkey, c_name FROM customer WHERE c_name = 'Customer#000000007'""")
def lookup_by_code(spark, sf_dir):
    """FILT-01: the input is normalised, the stored code is not, so the scan still prunes."""
    code = " customer#000000007 ".strip()
    return table(spark, sf_dir, "customer").where(F.col("c_name") == code[0].upper() + code[1:]).select("c_custkey", "c_name")


@query("""SELECT DISTINCT c_custkey, c_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey WHERE lower(c_name) LIKE '%12%' OR lower(n_name) LIKE '%n_7%' OR lower(c_mktsegment) LIKE '%mach%' ORDER BY c_name, c_custkey LIMIT 200""")
def search_multi_column(spark, sf_dir):
    """FILT-02, FILT-03: a search over several columns; % and _ keep their meaning."""
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    found = joined.where(F.lower("c_name").like("%12%") | F.lower("n_name").like("%n_7%") | F.lower("c_mktsegment").like("%mach%"))
    return found.select("c_custkey", "c_name").distinct().orderBy("c_name", "c_custkey").limit(200)


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_totalprice <= 30000 AND o_orderdate BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1998-03-01'""")
def typed_range(spark, sf_dir):
    """FILT-06, FILT-10: a typed range and a list reach the scan as pushed filters."""
    return table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("F", "P") & (F.col("o_totalprice") <= 30000) & F.col("o_orderdate").between(F.lit("1996-03-01").cast("timestamp"), F.lit("1998-03-01").cast("timestamp"))).select("o_orderkey")


@query("""SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority LIKE '%HIGH%' AND (CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_orderdate END IS NULL OR o_orderdate >= TIMESTAMP '2000-01-01')""")
def download_candidates(spark, sf_dir):
    """FILT-11: by category, term and date; kept where there is no date."""
    date = F.when(F.col("o_orderkey") % 9 != 0, F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").where((F.col("o_orderstatus") == "P") & F.col("o_orderpriority").contains("HIGH") & (date.isNull() | (date >= F.lit("2000-01-01").cast("timestamp")))).select("o_orderkey")


@query(r"""SELECT page_id FROM pages WHERE regexp_matches(url, '^http://[a-z]+\.') AND url LIKE '%/en/%' AND trim(coalesce(html, '')) <> ''""")
def path_suffix(spark, sf_dir):
    """FILT-08, FILT-09."""
    return table(spark, sf_dir, "pages").where(F.col("url").rlike(r"^http://[a-z]+\.") & F.col("url").contains("/en/") & (F.trim(F.coalesce("html", F.lit(""))) != "")).select("page_id")


@query(r"""SELECT doc_id, regexp_replace(lower(strip_accents(coalesce(text, ''))), '^\s+|\s+$', '', 'g') AS folded FROM documents""")
def folded_text(spark, sf_dir):
    """STR-01: accents and case folded, whole texts."""
    return table(spark, sf_dir, "documents").select("doc_id", text.fold(F.col("text")).alias("folded"))


@query("""SELECT s_suppkey, trim(regexp_replace(upper(s_name), '[^A-Z0-9]+', ' ', 'g')) AS name FROM supplier""")
def matching_names(spark, sf_dir):
    """STR-02."""
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.matching_name(F.col("s_name")).alias("name"))


@query("""SELECT s_suppkey, s_suppkey % 4 < 2 AS same FROM supplier""")
def same_companies(spark, sf_dir):
    """STR-04: names equal but for case, accents and signs; an empty name equals nothing."""
    k = F.col("s_suppkey") % 4
    other = F.when(k == 0, F.concat(F.lit("  "), F.lower("s_name"), F.lit("!"))).when(k == 1, F.replace("s_name", F.lit("u"), F.lit("ú"))).when(k == 2, F.concat("s_name", F.lit("9"))).otherwise("")
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.same_company(F.when(k == 3, "").otherwise(F.col("s_name")), other).alias("same"))


@query("""SELECT s_suppkey, list_aggregate(list_filter(list_sort(list_distinct([CASE WHEN s_suppkey % 2 = 0 THEN 'cnpj=11222333000181' END, CASE WHEN s_suppkey % 3 = 0 THEN 'cnpj=12ABC34501DE35' END, 'w=SUPPLIER', 'w=' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0'), 'w=CREDITO'])), lambda x: x IS NOT NULL), 'string_agg', ' ') AS tokens FROM supplier""")
def party_name_tokens(spark, sf_dir):
    """STR-11: words before the first comma without stop words, and identifiers found in the name."""
    name = F.concat(
        F.replace("s_name", F.lit("#"), F.lit(" de ")),
        F.lit(" Crédito S.A., sociedade"),
        F.when(F.col("s_suppkey") % 2 == 0, " CNPJ 11.222.333/0001-81").otherwise(""),
        F.when(F.col("s_suppkey") % 3 == 0, " CNPJ 12.ABC.345/01DE-35").otherwise(" ref 12.ABC.345/01DE-36"),
    )
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(text.party_tokens(name), " ").alias("tokens"))


@query("""SELECT p_partkey, trim(regexp_replace(replace(lower(p_brand || ' | ' || p_name), '|', ''), '\\s+', ' ', 'g')) AS series_key, upper(regexp_replace(p_brand || ' ' || p_name, '\\s', '', 'g')) AS identifier FROM part""")
def series_keys(spark, sf_dir):
    """STR-03, STR-05."""
    both = F.concat("p_brand", F.lit(" | "), "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", text.series_key(both).alias("series_key"), text.clean_identifier(F.concat("p_brand", F.lit(" "), "p_name")).alias("identifier"))


@query("""WITH c AS (SELECT c_custkey, 'BR' || upper(substr(md5(CAST(c_custkey AS VARCHAR)), 1, 9)) || CASE WHEN c_custkey % 4 = 0 THEN 'X' ELSE '1' END AS isin FROM customer) SELECT c_custkey, CASE WHEN regexp_full_match(isin, '[A-Z]{2}[A-Z0-9]{9}[0-9]') THEN isin ELSE '' END AS isin FROM c""")
def valid_isins(spark, sf_dir):
    """STR-06."""
    isin = F.concat(F.lit("br"), F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 9), F.when(F.col("c_custkey") % 4 == 0, "X").otherwise("1"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.real_isin(isin).alias("isin"))


CNPJ_SQL = """
WITH b AS (SELECT c_custkey, lpad(CAST((c_custkey * 7919 + 13) % 99999999 AS VARCHAR), 8, '0') || '0001' AS base FROM customer),
d1 AS (SELECT *, list_sum(list_transform(range(1, 13), lambda i: CAST(substr(base, i, 1) AS INTEGER) * ([5,4,3,2,9,8,7,6,5,4,3,2])[i])) % 11 AS r FROM b),
e1 AS (SELECT *, base || CASE WHEN r < 2 THEN 0 ELSE 11 - r END AS b1 FROM d1),
d2 AS (SELECT *, list_sum(list_transform(range(1, 14), lambda i: CAST(substr(b1, i, 1) AS INTEGER) * ([6,5,4,3,2,9,8,7,6,5,4,3,2])[i])) % 11 AS r2 FROM e1),
f AS (SELECT c_custkey, b1 || CASE WHEN r2 < 2 THEN 0 ELSE 11 - r2 END AS good FROM d2)
"""


def _good_ids(customers):
    """Valid ids made from the customers' keys."""

    def whole(base):
        return identifiers.let(F.concat(base, identifiers.check_digit(base, identifiers.CNPJ_WEIGHTS[0]).cast("string")), lambda x: F.concat(x, identifiers.check_digit(x, identifiers.CNPJ_WEIGHTS[1]).cast("string")))

    base = F.concat(F.lpad(((F.col("c_custkey") * 7919 + 13) % 99999999).cast("string"), 8, "0"), F.lit("0001"))
    return customers.select("c_custkey", identifiers.let(base, whole).alias("good"))


@query(CNPJ_SQL + """SELECT c_custkey, CASE WHEN c_custkey % 3 = 1 THEN good END AS cnpj, CASE WHEN c_custkey % 3 = 0 THEN 'invalid' WHEN c_custkey % 3 = 2 THEN 'invalid' ELSE 'cnpj' END AS kind FROM f""")
def checked_identifiers(spark, sf_dir):
    """STR-07, STR-08: two check digits computed as columns; one in three is spoilt, one has half a mask."""
    last = F.substring("good", 14, 1).cast("int")
    given = F.concat(F.substring("good", 1, 13), F.when(F.col("c_custkey") % 3 == 0, (last + 1) % 10).otherwise(last))
    masked = identifiers.format_cnpj(F.col("given"))
    shown = F.when(F.col("c_custkey") % 3 == 2, F.replace(masked, F.lit("/"), F.lit(""))).otherwise(masked)
    rows = _good_ids(table(spark, sf_dir, "customer")).select("c_custkey", given.alias("given"))
    return rows.select("c_custkey", identifiers.normalise_cnpj(shown).alias("cnpj"), identifiers.fund_identifier_class(shown).alias("kind"))


@query(CNPJ_SQL + """SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN 'cnpj' WHEN 1 THEN 'nao_informado' WHEN 2 THEN 'nao_informado' WHEN 3 THEN 'cpf' WHEN 4 THEN 'invalido' ELSE CASE WHEN good LIKE '0%' AND good NOT LIKE '000%' THEN 'cnpj_sem_zeros' ELSE 'cnpj' END END AS kind FROM f""")
def market_identifiers(spark, sf_dir):
    """STR-08, market: broken masks are read by their digits, left zeros are restored, placeholders mean not informed."""
    k = F.col("c_custkey") % 6
    bare = F.when(F.col("good").rlike("^0(?!00)"), F.regexp_replace("good", "^0+", "")).otherwise(F.col("good"))
    given = F.when(k == 0, F.regexp_replace("good", "^(..)", "$1-")).when(k == 1, "NA").when(k == 2, "99.999.999/9999-99").when(k == 3, "529.982.247-25").when(k == 4, "529.982.247-24").otherwise(bare)
    return _good_ids(table(spark, sf_dir, "customer")).select("c_custkey", identifiers.market_identifier_class(given).alias("kind"))


@query(CNPJ_SQL + """SELECT c_custkey, good[1:2] || '.' || good[3:5] || '.' || good[6:8] || '/' || good[9:12] || '-' || good[13:14] AS formatted FROM f""")
def formatted_identifiers(spark, sf_dir):
    """STR-09."""
    return _good_ids(table(spark, sf_dir, "customer")).select("c_custkey", identifiers.format_cnpj(F.col("good")).alias("formatted"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 0.0 ELSE o_totalprice END AS market, CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS event FROM orders""")
def money_parsing(spark, sf_dir):
    """NUM-01: 0 or null where a text is no number; the two rules differ."""
    shown = F.when(F.col("o_orderkey") % 4 == 0, "n/d").otherwise(F.replace(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("."), F.lit(",")))
    return table(spark, sf_dir, "orders").select("o_orderkey", values.money_or_zero(shown).cast("double").alias("market"), values.money_or_null(shown).cast("double").alias("event"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN -o_totalprice ELSE o_totalprice END AS amount FROM orders""")
def brazilian_amounts(spark, sf_dir):
    """STR-15: R$ -1.234,56 and 1.234,56%; signs alone are null."""
    from ..functions.values import grouped

    cents = F.abs(F.col("o_totalprice")).cast("decimal(18,2)").cast("string")
    written = F.concat(grouped(F.substring_index(cents, ".", 1)), F.lit(","), F.substring_index(cents, ".", -1))
    shown = F.when(F.col("o_orderkey") % 5 == 0, "R$ -").when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("R$ -"), written)).otherwise(F.concat(written, F.lit(" %")))
    return table(spark, sf_dir, "orders").select("o_orderkey", values.brazilian_decimal(shown).cast("double").alias("amount"))


RATE_SQL = """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS BIGINT) AS q, CAST(round(l_discount * 100) AS BIGINT) AS d FROM lineitem)"""


def _rates(spark, sf_dir):
    q, d = F.col("l_quantity").cast("long").cast("string"), F.round(F.col("l_discount") * 100).cast("long").cast("string")
    shown = (
        F.when(F.col("l_linenumber") % 4 == 0, F.concat(q, F.lit("% (por cento) da variação acumulada das taxas médias diárias dos DI, base 252 dias")))
        .when(F.col("l_linenumber") % 4 == 1, F.concat(F.lit("IPCA + "), d, F.lit(",5000% ao ano")))
        .when(F.col("l_linenumber") % 4 == 2, F.concat(F.lit("Pré-fixada "), q, F.lit(",128% a.a.")))
        .otherwise(F.concat(F.lit("100% da Taxa DI acrescida de "), d, F.lit(",25% ao ano; taxa prefixada")))
    )
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", shown.alias("rate"))


@query(RATE_SQL + """SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 4 WHEN 0 THEN 'idx=DI mult=' || q WHEN 1 THEN 'idx=IPCA taxa=' || d || '.5' WHEN 2 THEN 'idx=PREFIXADA taxa=' || q || '.128' ELSE 'idx=DI mult=100 taxa=' || d || '.25' END AS tokens FROM r""")
def rate_token_sets(spark, sf_dir):
    """STR-10: a percentage of an index, a spread over it and a fixed rate are told apart; 252 days are no rate."""
    return _rates(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(values.rate_tokens(F.col("rate")), " ").alias("tokens"))


@query(RATE_SQL + """SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 4 WHEN 0 THEN 'mult=' || q WHEN 1 THEN 'taxa=' || d || '.5' WHEN 2 THEN 'taxa=' || q || '.13' ELSE 'mult=100 taxa=' || d || '.25' END AS numbers FROM r""")
def rate_numbers(spark, sf_dir):
    """STR-12: only the numbers, to two places, decide whether a rate changed."""
    return _rates(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(values.rate_numbers(F.col("rate")), " ").alias("numbers"))


@query("""SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN '' WHEN 2 THEN 'br' || lower(c_mktsegment) ELSE 'a+ (bra)' END AS rating FROM customer""")
def ratings(spark, sf_dir):
    """STR-13: texts that mean no rating are empty, whatever their accents and final points."""
    k = F.col("c_custkey") % 4
    shown = F.when(k == 0, " Não  há.").when(k == 1, "0").when(k == 2, F.concat(F.lit("br"), "c_mktsegment")).otherwise("A+ (bra).")
    return table(spark, sf_dir, "customer").select("c_custkey", values.rating_key(shown).alias("rating"))


@query("""
WITH v AS (SELECT o_orderkey, o_orderkey % 4 AS k, CAST(o_orderdate AS DATE) AS d, CAST(o_totalprice AS DECIMAL(18,2)) AS p, CAST(o_orderkey % 50 AS VARCHAR) AS f FROM orders)
SELECT o_orderkey, CASE k
 WHEN 0 THEN strftime(d, '%d/%m/%Y') || ' ; ' || day(d) || ' de ' || (['janeiro','fevereiro','marco','abril','maio','junho','julho','agosto','setembro','outubro','novembro','dezembro'])[month(d)] || ' de ' || year(d)
  || CASE WHEN day(d) < 10 THEN ' ; ' || strftime(d, '%d') || ' de ' || (['janeiro','fevereiro','marco','abril','maio','junho','julho','agosto','setembro','outubro','novembro','dezembro'])[month(d)] || ' de ' || year(d) ELSE '' END
  || CASE WHEN day(d) = 1 THEN ' ; 1o de ' || (['janeiro','fevereiro','marco','abril','maio','junho','julho','agosto','setembro','outubro','novembro','dezembro'])[month(d)] || ' de ' || year(d) ELSE '' END
 WHEN 1 THEN replace(format('{:,}', CAST(floor(p) AS BIGINT)), ',', '.') || ',' || right(CAST(p AS VARCHAR), 2) || ' ; r$ ' || replace(format('{:,}', CAST(floor(p) AS BIGINT)), ',', '.')
 WHEN 2 THEN f || '% ; ' || f || ',00% ; ' || f || ',0%'
 ELSE CASE WHEN floor(p) >= 1000 THEN replace(format('{:,}', CAST(floor(p) AS BIGINT)), ',', '.') ELSE '' END END AS variants FROM v""")
def contract_variants(spark, sf_dir):
    """STR-14: how dates, amounts, shares and whole numbers are written in contracts."""
    k, p = F.col("o_orderkey") % 4, F.col("o_totalprice").cast("decimal(18,2)")
    value = F.when(k == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 1, p.cast("string")).when(k == 2, ((F.col("o_orderkey") % 50) / 100).cast("decimal(6,2)").cast("string")).otherwise(F.floor(p).cast("string"))
    unit = F.when(k == 1, "BRL").when(k == 2, "Fração").otherwise("")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(values.value_variants(value, unit), " ; ").alias("variants"))


@query("""SELECT o_orderkey, list_aggregate([CAST(month(o_orderdate) - 1 AS INTEGER), CASE WHEN month(o_orderdate) <> 12 THEN 11 END], 'string_agg', ',') AS months FROM orders""")
def payment_months(spark, sf_dir):
    """DATE-04: months spelt out in a text."""
    month = F.element_at(F.array(*[F.lit(m.replace("marco", "março")) for m in values.MONTHS]), F.month("o_orderdate"))
    shown = F.concat(F.lit("Em "), F.initcap(month), F.lit(" e DEZEMBRO, maiores"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(values.named_months(text.fold(shown)), ",").alias("months"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, sha256('{"part":' || l_partkey || ',"flag":' || CASE WHEN l_linenumber = 2 THEN 'null' ELSE '"' || l_returnflag || '"' END || '}') AS hash FROM lineitem""")
def record_hashes(spark, sf_dir):
    """STR-16: the hash of a record's canonical JSON, nulls included."""
    flag = F.when(F.col("l_linenumber") != 2, F.col("l_returnflag"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", values.record_hash(F.col("l_partkey").alias("part"), flag.alias("flag")).alias("hash"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN k = 'text' THEN NULL WHEN l_linenumber % 4 = 1 THEN NULL WHEN k = 'integer' AND l_linenumber % 4 <> 2 THEN CAST(q AS VARCHAR) WHEN k = 'date' AND l_linenumber % 4 <> 2 THEN strftime(l_shipdate, '%Y-%m-%d') END AS value,
 CASE WHEN l_linenumber % 4 = 1 THEN 'present_empty' WHEN k = 'text' THEN 'absent' WHEN l_linenumber % 4 = 2 THEN 'invalid' WHEN k = 'integer' AND q = 0 THEN 'zero' ELSE 'present_value' END AS state,
 CASE WHEN k <> 'text' AND l_linenumber % 4 = 2 THEN 'invalid' ELSE 'valid' END AS validity
FROM (SELECT *, CASE l_orderkey % 3 WHEN 0 THEN 'integer' WHEN 1 THEN 'date' ELSE 'text' END AS k, CAST(l_quantity AS BIGINT) % 10 AS q FROM lineitem)""")
def leaf_values(spark, sf_dir):
    """PROJ-04: a leaf's value, state and validity by its declared type."""
    kind = F.when(F.col("l_orderkey") % 3 == 0, "integer").when(F.col("l_orderkey") % 3 == 1, "date").otherwise("text")
    good = F.when(kind == "integer", (F.col("l_quantity").cast("long") % 10).cast("string")).when(kind == "date", F.date_format("l_shipdate", "yyyy-MM-dd"))
    raw = F.when(F.col("l_linenumber") % 4 == 1, " ").when((F.col("l_linenumber") % 4 == 2) & (kind != "text"), "1,5").otherwise(good)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", values.leaf_value(raw, kind).alias("v")).select("l_orderkey", "l_linenumber", "l_partkey", "v.*")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN s > 1 AND s <= 100 THEN round(s / 100, 6) WHEN s > 0 AND s <= 1 THEN s END AS share FROM (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity * 3 ELSE l_discount END AS s FROM lineitem)""")
def normalised_shares(spark, sf_dir):
    """NUM-02."""
    s = F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity") * 3).otherwise(F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(values.share(s), 6).alias("share"))


@query("""SELECT o_orderkey, o_totalprice > 20 * (o_orderkey % 9) * 2000 AND o_orderkey % 9 > 0 AS suspect, CASE WHEN o_totalprice > 20 * (o_orderkey % 9) * 2000 AND o_orderkey % 9 > 0 THEN 0 ELSE o_totalprice END AS trusted FROM orders""")
def suspect_balances(spark, sf_dir):
    """NUM-03."""
    paid, b = (F.col("o_orderkey") % 9) * 2000, F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select("o_orderkey", values.suspect_balance(b, paid).alias("suspect"), values.trusted_balance(b, paid).cast("double").alias("trusted"))


@query("""SELECT o_orderkey, CAST(o_orderkey % 3 * 0 + CASE o_orderkey % 2 WHEN 0 THEN 1000 ELSE 1 END AS BIGINT) * CAST(o_orderkey AS BIGINT) AS amount FROM orders""")
def unit_amounts(spark, sf_dir):
    """NUM-06: factors of declared units; another unit is an error."""
    unit = F.when(F.col("o_orderkey") % 2 == 0, "BRL_mil").otherwise("BRL")
    return table(spark, sf_dir, "orders").select("o_orderkey", values.in_units(F.col("o_orderkey"), unit).alias("amount"))


@query("""SELECT o_orderkey, CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INTEGER) AS month_index, strftime(date_trunc('month', o_orderdate) - INTERVAL 5 MONTH, '%Y-%m-%d') AS window_start, CAST(datediff('day', last_day(CAST(o_orderdate AS DATE)), CAST(o_orderdate AS DATE) + 40) AS INTEGER) AS delay FROM orders""")
def date_arithmetic(spark, sf_dir):
    """DATE-01, DATE-02, DATE-03."""
    day = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", values.month_index(day).alias("month_index"), F.date_format(values.window_start(day, 5), "yyyy-MM-dd").alias("window_start"), values.delivery_delay(F.date_add(day, 40), day).alias("delay"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS parsed FROM orders WHERE o_orderkey % 3 <> 2 UNION ALL SELECT o_orderkey, NULL FROM orders WHERE o_orderkey % 3 = 2""")
def date_texts(spark, sf_dir):
    """DATE-05: ISO or dd/MM/yyyy; anything else is null."""
    shown = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).otherwise("31/02/x")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(values.legacy_timestamp(shown), "yyyy-MM-dd").alias("parsed"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def json_props(spark, sf_dir):
    """JSON-01."""
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("""
WITH e AS (SELECT event_id, '{"a": {"b": [' || props || ', {"c": "' || event_type || '"}], "empty": []}, "d": [1, [true, null, ' || props || ']]}' AS j FROM events)
SELECT event_id, substr(t.fullkey, 3) AS path, CASE WHEN t.fullkey NOT LIKE '%]' THEN t."key" END AS "key", CASE WHEN t.type = 'NULL' THEN NULL ELSE json_extract_string(j, t.fullkey) END AS leaf FROM e, json_tree(j) t WHERE t.type NOT IN ('OBJECT', 'ARRAY')""")
def json_paths(spark, sf_dir):
    """JSON-01: every leaf of nested JSON with its path, at any depth."""
    made = F.concat(F.lit('{"a": {"b": ['), "props", F.lit(', {"c": "'), "event_type", F.lit('"}], "empty": []}, "d": [1, [true, null, '), "props", F.lit("]]}"))
    found = json_walk.json_leaves(table(spark, sf_dir, "events").select("event_id", made.alias("j")), "j")
    return found.select("event_id", "path", "key", "leaf")


OBSERVED = """o AS (SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'registro.CNPJ_Classe' WHEN 1 THEN 'registro.CPF_CNPJ_Gestor' WHEN 2 THEN 'cadastro.Diretor' ELSE 'cadastro.Valor' END AS field_name, CASE o_orderkey % 5 WHEN 0 THEN '11222333000181' WHEN 1 THEN '529.982.247-25' WHEN 2 THEN NULL WHEN 3 THEN '11.222.333/0001-81' ELSE '52998224725' END AS value FROM orders)"""


def _observed(spark, sf_dir):
    k = F.col("o_orderkey")
    field = F.when(k % 6 == 0, "registro.CNPJ_Classe").when(k % 6 == 1, "registro.CPF_CNPJ_Gestor").when(k % 6 == 2, "cadastro.Diretor").otherwise("cadastro.Valor")
    value = F.when(k % 5 == 0, "11222333000181").when(k % 5 == 1, "529.982.247-25").when(k % 5 == 3, "11.222.333/0001-81").when(k % 5 == 4, "52998224725")
    return table(spark, sf_dir, "orders").select(k.alias("id"), field.alias("field_name"), value.alias("value"))


REFUSED = """CASE WHEN field_name = 'cadastro.Diretor' THEN 'column of a natural person or of a contact' WHEN field_name LIKE 'registro%' AND id % 5 IN (1, 4) THEN 'looks like a CPF' WHEN field_name LIKE 'registro%' AND id % 5 > 0 THEN 'not a CNPJ as it is stored' END"""


@query(f"WITH {OBSERVED} SELECT id, field_name || ': ' || {REFUSED} AS refused FROM o WHERE {REFUSED} IS NOT NULL")
def refused_observations(spark, sf_dir):
    """RULE-23: observations that the guard stops, and why."""
    found = guard.refusal(F.col("field_name"), F.col("value"))
    return _observed(spark, sf_dir).select("id", found.alias("refused")).where("refused is not null")


@query(f"WITH {OBSERVED} SELECT id, field_name, value FROM o WHERE {REFUSED} IS NULL")
def guarded_write(spark, sf_dir):
    """RULE-23: what a guarded write has written, once the refused rows were left out."""
    path = new_folder(spark, "guarded")
    observed = _observed(spark, sf_dir)
    guard.write_guarded(observed.where(guard.refusal(F.col("field_name"), F.col("value")).isNull()), path)
    return spark.read.parquet(path)


@query("""SELECT doc_id, sha256(text) AS text_sha256, left(text, 300) AS excerpt FROM documents""")
def hashed_texts(spark, sf_dir):
    """HASH-01, STR-16, TXT-14."""
    from ..operators.text_rules import excerpt_evidence

    found = excerpt_evidence(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", found["text_sha256"].alias("text_sha256"), found["excerpt"].alias("excerpt"))


SHAPE_SQL = r"""CASE WHEN v = '' THEN 'empty' WHEN regexp_full_match(v, '-?0+(\.0+)?') THEN 'zero' WHEN regexp_full_match(v, '-?[0-9]+') THEN 'integer' WHEN regexp_full_match(v, '-?[0-9]+\.[0-9]+') THEN 'decimal_dot' WHEN regexp_full_match(v, '-?[0-9]{1,3}(\.[0-9]{3})*,[0-9]+|-?[0-9]+,[0-9]+') THEN 'decimal_comma' WHEN regexp_full_match(v, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN 'date_iso' WHEN regexp_full_match(v, '[0-9]{2}/[0-9]{2}/[0-9]{4}') THEN 'date_br' ELSE 'text' END"""


@query(f"""WITH w AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), ' ')) AS v FROM documents) SELECT {SHAPE_SQL} AS shape, count(*) AS n, count(DISTINCT doc_id) AS texts FROM w GROUP BY 1""")
def value_shapes(spark, sf_dir):
    """STR-17: the forms of all blank-separated values of the texts."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), " ")).alias("v"))
    return words.groupBy(text.value_shape(F.col("v")).alias("shape")).agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("texts"))


@query(r"""SELECT doc_id, regexp_replace(text, '[\w.+-]+@[\w-]+\.[\w.]+', '***@***', 'g') <> text OR regexp_replace(text, '\b[0-9]{3}\.?[0-9]{3}\.?[0-9]{3}-?[0-9]{2}\b', '*', 'g') <> text AS has_personal, regexp_matches(text, '(?i)(token|senha|password|secret|api[_-]?key)\s*[=:]\s*\S+') AS has_secret, length(regexp_replace(text, '(?i)(token|senha|password|secret|api[_-]?key)(\s*[=:]\s*)\S+', '\1\2***', 'g')) AS masked_length FROM documents""")
def masked_texts(spark, sf_dir):
    """STR-17, STR-18, RULE-23: what the guards mask before a write."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", (text.mask_personal(t) != t).alias("has_personal"), text.has_secret(t).alias("has_secret"), F.char_length(text.mask_secrets(t)).cast("long").alias("masked_length"))


@query("""SELECT c_custkey, CASE c_custkey % 3 WHEN 1 THEN repeat('x', 60) || '…' WHEN 2 THEN c_mktsegment ELSE regexp_replace(c_name, '[A-Za-z0-9]', '*', 'g') END AS example FROM customer""")
def shown_examples(spark, sf_dir):
    """STR-17: examples of values, starred under a personal tag and cut when long."""
    k = F.col("c_custkey") % 3
    tag = F.when(k == 0, "EnderecoCedente").otherwise("Segmento")
    value = F.when(k == 0, F.col("c_name")).when(k == 1, F.repeat(F.lit("x"), 80)).otherwise(F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", text.shown_example(tag, value).alias("example"))
