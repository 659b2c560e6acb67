"""Files written from the benchmark tables and read back (SCAN-01 to SCAN-05, SCAN-11 to SCAN-13, SINK-01, SINK-02)."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, LongType, StringType, StructField, StructType

from ..operators import text_rules
from ..sources import files, members
from ..sources.scratch import new_folder
from ..sources.tables import table
from .registry import query


def _archives(lines):
    """(file, content): a ZIP for each file of lines (file, at, raw), with a CSV member and one that isn't read."""

    @F.arrow_udf("binary")
    def packed(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            held = io.BytesIO()
            with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
                archive.writestr("dados.csv", text.encode("latin-1"))
                archive.writestr("leia-me.txt", "x")
            out.append(held.getvalue())
        return pa.array(out, pa.binary())

    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "raw"))), lambda x: x["raw"]), "\r\n")
    texts = lines.groupBy("file").agg(F.concat(F.lit("Chave;Nome;Valor\r\n"), text, F.lit("\r\n")).alias("text"))
    return texts.select("file", packed("text").alias("content"))


@query("""SELECT 'f' || (o_custkey % 20) AS file, 'dados.csv' AS member, CAST(o_orderkey AS VARCHAR) AS "Chave", CASE o_orderkey % 4 WHEN 0 THEN 'dois; três' WHEN 1 THEN '"aberta' WHEN 2 THEN 'diz "sim"' ELSE o_orderpriority END AS "Nome", CAST(o_orderkey % 1000 AS VARCHAR) AS "Valor" FROM orders""")
def archived_records(spark, sf_dir):
    """SCAN-01, SCAN-02, SCAN-03: records by physical line of the CSV members of archives, by name; open quotes are text."""
    k = F.col("o_orderkey")
    name = F.when(k % 4 == 0, '"dois; três"').when(k % 4 == 1, '"aberta').when(k % 4 == 2, '"diz ""sim"""').otherwise(F.col("o_orderpriority"))
    lines = table(spark, sf_dir, "orders").select(F.concat(F.lit("f"), F.col("o_custkey") % 20).alias("file"), k.alias("at"), F.concat_ws(";", k.cast("string"), name, (k % 1000).cast("string")).alias("raw"))
    members = files.archive_members(_archives(lines)).select("file", "member", "text")
    return files.with_header(files.physical_lines(members), ["Chave", "Nome", "Valor"]).drop("line")


@query("""SELECT o_orderkey, o_custkey, 'São– "' || o_orderstatus || '"' AS status, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders""")
def typed_csv_files(spark, sf_dir):
    """SCAN-02, SCAN-05: typed columns of text files in windows-1252 whose quotes are text."""
    path = new_folder(spark, "typed")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.concat(F.lit('São\u0096 "'), "o_orderstatus", F.lit('"')).alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    rows.write.csv(path, header=True, sep=";", encoding="ISO-8859-1", quote="\u0000", escape="\u0000")
    schema = StructType([StructField("o_orderkey", LongType()), StructField("o_custkey", LongType()), StructField("status", StringType()), StructField("day", DateType())])
    return files.typed_csv(spark, path, schema).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("""SELECT o_custkey % 7 AS kind, year(o_orderdate) AS year, max(first) AS file_id FROM (SELECT o_custkey, o_orderdate, min(o_orderkey) OVER (PARTITION BY o_custkey % 7, year(o_orderdate), o_orderpriority) AS first FROM orders) GROUP BY 1, 2""")
def current_files(spark, sf_dir):
    """SCAN-03: the newest file of a kind and year supersedes; content seen before is no new file."""
    manifest = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 7).alias("kind"), F.year("o_orderdate").cast("long").alias("year"), F.col("o_orderpriority").alias("sha256"), F.col("o_orderkey").alias("file_id"))
    return files.newest_files(manifest)


@query("""SELECT 'f' || (p_partkey % 10) AS file, CAST(p_partkey AS VARCHAR) AS code, p_brand AS brand, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END AS kind FROM part""")
def tab_export_rows(spark, sf_dir):
    """SCAN-11: rows of tab-separated exports after their preamble; short rows are padded."""
    k = F.col("p_partkey")
    raw = F.concat(k.cast("string"), F.lit("\t "), "p_brand", F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("\t"), "p_type")))
    held = F.transform(F.array_sort(F.collect_list(F.struct(k.alias("at"), raw.alias("raw")))), lambda x: x["raw"])
    texts = table(spark, sf_dir, "part").groupBy(F.concat(F.lit("f"), k % 10).alias("file")).agg(F.concat(F.lit("Relatório\nem 2026\n\nCodigo do Ativo\tEmpresa \tTipo\n"), F.array_join(held, "\n"), F.lit("\n")).alias("text"))
    cells = files.tab_export(texts, "Codigo do Ativo")
    return cells.select("file", F.col("cells")["Codigo do Ativo"].alias("code"), F.col("cells")["Empresa"].alias("brand"), F.col("cells")["Tipo"].alias("kind"))


@query("""
WITH l AS (SELECT l_orderkey, l_partkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag) - 1 AS n FROM lineitem)
SELECT l_orderkey, 'r/item/parte' AS xml_path, CAST(n AS INTEGER) AS item, CAST(l_partkey AS VARCHAR) AS raw_text, false AS xsi_nil FROM l UNION ALL SELECT l_orderkey, 'r/item/sinal', CAST(n AS INTEGER), CASE WHEN l_linenumber = 2 THEN '' ELSE l_returnflag END, l_linenumber = 2 FROM l""")
def xml_leaf_rows(spark, sf_dir):
    """SCAN-13: every leaf of XML documents with the numbers of the blocks that hold it."""
    item = F.concat(F.lit("<item><parte>"), "l_partkey", F.lit("</parte>"), F.when(F.col("l_linenumber") == 2, '<sinal xsi:nil="true"/>').otherwise(F.concat(F.lit("<sinal>"), "l_returnflag", F.lit("</sinal>"))), F.lit("</item>"))
    held = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", item.alias("x")))), lambda x: x["x"])
    docs = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.concat(F.lit('<r xmlns:xsi="http://www.w3.org/2001/XMLSchema-instance">'), F.array_join(held, "\n"), F.lit("</r>")).cast("binary").alias("content"))
    return files.xml_values(docs).select("l_orderkey", "xml_path", F.element_at("chain", 2).alias("item"), "raw_text", "xsi_nil")


@query("""SELECT c_custkey, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS segment, 'Emissor & Cia' AS issuer FROM customer""")
def html_label_pairs(spark, sf_dir):
    """SCAN-12: labels and values of two-cell rows and definition lists; the first label wins."""
    segment = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("<tr class='x'><td>Segmento</td>\n<td><span>"), "c_mktsegment", F.lit("</span></td></tr>"))).otherwise("")
    page = F.concat(F.lit("<html><table><tr><th>Nome</th><td> <b>"), "c_name", F.lit("</b>\n</td></tr>"), segment, F.lit("<tr><td>Nome</td><td>outro</td></tr></table><dl><dt>Emissor</dt><dd>Emissor\n & Cia</dd></dl></html>"))
    pairs = table(spark, sf_dir, "customer").select("c_custkey", text_rules.html_pairs(page).alias("p"))
    get = lambda k, n: F.try_element_at("p", F.lit(k)).alias(n)
    return pairs.select("c_custkey", get("Nome", "name"), get("Segmento", "segment"), get("Emissor", "issuer"))


@query("""SELECT o_custkey AS k, max(o_orderkey) AS id, CASE WHEN max(o_orderkey) % 6 <> 0 THEN arg_max(o_orderpriority, o_orderkey) END AS priority FROM orders GROUP BY 1""")
def exported_csv(spark, sf_dir):
    """SINK-01: the consolidated form of a history, written as CSV with a byte-order mark and read back."""
    path = new_folder(spark, "csv")
    priority = F.when(F.col("o_orderkey") % 6 != 0, F.col("o_orderpriority"))
    history = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("id"), priority.alias("priority"))
    files.export(files.consolidated(history, ["k"], "id"), path)
    return spark.read.csv(path, header=True, schema="k long, id long, priority string")


@query("""SELECT s_suppkey, s_name, CASE WHEN s_acctbal >= 0 THEN s_acctbal END AS balance FROM supplier""")
def exported_json(spark, sf_dir):
    """SINK-02: JSON lines with nulls, read back."""
    path = new_folder(spark, "json")
    files.export(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", F.when(F.col("s_acctbal") >= 0, F.col("s_acctbal")).alias("balance")), path, "json")
    return spark.read.json(path, schema="s_suppkey long, s_name string, balance double")


def _members_archived(rows):
    """(file, content): a ZIP for each file of rows (file, member, text)."""

    @F.arrow_udf("binary")
    def packed(held: pa.Array) -> pa.Array:
        out = []
        for one in held.to_pylist():
            content = io.BytesIO()
            with zipfile.ZipFile(content, "w", zipfile.ZIP_DEFLATED) as archive:
                for m in one:
                    archive.writestr(m["member"], m["text"].encode("latin-1"))
            out.append(content.getvalue())
        return pa.array(out, pa.binary())

    return rows.groupBy("file").agg(F.collect_list(F.struct("member", "text")).alias("m")).select("file", packed("m").alias("content"))


#: The columns of the made archives: the leading ones, a series and a subclass, and the values of a line.
LEADING = [members.KIND, members.SUBJECT, members.NAME, members.COMPETENCE]
HEADERS = {t: [*LEADING, *([members.SERIES, members.SUBCLASS] if t.startswith("tab_X_") else []), "QT", "VL"] for t in members.FUND_TABLES}


def _fund_archives(spark, sf_dir):
    """One archive a supplier's month, of 18 members; the supplier's number says what is wrong with it."""
    tables = F.array(*[F.lit(t) for t in members.FUND_TABLES])
    lines = table(spark, sf_dir, "lineitem").where("l_suppkey <= 40").select(F.col("l_suppkey").alias("f"), F.posexplode(tables).alias("at", "t"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    lines = lines.where("(l_partkey + at) % 4 = 0 or at = 0")
    f, t = F.col("f"), F.col("t")
    day = F.when((f == 7) & (t == "tab_V"), "2026-08-30").when(f == 8, "2026-07-31").when(f == 9, "2999-09-30").when((f == 10) & (t == "tab_II"), "x").otherwise("2026-09-30")
    name = F.concat(F.lit("Fundo "), F.col("l_partkey") % 30, F.when((f % 5 == 0) & (t == "tab_III") & (F.col("l_partkey") % 2 == 0), " II").otherwise(""))
    series = F.when(t.startswith("tab_X_"), F.concat(F.lit(";Série "), F.col("l_linenumber") % 3, F.lit(";S"), F.col("l_partkey") % 11)).otherwise("")
    kind = F.when(F.col("l_partkey") % 7 == 0, "Outro").when(F.col("l_partkey") % 2 == 0, "Fundo").otherwise("Classe")
    raw = F.concat(kind, F.lit(";"), F.lpad((F.col("l_partkey") % 30).cast("string"), 14, "0"), F.lit(";"), name, F.lit(";"), day, series, F.lit(";"), F.col("l_quantity").cast("int"), F.lit(";"), F.col("l_orderkey"))
    raw = F.when((f == 11) & (t == "tab_IX"), F.concat(raw, F.lit(";mais"))).otherwise(raw)
    headers = F.create_map(*[F.lit(x) for k, v in HEADERS.items() for x in (k, ";".join(v))])
    header = F.when((f == 12) & (t == "tab_VI"), "X;Y").otherwise(headers[t])
    text = F.array_join(F.concat(F.array(F.first(header)), F.array_sort(F.collect_list(raw))), "\r\n")
    held = lines.groupBy("f", "t").agg(text.alias("text"))
    wrong = F.when(f == 1, F.when(t != "tab_VII", F.array(t))).when(f == 2, F.array(t, F.when(t == "tab_I", F.lit("tab_XI")))).otherwise(F.array(t))
    held = held.select("f", "text", F.explode(F.array_compact(wrong)).alias("t"))
    period = F.when((f == 3) & (t == "tab_IV"), "202608").when(f == 9, "299909").otherwise("202609")
    member = F.when((f == 2) & (t == "tab_XI"), "outro.csv").otherwise(F.concat(F.lit("inf_mensal_fidc_"), t, F.lit("_"), period, F.lit(".csv")))
    member = F.array(member, F.when((f == 6) & (t == "tab_II"), "inf_mensal_fidc_tab_II_202609.csv"))
    name = F.concat(f.cast("string"), F.lit("/inf_mensal_fidc_"), F.when(f == 4, "202610").when(f == 9, "299909").otherwise("202609"), F.lit(".zip"))
    return files.archive_members(_members_archived(held.select(name.alias("file"), F.explode(F.array_compact(member)).alias("member"), "text"))).select("file", "member", "text")


FUND_LINES = f"""
WITH t AS (SELECT unnest({list(members.FUND_TABLES)}) AS t, unnest(range(18)) AS place),
l AS (SELECT l_suppkey AS f, t, CASE WHEN l_partkey % 7 = 0 THEN 'Outro' WHEN l_partkey % 2 = 0 THEN 'Fundo' ELSE 'Classe' END AS kind, l_partkey % 30 AS subject, 'Fundo ' || (l_partkey % 30) || CASE WHEN l_suppkey % 5 = 0 AND t = 'tab_III' AND l_partkey % 2 = 0 THEN ' II' ELSE '' END AS name,
 CASE WHEN starts_with(t, 'tab_X_') THEN l_linenumber % 3 END AS series, CASE WHEN starts_with(t, 'tab_X_') THEN l_partkey % 11 END AS subclass, l_quantity, l_orderkey, CASE WHEN l_suppkey = 6 AND t = 'tab_II' THEN 2 ELSE 1 END AS times
 FROM lineitem, t WHERE l_suppkey <= 40 AND ((l_partkey + place) % 4 = 0 OR place = 0)),
r AS (SELECT * FROM l WHERE NOT (f = 1 AND t = 'tab_VII') AND NOT (f = 11 AND t = 'tab_IX'))"""


@query(FUND_LINES + """,
s AS (SELECT f, kind, subject, bool_or(t = 'tab_I') AS listed, bool_or(t <> 'tab_I') AS elsewhere, max(CASE WHEN t = 'tab_I' THEN name END) AS own, bool_or(t <> 'tab_I' AND name <> 'Fundo ' || subject) AS other FROM r GROUP BY 1, 2, 3),
i AS (SELECT f, subclass, sum(times) AS n, count(DISTINCT (kind, subject, series)) AS owners FROM r WHERE subclass IS NOT NULL GROUP BY 1, 2)
SELECT f || '/inf_mensal_fidc_' || CASE f WHEN 4 THEN '202610' WHEN 9 THEN '299909' ELSE '202609' END || '.zip' AS file, CASE f WHEN 7 THEN '2026-08-30' WHEN 8 THEN '2026-07-31' WHEN 9 THEN '2999-09-30' ELSE '2026-09-30' END AS competence,
 (SELECT CAST(sum(times) AS BIGINT) FROM r WHERE r.f = x.f) AS n_rows, (SELECT CAST(coalesce(sum(times), 0) AS BIGINT) FROM r WHERE r.f = x.f AND kind = 'Outro') AS n_other_kinds, (SELECT count(*) FROM s WHERE s.f = x.f AND listed) AS n_subjects, (SELECT count(*) FROM s WHERE s.f = x.f AND elsewhere AND (NOT listed OR other)) AS n_divergent_names,
 (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM i WHERE i.f = x.f) AS n_subclass_rows, (SELECT count(*) FROM i WHERE i.f = x.f) AS n_subclasses, (SELECT count(*) FROM i WHERE i.f = x.f AND owners > 1) AS n_shared_subclasses,
 CASE f WHEN 1 THEN 'missing_members' WHEN 2 THEN 'unexpected_members' WHEN 3 THEN 'several_periods' WHEN 4 THEN 'archive_of_another_period' WHEN 6 THEN 'repeated_members' WHEN 7 THEN 'competence_of_another_month,several_competences' WHEN 8 THEN 'competence_of_another_month' WHEN 9 THEN 'competence_in_future' WHEN 10 THEN 'no_competence' WHEN 11 THEN 'wrong_number_of_fields' WHEN 12 THEN 'unexpected_header' ELSE '' END AS problems
FROM (SELECT DISTINCT f FROM r) x""")
def fund_archive_reports(spark, sf_dir):
    """SCAN-07: archives of 18 members read in one pass, with what is wrong in each and what its members agree on."""
    found = members.archive_report(_fund_archives(spark, sf_dir), HEADERS, F.lit("2026-12-31").cast("date"))
    return found.withColumn("problems", F.array_join("problems", ",")).withColumn("competence", F.date_format("competence", "yyyy-MM-dd"))


@query(FUND_LINES + """
SELECT f || '/inf_mensal_fidc_' || CASE f WHEN 4 THEN '202610' WHEN 9 THEN '299909' ELSE '202609' END || '.zip' AS file, "TAB_X_CLASSE_SERIE", "ID_SUBCLASSE", sum("QT" * times) AS quantity, CAST(sum(times) AS BIGINT) AS n FROM (SELECT f, 'Série ' || series AS "TAB_X_CLASSE_SERIE", 'S' || subclass AS "ID_SUBCLASSE", CAST(l_quantity AS INTEGER) AS "QT", times FROM r WHERE t = 'tab_X_2') GROUP BY 1, 2, 3""")
def fund_series_table(spark, sf_dir):
    """SCAN-07: one member of all archives in columns of their own types."""
    records = members.member_records(_fund_archives(spark, sf_dir), HEADERS)
    found = members.member_table(records, "tab_X_2", {members.SERIES: "string", members.SUBCLASS: "string", "QT": "long"})
    return found.groupBy("file", members.SERIES, members.SUBCLASS).agg(F.sum("QT").alias("quantity"), F.count("*").alias("n"))


@query("""
WITH l AS (SELECT CASE WHEN l_suppkey % 50 = 0 THEN 7 ELSE l_suppkey % 7 END AS f, l_linenumber AS n, l_returnflag AS member FROM lineitem),
s AS (SELECT f, count(*) AS rows_before FROM l WHERE f < 7 AND NOT (f IN (0, 3) AND n > 3) GROUP BY 1), w AS (SELECT f, count(*) AS rows FROM l WHERE f <> 6 GROUP BY 1)
SELECT CAST(coalesce(s.f, w.f) AS INTEGER) AS file_id, CASE WHEN w.f IS NULL THEN 'not_read' WHEN s.f IS NULL THEN 'not_loaded' WHEN rows = rows_before THEN 'unchanged' ELSE 'reparsed' END AS status, coalesce(rows_before, 0) AS rows_before, CASE WHEN s.f IS NULL THEN 0 WHEN w.f IS NULL THEN rows_before ELSE rows END AS n_now FROM s FULL JOIN w ON s.f = w.f""")
def reparsed_files(spark, sf_dir):
    """SCAN-04: files read again by a mended reader; only the partitions of those whose rows changed are rewritten."""
    file_id = F.when(F.col("l_suppkey") % 50 == 0, 7).otherwise(F.col("l_suppkey") % 7).cast("int")
    lines = table(spark, sf_dir, "lineitem").select(file_id.alias("file_id"), F.col("l_returnflag").alias("member"), "l_orderkey", "l_linenumber")
    path = new_folder(spark, "loaded")
    lines.where("file_id < 7 and not (file_id in (0, 3) and l_linenumber > 3)").write.partitionBy("file_id").parquet(path)
    before = spark.read.parquet(path).groupBy("file_id").agg(F.count("*").alias("was")).collect()
    outcome = members.rewrite_changed(path, lines.where("file_id <> 6"))
    was = spark.createDataFrame([(r["file_id"], r["was"]) for r in before], "file_id int, was long")
    now = spark.read.parquet(path).groupBy("file_id").agg(F.count("*").alias("n_now"))
    found = outcome.join(was, "file_id", "full").join(now, "file_id", "left")
    return found.select("file_id", F.coalesce("status", F.lit("not_read")).alias("status"), F.coalesce("was", F.lit(0)).alias("rows_before"), F.coalesce("n_now", F.lit(0)).alias("n_now"))
