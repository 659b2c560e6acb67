"""Steps whose work or result must not depend on how large a table is or how it is laid out."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lastro.functions import text, values
from lastro.llm import hpylm
from lastro.operators import excerpts, graph, matching, minutes, observations, proposals, term_texts, terms, text_rules
from lastro.sources import files, tables


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_tab_export_splits_a_text_once(spark):
    texts = spark.createDataFrame([("a", "x\nCodigo\tNome \n1\tum\n\n2\n"), ("b", "x")], "file string, text string")
    found = files.tab_export(texts, "Codigo")
    above = optimized(found).partition("Generate")[0]
    assert "split(text" not in above
    assert sorted((r["file"], r["line"], r["cells"]) for r in found.collect()) == [("a", 0, {"Codigo": "1", "Nome": "um"}), ("a", 1, {"Codigo": "2", "Nome": ""})]


def test_import_meets_a_key_once(spark):
    """However many instruments share a key, a record meets it in one row; the outcomes are those of all of them."""
    records = spark.createDataFrame([(1, 5, [10, 11]), (2, 5, [10]), (3, 6, [12, 12]), (4, 7, [12]), (5, 9, [10]), (6, 5, [99]), (7, 5, None), (8, 5, [13]), (9, 5, [14])], "id long, issuer long, keys array<long>")
    issuers = spark.createDataFrame([(5,), (6,), (7,)], "issuer long")
    many = spark.range(1000).select((F.col("id") % 1 + 10).alias("key"), F.col("id").alias("instrument_id"), F.lit(5).cast("long").alias("issuer"))
    few = spark.createDataFrame([(11, 3, 5), (12, 8, 6), (12, 8, 6), (13, 8, None), (14, None, 6)], "key long, instrument_id long, issuer long")
    found = proposals.import_instruments(records, issuers, many.unionByName(few)).orderBy("id").collect()
    assert [(r["reason"], r["instrument_id"]) for r in found] == [
        ("conflicting_candidates", None), ("conflicting_candidates", None), ("one_candidate", 8), ("issuer_mismatch", None), ("issuer_not_found", None),
        ("no_candidate", None), ("no_candidate", None), ("one_candidate", 8), ("issuer_mismatch", None),
    ]
    joined = optimized(proposals.import_instruments(records, issuers, many)).rpartition("Join Inner")[2]
    assert "Aggregate [key" in joined


def test_first_in_file_takes_the_first_of_tied_rows(spark, tmp_path):
    """The larger file of a table is read first; its rows don't come first."""
    path = tmp_path / "lineitem.parquet"
    rows = spark.createDataFrame([(1, 1, 7, "R"), (2, 3, 7, "A")], "l_orderkey long, l_linenumber int, l_partkey long, l_returnflag string")
    more = spark.range(5000).selectExpr("1L + id % 2 AS l_orderkey", "3 AS l_linenumber", "7L AS l_partkey", "'N' AS l_returnflag")
    for at, df in enumerate((rows, more.unionByName(rows.selectExpr("l_orderkey", "l_linenumber", "l_partkey", "'Z' AS l_returnflag")))):
        df.coalesce(1).write.parquet(str(tmp_path / f"p{at}"))
        path.mkdir(exist_ok=True)
        next((tmp_path / f"p{at}").glob("part-*")).rename(path / f"part-{at}.parquet")
    found = __spark_entry__.queries()["first_in_file"](spark, str(tmp_path))
    assert {r["l_orderkey"]: r["first_value"] for r in found.collect()} == {1: "R", 2: "A"}


def test_identifier_pairs_are_shuffled_once(spark):
    schema = "id long, type string, value long, is_primary boolean"
    left = spark.createDataFrame([(1, "a", 1, False), (1, "b", 5, False), (2, "a", 1, True), (3, "a", 1, False), (3, "c", None, False), (4, "a", 1, False), (4, "a", 2, True), (None, "a", 1, True), (5, None, 1, False)], schema)
    right = spark.createDataFrame([(8, "a", 1, True), (8, "b", 6, False), (9, "a", 1, False), (9, "a", 2, True), (9, "c", 1, False), (9, None, 1, False)], schema)
    found = matching.compare_identifiers(left, right)
    assert {(r[0], r[1]): r[2] for r in found.collect()} == {(1, 8): "blocked", (1, 9): "matched", (2, 8): "matched", (2, 9): "blocked", (3, 8): "matched", (3, 9): "blocked", (4, 8): "blocked", (4, 9): "matched"}
    lines = optimized(found).splitlines()
    first_join = next(at for at, line in enumerate(lines) if "Join Inner" in line)
    assert "type" in lines[first_join] and "value" in lines[first_join] and sum("Aggregate" in line for line in lines[:first_join]) == 1


def test_links_need_no_join_and_lone_codes_no_rounds(spark):
    rows = [("i", "a", "x"), ("i", "b", "x"), ("i", "b", "y"), ("i", "c", "y"), ("i", "c", "z"), ("i", "d", "q"), ("j", "a", "x"), ("j", "e", ""), (None, "f", "x"), ("i", "b", "")]
    df = spark.createDataFrame(rows, "issuer string, code string, isin string")
    assert "Join" not in optimized(graph.shared_value_links(df, "code", ["issuer", "isin"]))
    assert {(r[0], r[1]) for r in graph.shared_value_links(df.where("isin <> ''"), "code", ["issuer", "isin"]).collect()} == {("b", "a"), ("c", "b")}
    assert {(r["issuer"], r["code"]): r["group_id"] for r in graph.alias_groups(df).collect()} == {("i", "a"): "b", ("i", "b"): "b", ("i", "c"): "b", ("i", "d"): "d", ("j", "a"): "a", ("j", "e"): "e", (None, "f"): "f"}


def test_accents_of_latin_texts_stay_in_the_jvm(spark):
    """Every sign, alone and among letters, as Python folds it; only texts with rare signs are handed to it."""
    signs = [chr(c) for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000] + list("\uac00\ufb01\uff21\U0001d400\U0001f600")
    rows = [(c, f"é{c}a\u0301\u0323") for c in signs]
    found = spark.createDataFrame([*rows, (None, None)], "c string, t string").select("t", text.strip_accents(F.col("t")).alias("plain")).collect()
    expected = {t: "".join(x for x in unicodedata.normalize("NFKD", t) if not unicodedata.combining(x)) for _, t in rows}
    assert len(found) == len(rows) + 1 and all(r["plain"] == expected.get(r["t"]) for r in found)
    plan = spark.createDataFrame([("Prefixação – “ª”",)], "t string").select(text.strip_accents(F.col("t")))
    assert "_plain(CASE WHEN" in optimized(plan)


def test_rate_tokens_are_read_once(spark):
    df = spark.createDataFrame([("100% da Taxa DI, pré-fixada",)], "t string").select(values.rate_numbers(F.col("t")).alias("n"))
    assert optimized(df).count("regexp_extract_all") == 2
    assert df.first()["n"] == ["mult=100"]


def test_places_are_made_for_excerpts_alone():
    held = minutes.Compact("Ata ﬁnal ½ é\u0301İ x")
    assert held.flat == "atafinal1⁄2ei" + "x" and "places" not in vars(held)
    assert held.excerpt(3, 7) == "ﬁnal" and held.excerpt(8, 10) == "½"
    assert minutes.Compact("").flat == "" and not len(minutes.Compact("").places)


def test_candidates_are_not_joined_with_themselves(spark):
    rows = [("a", "d", 0, "data_vencimento", 1, 3, "x"), ("a", "d", 0, "data_vencimento", 1, 2, "y"), ("a", "d", 0, "data_vencimento", 2, 1, "z"), ("a", "d", 0, "data_vencimento", 1, None, "w"), ("a", "d", 0, "quantidade", 0, 1, "5"), ("a", "d", 0, "quantidade", 0, 1, "5"), ("a", "d", 0, "data_emissao", 1, 1, "i"), ("a", "d", 0, "data_emissao", 0, 2, "j"), ("a", None, 0, "quantidade", 0, 1, "7")]
    best = terms.best_candidates(spark.createDataFrame(rows, "asset string, doc string, doc_rank int, field string, strength int, page int, value string"))
    assert sorted(r["value"] for r in best.collect()) == ["5", "i", "y"] and "Join" not in optimized(best)


def test_debtors_without_a_window(spark):
    rows = [("one", 1, "x", 1.0), ("one", 2, "x", 1.0), ("two", 1, "x", 1.0), ("two", 2, "y", 1.0), ("none", 1, None, None), ("bad", 1, None, 1.0), ("part", 1, "x", 1.0), ("part", 2, "x", 0.5), ("gone", 1, "x", 1.0), ("gone", 2, None, None), ("undated", None, "x", 1.0), ("mixed", 2, "x", 1.0), ("mixed", 2, None, 1.0), ("mixed", 2, "x", None)]
    found = proposals.resolved_debtors(spark.createDataFrame(rows, "a string, t int, cnpj string, share double"), "a", "t")
    expected = {"one": ("x", None), "two": (None, proposals.SEVERAL), "none": (None, proposals.NO_DEBTOR), "bad": (None, proposals.INVALID), "part": (None, proposals.PARTIAL), "gone": (None, proposals.NO_DEBTOR), "undated": (None, proposals.NO_DEBTOR), "mixed": (None, proposals.PARTIAL)}
    assert {r["a"]: (r["cnpj"], r["reason"]) for r in found.collect()} == expected and "Window" not in optimized(found)


def test_sibling_keys_need_no_join(spark):
    df = spark.createDataFrame([("d", 1, "isin", " X "), ("d", 1, "v", "1"), (None, 1, "isin", "Y"), (None, 1, "v", "2"), ("d", None, "isin", "Z"), ("d", None, "v", "3"), ("d", 2, "v", "4")], "doc string, block long, leaf string, value string")
    found = observations.sibling_keys(df, ["doc"], "block", "leaf", "value", ["isin"])
    assert {r["value"]: (r["instance_key"], r["repeats"]) for r in found.where("leaf = 'v'").collect()} == {"1": ("X", 1), "2": (None, 1), "3": (None, 2), "4": (None, 2)}
    assert "Join" not in optimized(found)


def test_every_learned_word_is_a_context(spark, monkeypatch):
    """Also words beyond those that are broadcast; each cell is kept."""
    monkeypatch.setattr(hpylm, "KNOWN_WORDS", 2)
    model = hpylm.Model(spark.createDataFrame([("a b a c",), ("c d",), (None,)], "text string"))
    key = hpylm.word_key
    expected = [(b" ", b"a"), (b"a", b"b"), (b"b", b"a"), (b"a", b"c"), (b"c", b""), (b" ", b"c"), (b"c", b"d"), (b"d", b""), (b" ", b"")]
    assert {(r["u"], r["w"]) for r in model.cells.collect()} == {(key(u), key(w)) for u, w in expected}


def test_pairs_met_once_are_written_only_if_a_score_asks(spark):
    """The model is learned from those met more often; a held-out text asks for its pairs, and so does one with a word that isn't broadcast."""
    texts = spark.createDataFrame([("a b c", True), ("a b d", True), ("c d", False)], "text string, learned boolean")
    key = hpylm.word_key
    for known, asked in ((9, {(b" ", b"a"): 2, (b"a", b"b"): 2, (b"d", b""): 1}), (0, {(b" ", b"a"): 2, (b"a", b"b"): 2, (b"b", b"c"): 1, (b"b", b"d"): 1, (b"c", b""): 1, (b"d", b""): 1})):
        hpylm.KNOWN_WORDS, before = known, hpylm.KNOWN_WORDS
        try:
            model = hpylm.Model(texts)
            assert {(r["u"], r["w"]): r["c"] for r in model.kept.collect()} == {(key(u), key(w)): c for (u, w), c in asked.items()}
            assert model.cells.count() == 6
        finally:
            hpylm.KNOWN_WORDS = before


def test_leaves_of_documents_are_held_by_column():
    """A leaf is a value in each list, not an object of its own; blocks are told apart by their parents."""
    found = files.Leaves()
    found.read(b'<r xmlns:xsi="x"><a><b>1&amp;2</b><b xsi:nil="true"/></a>\n<a><b>3\n4</b></a></r>')
    found.read(b"<s>5</s>")
    assert (found.paths, found.texts, found.nils) == (["r/a/b"] * 3 + ["s"], ["1&2", "", "3\n4", "5"], [False, True, False, False])
    assert (found.instances, found.chains, found.ends, found.lines) == ([0, 1, 0, 0], [0, 0, 0, 0, 0, 1], [0, 2, 4, 6, 6], [1, 1, 2, 1])


def test_pages_are_searched_once_and_only_where_they_name_the_field(spark):
    """What a page's lines say is made once; a document's pages lie in one of many tasks, with no other shuffle."""
    plan = optimized(spark.range(1).select(excerpts.field_hits(F.split(F.col("id").cast("string"), "\n"), ["a", "b"]).alias("h")))
    assert plan.count("regexp_instr") == 1
    rows = spark.createDataFrame([(["x", "“a”: um b", "(i) a e b: c"],), (["c"],)], "lines array<string>").select(excerpts.field_hits(F.col("lines"), ["a", "b"]).alias("h")).collect()
    assert [(r["h"]["n"], r["h"]["first"], r["h"]["definition"], r["h"]["label"]) for r in rows] == [(4, 1, (1, 2), 2), (0, None, None, None)]


def test_parts_grow_with_the_rows(spark):
    assert tables.parts(spark.range(5000), 100) == 50 and tables.parts(spark.range(10), 100) == 16


def test_lines_are_sorted_in_parts_by_their_number(spark):
    for name, sides in (("series_from_latest_report", 1), ("quality_checks_union", 2)):
        assert optimized(__spark_entry__.queries()[name](spark, __spark_entry__.SMALLEST)).count("RepartitionByExpression") == sides


def test_parameters_are_merged_and_only_those_that_are_compared(spark):
    plan = optimized(__spark_entry__.queries()["contract_deadlines"](spark, __spark_entry__.SMALLEST))
    assert plan.count("rightHint=(strategy=merge)") == 2 and "serie_" in plan.rpartition("rightHint=(strategy=merge)")[2]


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_covenants_of_a_document_need_one_shuffle(spark):
    assert exchanges(__spark_entry__.queries()["covenant_limits"](spark, __spark_entry__.SMALLEST)) == 1


def test_first_limit_is_the_first_of_all(spark):
    rows = [("não poderá ser superior a 3,5x e mínimo de 2%",), ("≥ 10x5 ou < 7 vezes",), ("MÁXIMO DE 80%",), ("nada",), ("",), (None,)]
    found = spark.createDataFrame(rows, "t string").select(text_rules.first_limit(F.col("t")).alias("one"), text_rules.limits(F.col("t")).alias("all")).collect()
    assert [r["one"] for r in found] == [r["all"][0] if r["all"] else None for r in found] and found[0]["one"]["limit"] == 3.5


def test_texts_of_terms_are_not_shuffled_again(spark):
    """Orders are dealt once, by document; the texts made of them stay where they are."""
    plan = __spark_entry__.queries()["term_value_candidates"](spark, __spark_entry__.SMALLEST)._jdf.queryExecution().executedPlan().toString()
    # by value, after Python has read the rates
    assert plan.count("ENSURE_REQUIREMENTS") == 1


def test_letters_are_found_in_whatever_case_the_patterns_find_them(spark):
    rows = [("VALOR TOTAL DA",), ("valor total da",), ("vencendo",), ("compreende",), ("quantıdade de",), ("QUANTİDADE DE",), ("emiſſão de",), ("Data de Emiſsão",), ("nada",)]
    words = [letters for _, *patterns in term_texts.PATTERNS.values() for letters, _ in patterns]
    df = spark.createDataFrame(rows, "t string").select(*[F.struct(F.col("t").rlike("(?iU)" + "|".join(w.replace(")", "\\)") for w in x)).alias("a"), term_texts._may_hold(F.lower("t"), x).alias("b")) for x in words])
    assert all(c["b"] or not c["a"] for r in df.collect() for c in r) and not any(c["b"] for c in df.collect()[-1])


def test_packed_pairs_come_back():
    """Sorted numbers over the whole range and those beside them, also of nothing."""
    rng = np.random.default_rng(3)
    for n in (0, 1, 1000):
        keys, others = np.sort(rng.integers(-(1 << 63), (1 << 63) - 1, n)), rng.integers(-9, 1 << 40, n)
        found = hpylm._unpacked([hpylm._packed(keys, others), hpylm._packed(keys[:1], others[:1])], 2)
        assert found[0].tolist() == [*keys, *keys[:1]] and found[1].tolist() == [*others, *others[:1]]


def test_pairs_of_words_met_once_need_no_row(spark, monkeypatch):
    """Words met once all have the same values, so a learned text's pairs with them are scored where they are read; no score changes by it."""
    rows = [(i, f"the cat sat on the mat by the door x{i} and the dog y{i} z{i} sat") for i in range(40)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    expected = {r["doc_id"]: (r["n_known"], r["score"]) for r in hpylm.score_documents(texts).collect()}
    monkeypatch.setattr(hpylm, "KNOWN_WORDS", 12)
    monkeypatch.setattr(hpylm, "SENT_WORDS", 5)
    learned = texts.where(hpylm.fold("doc_id") != 2)
    model = hpylm.Model(learned)
    assert model.kept.where("c = 1").count() == 0 and model.cells.where("c = 1").count() > 3 * learned.count()
    found = {r["doc_id"]: (r["n_known"], r["score"]) for r in hpylm.score_documents(texts).collect()}
    assert {k: v[0] for k, v in found.items()} == {k: v[0] for k, v in expected.items()}
    assert {k: v[1] for k, v in found.items()} == pytest.approx({k: v[1] for k, v in expected.items()}, abs=1e-9)


def test_words_are_cut_as_bytes_are():
    texts = ["", "  ", " A\x0b\x0cB ", "x\u0085y   \x1c\x1f Qİ", None, "\t\r\nz  z"]
    keys, after, before, sizes = hpylm._tokens(pa.array(texts))
    at = 0
    for text, n in zip(texts, sizes, strict=True):
        words = [hpylm.word_key(w) for w in (*(text or "").encode().lower().split(), b"")]
        assert keys[after[at : at + n]].tolist() == words and keys[before[at : at + n]].tolist() == [hpylm.START, *words[:-1]]
        at += n
    rows = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    for most in (1, 4, 1000):
        assert [x for p in hpylm._pieces(iter([rows, rows]), most) for x in p.column(0).to_pylist()] == texts * 2
