"""Registrations in force, first aliases, portal statuses, sibling keys, appends: edge cases and brute force."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lastro.operators import market, matching, observations, registrations

REGISTRATION = "owner string, record long, cancelled boolean, date string, consistent boolean, dated boolean, scoped boolean"


def chosen(spark, rows):
    df = spark.createDataFrame(rows, REGISTRATION)
    found = registrations.current_registrations(df, "owner", "record", *[F.col(c) for c in ("cancelled", "date", "consistent", "dated", "scoped")])
    return sorted((r["owner"] or "", r["n_rows"], r["reason"], r["record"]) for r in found.collect())


def test_registrations_in_force(spark):
    rows = [
        ("cancelled last", 1, True, "2024", True, True, True), ("cancelled last", 2, False, "2020", True, True, True),
        ("all cancelled", 3, True, "2020", True, True, True), ("all cancelled", 4, True, None, True, True, True),
        ("tie", 5, False, "2020", True, True, True), ("tie", 6, False, "2020", True, True, False),
        ("tie of old", 7, False, "2020", True, True, True), ("tie of old", 8, False, "2019", True, True, True), ("tie of old", 9, False, "2019", True, True, True),
        ("bad", 10, False, "2020", True, True, True), ("bad", 11, True, "2019", False, False, True),
        ("undated", 12, False, "2020", True, True, True), ("undated", 13, True, "2019", True, None, False),
        ("other", 14, False, "2020", True, True, False), ("other", 15, False, "2019", True, True, True),
        ("foreign", 16, False, "2020", True, True, False),
        (None, 17, False, "2020", True, True, True), (None, 18, False, "2020", True, True, True), (None, 19, False, "2020", True, True, None),
    ]
    assert chosen(spark, rows) == [
        ("", 1, "invalid_id", None), ("", 1, "invalid_id", None), ("all cancelled", 2, "chosen", 3), ("bad", 2, "inconsistent", None), ("cancelled last", 2, "chosen", 2),
        ("other", 2, "other_type", None), ("tie", 2, "tie", None), ("tie of old", 3, "chosen", 7), ("undated", 2, "invalid_date", None),
    ]
    assert chosen(spark, []) == []


def test_classes_of_chosen_funds(spark):
    classes = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "x"), (4, None, "x"), (5, "c", None)], "class_id long, fund_id string, scope string")
    funds = spark.createDataFrame([("a", "x"), ("c", None), (None, "x")], "fund_id string, scope string")
    found = registrations.classes_of_chosen_funds(classes, funds).orderBy("class_id").collect()
    assert [(r["reason"], r["differs"]) for r in found] == [("chosen", False), ("chosen", True), ("fund_not_chosen", False), ("fund_not_chosen", False), ("chosen", False)]


def test_first_alias(spark):
    rows = spark.createDataFrame([(1, ["x", "a", "b"]), (2, ["b", None, "a"]), (3, ["x"]), (4, None), (5, [])], "id long, codes array<string>")
    stated = spark.createDataFrame([("a", 9), ("a", 7), ("b", 1), (None, 5)], "code string, n long")
    assert sorted(map(tuple, matching.first_alias(rows, "id", F.col("codes"), stated, "code").collect())) == [(1, "a", 7), (2, "b", 1)]


def test_portal_against_market(spark):
    series = spark.createDataFrame([("o1", "Default", 1, "a"), ("o1", "Default", 2, "b"), ("o2", "Default", 1, "c"), ("o3", "Ativa", 1, None), ("o4", "Default", 2, "a"), ("o4", "Default", 1, "d")], "operation string, status string, place int, code string")
    filings = spark.createDataFrame([("a", "2024-01", "Em Atraso"), ("a", "2024-02", "Adimplente"), ("b", "2024-01", "EM ATRASO"), ("d", "2024-01", None), (None, "2024-01", "Em Atraso")], "code string, reference string, situation string")
    found = {r["operation"]: r for r in market.portal_against_market(series, filings).collect()}
    assert [(o, found[o]["late"], found[o]["situation"], found[o]["divergent"]) for o in sorted(found)] == [("o1", True, "Em atraso", False), ("o2", False, "sem dado na CVM", True), ("o3", False, "sem dado na CVM", False), ("o4", False, "vazio", True)]
    assert found["o4"]["codes"] == ["a", "d"] and found["o3"]["codes"] == []


def test_series_by_indicator(spark):
    df = spark.createDataFrame([("r1", "A", 1), ("r1", "B_q", 2), ("r2", "A", 5)], "r string, s string, v long")
    two = observations.indicator_series(df, "r", "s", {"q": F.sum("v"), "n": F.count("v")})
    assert set(two.columns) == {"r", "qa", "na", "qb_q", "nb_q"}
    assert {r["r"]: (r["qa"], r["qb_q"]) for r in two.collect()} == {"r1": (1, 2), "r2": (5, None)}
    assert observations.indicator_series(df, "r", "s", {"q": F.sum("v")}, ["A"]).columns == ["r", "qa"]


def test_keys_of_siblings(spark):
    leaves = [("d", 1, "isin", " X "), ("d", 1, "v", "1"), ("d", 2, "isin", " "), ("d", 2, "code", "Y"), ("d", 2, "v", "2"), ("d", 3, "v", "3"), ("d", 4, "code", "X"), ("d", 4, "v", None), ("e", 1, "isin", "X"), ("e", 1, "v", "9")]
    df = spark.createDataFrame(leaves, "doc string, block long, leaf string, value string")
    found = {(r["doc"], r["block"]): (r["instance_key"], r["repeats"]) for r in observations.sibling_keys(df, ["doc"], "block", "leaf", "value", ["isin", "code"]).where("leaf = 'v'").collect()}
    assert found == {("d", 1): ("X", 2), ("d", 2): ("Y", 1), ("d", 3): (None, 1), ("d", 4): ("X", 2), ("e", 1): ("X", 1)}


def appended_in_order(stored, batch):
    held, out, pairs = list(stored), [], []
    for row in sorted(batch):
        if any(row[1:] == h[1:] for h in held):
            continue
        others = [h for h in held if h[1] == row[1] and h[3] != row[3]]
        if others:
            pairs.append((row[0], others[-1][0]))
        held.append(row)
        out.append(row)
    return out, pairs


@pytest.mark.parametrize("seed", range(4))
def test_appends_equal_a_loop(spark, seed):
    draw = random.Random(seed)
    rows = [(i, draw.choice(["a", "a", "a", "b", None]), draw.choice("xy"), draw.choice(["1", "2", "3", None])) for i in range(60)]
    cut = draw.choice([0, 20, 59])
    df = lambda x: spark.createDataFrame(x, "id long, k string, source string, value string")
    added, pairs = observations.append_with_conflicts(df(rows[cut:]), df(rows[:cut]), ["k"], ["k", "source", "value"], "id", "value")
    expected = appended_in_order(rows[:cut], rows[cut:])
    assert sorted(r["id"] for r in added.collect()) == [r[0] for r in expected[0]]
    assert sorted((r["new_id"], r["other_id"]) for r in pairs.collect()) == expected[1]
