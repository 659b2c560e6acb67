"""Every query that has SQL gives the rows that DuckDB gives for it."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from lastro import catalog

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def oracle():
    with duckdb.connect() as con:
        for p in SF.glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        yield con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.8g}"
    return value


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_its_sql(spark, oracle, name):
    df = catalog.queries()[name](spark, str(SF))
    found = oracle.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    expected = Counter(tuple(map(plain, r)) for r in found.fetchall())
    assert Counter(tuple(plain(r[c]) for c in columns) for r in df.collect()) == expected


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


def test_entry_point(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["o_custkey", "o_orderkey", "o_totalprice", "priority"]
