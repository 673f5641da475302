"""Every registered panel query against its SQL in DuckDB on the smallest tables."""

from __future__ import annotations

import os

import pytest

SF = "/root/testdata/sf0.001"


def _names() -> list[str]:
    from tidemark.plans import registry

    return sorted(registry.oracle_sql())


def _plain(value):
    import pandas as pd

    if value is None or (pd.api.types.is_scalar(value) and pd.isna(value)):
        return None
    if isinstance(value, bool):
        return value
    try:
        return round(float(value), 9) + 0.0
    except (TypeError, ValueError):
        return str(value)[:19].replace("T", " ").removesuffix(" 00:00:00")


def _rows(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted((tuple(map(_plain, r)) for r in frame.itertuples(index=False)), key=repr)


@pytest.fixture(scope="module")
def con():
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{file}'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", _names())
def test_query_equals_its_sql(spark, con, name):
    import __spark_entry__ as e

    got, want = e.queries()[name](spark, SF).toPandas(), con.execute(e.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_every_month_gets_an_optimised_book(spark):
    import __spark_entry__ as e

    months = lambda name: {r[0] for r in e.queries()[name](spark, SF).select("m").distinct().collect()}
    got = months("l3_portfolio")
    assert got >= months("l2_portfolio") and len(got) > 6


@pytest.mark.parametrize("tables", [SF, "/root/testdata/sf0.01"])
def test_covariances_of_all_names(spark, tables):
    """Every pair of names with two months in common, against the same sums in SQL."""
    if not os.path.isdir(tables):
        pytest.skip("needs the driver's tables")
    import duckdb

    import __spark_entry__ as e

    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tables}/lineitem.parquet'")
    got, want = e.queries()["covariance_all"](spark, tables).toPandas(), con.execute(e.oracle_sql()["covariance_all"]).df()
    one, two = ({(r.a, r.b): r["cov"] for _, r in x.iterrows()} for x in (got, want))
    assert one.keys() == two.keys() and len(got) == len(want) and all(abs(one[k] - two[k]) < 2e-8 for k in one)
    if tables != SF:
        assert got["a"].nunique() > 21
