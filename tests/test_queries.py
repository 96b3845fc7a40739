import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from splinebrook.plans import catalog


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted(tuple("" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) and not math.isnan(v) else str(v) for v in r) for r in pdf.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_duckdb(spark, sf, duck, name):
    got, want = catalog.QUERIES[name](spark, sf).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_others_give_rows(spark, sf, name):
    assert catalog.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["pc", "eigval", "explained_pct"] and df.count() == 7
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_region_series_read_lineitem_once(spark, sf):
    """Sums are made of rows dealt out by subject, and the grid of regions needs no second pass."""
    from splinebrook.sources import tables

    plan = tables.region_series(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_extendedprice#") and plan.count("Relation [l_orderkey") == 1 and "RepartitionByExpression" in plan
