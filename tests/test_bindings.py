"""Every bound query against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from dutyflow.plans import bindings, layout_queries, operator_queries, payroll_queries, raster_queries, reader_queries, roster_queries, text_queries  # noqa: F401 - these add queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages benchmark conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(pdf: pd.DataFrame) -> list[tuple]:
    show = lambda v: "null" if pd.isna(v) else f"{v:.6g}" if isinstance(v, float) else str(v)
    pdf = pdf[sorted(pdf.columns)]
    return sorted(tuple(show(v) for v in row) for row in pdf.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(bindings.ORACLES))
def test_agrees_with_sql(spark, duck, name):
    ours, theirs = bindings.QUERIES[name](spark, SF).toPandas(), duck.sql(bindings.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert norm(ours) == norm(theirs)


def test_others(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    assert bindings.QUERIES["stream_upsert_equals_batch"](spark, SF).first()["equal"]


def test_entry_smoke(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(e.oracle_sql()) <= set(e.queries())
