"""Driver contract and a sample of oracle comparisons at the smallest scale."""

import math
from collections import Counter

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from arlens.sources.tables import TABLES

from conftest import SF_SMALL


def norm(v):
    if v is None or v is pd.NA:
        return "NULL"
    if isinstance(v, float):
        return "NULL" if math.isnan(v) else (str(int(v)) if v.is_integer() else repr(round(v, 9)))
    if hasattr(v, "item"):
        return norm(v.item())
    return str(v)


def multiset(pdf):
    cols = sorted(pdf.columns)
    return cols, Counter(tuple(norm(x) for x in rec) for rec in pdf[cols].itertuples(index=False))


def own_queries():
    from arlens.plans.queries import REGISTRY

    return REGISTRY


def test_contract_keys():
    assert set(own_queries()) == set(E.oracle_sql()) & set(own_queries()) and set(E.oracle_sql()) <= set(E.queries())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and len(df.columns) == 17


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("key", sorted(own_queries()))
def test_oracle_sf0001(spark, duck, key):
    sp = E.queries()[key](spark, SF_SMALL).toPandas()
    dd = duck.execute(E.oracle_sql()[key]).df()
    assert multiset(sp) == multiset(dd)


def test_documents_hold_tables(spark):
    got = E.queries()["html_document"](spark, SF_SMALL).toPandas()
    assert got.n_tables.sum() > 100 and (got.title == got.report).all()
