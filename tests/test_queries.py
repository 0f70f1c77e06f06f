"""Every registered query of the transcript and catalogue operators against its DuckDB equivalent, or at least run."""

from __future__ import annotations

import math

import duckdb
import pytest

from cuelattice.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(value):
    if hasattr(value, "tolist") and not isinstance(value, str | bytes):
        value = value.tolist()
    if value is None or (isinstance(value, float) and math.isnan(value)) or str(value) in ("NaT", "<NA>"):
        return "null"
    return f"{value:.6g}" if isinstance(value, float) else str(value)


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted(tuple(map(plain, r)) for r in pdf.itertuples(index=False, name=None)), list(pdf.columns)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name in registry.ORACLE_SQL:
        assert rows(got) == rows(duck.sql(registry.ORACLE_SQL[name]).df())
    else:
        assert len(got.columns)


def test_contract():
    import __spark_entry__ as entry

    assert set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
