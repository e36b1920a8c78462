"""Every query of the core runs; those with SQL give what DuckDB gives."""

from __future__ import annotations

import math
import os

import pytest

from lexiflow.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "customer documents embeddings events lineitem nation orders pages part region supplier benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def rows(pdf):
    def plain(x):
        if x is None or x != x:
            return None
        return x.item() if hasattr(x, "item") else x

    cols = sorted(pdf.columns)
    return cols, sorted(repr([round(v, 9) if isinstance(v, float) and math.isfinite(v) else v for v in map(plain, r)]) for r in pdf[cols].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLE_SQL:
        assert rows(got) == rows(duck.sql(ORACLE_SQL[name]).df())
    else:
        assert len(got.columns)
