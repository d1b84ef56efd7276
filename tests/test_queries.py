"""Every registered query against its SQL on the same tables."""

import os
from datetime import datetime

import duckdb
import pandas as pd
import pytest

from dynspec.queries import ORACLE, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return bool(v)
        if isinstance(v, str):
            return v
        if isinstance(v, datetime):
            return str(pd.Timestamp(v))
        return round(float(v), 6) + 0.0

    cols = sorted(df.columns)
    rows = [tuple(one(v) for v in r) for r in df[cols].astype(object).itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: [(x is None, str(type(x)), x if x is not None else 0) for x in r])


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = con.execute(ORACLE[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = plain(got), plain(want)
    assert len(a) == len(b) and len(a) > 0
    wrong = [(x, y) for x, y in zip(a, b) if x != y and any(p != q and not (isinstance(p, float) and isinstance(q, float) and abs(p - q) <= 2e-6) for p, q in zip(x, y))]
    assert not wrong, wrong[:3]


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_makes_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
