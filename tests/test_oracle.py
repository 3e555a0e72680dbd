"""Every registered query against its SQL in DuckDB, at the smallest scale."""

import decimal
import os

import duckdb
import pytest

from quire import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        files = f"{p}/*.parquet" if os.path.isdir(p) else p
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{files}')")
    return c


def plain(v) -> str:
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, decimal.Decimal):
        return f"{float(v):.9g}" if v != int(v) else str(int(v))
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = registry.queries()[name](spark, SF)
    cur = con.execute(registry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    want = sorted("|".join(plain(r[cols.index(c)]) for c in sorted(cols)) for r in cur.fetchall())
    assert sorted(df.columns) == sorted(cols)
    assert sorted("|".join(plain(r[c]) for c in sorted(cols)) for r in df.collect()) == want


def test_flagship(spark):
    assert registry.flagship(spark, SF).count() > 0
