"""Every query of the subpackage that SQL can express, against its SQL in DuckDB, at the smallest scale."""

import pytest

from quire.llm import queries
from tests.test_oracle import SF, con, plain  # noqa: F401  con is a fixture


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):  # noqa: F811
    df = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.ORACLE_SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    want = sorted("|".join(plain(r[cols.index(c)]) for c in sorted(cols)) for r in cur.fetchall())
    assert sorted("|".join(plain(r[c]) for c in sorted(cols)) for r in df.collect()) == want
