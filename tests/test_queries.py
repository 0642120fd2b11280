"""Every registered query of the engine against its SQL, on the smallest tables."""

import decimal
import os

import pytest

from quarry.plans import replay  # noqa: F401  registers its queries
from quarry.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(SF):
        path = f"{SF}/{name}"
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 5)
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    if name not in SQL:
        assert got
        return
    ours = duck.execute(SQL[name])
    columns = [c[0] for c in ours.description]
    assert sorted(columns) == sorted(df.columns)
    key = str
    assert sorted(([plain(r[c]) for c in columns] for r in got), key=key) == sorted(([plain(v) for v in r] for r in ours.fetchall()), key=key)
