"""Every registered query against its DuckDB twin, value by value."""

import math
import os

import duckdb
import pytest

from quern.plans import checks
from quern.registry import ORACLES, QUERIES

AT = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in sorted(os.listdir(AT)):
        c.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{AT}/{t}'")
    return c


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    return x


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, name):
    df = QUERIES[name](spark, AT)
    assert "CartesianProduct" not in checks.physical(df), "each row with each"
    columns = sorted(df.columns)
    want = con.execute(ORACLES[name])
    assert sorted(d[0] for d in want.description) == columns
    at = [[d[0] for d in want.description].index(c) for c in columns]
    expected = sorted(([plain(r[i]) for i in at] for r in want.fetchall()), key=repr)
    got = sorted(([plain(x) for x in r] for r in df.select(*columns).collect()), key=repr)
    assert got, "a comparison of nothing shows nothing"
    assert got == expected
