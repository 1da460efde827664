"""Each corpus query that has SQL against DuckDB, on the smallest tables."""

import glob
import os

import pytest

from maskora.llm import registry
from tests.test_catalogue import plain

SF_DIR = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="tables are not here")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    df = registry.queries()[name](spark, SF_DIR)
    columns = sorted(df.columns)
    cursor = con.execute(registry.oracle_sql()[name])
    assert sorted(c[0] for c in cursor.description) == columns
    at = [[c[0] for c in cursor.description].index(c) for c in columns]
    got = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in cursor.fetchall())
