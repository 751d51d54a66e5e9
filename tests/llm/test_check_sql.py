"""Operators that SQL can express against their check SQL, on the supplied tables."""

import glob
import os

import duckdb
import pytest

from invoicefields.llm.queries import ORACLES, QUERIES
from llm.conftest import SF, as_set

CHECK_SF = os.environ.get("CHECK_SF_DIR", SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_check_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{CHECK_SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM read_parquet('{path}')")
    want = con.execute(ORACLES[name])
    columns = sorted(d[0] for d in want.description)
    df = QUERIES[name](spark, CHECK_SF)
    assert sorted(df.columns) == columns
    at = [[d[0] for d in want.description].index(c) for c in columns]
    rows = [tuple(r[i] for i in at) for r in want.fetchall()]
    assert as_set(df.select(*columns).collect()) == as_set(rows)
