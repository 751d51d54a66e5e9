"""Each registered query against its check SQL on the same tables."""

import glob
import math
import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry
from invoicefields.plans.oracles import ORACLES

SF = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def cell(value):
    if isinstance(value, float) and math.isnan(value):
        return None
    return value.normalize() if isinstance(value, Decimal) else value


def as_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([cell(r[i]) for i in order] for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_check_sql(spark, db, name):
    df = entry.queries()[name](spark, SF)
    want = db.execute(ORACLES[name])
    want_columns = [d[0] for d in want.description]
    want_rows = as_rows(want_columns, want.fetchall())
    got_rows = as_rows(df.columns, [tuple(r) for r in df.collect()])
    assert sorted(df.columns) == sorted(want_columns)
    assert len(got_rows) == len(want_rows) > 0
    wrong = [(g, w) for g, w in zip(got_rows, want_rows) if g != w]
    assert not wrong, (len(wrong), wrong[:5])


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
