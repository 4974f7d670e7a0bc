"""A representative subset of the driver's Spark-vs-DuckDB comparison, at sf0.001."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts"))

import __spark_entry__ as E  # noqa: E402
from oracle_check import TABLES, duck_rows, spark_rows  # noqa: E402

SF = "/root/testdata/sf0.001"
NAMES = ["status_summary", "charges", "storage_charges", "bill_summary", "repack_chain",
         "debit_match", "run_totals", "invoice_lines", "labor_needed", "shipping_total", "charges_stored"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql_oracle(spark, duck, name):
    sc, sr = spark_rows(E.queries()[name](spark, SF))
    dc, dr = duck_rows(duck, E.oracle_sql()[name])
    assert sc == dc
    assert len(sr) == len(dr) and sr == dr
