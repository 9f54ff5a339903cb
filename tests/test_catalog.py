"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os
import subprocess
import sys

import duckdb
import pytest

from loomwork.plans import catalog

DATA = "/root/testdata/sf0.001"


def _norm(v):
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_agrees_with_sql(spark, duck, name):
    sql, df = catalog.oracle_sql()[name], catalog.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    assert cols == sorted(duck.sql(sql).columns)
    names = ", ".join(f'"{c}"' for c in cols)
    want = sorted(tuple(map(_norm, r)) for r in duck.sql(f"select {names} from ({sql})").fetchall())
    got = sorted(tuple(map(_norm, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    assert got == want


def test_queries_without_sql_run(spark):
    for name in set(catalog.queries()) - set(catalog.oracle_sql()):
        assert catalog.queries()[name](spark, DATA).count() > 0


def test_entry_works_without_the_training_data_package(tmp_path):
    code = "import sys; sys.modules['loomwork.llm'] = None; import __spark_entry__ as e; assert len(e.queries()) > 90 and not any(n[0] == 'p' and n[1].isdigit() for n in e.queries())"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
