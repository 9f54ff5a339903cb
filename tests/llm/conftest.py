import glob
import os

import duckdb
import pytest


@pytest.fixture(scope="session")
def duck_small():
    c = duckdb.connect()
    for f in glob.glob("/root/testdata/sf0.001/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c
