"""Queries with SQL against DuckDB; all others run and have rows."""

import pytest

from loomwork.llm import catalog

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_agrees_with_sql(spark, duck_small, name):
    sql, df = catalog.oracle_sql()[name], catalog.queries()[name](spark, DATA)
    cols = sorted(df.columns)
    names = ", ".join(f'"{c}"' for c in cols)
    want = sorted(tuple(map(str, r)) for r in duck_small.sql(f"select {names} from ({sql})").fetchall())
    assert sorted(tuple(map(str, r)) for r in df.select(cols).collect()) == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    df = catalog.queries()[name](spark, DATA)
    assert df.count() > 0 or name == "p1_report"


FOUND = {
    "p1_found": "record_kind id_a id_b",
    "p2_found": "group_id label_id",
    "p3_found": "id_a id_b",
    "p4_found": "result_id skill_id",
    "p5_found": "resume_id pii_type pii_value",
    "p6_found": "resume_id match_id",
    "p7_found": "item_kind item_id case_kind",
    "p9_found": "doc_id item_id",
    "p10_found": "doc_id",
}


@pytest.mark.parametrize("name", sorted(FOUND))
def test_found_columns_and_distinct_rows(spark, name):
    df = catalog.queries()[name](spark, DATA)
    assert df.columns == FOUND[name].split()
    assert df.count() == df.distinct().count()
