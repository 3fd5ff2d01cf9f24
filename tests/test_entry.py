import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", ["q_merge_pages", "q_layout_best", "q_detect_repetition", "q_text_structure"])
def test_queries_agree_with_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "labels", "conversations", "pages", "part"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    found = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    wanted = sorted(map(repr, found.fetchall()))
    assert sorted(repr(tuple(r)) for r in entry.queries()[name](spark, DATA).select(*columns).collect()) == wanted
