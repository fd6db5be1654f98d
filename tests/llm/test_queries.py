"""Queries of the subpackage against their SQL, on whole tables."""

import duckdb
import pytest

from sparkloom.llm.queries import QUERIES, SQL

#: On the largest of these tables some lines are above the limit of op2.
SFS = ("/root/testdata/sf0.001", "/root/testdata/sf0.1")


@pytest.mark.parametrize("sf", SFS)
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name, sf):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    expected = con.sql(SQL[name])
    got = QUERIES[name](spark, sf)
    order = sorted(got.columns)
    assert order == sorted(expected.columns)
    rows = got.select(*order).collect()
    assert sorted(map(repr, expected.select(*order).fetchall())) == sorted(repr(tuple(r)) for r in rows)
    if name == "op2_line_frequency" and sf == SFS[-1]:
        assert sum(r.n_lost_words > 0 for r in rows) > 20


def test_there_is_a_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
