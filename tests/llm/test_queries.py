import os

import pytest

from lectern.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_their_sql(spark, data, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in os.listdir(data):
        con.sql(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{data}/{file}'")
    told = con.sql(queries.SQL[name]).df()
    got = queries.QUERIES[name](spark, data).toPandas()
    assert set(map(tuple, got[sorted(got)].values)) == set(map(tuple, told[sorted(told)].values))


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("p1_found", [("doc_id", "string"), ("line_no", "int"), ("defect", "string")]), ("p4_found", [("result_id", "bigint"), ("defect", "string")]),
        ("p6_found", [("doc_id", "bigint"), ("case_id", "bigint")]), ("p8_found", [("doc_id", "bigint"), ("residue", "string")]),
    ],
)
def test_results_have_the_stated_columns(spark, data, name, columns):
    result = queries.QUERIES[name](spark, data)
    assert result.dtypes == columns
    assert result.count() == result.distinct().count() > 0
