import os

import pytest

import __spark_entry__ as entry
from lectern import queries as core


def test_every_query_has_a_name_and_a_text():
    queries = entry.queries()
    assert len(queries) > 40
    assert all(f.__doc__ for f in queries.values())
    assert set(entry.oracle_sql()) <= set(queries)


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_queries_equal_their_sql(spark, data, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for file in os.listdir(data):
        con.sql(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{data}/{file}'")
    told = con.sql(core.SQL[name]).df()
    got = core.QUERIES[name](spark, data).toPandas()
    assert sorted(got.columns) == sorted(told.columns)

    def rows(frame):
        import pandas as pd

        def cell(x):
            return None if pd.isna(x) else f"{x:.6f}" if isinstance(x, float) else str(x)

        return sorted((tuple(cell(x) for x in r) for r in frame[sorted(frame.columns)].itertuples(index=False)), key=str)

    assert rows(got) == rows(told)


def test_the_flagship_query_runs(spark, data):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize(
    ("name", "columns"),
    [
        ("p2_found", [("record_kind", "string"), ("id_a", "string"), ("id_b", "string")]), ("p3_found", [("id_a", "string"), ("id_b", "string")]),
        ("p5_found", [("doc_id", "string"), ("section_idx", "int"), ("block_idx", "int")]),
    ],
)
def test_results_have_the_stated_columns(spark, data, name, columns):
    result = core.QUERIES[name](spark, data)
    assert result.dtypes == columns
    rows = result.collect()
    assert len(rows) == len(set(rows))
    assert all(r["id_a"] < r["id_b"] for r in rows if "id_a" in r)
