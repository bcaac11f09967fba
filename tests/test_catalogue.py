"""Every registered query against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from lodestone.plans import catalogue, large_inputs, whole_tables

assert whole_tables.catalogue is catalogue is large_inputs.catalogue  # they add their queries there


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    for f in glob.glob(f"{data}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def sorted_rows(table):
    return sorted(repr([row[k] for k in sorted(row)]) for row in table.to_pylist())


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_spark_and_sql_agree(spark, data, duck, name):
    got, want = catalogue.QUERIES[name](spark, data).toArrow(), duck.sql(catalogue.SQL[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    assert sorted_rows(got) == sorted_rows(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_other_queries_have_rows(spark, data, name):
    assert catalogue.QUERIES[name](spark, data).count()
