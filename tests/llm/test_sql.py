"""The operator queries that SQL can express, against it at sf0.01."""

import pytest
from compare import duckdb_rows, spark_rows

from gleaner.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, sf_dir, name):
    columns, rows = spark_rows(queries.queries()[name](spark, sf_dir))
    expected_columns, expected = duckdb_rows(queries.oracle_sql()[name], sf_dir)
    assert columns == expected_columns
    assert rows == expected


@pytest.mark.parametrize("name", ["op4_pii", "op7_mixing", "op8_exact_dedup", "op9_url_filter"])
def test_native_plans_hold_no_python(spark, sf_dir, name):
    plan = queries.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct"))
