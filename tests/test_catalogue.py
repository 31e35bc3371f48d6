"""Queries over the given tables against their SQL in DuckDB."""

import os
import sys

import pytest

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.01"
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the given tables are absent")

#: A share of the catalogue that reads one measured table; tools/compare.py runs all of it.
NAMES = [
    "missing_counts", "cardinality", "top_values", "sample_values", "infer_types", "parse_numbers", "parse_dates", "identity_keys",
    "check_placeholder_values", "check_inconsistent_category", "check_corrupted_encoding", "check_exact_duplicates",
    "check_probable_duplicates", "check_business_rules", "evidence_rows", "structural_findings", "rule_unique",
    "rule_comparison_dates", "quality_score", "functional_dependencies", "category_spelling", "impute_median", "drop_duplicates",
]


@pytest.fixture(scope="module")
def base():
    from plumbline.catalogue.views import TABLES

    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, base, name):
    import compare

    import __spark_entry__ as entry

    df = entry.queries()[name](spark, FOLDER)
    result = base.execute(entry.oracle_sql()[name])
    names = [column[0] for column in result.description]
    assert sorted(names) == sorted(df.columns)
    assert compare.rows(df.columns, df.collect()) == compare.rows(names, result.fetchall())


def test_every_oracle_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.oracle_sql()) >= 90
