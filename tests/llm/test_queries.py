"""The subpackage's queries: those with SQL against DuckDB, all others run, on the smallest tables."""

import os

import pytest

from quire.llm.queries import QUERIES, SQL
from tests.test_queries import FOLDER, compare, duck  # noqa: F401

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):  # noqa: F811
    compare(spark, duck, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    df = QUERIES[name](spark, FOLDER)
    rows = df.collect()
    assert len(set(map(str, rows))) == len(rows) or name in {"p8_ids"}


@pytest.mark.parametrize("name,columns", [
    ("p2_found", "item_kind string, item_a string, item_b string"), ("p3_found", "candidate_id bigint"), ("p4_found", "openalex_id string, record_id bigint"),
    ("p5_found", "node_id string, foodon_id string"), ("p6_found", "openalex_id_a string, openalex_id_b string"), ("p7_found", "node_id_a string, node_id_b string"),
    ("p8_ids", "doc_id bigint, ids array<int>"), ("p10_found", "doc_id bigint")])
def test_columns(spark, name, columns):
    assert ", ".join(f"{n} {k}" for n, k in QUERIES[name](spark, FOLDER).dtypes) == columns
