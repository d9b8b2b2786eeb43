"""Registered queries against their DuckDB oracles at sf0.001, and the entry smoke check."""

import pytest

from tests.conftest import SF_SMALL
from tests.oracle_compare import compare, duck

FAST = ["tenant_region_totals", "load_report", "profile_columns_compat", "sample_rows_json",
        "upload_status", "validate_decisions", "unmapped_cdm_fields", "cdm_add_fields",
        "data_checks", "similar_documents", "similar_vectors", "column_field_scores",
        "chat_context"]


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    assert compare(spark, name, SF_SMALL, con, verbose=True)


def test_every_query_has_a_callable_and_most_an_oracle():
    import __spark_entry__ as E
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 60 and len(o) >= 50


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0 and "revenue" in df.columns
