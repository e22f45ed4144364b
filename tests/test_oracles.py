"""Every query against its SQL in DuckDB, whole results, exact values."""

from __future__ import annotations

import pytest
from compare import SF_DIR, compare, duck
from fixture_queries.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def connection():
    with duck(SF_DIR) as connection:
        yield connection


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_oracle(spark, sf_dir, connection, name):
    outcome = compare(spark, connection, sf_dir, name, QUERIES[name], ORACLES.get(name))
    assert not outcome.startswith("DIFFERENT"), outcome
    assert "rows=0 " not in outcome


def test_every_oracle_belongs_to_a_query():
    assert set(ORACLES) <= set(QUERIES)
