"""Every registered query against its DuckDB oracle SQL on sf0.001 (the
driver runs the same comparison at sf0.01)."""

import pytest

import __spark_entry__ as E
from matchflow.plans import queries as core
from tests.conftest import SF_SMALL
from tests.oracle_compare import compare


def test_every_query_has_an_oracle():
    assert set(core.queries()) <= set(E.oracle_sql()) <= set(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "equipe" in df.columns


@pytest.mark.parametrize("name", sorted(core.queries()))
def test_query_matches_oracle(spark, name):
    res = compare(spark, SF_SMALL, [name], verbose=False)[name]
    assert res.get("ok"), res
