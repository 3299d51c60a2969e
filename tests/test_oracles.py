"""A sample of the named queries against their SQL; ``python -m oracles.check`` runs them all."""

import pytest

import __spark_entry__ as entry
from oracles.check import compare

SAMPLE = [
    "tokens", "ddl_catalog", "lint_L012", "lint_L016", "lint_L020", "query_stats", "formatted",
    "analysis_records", "rules_per_user_day", "stream_rule_windows",
]
LIGHT = [q for q in entry.queries() if q.startswith("impact_")]


@pytest.mark.parametrize("name", SAMPLE + LIGHT)
def test_query_matches_sql(spark, sf_dir, name):
    assert compare(spark, sf_dir, name) == ""


def test_every_query_has_sql():
    assert set(entry.queries()) - set(entry.OF_TEXTS) == set(entry.oracle_sql()) - set(entry.OF_TEXTS)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["rule_id", "severity", "category", "findings", "queries"]
