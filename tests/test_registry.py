"""The registered queries run, keep their columns, and agree with their SQL on the smallest tables."""

import os

import pytest

import __spark_entry__ as registry
from compare import canonical, duck

SF, FULL = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
SOME = ["fastest_lap_per_driver", "tyre_stats", "corner_stats", "t06_driver_sector_strengths", "e06_compound_risk_rank", "stay_out", "intent_fields", "grounding", "bleu4", "cosine_knn"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_sql_belongs_to_queries():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_entry(spark):
    assert registry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SOME)
def test_agreement(spark, name):
    got = registry.queries()[name](spark, SF).toPandas()
    want = duck(SF).execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and canonical(got) == canonical(want)


OWN = [n for n in registry.queries() if n != "pipeline" and not n.startswith("op")]


@pytest.mark.parametrize("name", OWN)
def test_no_query_is_empty(spark, name):
    """A query and its SQL that agree on nothing would prove nothing."""
    assert not registry.queries()[name](spark, FULL).isEmpty()
