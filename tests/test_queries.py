"""Every registered query against its SQL, on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entries
from tools.check import compare, connect
from workloads import load_all
from workloads.registry import ORACLES, QUERIES

load_all()


@pytest.fixture(scope="module")
def duck(folder):
    return connect(folder)


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, duck, name):
    have = QUERIES[name](spark, folder).toPandas()
    assert compare(have, duck.execute(ORACLES[name]).df()) is None


def test_entry(spark):
    assert entries.entry(spark).count() > 0
