"""Every registered query beside its SQL twin."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import compare  # noqa: E402

import __spark_entry__ as contract  # noqa: E402
from wayloom.suite import registry  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.duck(DATA)


def test_every_query_has_a_twin():
    assert set(registry.queries()) == set(registry.oracles())
    assert set(registry.queries()) <= set(contract.queries())


def test_entry(spark):
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_same_rows(spark, con, name):
    assert compare.difference(spark, con, DATA, name) is None
