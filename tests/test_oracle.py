"""Every bound query runs on the smallest shared tables; those with SQL must give the same rows."""

from __future__ import annotations

import os

import pytest

from lodestone.plans import all_queries
from tests.oracle import compare, duck

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="shared tables are absent")


@pytest.fixture(scope="module")
def connection():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, connection, name):
    count, problem = compare(spark, connection, all_queries()[name], SF_DIR)
    assert problem is None, problem
    assert count >= 0
