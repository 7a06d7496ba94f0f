import os

import pytest

from tests import oracle
from vellumix.llm import registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the input tables")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    assert oracle.same(registry.queries()[name](spark, FOLDER), oracle.connect(FOLDER), registry.oracle_sql()[name]) > 0


def test_ten_operators():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.queries()) == list(range(1, 11))
