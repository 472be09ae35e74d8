import os

import pytest
from verify_sql import compare, duck

from linkprism.plans import general
from linkprism.plans import queries as core

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", [*core.ORACLE, *general.ORACLE])
def test_query_equals_its_sql(spark, con, name):
    part = core if name in core.ORACLE else general
    columns, got, want = compare(spark, con, SF, name, part.QUERIES[name], part.ORACLE[name])
    assert columns and got == want


def test_llm_is_optional():
    import pathlib
    import re

    root = pathlib.Path(core.__file__).parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"^\s*(from|import)\s+linkprism\.llm", p.read_text(), re.M), p
