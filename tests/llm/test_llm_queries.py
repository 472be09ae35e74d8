import os

import pytest
from verify_sql import compare, duck

from linkprism.llm import queries as Q

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
COLUMNS = {
    "p1_found": [("link_no", "bigint"), ("field_name", "string")],
    "p3_found": [("row_id", "bigint"), ("segment_no", "int"), ("lang", "string")],
    "p4_found": [("table_name", "string"), ("record_id", "bigint"), ("link_pos", "int")],
    "p5_found": [("prompt_id", "bigint"), ("row_id", "bigint")],
    "p6_found": [("first_row_id", "bigint"), ("row_id", "bigint")],
    "p8_ids": [("doc_id", "bigint"), ("ids", "array<int>")],
    "p10_found": [("doc_id", "bigint")],
}


@pytest.mark.parametrize("name", list(Q.QUERIES))
def test_runs_with_stated_columns(spark, name):
    df = Q.QUERIES[name](spark, SF)
    rows = df.collect()
    assert rows
    if name in COLUMNS:
        assert df.dtypes == COLUMNS[name]
    if name == "p8_tree":
        assert all(r["n_equal"] == r["n_docs"] for r in rows)
    if name.endswith("_found"):
        assert len(rows) == len({tuple(r) for r in rows})


@pytest.mark.parametrize("name", list(Q.ORACLE))
def test_equals_its_sql(spark, name):
    columns, got, want = compare(spark, duck(SF), SF, name, Q.QUERIES[name], Q.ORACLE[name])
    assert columns and got == want
