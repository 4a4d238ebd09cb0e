"""The pN queries run over the small test tables."""

import os

import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
COLUMNS = {
    "p1_found": ["id", "group_id"], "p3_found": ["id_a", "id_b"], "p4_found": ["id", "cluster_id"], "p5_found": ["id_a", "id_b"],
    "p6_ids": ["doc_id", "ids"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id"],
}


@pytest.mark.parametrize("name", ["p1_found", "p2_subset", "p3_found", "p4_clusters", "p4_found", "p5_found", "p5_nearest", "p6_ids", "p7_found", "p7_leaks", "p8_found", "p8_pieces"])
def test_query(spark, name):
    from motionq.llm.queries import QUERIES

    df = QUERIES[name](spark, DATA)
    assert df.columns == COLUMNS.get(name, df.columns)
    rows = [tuple(map(str, r)) for r in df.collect()]
    assert len(rows) == len(set(rows))
