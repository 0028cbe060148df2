"""Every query of the subpackage runs on the smallest tables; found cases have exactly their columns."""

import pytest

from thicket.llm import queries

COLUMNS = {"p1_found": ["file_id"], "p3_found": ["file_id"], "p5_found": ["table_name", "file_id", "item_id"], "p7_found": ["file_id", "node_id", "text_lang"], "p10_found": ["doc_id"]}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, folder, name):
    df = queries.QUERIES[name](spark, folder)
    rows = df.collect()
    assert rows
    if name in COLUMNS:
        assert df.columns == COLUMNS[name] and len(set(map(tuple, rows))) == len(rows)
