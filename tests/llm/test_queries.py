"""The text queries over the smallest data: schemas, and SQL where there is any."""

import os

import pytest

from tests.test_queries import DATA, compare

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
COLUMNS = {
    "p3_found": ["entry_id"], "p4_found": ["entry_id_a", "entry_id_b"], "p6_ids": ["doc_id", "ids"], "p7_found": ["doc_id", "item_id"], "p8_found": ["doc_id", "span_start", "span_end"],
}


def test_schemas_and_sql(spark):
    from blockloom.llm import queries

    for name, f in queries.QUERIES.items():
        df = f(spark, DATA)
        if name in COLUMNS:
            assert df.columns == COLUMNS[name]
        if name in queries.SQL:
            compare(df, queries.SQL[name])
        else:
            assert df.count() >= 0
