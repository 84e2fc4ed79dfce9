"""The registered queries over the smallest tables, against their SQL where there is one."""
import os
import re

import duckdb
import pytest

from refreshgate.llm import registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
#: Columns that the results must have.
COLUMNS = {
    1: {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    2: {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    3: {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    4: {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    5: {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint",
        "base_failed": "boolean", "kept": "boolean"},
    6: {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string",
        "labels": "string", "score": "double"},
    7: {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"},
    8: {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    9: {"doc_id": "bigint", "n_tokens": "bigint"},
    10: {"doc_id": "bigint", "n_pieces": "bigint", "lossless": "boolean"},
    11: {"conv_id": "bigint", "depth": "bigint", "parent_conv_id": "bigint", "n_convs": "bigint", "n_children": "bigint", "n_leaves": "bigint",
         "saved_tokens": "bigint", "ends_sha256": "string"},
    12: {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    13: {"part": "string", "filter_order": "string", "step": "int", "kept": "bigint", "removed": "bigint", "redundant": "bigint",
         "unique_fails": "bigint", "good_lost": "bigint", "toxic_lost": "bigint", "shapley": "bigint"},
}


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, name):
    df = registry.QUERIES[name](spark, SF_DIR)
    want = COLUMNS[int(re.match(r"op(\d+)_", name)[1])]
    assert want.items() <= dict(df.dtypes).items()
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert got
    if name in registry.SQL:
        con = duckdb.connect()
        for file in os.listdir(SF_DIR):
            con.sql(f"create view {file.removesuffix('.parquet')} as select * from '{SF_DIR}/{file}'")
        relation = con.sql(registry.SQL[name])
        place = [relation.columns.index(c) for c in columns]
        assert got == sorted((tuple(r[i] for i in place) for r in relation.fetchall()), key=repr)
    elif "doc_id" in columns and name != "op1_packing":
        assert len(got) == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()


def test_one_query_of_each():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES) == list(range(1, 14))
