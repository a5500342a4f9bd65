"""The registered queries: SQL twins where they exist, else that they run with the stated columns."""

import os

import duckdb
import pytest
from mnemospark.llm import queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
Q, SQL = queries.queries(), queries.oracle_sql()
COLUMNS = {
    "p2_found": ["group_id", "survivor_id", "confidence_from", "n_evidence"], "p3_found": ["session_id", "pos", "turn_id"], "p4_found": ["first_id", "dup_id"], "p5_found": ["belief_id_a", "belief_id_b"],
    "p6_found": ["first_id", "copies"], "p8_ids": ["doc_id", "ids"], "p9_found": ["doc_id", "item_id"], "p10_found": ["doc_id", "reading_level"],
}


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for f in sorted(os.listdir(DATA)):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    df = Q[name](spark, DATA)
    cur = c.execute(SQL[name])
    names = [x[0] for x in cur.description]
    assert sorted(map(tuple, df.select(*names).collect())) == sorted(cur.fetchall())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    df = Q[name](spark, DATA)
    assert df.columns == COLUMNS[name] and df.limit(1).count() == 1


def test_all_documents_are_encoded(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    ids = Q["p8_ids"](spark, DATA)
    assert ids.count() == docs.count() and ids.schema["ids"].dataType.simpleString() == "array<int>"
