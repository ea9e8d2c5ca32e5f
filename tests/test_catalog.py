import hashlib
import os

import duckdb
import pytest

import __spark_entry__
from sparkfold.functions.superfeatures import super_features
from sparkfold.plans.catalog import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_every_oracle_has_a_query():
    assert ORACLES.keys() <= QUERIES.keys() and __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, tmp_path, name):
    QUERIES[name](spark, DATA).write.parquet(f"{tmp_path}/out")
    db = duckdb.connect()
    for table in os.listdir(DATA):
        db.execute(f"CREATE VIEW {table.split('.')[0]} AS SELECT * FROM '{DATA}/{table}'")
    db.execute(f"CREATE TABLE want AS {ORACLES[name]}")
    db.execute(f"CREATE TABLE got AS SELECT * FROM '{tmp_path}/out/*.parquet'")
    columns = ", ".join(f'"{r[0]}"' for r in sorted(db.execute("DESCRIBE want").fetchall()))
    for a, b in (("want", "got"), ("got", "want")):
        assert db.execute(f"SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b}").fetchall() == []


def test_bases_of_documents_equal_brute_force(spark):
    rows = duckdb.sql(f"SELECT doc_id, encode(coalesce(text, '')) FROM '{DATA}/documents.parquet' ORDER BY doc_id").fetchall()
    owners, chunks = {}, {}
    for _, data in rows:
        fp = hashlib.sha256(data).hexdigest()
        chunks[fp] = super_features(data) if len(data) > 564 else []
        for at in enumerate(chunks[fp]):
            owners.setdefault(at, fp)
    want = {}
    for fp, sf in chunks.items():
        hit = next(((owners[at], at[0]) for at in enumerate(sf) if owners[at] != fp), None)
        if hit:
            want[fp] = hit
    assert want and {r.fp: (r.base_fp, r.slot) for r in QUERIES["similar_base_candidates"](spark, DATA).collect()} == want
