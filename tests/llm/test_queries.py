"""The registered queries: whole tables, and SQL where there is some."""

from pathlib import Path

import duckdb
import pytest
from lectern.llm import queries as Q

SF = "/root/testdata/sf0.01"
KEYS = {"op1_secret_scans": None, "op2_sampled_pieces": None, "op9_cap_filters": "vec_id", "op13_inverted_multi_index": None}


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = c.sql(Q.oracle_sql()[name])
    df = Q.queries()[name](spark, SF)
    assert df.columns == want.columns
    assert sorted(map(tuple, df.collect())) == sorted(want.fetchall())


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_whole_tables(spark, name):
    rows = Q.queries()[name](spark, "/root/testdata/sf0.001").collect()
    key = KEYS.get(name, "doc_id")
    source = "embeddings" if key == "vec_id" else "documents"
    if key:
        ids = [r[0] for r in spark.read.parquet(f"/root/testdata/sf0.001/{source}.parquet").select(key).collect()]
        assert sorted({r[key] for r in rows}) == sorted(ids)
        assert name == "op6_length_buckets" or len(rows) == len(ids)
    elif name == "op2_sampled_pieces":
        assert len(rows) == 600 and all(r.round_trip for r in rows)
