"""Every operator's query on the smallest tables, against DuckDB where SQL can express it."""

import math
import zlib

import duckdb
import pytest

import __spark_entry__ as entry
from scenekiln.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return v.item() if hasattr(v, "item") else v


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations", "benchmark", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF), con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    by_name = sorted(columns)
    rows = sorted(repr([plain(r[c]) for c in by_name]) for r in got.collect())
    assert rows == sorted(repr([plain(r[columns.index(c)]) for c in by_name]) for r in want.fetchall())


def test_all_and_the_pipeline_are_registered():
    names = entry.queries()
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14)) and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)


def test_sharding_query(spark):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op3_sharding"](spark, SF).collect()
    assert {r.doc_id: (r["size"], r.text_crc32) for r in rows} == {i: (len(t) + 1, zlib.crc32(t)) for i, t in docs.items()}
    by = [[r for r in rows if r.shard == k] for k in range(8)]
    assert all(sorted(r.slot for r in b) == list(range(len(b))) for b in by)
    loads = [sum(r["size"] for r in b) for b in by]
    assert max(loads) - min(loads) <= 0.02 * sum(loads) / 8 and {(r.law, r.grown_shard) for r in rows} == {("bytes", None)}
