"""The registered queries that SQL can say, against that SQL on the same files."""

import duckdb
import pytest

from kvlake.llm import queries

from ..test_oracle import rows

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name]).fetchdf()
    got = queries.queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_oversized_shards(spark, monkeypatch):
    """With a limit that single documents pass, the SQL and the operator mark the same shards."""
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    sql = queries.OP4_SQL.replace(str(queries.SHARD_BYTES), "20000")
    monkeypatch.setattr(queries, "SHARD_BYTES", 20_000)
    want, got = con.execute(sql).fetchdf(), queries.op4_sharding(spark, SF).toPandas()
    assert want.oversized.any() and rows(got) == rows(want)
