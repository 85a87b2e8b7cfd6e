"""Queries on small tables of their own, against their SQL."""

import duckdb

from __spark_entry__ import oracle_sql, queries


def both(spark, folder, name, rows, schema):
    """Rows of a query over conversations made of ``rows``, and of its SQL over the same file."""
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / "conversations.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet/*.parquet'")
    want = con.sql(oracle_sql()[name])
    return sorted(map(tuple, queries()[name](spark, str(folder)).select(*want.columns).collect())), sorted(want.fetchall())


def test_transcripts_of_hidden_conversations(spark, tmp_path):
    """Of 14478, one turn is hidden and the other a tool's."""
    rows = [(c, t, "user", f"turn {t} of {c}") for c in (1, 14478) for t in (0, 1)]
    got, want = both(spark, tmp_path, "transcript_render", rows, "conv_id bigint, turn bigint, role string, text string")
    assert got == want and [r[0] for r in got] == ["1"]
