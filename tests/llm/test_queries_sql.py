"""Queries that SQL can express, side by side with DuckDB."""

import duckdb
import pytest

from provenia.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_matches_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "conversations", "benchmark", "labels", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.queries()[name](spark, SF)
    columns = ", ".join(sorted(df.columns))
    want = c.sql(f"SELECT {columns} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.select(*sorted(df.columns)).collect())) == sorted(want)


def test_disclosed_terms_match_sql(spark, tmp_path):
    """The test tables hold no term that discloses a value; these documents do."""
    rows = [(i, f"window number{'x' * i} the Zanzibarian meadow ann@corp.example lantern {'stone ' * (i + 1)}") for i in range(6)]
    rows += [(10 + i, "river stone house meadow lantern window signal copper " * 3) for i in range(80)]
    rows += [(100, "ip 001.2.3.4 card 4111 1111 1111 1111 phone +49 (0)30 123456-78"), (101, ""), (102, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    df = queries.queries()["op10_pmi"](spark, str(tmp_path))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    columns = ", ".join(sorted(df.columns))
    got = sorted(map(tuple, df.select(*sorted(df.columns)).collect()))
    assert got == sorted(c.sql(f"SELECT {columns} FROM ({queries.oracle_sql()['op10_pmi']})").fetchall())
    assert sum("term" in r[-1] for r in got) == 6


def test_all_operators_are_registered():
    """The entry leaves them out when they can't be imported; here that is a failure."""
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and {int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()} == set(range(1, 14))
