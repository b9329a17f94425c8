"""Every registered query against its SQL on the smallest tables, in the way the driver compares them."""

import math
import pathlib
import re

import duckdb
import pytest

from provenia.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SPARK_TO_DUCK = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN", "int": "INTEGER"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    return None if isinstance(x, float) and math.isnan(x) else round(x, 9) if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_matches_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    want = duck.sql(catalogue.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    kinds = dict(df.dtypes)
    assert {c: SPARK_TO_DUCK[kinds[c]] for c in columns} == {c: str(k) for c, k in zip(want.columns, want.types)}
    rows = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=str)
    assert rows == sorted((tuple(map(plain, r)) for r in want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall()), key=str)
    assert rows


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_has_rows(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["support_rate_by_source", "published_rates_long", "agreement_summary", "claim_states", "freeze_diff", "source_classification", "span_present"])
def test_stays_in_the_jvm(spark, name):
    name = {"claim_states": "claim_state_rollup"}.get(name, name)
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|CartesianProduct", plan)


def test_rates_read_no_texts(spark):
    plan = catalogue.QUERIES["support_rate_by_source"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "text" not in "".join(re.findall(r"ReadSchema: [^\n]*", plan))


def test_nothing_else_imports_the_corpus_folder():
    root = pathlib.Path(__file__).parent.parent
    for path in [*root.glob("provenia/**/*.py"), *root.glob("tests/*.py")]:
        if "llm" not in path.parts and path.name != "test_catalogue.py":
            assert "provenia.llm" not in path.read_text(), path


def test_entry(spark):
    import __spark_entry__ as entry

    rows = entry.entry(spark).collect()
    assert rows and set(catalogue.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
