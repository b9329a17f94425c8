"""Queries against their SQL on small tables of rows that the given ones don't have."""

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from provenia.operators import lookup
from provenia.plans import catalogue
from provenia.session import importable


def both(spark, tmp_path, name, **tables):
    c = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    got = catalogue.QUERIES[name](spark, str(tmp_path))
    columns = sorted(got.columns)
    want = c.sql(catalogue.ORACLES[name]).select(*[duckdb.ColumnExpression(x) for x in columns]).fetchall()
    return sorted((tuple(r) for r in got.select(*columns).collect()), key=str), sorted(want, key=str)


def test_capitals_of_letters_without_one(spark, tmp_path):
    texts = ["den ßlichkeit dem mit entz.", "Chzutz ßte ü.", "der ﬁnal mit entz dem.", "ein aaİbb mit dem ǰein."]
    rows = [(i, 1, "assistant", t) for i, t in enumerate(texts)]
    got, want = both(spark, tmp_path, "factual_units", conversations=(rows, "conv_id long, turn long, role string, text string"))
    assert got == want and got


def test_common_terms_behind_heavier_ones_bring_no_rows(spark):
    known = [(3, "no7", 13), (30, "surab", 10), (333, "1999", 6), (2500, "hot", 4), (2500, "ring", 4)]
    said = spark.createDataFrame([("m", known)], "mention string, known array<struct<n: long, term: string, weight: long>>")
    terms = lambda top: [r["term"] for r in lookup.sought(said, top, 4).orderBy("i").collect()]
    assert terms(5) == ["no7", "surab", "1999"] and terms(50) == ["no7", "surab", "1999", "hot"]
    works = [(i, f"common {'rare' if i % 10 == 3 else 'other'} w{i % 7}") for i in range(100)]
    found = lookup.ranked_candidates(spark.createDataFrame([("m", "rare common w3")], "mention string, text string"), spark.createDataFrame(works, "work int, described string"), top=3)
    held, weight = {i: set(t.split()) for i, t in works}, {"rare": 4, "common": 1, "w3": 3}
    scores = sorted((-sum(w for t, w in weight.items() if t in held[i]), i) for i in held)[:3]
    assert sorted((-r["score"], r["work"]) for r in found.collect()) == scores


def test_batches_of_pages_are_bounded_by_bytes(spark):
    importable(spark)
    size = F.pandas_udf(lambda x: pd.Series([int(x.str.len().sum())] * len(x)), "long")
    pages = spark.range(0, 400, 1, 1).select("id", F.repeat(F.lit("x"), 50_000).alias("html"))
    most = pages.select("id", size("html").alias("n")).agg(F.max("n").alias("most"), F.count(F.lit(1)).alias("rows")).first()
    assert most["rows"] == 400 and most["most"] < 6_000_000


def test_a_catalogue_is_not_broadcast(spark, tmp_path):
    parts = [(i, f"hot bolt{i % 3}", i % 50) for i in range(300)]
    turns = [(i, t, "assistant", f"turn {t}") for i in range(60) for t in range(5)]
    got, want = both(spark, tmp_path, "named_lookup", part=(parts, "p_partkey long, p_name string, p_size int"), conversations=(turns, "conv_id long, turn long, role string, text string"))
    assert got == want and len(got) == 300
    plan = catalogue.QUERIES["named_lookup"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
