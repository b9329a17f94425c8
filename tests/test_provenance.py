"""Classes of fields: declared, carried, derived, refused."""

import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from provenia.operators import provenance as P
from provenia.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture
def judged(spark):
    df = spark.createDataFrame([(1, "a", "S", 0.5), (2, "b", None, 0.1), (3, "b", "S", 0.1)], "id int, url string, verdict string, x double")
    return P.classified(df, {"id": "record", "url": "record", "verdict": "model-inference", "x": "external-source"})


def classes(df):
    return {name: (value, tuple(under)) for name, value, under in P.lineage(df)}


def test_copies_keep_their_class(judged):
    out = judged.select(F.col("verdict").alias("v"), "url").where("v = 'S'").join(judged.select("url", "x"), "url").orderBy("x").limit(2)
    assert classes(out) == {"url": ("record", ("record",)), "v": ("model-inference", ("model-inference",)), "x": ("external-source", ("external-source",))}


def test_computed_columns_join_their_inputs(judged):
    label = P.classified(judged.select("id", F.lit("S").alias("label")), {"label": "your-input"})
    out = judged.join(label, "id").select((F.col("x") * 2).alias("twice"), F.upper("verdict").alias("told"), (F.col("label") == F.col("verdict")).alias("agrees"), F.lit(1).alias("one"), F.lit(None).cast("string").alias("none"))
    assert classes(out) == {
        "twice": ("script-output", ("external-source",)),
        "told": ("model-inference", ("model-inference",)),
        "agrees": ("model-inference", ("your-input", "model-inference")),
        "one": ("script-output", ()),
        "none": ("missing", ()),
    }


def test_counts_remember_what_lies_under_them(judged):
    out = judged.groupBy("url").agg(F.count_if(F.col("verdict") == "S").alias("hits"), F.max("verdict").alias("some"), F.avg("x").alias("mean"))
    out = out.withColumn("place", F.row_number().over(Window.orderBy("some")))
    assert classes(out) == {
        "url": ("record", ("record",)),
        "hits": ("script-output", ("model-inference",)),
        "some": ("model-inference", ("model-inference",)),
        "mean": ("script-output", ("external-source",)),
        "place": ("script-output", ("model-inference",)),
    }


def test_unions_have_the_furthest_class_of_their_parts(judged):
    both = judged.select(F.col("url").alias("v")).union(judged.select("verdict"))
    assert classes(both)["v"] == ("model-inference", ("record", "model-inference"))
    bare = judged.sparkSession.createDataFrame([("q",)], "v string")
    assert classes(judged.select(F.col("url").alias("v")).union(bare))["v"] == (None, ())


def test_generators_subqueries_and_python(judged):
    spark = judged.sparkSession
    told = judged.select("id", F.explode(F.split("verdict", "")).alias("letter"))
    assert classes(told)["letter"] == ("model-inference", ("model-inference",))
    judged.createOrReplaceTempView("judged_rows")
    out = spark.sql("WITH w AS (SELECT id, verdict AS v FROM judged_rows) SELECT a.id, (SELECT max(v) FROM w) AS top FROM w a JOIN w b ON a.id = b.id")
    assert classes(out) == {"id": ("record", ("record",)), "top": ("model-inference", ("model-inference",))}

    def twice(frames):
        for f in frames:
            yield pd.DataFrame({"y": f["x"] * 2})

    assert classes(judged.select("x").mapInPandas(twice, "y double"))["y"] == ("script-output", ("external-source",))


def test_classes_outlive_a_file(judged, tmp_path):
    P.published(judged.groupBy("url").agg(F.count("verdict").alias("n"))).write.parquet(f"{tmp_path}/t")
    again = judged.sparkSession.read.parquet(f"{tmp_path}/t")
    assert classes(again) == {"url": ("record", ("record",)), "n": ("script-output", ("model-inference",))}
    assert classes(again.select((F.col("n") + 1).alias("m")))["m"] == ("script-output", ("model-inference",))


def test_an_unclassified_field_refuses(judged):
    bare = judged.sparkSession.createDataFrame([(1, 2)], "id int, y int")
    with pytest.raises(ValueError, match="not classified: y"):
        P.published(judged.join(bare, "id"))
    with pytest.raises(ValueError, match="not a class"):
        P.classified(bare, {"y": "guess"})
    with pytest.raises(ValueError, match="no such field"):
        P.classified(bare, {"z": "record"})


def test_field_table_counts_nulls_and_empty_tables(judged):
    rows = {r["field"]: r for r in P.field_table(judged.withColumn("truth", F.lit(None).cast("int"))).collect()}
    assert (rows["verdict"]["present"], rows["verdict"]["absent"], rows["verdict"]["marked"]) == (2, 1, True)
    assert (rows["truth"]["class"], rows["truth"]["present"], rows["truth"]["absent"]) == ("missing", 0, 3)
    assert not rows["url"]["marked"]
    assert {(r["present"], r["absent"]) for r in P.field_table(judged.where("id > 9")).collect()} == {(0, 0)}


def test_lines_of_a_table(judged):
    lines = {r["place"]: r["line"] for r in P.table_lines(judged.withColumn("url", F.lit("a|b")), "id", "url", "verdict").collect()}
    assert lines[1] == "| a\\|b | S |" and lines[2] == "| a\\|b | withheld |"


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_every_field_of_every_query_is_classified(spark, name):
    df = P.published(catalogue.QUERIES[name](spark, SF))
    assert {f.metadata[P.KEY] for f in df.schema} <= set(P.CLASSES)
