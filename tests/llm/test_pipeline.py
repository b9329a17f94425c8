from pyspark.sql import functions as F

import corpus_pipeline
from provenia.llm import common, queries
from provenia.llm.exact_dedup import drop_copies

SF = "/root/testdata/sf0.001"


def test_stages_hand_on_the_documents(spark):
    docs = common.read(spark, SF, "documents")
    left, names = docs, docs.columns
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = common.cut(stage(spark, left, SF))
        assert left.columns == names, name
        counts.append(left.count())
    assert counts == sorted(counts, reverse=True) and 0 < counts[-1] < counts[0]
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in left.collect()}


def test_exact_stage_leaves_one_of_each(spark):
    docs = common.read(spark, SF, "documents")
    assert drop_copies(docs).count() == docs.select("text").distinct().count()


def test_every_query_runs_and_keeps_its_columns(spark):
    got = queries.queries()
    assert [int(n[2:].split("_")[0]) for n in sorted(got, key=lambda n: int(n[2:].split("_")[0]))] == list(range(1, 14))
    for name, f in got.items():
        assert f(spark, SF).count() >= 0, name


def test_components_of_chains_and_stars(spark):
    import random

    rng = random.Random(5)
    links = [(i, i + 1) for i in range(0, 120)] + [(200, 200 + k) for k in range(1, 300)] + [(600, 601), (601, 600), (700, 700)]
    rng.shuffle(links)
    got = {r.node: r.component for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(121)}, **{200 + k: 200 for k in range(300)}, 600: 600, 601: 600}


def test_stages_on_awkward_documents(spark, docs, tmp_path):
    """Nulls in any column, blank and very long texts, repeated rows, clashing extra columns; labels and benchmark almost empty."""
    docs = docs.withColumn("text", F.when(F.col("doc_id").isNull(), "river stone").otherwise(F.col("text")))
    spark.createDataFrame([(i, 1, 0) for i in [1, *range(100, 160)]] + [(15, 1, None), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = common.cut(stage(spark, left, str(tmp_path)))
        assert left.columns == docs.columns, name
    ids = [r.doc_id for r in left.collect()]
    assert None in ids and 1 in ids and len(ids) == len(set(ids)) and not {3, 4, 9} & set(ids)
    assert corpus_pipeline.STAGES[-1][1](spark, left, str(tmp_path)).count() >= len(ids)


def test_stages_on_nothing(spark, empty, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = empty
    for _, stage in corpus_pipeline.STAGES:
        left = stage(spark, left, str(tmp_path))
        assert left.collect() == []
