"""Counts of stages as they pass, in a batch run and batch by batch in a stream."""

import time

import pytest
from pyspark.sql import functions as F

from provenia.operators.progress import Batches, Stages


def test_stages_of_a_batch_run(spark):
    run = Stages()
    rows = run.watch(spark.range(100).withColumn("odd", F.when(F.col("id") > 9, F.col("id") % 2 == 1)), "read", odd=F.col("odd"))
    kept = run.watch(rows.where("id >= 40"), "kept")
    kept.groupBy("odd").count().write.format("noop").mode("overwrite").save()
    got = {(r.stage, r.metric): r.value for r in run.counts(spark).collect()}
    assert got == {("read", "rows"): 100, ("read", "odd"): 45, ("kept", "rows"): 60}
    with pytest.raises(ValueError):
        run.watch(rows, "read")


def test_no_rows(spark):
    run = Stages()
    run.watch(spark.range(10).where("rand() > 2"), "none").write.format("noop").mode("overwrite").save()
    assert [(r.stage, r.metric, r.value) for r in run.counts(spark).collect()] == [("none", "rows", 0)]


def test_batches_of_a_stream_add_up(spark, tmp_path):
    spark.range(60).repartition(3).write.parquet(f"{tmp_path}/in")
    seen = Batches()
    spark.streams.addListener(seen)
    try:
        stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        even = seen.watch(seen.watch(stream, "read").where("id % 2 = 0"), "even", big=F.col("id") >= 30)
        query = even.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
        query.awaitTermination()
        for _ in range(100):  # progress reaches listeners a little after the batch
            counts = seen.counts(spark).where("stage = 'read'")
            if counts.count() >= 3:
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(seen)
    total = {(r.stage, r.metric): r.n for r in seen.counts(spark).groupBy("stage", "metric").agg(F.sum("value").alias("n")).collect()}
    out = spark.read.parquet(f"{tmp_path}/out")
    assert total == {("read", "rows"): 60, ("even", "rows"): out.count(), ("even", "big"): out.where("id >= 30").count()}
    assert seen.counts(spark).select("batch").distinct().count() == 3
