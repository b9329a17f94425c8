import os
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from provenia.sources import versioned


def _rows(spark, n, body="b"):
    return spark.range(n).repartition(3).select((F.col("id") % 4).cast("string").alias("key"), F.lit("20240101").alias("stamp"), F.lit("{}").alias("meta"), F.concat(F.lit(body), F.col("id").cast("string")).alias("body"))


def _bodies(spark, path):
    return sorted(bytes(r.body).decode() for r in versioned.read(spark, path).collect())


def test_versions_of_one_second(spark, tmp_path):
    path = str(tmp_path / "store")
    versioned.append(_rows(spark, 8), path)
    versioned.append(_rows(spark, 4, "c"), path)
    rows = versioned.read(spark, path).where("key = '1'").orderBy("version").collect()
    assert [r.name for r in rows] == ["20240101", "20240101-1", "20240101-2"] and bytes(rows[2].body) == b"c1"
    assert sorted(bytes(r.body) for r in versioned.latest(spark, path).collect()) == [b"c0", b"c1", b"c2", b"c3"]


def test_two_writers_at_once(spark, tmp_path):
    path = str(tmp_path / "store")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: versioned.append(_rows(spark, 20, f"w{k}-"), path), range(4)))
    assert _bodies(spark, path) == sorted(f"w{k}-{i}" for k in range(4) for i in range(20))
    assert sorted(os.listdir(f"{path}/commits")) == [f"{k:09d}.json" for k in range(4)]
    assert os.listdir(f"{path}/staged") == []


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    versioned.append(_rows(spark, 5), path)
    bad = _rows(spark, 9, "x").withColumn("body", F.when(F.col("body") == "x7", F.raise_error(F.lit("lost"))).otherwise(F.col("body")))
    with pytest.raises(PySparkException):
        versioned.append(bad, path)
    assert _bodies(spark, path) == [f"b{i}" for i in range(5)]
    versioned.append(_rows(spark, 0), path)  # an empty table is a commit without entries
    assert len(_bodies(spark, path)) == 5


def test_a_commit_that_stops_half_way_is_not_read(spark, tmp_path, monkeypatch):
    """The driver dies after the files were moved in and before the commit is named."""
    path = str(tmp_path / "store")
    versioned.append(_rows(spark, 5), path)
    writer = versioned.VersionedWriter(path)
    message = writer.write(iter(_rows(spark, 3, "half").withColumn("body", F.col("body").cast("binary")).toArrow().to_batches()))
    monkeypatch.setattr(versioned.os, "link", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        writer.commit([message])
    assert len(_bodies(spark, path)) == 5


def test_is_never_overwritten(spark, tmp_path):
    versioned.register(spark)
    with pytest.raises(Exception, match="only appended to"):
        _rows(spark, 2).withColumn("body", F.col("body").cast("binary")).write.format("versioned").mode("overwrite").save(str(tmp_path / "store"))
