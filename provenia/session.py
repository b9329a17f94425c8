"""Session helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


#: Bytes of a batch that a Python worker gets, where the session sets none. By rows alone (10,000) a batch of pages
#: grows with the table until it is full, and its texts and columns are some five times as large.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package when the driver found it by a path of its own, and get batches of bounded bytes."""
    if BATCH[0] not in spark.conf.getAll:
        spark.conf.set(*BATCH)
    env = spark.sparkContext.environment
    paths = list(filter(None, env.get("PYTHONPATH", "").split(os.pathsep)))
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the cluster's shared folder; a local one only where none is configured (tests)."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="provenia-"))
    return df.checkpoint(eager=True)
