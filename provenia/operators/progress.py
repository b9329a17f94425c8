"""Counts of each stage while a run goes on, taken as the rows pass and without a job of their own.

A batch run is watched by observations, a stream by a listener, so a caller sees counts batch by batch. What reaches the
driver is one number per stage, metric and batch. The numbers are Spark's own metrics: a stage that is computed again,
after an executor was lost or because two actions read it, is counted again, so they are progress and not results.
"""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from provenia.operators.provenance import classified

COUNTS = "stage string, batch long, metric string, value long"


def _metrics(counts: dict[str, Column]) -> list[Column]:
    """Rows, and how many of them meet each condition; null conditions aren't met."""
    return [F.count(F.lit(1)).alias("rows"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in counts.items()]]


class Stages:
    """Stages of a batch run. ``watch`` marks one, ``counts`` gives what has passed once an action has read it."""

    def __init__(self) -> None:
        self._seen: dict[str, Observation] = {}

    def watch(self, df: DataFrame, stage: str, **counts: Column) -> DataFrame:
        if stage in self._seen:
            raise ValueError(f"watched already: {stage}")
        self._seen[stage] = Observation()
        return df.observe(self._seen[stage], *_metrics(counts))

    def counts(self, spark: SparkSession) -> DataFrame:
        """(stage, batch, metric, value), the batch null. Waits for the first action over each stage, so it is called after one."""
        rows = [(stage, None, k, v) for stage, o in self._seen.items() for k, v in o.get.items()]
        return classified(spark.createDataFrame(rows, COUNTS), "script-output")


class Batches(StreamingQueryListener):
    """Stages of a stream: ``spark.streams.addListener(Batches())``; ``counts`` grows with every batch, also while it runs."""

    def __init__(self) -> None:
        self._rows: list[tuple] = []
        self._lock = threading.Lock()

    @staticmethod
    def watch(df: DataFrame, stage: str, **counts: Column) -> DataFrame:
        return df.observe(stage, *_metrics(counts))

    def onQueryStarted(self, event) -> None: ...

    def onQueryIdle(self, event) -> None: ...

    def onQueryTerminated(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        batch = event.progress.batchId
        rows = [(stage, batch, k, v) for stage, row in event.progress.observedMetrics.items() for k, v in row.asDict().items()]
        with self._lock:
            self._rows += rows

    def counts(self, spark: SparkSession) -> DataFrame:
        with self._lock:
            rows = list(self._rows)
        return classified(spark.createDataFrame(rows, COUNTS), "script-output")
