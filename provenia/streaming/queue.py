"""The capture queue as one stateful stream: each answer is audited once, failures are tried again, and nothing is lost.

The stream reads two folders, captures and the ledger that its own batches write, and keeps a state for each answer's
hash: attempts, the capture's name, and the text until the answer is settled. A capture of a new answer is due at once.
A failed entry of the ledger makes its answer due again after the back-off, up to ATTEMPTS. An attempt without an
entry after LOCK is taken for dead and its answer is due again. Batches write their entries into folders of their own
number, so that a batch that runs again gives the same attempts and replaces what it wrote.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from provenia.operators.ordering import keep_last
from provenia.operators.provenance import classified
from provenia.session import importable

FILES_PER_BATCH = 5
ATTEMPTS = 3
#: Milliseconds after which an attempt that left no entry counts as dead.
LOCK = 2 * 60 * 60 * 1000
CAPTURE = "query_id string, answer_text string"
LEDGER = "answer_sha256 string, capture string, status string, attempts int, batch long"
DUE = "answer_sha256 string, query_id string, answer_text string, attempts int"
STATE = "status string, attempts int, capture string, text string, at long"
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def shared_folder(spark: SparkSession) -> str:
    """A folder every executor sees: the cluster's, or a temporary one in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(shared or tempfile.mkdtemp(prefix="provenia-"), f"queue-{uuid.uuid4().hex}")


class RowAttempts(StatefulProcessor):
    """Rows due for an audit, from captures and from the entries of earlier audits.

    Statuses: waiting (an attempt is out; ``at`` is when), failed (the next one is due after the back-off), ok, given up.
    An answer is met as often as it has attempts, so each meeting reads its state once and makes no frame.
    """

    def __init__(self, attempts: int, backoff: int, lock: int) -> None:
        self.most, self.backoff, self.lock = attempts, backoff, lock

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("answer", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timers) -> Iterator[Row]:
        now = timers.getCurrentProcessingTimeInMs()
        entries, first = [], None
        for row in rows:
            if row.status is not None:
                entries.append((row.attempts, row.status))
            elif first is None or row.query_id is not None and (first.query_id is None or row.query_id < first.query_id):
                first = row
        held = self.state.get()
        for attempts, status in sorted(entries):
            if held is not None and held[0] == "waiting" and attempts == held[1]:
                held = self._after(held, status, now)
        if held is None and first is not None:
            held = ("failed", 0, first.query_id, first.answer_text, now)
        if held is not None:
            yield from self._due(key, held, now)

    def handleExpiredTimer(self, key, timers, expired) -> Iterator[Row]:
        now = timers.getCurrentProcessingTimeInMs()
        held = self.state.get()
        if held is not None:
            if held[0] == "waiting" and now >= held[4] + self.lock:
                held = self._after(held, "dead", now)
            yield from self._due(key, held, now)

    def close(self) -> None:
        pass

    def _after(self, held, status: str, now: int):
        """The state after an attempt has ended; the text goes once the answer is settled."""
        if status == "ok":
            return ("ok", held[1], held[2], "", now)
        if held[1] >= self.most:
            return ("given up", held[1], held[2], "", now)
        return ("failed", held[1], held[2], held[3], now + self.backoff)

    def _due(self, key, held, now: int) -> Iterator[Row]:
        if held[0] != "failed":
            self.state.update(tuple(held))
        elif now < held[4]:
            self.state.update(tuple(held))
            self.handle.registerTimer(held[4])
        else:
            self.state.update(("waiting", held[1] + 1, held[2], held[3], now))
            self.handle.registerTimer(now + self.lock)
            yield Row(answer_sha256=key[0], query_id=held[2], answer_text=held[3], attempts=held[1] + 1)


class Attempts(RowAttempts):
    """The same over pandas frames, for ``transformWithStateInPandas``; makes frames for each meeting."""

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        met = (row for frame in rows for row in frame.astype(object).where(frame.notna(), None).itertuples(index=False))
        yield from map(_frame, super().handleInputRows(key, met, timers))

    def handleExpiredTimer(self, key, timers, expired) -> Iterator[pd.DataFrame]:
        yield from map(_frame, super().handleExpiredTimer(key, timers, expired))


def _frame(row: Row) -> pd.DataFrame:
    return pd.DataFrame([row.asDict()])


def watch(spark: SparkSession, captures: str, ledger: str, checkpoint: str, audit: Callable[[DataFrame], DataFrame], attempts: int = ATTEMPTS, backoff: int = 0, lock: int = LOCK):
    """Starts one run of the stream, which ends when what lies in both folders is read.

    ``audit`` maps due rows (answer_sha256, query_id, answer_text, attempts) to (answer_sha256, status). An answer that
    it gives no status failed. Captures with a null text are left out; equal texts are one answer, named by the
    smallest query_id of the batch that brings it. ``captures`` and ``ledger`` must exist; the ledger is empty at first.
    """
    importable(spark)
    # an empty table of its own gives each run a batch, in which timers that have run out are seen; without it, a
    # run that ends when all is read would never end, for a state with timers asks for one batch after another
    spark.createDataFrame([], LEDGER).write.parquet(f"{ledger}/run={uuid.uuid4().hex}")
    new = spark.readStream.schema(CAPTURE).option("maxFilesPerTrigger", FILES_PER_BATCH).parquet(captures).where("answer_text IS NOT NULL")
    new = new.select(F.sha2("answer_text", 256).alias("answer_sha256"), "query_id", "answer_text", F.lit(None).cast("string").alias("status"), F.lit(None).cast("int").alias("attempts"))
    old = spark.readStream.schema(LEDGER).parquet(ledger)
    old = old.select("answer_sha256", F.col("capture").alias("query_id"), F.lit(None).cast("string").alias("answer_text"), "status", "attempts")
    due = new.unionByName(old).groupBy("answer_sha256").transformWithState(RowAttempts(attempts, backoff, lock), DUE, "append", "ProcessingTime")
    writer = due.writeStream.foreachBatch(lambda rows, n: record(rows, ledger, n, audit)).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    try:
        return writer.start()  # the stream keeps the settings of its start
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def record(rows: DataFrame, ledger: str, number: int, audit: Callable[[DataFrame], DataFrame]) -> None:
    """Audits the due rows and writes the batch's entries; a batch that runs again replaces its own."""
    rows = rows.persist()
    if not rows.isEmpty():
        said = rows.select("answer_sha256", F.col("query_id").alias("capture"), "attempts").join(audit(rows), "answer_sha256", "left")
        entry = said.select("answer_sha256", "capture", F.coalesce("status", F.lit("failed")).alias("status"), "attempts", F.lit(number).cast("long").alias("batch"))
        entry.write.mode("overwrite").parquet(f"{ledger}/run=batch-{number}")
    rows.unpersist()


def last_entries(spark: SparkSession, ledger: str) -> DataFrame:
    """Last status and attempts of each answer in the ledger."""
    return classified(keep_last(spark.read.schema(LEDGER).parquet(ledger), ["answer_sha256"], "attempts").select("answer_sha256", "capture", "status", "attempts"), "record")


def prepare(spark: SparkSession, folder: str) -> tuple[str, str, str]:
    """Folders of captures, ledger and checkpoint, the first two with an empty table, so that a stream can start."""
    captures, ledger, checkpoint = (f"{folder}/{x}" for x in ("captures", "ledger", "checkpoint"))
    spark.createDataFrame([], CAPTURE).write.mode("append").parquet(f"{captures}/drop=0")
    spark.createDataFrame([], LEDGER).write.mode("overwrite").parquet(f"{ledger}/run=start")
    return captures, ledger, checkpoint


def drain(captures: DataFrame, audit: Callable[[DataFrame], DataFrame] | None = None, drops: int = 1) -> DataFrame:
    """Drops the captures as files, in ``drops`` parts with a run after each, runs until nothing is left to try, and
    returns the ledger's last entries."""
    spark = captures.sparkSession
    paths = prepare(spark, shared_folder(spark))
    ok = audit or (lambda rows: rows.select("answer_sha256", F.lit("ok").alias("status")))
    rows = captures.select("query_id", "answer_text")
    for part in range(drops):
        own = rows.where(F.pmod(F.xxhash64("query_id"), F.lit(drops)) == part)
        own.repartition(8, "query_id").write.parquet(f"{paths[0]}/drop={part + 1}")
        watch(spark, *paths, ok).awaitTermination()
    while not last_entries(spark, paths[1]).where(f"status != 'ok' AND attempts < {ATTEMPTS}").isEmpty():
        watch(spark, *paths, ok).awaitTermination()  # ATTEMPTS times at most
    return last_entries(spark, paths[1])
