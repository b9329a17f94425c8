"""Append-only stores whose entries are never overwritten: a data source with a commit of its own.

Each task writes one file beside the store. Only when all tasks have ended, the files are moved in, and last of all a
numbered commit names them; its number is taken by creating its file, which only one of several writers can do. An
entry counts once a commit names its file, so a failed task or job leaves nothing to be read, and two writers at once
lose nothing. Entries of one key and stamp are told apart by version: stamp, stamp-1, stamp-2, in the order of commits.

The store is a folder that the driver and all executors share; the number of files follows the number of tasks.
"""

from __future__ import annotations

import json
import os
import threading
import uuid
import weakref
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from provenia.operators.ordering import keep_last
from provenia.operators.provenance import classified
from provenia.session import importable

ENTRY = "key string, stamp string, meta string, body binary"


@dataclass
class Written(WriterCommitMessage):
    file: str
    rows: int


class VersionedStore(DataSource):
    """``df.write.format("versioned").mode("append").save(folder)`` for rows (key, stamp, meta, body)."""

    @classmethod
    def name(cls) -> str:
        return "versioned"

    def schema(self) -> str:
        return ENTRY

    def writer(self, schema, overwrite: bool) -> VersionedWriter:
        if overwrite:
            raise ValueError("a versioned store is only appended to")
        return VersionedWriter(self.options["path"].removeprefix("file:"))


class VersionedWriter(DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.path, self.job = path, uuid.uuid4().hex
        for part in ("entries", "commits", f"staged/{self.job}"):
            os.makedirs(f"{path}/{part}", exist_ok=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        name, rows, out = f"{self.job}-{uuid.uuid4().hex}.parquet", 0, None
        for batch in iterator:
            out = out or pq.ParquetWriter(f"{self.path}/staged/{self.job}/{name}", batch.schema)
            out.write_batch(batch)
            rows += batch.num_rows
        if out:
            out.close()
        return Written(name if out else "", rows)

    def commit(self, messages: list[Written | None]) -> None:
        files = [m for m in messages if m and m.file]
        for m in files:
            os.rename(f"{self.path}/staged/{self.job}/{m.file}", f"{self.path}/entries/{m.file}")
        number = 1 + max((int(f.split(".")[0]) for f in os.listdir(f"{self.path}/commits") if f.endswith(".json")), default=-1)
        whole = f"{self.path}/staged/{self.job}/commit"
        with open(whole, "w") as f:
            f.writelines(json.dumps({"file": m.file, "rows": m.rows}) + "\n" for m in files)
        while True:
            try:
                os.link(whole, f"{self.path}/commits/{number:09d}.json")  # whole at once, and only if no other writer has the number
                break
            except FileExistsError:
                number += 1
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        """What attempts that failed or ran twice have left."""
        folder = f"{self.path}/staged/{self.job}"
        for name in os.listdir(folder):
            os.remove(f"{folder}/{name}")
        os.rmdir(folder)


_known: weakref.WeakSet[SparkSession] = weakref.WeakSet()
_registering = threading.Lock()


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, once: while it is registered anew, other writers wouldn't find it."""
    with _registering:
        if spark not in _known:
            importable(spark)
            spark.dataSource.register(VersionedStore)
            _known.add(spark)


def append(entries: DataFrame, path: str) -> None:
    """Appends rows (key, stamp, meta, body); null keys and stamps are entries like any other."""
    register(entries.sparkSession)
    entries.sparkSession.createDataFrame([], ENTRY)  # makes the session the active one of this thread, in which the format's name is looked up
    entries.select("key", "stamp", "meta", F.col("body").cast("binary").alias("body")).write.format("versioned").mode("append").save(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(key, stamp, version, name, meta, body) of all committed entries; name is the stamp, with -version from the second on."""
    commits = spark.read.schema("file string, rows long").json(f"{path}/commits").select("file", F.col("_metadata.file_name").alias("commit"))
    rows = spark.read.schema(ENTRY).parquet(f"{path}/entries").select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"))
    order = Window.partitionBy("key", "stamp").orderBy("commit", "file", "row")
    numbered = rows.join(commits, "file").withColumn("version", (F.row_number().over(order) - 1).cast("long"))
    name = F.when(F.col("version") == 0, F.col("stamp")).otherwise(F.concat_ws("-", "stamp", "version"))
    return classified(numbered.select("key", "stamp", "version", name.alias("name"), "meta", "body"), "local-evidence")


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest entry of each key: the last stamp, and of it the last version."""
    return keep_last(read(spark, path), ["key"], "stamp", "version")
