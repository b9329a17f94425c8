"""Operators whose result depends on order: first, last and latest rows, occurrence numbers, zips, seeded samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _ranked(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return _ranked(df, keys, [F.col(c).asc() for c in order])


def keep_last(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    return _ranked(df, keys, [F.col(c).desc() for c in order])


def claim_ids(claims: DataFrame, capture: str = "query_id", text: str = "canonical", pos: str = "pos") -> DataFrame:
    """Adds claim_id: capture # 8 hex digits of the text's SHA-256; the second of equal ones gets .2, the third .3."""
    base = F.concat(F.col(capture), F.lit("#"), F.substring(F.sha2(F.col(text), 256), 1, 8))
    n = F.row_number().over(Window.partitionBy("_base").orderBy(pos))
    rows = claims.withColumn("_base", base).withColumn("_n", n)
    return rows.withColumn("claim_id", F.when(F.col("_n") == 1, F.col("_base")).otherwise(F.concat("_base", F.lit("."), F.col("_n").cast("string")))).drop("_base", "_n")


def zip_in_order(left: DataFrame, right: DataFrame, key: str, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Full outer pairing of the n-th with the n-th row of each key; what is left over on either side shows."""
    ranked = lambda df, order: df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked(left, left_order).join(ranked(right, right_order), [key, "rank"], "full")


def stratified_sample(pool: DataFrame, buckets: list[str], key: str, target: int, seed: int, first_when=None) -> DataFrame:
    """Round robin over the buckets until ``target`` rows: the seeded n-th row of each bucket before any (n+1)-th.

    Which rows of a bucket come first depends on the seed alone; ``first_when`` puts such buckets first in each round.
    """
    mixed = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)
    rank = F.row_number().over(Window.partitionBy(*buckets).orderBy(mixed, key))
    rows = pool.withColumn("round", rank).withColumn("_late", F.lit(0) if first_when is None else F.when(first_when, 0).otherwise(1))
    return rows.orderBy("round", "_late", *buckets).limit(target).drop("_late")


def resume_sample(pool: DataFrame, done: DataFrame, buckets: list[str], key: str, target: int, seed: int, first_when=None) -> DataFrame:
    """What is still to be done for ``target`` rows in all: as many rows more are drawn as are done, those done are left
    out, and the first of the rest, in the order of ``stratified_sample``, fill the sample up."""
    done = done.select(key).distinct()
    n = done.count()
    rest = stratified_sample(pool, buckets, key, target + n, seed, first_when).join(done, key, "left_anti")
    late = [] if first_when is None else [F.when(first_when, 0).otherwise(1)]
    return rest.orderBy("round", *late, *buckets).limit(max(0, target - n))


def entries(cache: DataFrame, key: str) -> DataFrame:
    """(key, entries): how many stored versions there are of each."""
    return cache.groupBy(key).agg(F.count(F.lit(1)).alias("entries"))


def latest(entries: DataFrame, key: str, *order: str) -> DataFrame:
    """Newest entry of a key. A second entry within the same second is ordered by its sequence number."""
    return keep_last(entries, [key], *order)


def pending(captures: DataFrame, ledger: DataFrame, attempts: int = 3, per_run: int | None = None) -> DataFrame:
    """Captures still to be audited: not done, fewer attempts than allowed, their answer not audited under another
    name, and only the first capture of an answer; oldest first."""
    last = keep_last(ledger, ["capture"], "seq")
    done = last.where("status = 'ok'")
    rows = captures.join(last.select("capture", "status", F.col("attempts").alias("tried")), "capture", "left")
    rows = rows.where("(status IS NULL OR status != 'ok')").where(F.coalesce("tried", F.lit(0)) < attempts)
    rows = rows.join(done.select("answer_sha256").where("answer_sha256 IS NOT NULL").distinct(), "answer_sha256", "left_anti")
    rows = keep_first(rows, ["answer_sha256"], ["mtime", "capture"]).orderBy("mtime", "capture")
    return rows.limit(per_run) if per_run else rows


def watcher_outcome(exit_code, has_report, failed):
    """(status, outcome) of one firing."""
    status = F.when(failed, "failed").otherwise("ok")
    outcome = F.when(failed, "exception").when(exit_code != 0, "not scored").when(~has_report, "no report").otherwise("report")
    return status, outcome
