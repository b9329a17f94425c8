"""Exact dedup by 128-bit content hash with a byte comparison inside groups. DataFrame functions only.

Texts are compared after deleting the characters of [\\x20\\x09-\\x0D]. MD5 of what is left is the 128-bit key.
Grouping by (key, text) compares the bytes: two texts under one key make two classes. Partial aggregation
collapses the copies that a task holds before anything is shuffled, so a group of any size is cheap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Above any 2^63 - 1 - doc_id; as text, for it is beyond a long.
SCALE = "100000000000000000000"

BLANKS = " \t\n\x0b\x0c\r"


def squeezed(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the most code points, then the smallest doc_id, stays. Null text counts as empty;
    empty texts are one group. A repeated (doc_id, text) row is kept once per row that carries the winning doc_id.
    A null doc_id loses to any other. Empty input: no rows. Other columns aren't read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.length(text).cast("long").alias("n"), squeezed(text).alias("body"))
    rows = rows.withColumn("key", F.md5("body"))
    # Longest original first, then smallest id, in one number that hash aggregation can update in place.
    last = F.lit(2**63 - 1).cast("decimal(20,0)") - F.coalesce(F.col("doc_id"), F.lit(2**63 - 1)).cast("decimal(20,0)")
    rank = (F.col("n").cast("decimal(11,0)") * F.lit(SCALE).cast("decimal(21,0)")).cast("decimal(38,0)") + last
    classes = rows.select("key", "body", rank.cast("decimal(38,0)").alias("rank")).groupBy("key", "body").agg(F.max("rank").alias("best"), F.count(F.lit(1)).alias("group_size"))
    tail = F.pmod(F.col("best"), F.lit(SCALE).cast("decimal(21,0)"))
    keep = (F.lit(2**63 - 1).cast("decimal(20,0)") - tail).cast("long")
    classes = classes.select("key", F.sha2("body", 256).alias("text_sha256"), keep.alias("keep_id"), "group_size")
    members = rows.select("doc_id", "key", F.sha2("body", 256).alias("text_sha256"))
    return members.join(classes, ["key", "text_sha256"]).select(
        "doc_id",
        F.when(F.col("doc_id").isNull() & (F.col("keep_id") == 2**63 - 1), F.lit(None)).otherwise(F.col("keep_id")).alias("keep_id"),
        "group_size",
        F.coalesce(F.col("doc_id"), F.lit(2**63 - 1)).eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their columns as they were; a row repeated in full stays once."""
    names = docs.columns
    far = F.lit(2**63 - 1)
    kept = exact_groups(docs).where("kept").select(F.coalesce("doc_id", far).alias("_id"), F.col("text_sha256").alias("_sha")).distinct()
    rows = docs.select(F.struct(*names).alias("_row"), F.coalesce("doc_id", far).alias("_id"), F.sha2(squeezed(F.col("text")), 256).alias("_sha"), F.length("text").alias("_n"))
    stay = rows.join(kept, ["_id", "_sha"], "left_semi")
    # The join has already brought the rows of one (doc_id, text) together; nearly always there is one.
    one = Window.partitionBy("_id", "_sha").orderBy(F.col("_n").desc_nulls_last())
    return stay.withColumn("_rank", F.row_number().over(one)).where("_rank = 1").select("_row.*")
