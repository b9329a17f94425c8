"""Sharding by weighted rendezvous hashing.

Each (key, shard) pair draws a number u in (0, 1) from MD5 of "key:shard"; the key goes to the shard with the
smallest -ln(u) / weight. A shard's draws don't depend on the other shards, so another shard takes rows only into
itself and a removed one gives up only its own. All of it is column expressions over one narrow projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Numbered slots: a shard's rows are counted in this many parts, so no shard is sorted by one task. The table of
#: part sizes has at most shards x SLOT_PARTS rows.
SLOT_PARTS = 256


def rendezvous(key: Column, weights: list[float]) -> Column:
    """Shard (int) of a key; shards with weight 0 take nothing. A null key is placed like the text 'null'."""
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights: at least one positive, none negative")
    name = F.coalesce(key.cast("string"), F.lit("null"))
    drawn = []
    for shard, weight in enumerate(weights):
        if weight > 0:
            digits = F.substring(F.md5(F.concat(name, F.lit(f":{shard}"))), 1, 12)
            u = (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))
            drawn.append(F.struct((-F.log(u) / F.lit(float(weight))).alias("cost"), F.lit(shard).alias("shard")))
    return F.array_min(F.array(*drawn))["shard"]


def slots(df: DataFrame, shard: str, key: str, order: list[str]) -> DataFrame:
    """Adds slot: 0, 1, 2, ... within each shard, without a gap.

    Rows are ordered by part (a hash of key), then by ``order``; only the part counts are summed up per shard.
    """
    df = df.withColumn("_part", F.pmod(F.xxhash64(F.col(key)), F.lit(SLOT_PARTS)).cast("int"))
    sizes = df.groupBy(shard, "_part").agg(F.count(F.lit(1)).alias("_n"))
    run = Window.partitionBy(shard).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(shard).alias("_shard"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(run), F.lit(0)).alias("_start"))
    local = F.row_number().over(Window.partitionBy(shard, "_part").orderBy(*[F.col(c).asc_nulls_first() for c in order]))
    placed = df.withColumn("_rank", local)
    # at most shards x SLOT_PARTS rows of three numbers
    joined = placed.join(F.broadcast(starts), (F.col(shard) == F.col("_shard")) & (F.col("_part") == F.col("_p")))
    return joined.withColumn("slot", F.col("_start") + F.col("_rank") - 1).drop("_part", "_p", "_shard", "_start", "_rank", "_n")


def shard_documents(docs: DataFrame, weights: list[float], more: float = 1.0) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``grown_shard`` is the shard after one of weight ``more`` has been added. Null text: size 1, checksum 0. Null
    doc_id: placed under one name. Repeated rows land together, each with a slot of its own. Empty input: no rows.
    Columns of ``docs`` beyond doc_id and text aren't read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col("doc_id"), weights).alias("shard"),
        rendezvous(F.col("doc_id"), [*weights, more]).alias("grown_shard"),
    )
    return slots(rows, "shard", "doc_id", ["doc_id", "text_crc32", "size"])
