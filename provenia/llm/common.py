"""Helpers that several corpus operators share: lineage cuts, words, buckets, components."""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenia.session import cut  # noqa: F401

#: Buckets of at most this many rows are compared pair by pair; larger ones through their smallest member and then by blocks.
SMALL_BUCKET = 8
#: Members of a large bucket that one task compares with as many others at once, and shingles of them.
BLOCK = 512
COLUMNS = 4096

#: Keys of a table that are joined by broadcast: the most frequent ones, up to this many (some 50 MB).
BROADCAST_KEYS = 1_000_000

#: Keys with several members that are named to the tasks (some 30 MB); with more, all rows are shuffled to them.
BROADCAST_COUNTS = 500_000

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def ready(spark: SparkSession) -> None:
    """Let Python workers import this package when the driver found it by a path of its own."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])


#: Rows of a written table that one task reads back, so that a small table doesn't become many small shuffle files.
ROWS_A_TASK = 200_000


def tight(df: DataFrame, rows: int = ROWS_A_TASK) -> DataFrame:
    """``cut``, read back by as many tasks as its number of rows asks for."""
    table = cut(df)
    return table.coalesce(max(1, -(-table.count() // rows)))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Bytes of a text's lower-cased UTF-8 that separate words: ASCII other than letters and digits.
_FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))


def words(text: str) -> list[bytes]:
    """Lower-case words of a text, as UTF-8: runs of letters, digits and non-ASCII characters."""
    return text.lower().encode("utf-8", "replace").translate(_FOLD).split()


def links_by_bucket(met: DataFrame, key: str, member: str) -> DataFrame:
    """Candidate pairs (a, b), a < b, of the members that share a key; a first pass over ``colliding`` rows.

    Buckets of at most SMALL_BUCKET members give every pair. In a larger one each member meets the smallest, which
    ties most groups of copies together with few rows; ``large_bucket_links`` then finds what that leaves apart.
    """
    large = met.where((F.col("n") > SMALL_BUCKET) & (F.col("l0") < F.col(member)))
    return small_pairs(met, key, member).unionByName(large.select(F.col("l0").alias("a"), F.col(member).alias("b"))).distinct()


def large_bucket_links(met: DataFrame, tops: DataFrame, key: str, member: str, shingles_of: Callable[[DataFrame], DataFrame], similarity: float) -> DataFrame:
    """Links (a, b) that, with those behind ``tops``, connect all pairs of at least ``similarity`` that share a large bucket.

    Large buckets that have members in common are taken together as one crowd, so that a pair that meets in many keys
    is compared once. Members of a crowd that ``tops`` (node, component) connects already need no comparison. All others are compared: the
    members are dealt into blocks (a component of more than BLOCK members into blocks of its own, whose pairs are left
    out), and each pair of blocks is a group of its own that compares the shingle sets exactly and returns a spanning
    forest. ``shingles_of`` gives (member, shingles), sorted 32-bit hashes, of a table of members.
    """
    none = tops.select(F.col("node").alias("a"), F.col("component").alias("b")).limit(0)
    joint = cut(met.where(F.col("n") > SMALL_BUCKET).select("l0", member).distinct())
    if joint.isEmpty():
        return none
    crowds = components(joint, "l0", member).select(F.col("node").alias(member), F.col("component").alias("crowd"))
    tops = tops.select(F.col("node").alias(member), F.col("component").alias("top"))
    rows = cut(crowds.join(tops, member, "left").withColumn("top", F.coalesce("top", member)))
    apart = rows.groupBy("crowd").agg(F.count(F.lit(1)).alias("n"), F.min("top").alias("lo"), F.max("top").alias("hi")).where("lo < hi").select("crowd", "n")
    rows = cut(rows.join(apart, "crowd"))
    if rows.isEmpty():
        return none
    held = rows.groupBy("crowd", "top").agg(F.count(F.lit(1)).alias("c"))
    h = F.xxhash64(member)
    own = F.col("c") > BLOCK
    part = F.when(own, F.pmod(h, F.ceil(F.col("c") / BLOCK))).otherwise(F.pmod(F.xxhash64("top"), F.ceil(F.col("n") / BLOCK)))
    dealt = cut(rows.join(held, ["crowd", "top"]).select("crowd", member, F.struct(own.alias("own"), F.when(own, F.col("top")).otherwise(0).alias("top"), part.alias("part")).alias("block")))
    one = dealt.select("crowd", F.col("block").alias("i")).distinct()
    two = one.withColumnRenamed("i", "j")
    facing = one.join(two, "crowd").where("i <= j AND NOT (i.own AND j.own AND i.top = j.top)")
    sides = facing.select("crowd", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    found = shingles_of(cut(dealt.select(member).distinct()))
    groups = sides.join(dealt, ["crowd", "block"]).join(found, member).select("crowd", "i", "j", F.col(member).alias("member"), "shingles")

    def compare(table: pa.Table) -> pa.Table:
        ids = table["member"].to_numpy()
        a, b = spanning_links([np.frombuffer(x.as_py(), np.uint32) for x in table["shingles"]], similarity)
        return pa.table({"a": np.minimum(ids[a], ids[b]), "b": np.maximum(ids[a], ids[b])})

    return groups.groupBy("crowd", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def spanning_links(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of links that connect the sets exactly as all pairs of at least ``similarity`` (Jaccard) do."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    order = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], order[column[keep]]
    by_column = np.argsort(column, kind="stable")
    owner, column = owner[by_column], column[by_column]
    both = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(shared.sum()), COLUMNS):
        lo, hi = np.searchsorted(column, [at, at + COLUMNS])
        dense = np.zeros((len(sets), COLUMNS), np.float32)
        dense[owner[lo:hi], column[lo:hi] - at] = 1
        both += dense @ dense.T
    both = both.astype(np.float64)
    near = both >= similarity * (sizes[:, None] + sizes[None, :] - both)
    fresh = np.ones(len(sets), bool)
    a, b = [], []
    for start in range(len(sets)):
        front = [start] if fresh[start] else []
        fresh[start] = False
        while front:
            at = front.pop()
            reached = np.flatnonzero(near[at] & fresh)
            fresh[reached] = False
            a += [at] * len(reached)
            b += reached.tolist()
            front += reached.tolist()
    return np.array(a, np.int64), np.array(b, np.int64)


def colliding(keyed: DataFrame, key: str, member: str) -> DataFrame:
    """The rows whose key has several members, with n (their number) and l0 (the smallest)."""
    # written first, so that this is a plain join of two tables, in which Spark splits a key with very many rows
    counts = cut(keyed.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(member).alias("l0")).where("n > 1"))
    few = counts.count() <= BROADCAST_COUNTS
    return keyed.join(F.broadcast(counts) if few else counts, key)


def weighed(rows: DataFrame, owner: str, key: str, table: DataFrame, value: str, most: int = BROADCAST_KEYS, also: tuple[str, ...] = ()) -> DataFrame:
    """Per owner, total (the sum of n x value) and times (the sum of n) over its rows (owner, key, n); the sum of n x each column of ``also`` under its name.

    ``table`` has (key, n, value) for each key that ``rows`` can hold; a null key in ``rows`` weighs nothing. The most
    frequent keys, at most ``most`` by count, are joined by broadcast, so an owner's rows become one before anything is
    shuffled; rows with any other key are shuffled to it. Frequent keys are the ones that would make that join skewed.
    """
    sums = {"total": value} | {name: name for name in also}
    steps = table.groupBy(F.floor(F.log2("n")).alias("step")).agg(F.count(F.lit(1)).alias("keys")).orderBy(F.desc("step")).collect()  # 64 at most
    floor, held = 63, 0
    for row in steps:
        held += row["keys"]
        if held > most:
            break
        floor = row["step"]
    frequent = F.floor(F.log2("n")) >= floor
    values = [F.col(column).alias(f"_{name}") for name, column in sums.items()]
    head = table.where(frequent).select(key, *values)
    joined = rows.join(F.broadcast(head), key, "left")
    rare = F.when(F.col("_total").isNull(), F.col(key))
    found = joined.groupBy(owner, rare.alias(key)).agg(*[F.sum(F.col(f"_{name}") * F.col("n")).alias(name) for name in sums], F.sum(F.when(F.col(key).isNotNull(), F.col("n"))).alias("times"))
    if held > most:
        found = cut(found)
        tail = table.where(~frequent).select(key, *values)
        far = found.where(F.col(key).isNotNull()).drop(*sums).join(tail, key).select(owner, *[(F.col(f"_{name}") * F.col("times")).alias(name) for name in sums], "times")
        found = found.where(F.col(key).isNull()).select(owner, *sums, "times").unionByName(far)
    return found.groupBy(owner).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in (*sums, "times")])


def small_pairs(met: DataFrame, key: str, member: str) -> DataFrame:
    """Every pair (a, b), a < b, within buckets of at most SMALL_BUCKET members."""
    lists = met.where(F.col("n") <= SMALL_BUCKET).groupBy(key).agg(F.sort_array(F.collect_list(member)).alias("ms"))
    return lists.select("ms", F.posexplode("ms").alias("i", "a")).select("a", F.explode(F.expr("slice(ms, i + 2, size(ms))")).alias("b"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for every node in a link with two different ends.

    Alternating large-star and small-star steps; each step is two aggregations with map-side combine and is
    checkpointed. Stops when a round leaves the set of links as it was.
    """
    edges = tight(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    before = _digest(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        edges = tight(edges)
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        near = edges.join(low, "u")
        edges = near.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = tight(edges)
        after = _digest(edges)
        if after == before:
            break
        before = after
    tops = edges.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops).distinct()


def _digest(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(F.shiftright(h, 20))).first())
