"""Joins by nearness and by containment: as-of and nearest rows in time, sets that stand wholly in others."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenia.functions.text import canonical, signature


def by_seconds(width: int) -> Callable[[Column], Column]:
    """Pieces of time of so many seconds."""
    return lambda at: F.floor(F.unix_micros(at.cast("timestamp")) / (width * 1_000_000))


def asof_join(left: DataFrame, right: DataFrame, key: str, at: str, right_at: str, ties: list[str], piece: Callable[[Column], Column], forward: bool = False) -> DataFrame:
    """Adds ``match`` to each left row: the right row (a struct) of its key that is the last not after it; null if there is none.

    ``forward``: the first not before it. Of rows of one time the last by ``ties`` counts (forward: the first). Both
    sides are put in order together within a piece of a key's time, and a piece that has no match yet takes the one of
    the pieces before it; so no pair of rows is formed but the result's, and a key with very many rows is many tasks.
    ``piece`` maps a time to its piece and mustn't fall as time rises. Null keys and times match nothing.
    """
    void = F.col(key).isNull() | F.col(at).isNull()
    own, found = F.struct(*[F.col(f"`{c}`") for c in left.columns]), F.struct(*[F.col(f"`{c}`") for c in right.columns])
    place = F.struct(F.col(right_at).alias("at"), *[F.col(c).alias(f"t{i}") for i, c in enumerate(ties)])
    lefts = left.where(~void).select(F.col(key).alias("k"), F.col(at).alias("at"), own.alias("l"))
    rights = right.where(F.col(key).isNotNull() & F.col(right_at).isNotNull()).select(F.col(key).alias("k"), F.col(right_at).alias("at"), F.struct(place.alias("place"), found.alias("row")).alias("r"))
    both = lefts.unionByName(rights, allowMissingColumns=True).withColumn("piece", piece(F.col("at")))
    order = [F.desc("at"), F.col("l").isNotNull(), F.desc("r.place")] if forward else ["at", F.col("l").isNotNull(), "r.place"]
    here = F.last("r", ignorenulls=True).over(Window.partitionBy("k", "piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    nearest = F.min if forward else F.max
    pieces = both.groupBy("k", "piece").agg(nearest("r").alias("edge"))
    before = nearest("edge").over(Window.partitionBy("k").orderBy(F.desc("piece") if forward else "piece").rowsBetween(Window.unboundedPreceding, -1))
    carried = pieces.select("k", "piece", before.alias("carried"))
    rows = both.withColumn("here", here).where("l IS NOT NULL").join(carried, ["k", "piece"])
    out = rows.select("l.*", F.coalesce("here.row", "carried.row").alias("match"))
    kind = out.schema["match"].dataType
    return out.unionByName(left.where(void).withColumn("match", F.lit(None).cast(kind)))


def nearest_join(left: DataFrame, right: DataFrame, key: str, at: str, right_at: str, ties: list[str], piece: Callable[[Column], Column]) -> DataFrame:
    """Adds ``match``: the right row of the key that is nearest in time; the earlier one of two as near."""
    back = asof_join(left, right, key, at, right_at, ties, piece).withColumnRenamed("match", "_back")
    both = asof_join(back, right, key, at, right_at, ties, piece, forward=True)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    later = F.col("_back").isNull() | (micros(f"match.{right_at}") - micros(at) < micros(at) - micros(f"_back.{right_at}"))
    return both.withColumn("match", F.when(F.col("match").isNotNull() & later, F.col("match")).otherwise(F.col("_back"))).drop("_back")


def contained_in(left: DataFrame, right: DataFrame) -> DataFrame:
    """(id, other): the right sets that have every token of a left set. Both sides: id, tokens (distinct, not many).

    A left set asks only for its token that the fewest right sets have; whoever has that one is verified. Empty sets
    stand in nothing, and null tokens in no set.
    """
    sets = lambda df: df.select("id", F.filter("tokens", lambda t: t.isNotNull()).alias("tokens"), F.size(F.filter("tokens", lambda t: t.isNotNull())).alias("size"))
    held = sets(right).select(F.col("id").alias("other"), F.col("tokens").alias("all"), F.explode("tokens").alias("token"))
    often = held.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    asked = sets(left).select("id", "tokens", "size", F.explode("tokens").alias("token")).join(often, "token")
    rarest = asked.groupBy("id").agg(F.count(F.lit(1)).alias("known"), F.first("size").alias("size"), F.first("tokens").alias("tokens"), F.min(F.struct("n", "token")).alias("rarest"))
    # a token that no right set has rules a left set out
    asking = rarest.where("known = size").select("id", "tokens", F.col("rarest.token").alias("token"))
    return asking.join(held, "token").where(F.size(F.array_except("tokens", "all")) == 0).select("id", "other")


def same_citations(left: DataFrame, right: DataFrame) -> DataFrame:
    """(text, other): distinct written forms of both sides (text) that name the same work, as ``same_citation`` has it."""
    forms = lambda df: df.select("text").distinct().select("text", F.array_sort(signature(F.col("text"))).alias("tokens"), canonical(F.col("text")).alias("plain"))
    a, b = forms(left), forms(right)
    named = lambda df: df.where("size(tokens) > 0")
    sets = lambda df: named(df).select("tokens").distinct().select(F.concat_ws("\x00", "tokens").alias("id"), "tokens")
    back = contained_in(sets(b), sets(a)).select(F.col("other").alias("id"), F.col("id").alias("other"))
    pairs = contained_in(sets(a), sets(b)).unionByName(back).distinct()
    of = lambda df, text, key: named(df).select(F.col("text").alias(text), F.concat_ws("\x00", "tokens").alias(key))
    tokens = pairs.join(of(a, "text", "id"), "id").join(of(b, "other_text", "other"), "other").select("text", F.col("other_text").alias("other"))
    bare = lambda df, text: df.where("plain != ''").select(F.col("text").alias(text), "plain", F.size("tokens").alias(f"{text}_size"))
    equal = bare(a, "text").join(bare(b, "other"), "plain").where("text_size = 0 OR other_size = 0").select("text", "other")
    return tokens.unionByName(equal)
