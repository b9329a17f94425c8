"""Pluggable judges: verdicts over judgeable pairs only, refusals and what a budget left out as rows.

A judge is an object with ``complete(document, claim) -> dict`` (verdict, span, tokens, ...); it may raise ``Refused``.
If it has a ``probe()``, that is called once before any pair is sent: it costs no tokens and raises ``Unavailable``. A
rule judge as a column expression needs no Python at all.
"""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenia import codes
from provenia.functions.text import content_words
from provenia.session import importable


class Refused(Exception):
    pass


#: Why a judge can't do its work.
KINDS = ("key", "rejected", "model", "unreachable")


class Unavailable(RuntimeError):
    """The judge can't do its work, known before anything was sent to it."""

    def __init__(self, message: str, kind: str):
        if kind not in KINDS:
            raise ValueError(f"not a kind of failure: {kind}")
        super().__init__(message)
        self.kind = kind


class Judge(Protocol):
    def complete(self, document: str, claim: str) -> dict: ...


def rule_verdict(document: Column, claim: Column, enough: float = 0.8, some: float = 0.4) -> Column:
    """A deterministic stand-in: by the share of the claim's content words that the document has."""
    words = content_words(claim)
    share = F.when(F.size(words) > 0, F.size(F.array_intersect(words, content_words(document))) / F.size(words)).otherwise(0.0)
    return F.when(share >= enough, "SUPPORTED").when(share >= some, "PARTIALLY_SUPPORTED").otherwise("NOT_FOUND_IN_SOURCE")


COLUMNS = "claim_id string, url string, verdict string, span string, refusal string, tokens long, halted boolean"


def judge_metered(pairs: DataFrame, judge: Judge, budget: int | None = None, parts: int = 64, deal: Column | None = None) -> DataFrame:
    """(claim_id, url, verdict, span, refusal, tokens, halted) for the pairs (claim_id, url, claim, text, source_code) whose page was read.

    ``budget`` is dealt in equal shares to ``parts`` parts of the pairs (``deal``: 0 to parts - 1; by default a hash of
    address and claim), for tasks that can't see each other. A part stops before the call that finds its share spent:
    that pair and all behind it, by address and claim, come out with ``halted``, no verdict and no tokens, and can be
    given to another run. So at most one call a part goes over the budget. Without a budget nothing stops; a negative one is
    an error. Null claims and texts are judged as empty. A refusal is a verdict of its own, with its words apart.
    Write the result once: a judge isn't deterministic, and a lost task would ask, and pay, again.
    """
    if budget is not None and budget < 0:
        raise ValueError("a budget isn't negative")
    if hasattr(judge, "probe"):
        judge.probe()
    importable(pairs.sparkSession)
    share = None if budget is None else budget / parts
    why = None if budget is None else f"budget of {budget:,} tokens reached"
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def run(frames):
        part, spent = None, 0
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                if r.part != part:
                    part, spent = r.part, 0
                if share is not None and spent >= share:
                    out.append((r.claim_id, r.url, "", "", why, 0, True))
                    continue
                try:
                    said = judge.complete(r.text, r.claim)
                    out.append((r.claim_id, r.url, said.get("verdict", ""), said.get("span") or "", "", int(said.get("tokens") or 0), False))
                except Refused as e:
                    out.append((r.claim_id, r.url, codes.REFUSED, "", str(e), 0, False))
                spent += out[-1][5]
            yield pd.DataFrame(out, columns=names)

    part = F.pmod(F.xxhash64("url", "claim_id"), F.lit(parts)) if deal is None else deal
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    rows = pairs.where(F.col("source_code") == codes.SOURCE_OK).select(part.cast("long").alias("part"), F.col("claim_id").cast("string").alias("claim_id"), "url", text("claim"), text("text"))
    return rows.repartition(parts, "part").sortWithinPartitions("part", "url", "claim_id").mapInPandas(run, COLUMNS)


def judge_pairs(pairs: DataFrame, judge: Judge) -> DataFrame:
    """(claim_id, url, verdict, span, refusal) for pairs with claim, text and source_code.

    Pairs whose page wasn't read never reach the judge. Rows are dealt and sorted by address, so a document is sent
    for its claims one after another.
    """
    return judge_metered(pairs, judge).select("claim_id", "url", "verdict", "span", "refusal")


def spending(judged: DataFrame, budget: int) -> DataFrame:
    """One row: calls, tokens, left_out, budget, halted of a metered run."""
    called = ~F.col("halted")
    n = judged.agg(F.count_if(called).alias("calls"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("tokens"), F.count_if(~called).alias("left_out"))
    return n.select("*", F.lit(budget).cast("long").alias("budget"), (F.col("left_out") > 0).alias("halted"))
