"""The corpus pipeline: each stage works on what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from provenia.llm import stages
from provenia.llm.common import cut, read

STAGES = [
    ("quality classifier", stages.quality),
    ("exact dedup", stages.exact),
    ("near dedup", stages.near),
    ("benchmark decontamination", stages.benchmark),
    ("packing", stages.packed),
]

#: The language model, the fuzzy keys and the packing aren't expressible in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over ``documents``; each result is written before the next stage reads it."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
