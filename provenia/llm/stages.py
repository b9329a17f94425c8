"""The stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame, one operator each."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from provenia.llm.common import read
from provenia.llm.decontamination import drop_contaminated
from provenia.llm.exact_dedup import drop_copies
from provenia.llm.packing import pack_documents
from provenia.llm.quality_lm import drop_low_quality
from provenia.llm.queries import SPECIAL
from provenia.llm.simhash import drop_near_copies


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_low_quality(docs, read(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), SPECIAL)
