"""Relations of the audit model, derived from the given tables by rules that both engines can run.

The test data holds no captures or verdicts: these are synthetic bindings that exercise the operators, and say
nothing about any product, publisher or judge. ``PAIRS_SQL`` is the same relation for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenia import codes
from provenia.operators.provenance import classified

#: What the columns of the given tables stand in for. Tables not named are records.
ORIGINS = {
    "documents": {"text": "external-source", "lang": "external-source"},
    "pages": {"html": "local-evidence"},
    "labels": {"quality": "your-input", "toxic": "your-input"},
    "benchmark": {"text": "your-input"},
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    special = ORIGINS.get(name, {})
    return classified(rows, {c: special.get(c, "record") for c in rows.columns})


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels x documents: claim_id, url, source, answer, product, origin, source_code, verdict, voided, void_reason, drift."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars", "lang")
    rows = table(spark, sf_dir, "labels").join(d, "doc_id")
    i = F.col("doc_id")
    verdict = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "SUPPORTED").when(F.col("quality") == 1, "PARTIALLY_SUPPORTED").when(F.col("toxic") == 0, "NOT_FOUND_IN_SOURCE").otherwise("CONTRADICTED")
    code = F.when(F.col("n_chars") < 600, "SOURCE_EMPTY").when(i % 11 == 0, "SOURCE_PAYWALLED").otherwise(codes.SOURCE_OK)
    rows = rows.withColumn("source_code", code).withColumn("verdict", F.when((F.col("source_code") != codes.SOURCE_OK) | (i % 13 == 0), "").otherwise(verdict))
    voided = (F.col("verdict") != "") & (i % 7 == 0)
    reason = F.when(~voided, "").when(F.col("verdict").isin(*codes.SPAN_REQUIRED), codes.FABRICATED).otherwise(codes.SUSPECT)
    answer = F.floor(i / 20).cast("long")
    product = F.element_at(F.array(*[F.lit(x) for x in ("lynx", "otter", "heron", "gemini")]), (answer % 4 + 1).cast("int"))
    rows = rows.select(
        F.floor(i / 2).cast("long").alias("claim_id"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/"), i.cast("string")).alias("url"),
        "source",
        answer.alias("answer"),
        product.alias("product"),
        F.when(answer % 5 == 0, "api").otherwise("dom").alias("origin"),
        "source_code",
        "verdict",
        voided.alias("voided"),
        reason.alias("void_reason"),
        F.element_at(F.array(*[F.lit(x) for x in codes.DRIFT]), (i % 5 + 1).cast("int")).alias("drift"),
        "doc_id",
        "lang",
        "n_chars",
    )
    declared = {"claim_id": "model-inference", "verdict": "model-inference"} | dict.fromkeys(("source_code", "voided", "void_reason", "drift"), "script-output")
    return classified(rows, declared | dict.fromkeys(("url", "source", "answer", "product", "origin"), "record"))


PAIRS_SQL = """
b AS (
  SELECT doc_id, source, n_chars, lang, quality, toxic,
         CASE WHEN n_chars < 600 THEN 'SOURCE_EMPTY' WHEN doc_id % 11 = 0 THEN 'SOURCE_PAYWALLED' ELSE 'SOURCE_OK' END AS source_code
  FROM labels JOIN documents USING (doc_id)),
v AS (
  SELECT *, CASE WHEN source_code <> 'SOURCE_OK' OR doc_id % 13 = 0 THEN ''
                 WHEN quality = 1 AND toxic = 0 THEN 'SUPPORTED' WHEN quality = 1 THEN 'PARTIALLY_SUPPORTED'
                 WHEN toxic = 0 THEN 'NOT_FOUND_IN_SOURCE' ELSE 'CONTRADICTED' END AS verdict,
         doc_id // 20 AS answer FROM b),
p AS (
  SELECT doc_id // 2 AS claim_id, 'https://' || source || '.example.org/' || doc_id AS url, source, answer,
         list_extract(['lynx', 'otter', 'heron', 'gemini'], CAST(answer % 4 + 1 AS INT)) AS product,
         CASE WHEN answer % 5 = 0 THEN 'api' ELSE 'dom' END AS origin, source_code, verdict,
         verdict <> '' AND doc_id % 7 = 0 AS voided,
         CASE WHEN NOT (verdict <> '' AND doc_id % 7 = 0) THEN '' WHEN verdict = 'NOT_FOUND_IN_SOURCE' THEN 'EXTRACTION_SUSPECT' ELSE 'JUDGE_FABRICATED_SPAN' END AS void_reason,
         list_extract(['NONE', 'PAGE_CHANGED', 'PAGE_REPLACED', 'NO_SNAPSHOT', 'NOT_CHECKED'], CAST(doc_id % 5 + 1 AS INT)) AS drift,
         doc_id, lang, n_chars FROM v),
s AS (
  SELECT *, source_code = 'SOURCE_OK' AND verdict <> '' AND NOT voided AS st,
         source_code = 'SOURCE_OK' AND verdict = 'SUPPORTED' AND NOT voided AS su FROM p)
"""


def human_labels(pairs: DataFrame) -> DataFrame:
    """(claim_id, url, label, blind, extraction_missed): a person's label beside the judge's verdict."""
    i = F.col("doc_id")
    label = F.when(i % 17 == 0, "UNAUDITABLE").when(i % 19 == 0, "UNDECIDABLE").when(i % 4 == 1, "NOT_FOUND_IN_SOURCE").when(i % 9 == 2, "PARTIALLY_SUPPORTED").when(F.col("verdict") == "", "SUPPORTED").otherwise(F.col("verdict"))
    missed = F.when(i % 3 == 0, True).when(i % 3 == 1, False)
    rows = pairs.select("claim_id", "url", label.alias("label"), (i % 6 != 0).alias("blind"), missed.alias("extraction_missed"))
    return classified(rows, {"label": "your-input", "blind": "your-input", "extraction_missed": "script-output"})


LABELS_SQL = """
h AS (
  SELECT claim_id, url, verdict, voided, CASE WHEN doc_id % 17 = 0 THEN 'UNAUDITABLE' WHEN doc_id % 19 = 0 THEN 'UNDECIDABLE'
         WHEN doc_id % 4 = 1 THEN 'NOT_FOUND_IN_SOURCE' WHEN doc_id % 9 = 2 THEN 'PARTIALLY_SUPPORTED'
         WHEN verdict = '' THEN 'SUPPORTED' ELSE verdict END AS label, doc_id % 6 <> 0 AS blind,
         CASE WHEN doc_id % 3 = 0 THEN TRUE WHEN doc_id % 3 = 1 THEN FALSE END AS extraction_missed FROM p),
r AS (SELECT claim_id, url, label, extraction_missed, CASE WHEN verdict <> '' AND NOT voided THEN verdict END AS verdict FROM h WHERE blind),
c AS (SELECT * FROM r WHERE verdict IS NOT NULL AND label IN ('SUPPORTED', 'PARTIALLY_SUPPORTED', 'NOT_FOUND_IN_SOURCE', 'CONTRADICTED'))
"""


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns as captures: query_id, answer_text."""
    t = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return t.select("conv_id", "turn", F.concat(F.lit("CV-"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("query_id"), F.col("text").alias("answer_text"))


ANSWERS_SQL = "a AS (SELECT conv_id, turn, 'CV-' || conv_id || '-' || turn AS query_id, text AS answer_text FROM conversations WHERE role = 'assistant')"
