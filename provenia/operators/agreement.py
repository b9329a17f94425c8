"""Human labels against the judge: kappa, per-class precision and recall, tri-state attribution, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenia import codes
from provenia.functions.stats import kappa, wilson
from provenia.operators.provenance import classified


def compare(labels: DataFrame, judgements: DataFrame) -> DataFrame:
    """Blind labels left joined to standing verdicts on (claim_id, url); verdict is null where there is none."""
    stands = judgements.where("verdict != '' AND NOT voided").select("claim_id", "url", "verdict")
    return labels.where("blind").join(stands, ["claim_id", "url"], "left")


def comparable(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("label").isin(*codes.VERDICTS) & F.col("verdict").isNotNull())


def confusion(rows: DataFrame) -> DataFrame:
    return comparable(rows).groupBy("label", "verdict").agg(F.count(F.lit(1)).alias("n"))


def agreement(rows: DataFrame) -> DataFrame:
    """One row: n, agree, kappa, its interval, and what was left out, each counted; one pass of counts by class."""
    label, verdict = F.col("label"), F.col("verdict")
    both = label.isin(*codes.VERDICTS) & verdict.isNotNull()
    sides = [F.count_if(both & (side == c)).alias(f"_{name}{k}") for k, c in enumerate(codes.VERDICTS) for name, side in (("label", label), ("verdict", verdict))]
    one = rows.agg(
        F.count_if(both).alias("n"),
        F.count_if(both & (label == verdict)).alias("agree"),
        *sides,
        F.count_if(label == "UNAUDITABLE").alias("unauditable"),
        F.count_if(label == "UNDECIDABLE").alias("undecidable"),
        F.count_if(label.isin(*codes.VERDICTS) & verdict.isNull()).alias("unmatched"),
    )
    chance = sum((F.col(f"_label{k}") * F.col(f"_verdict{k}") for k in range(len(codes.VERDICTS))), F.lit(0))
    value, low, high = kappa(F.col("n"), F.col("agree"), chance)
    return one.select("n", "agree", F.round(value, 10).alias("kappa"), F.round(low, 10).alias("lo"), F.round(high, 10).alias("hi"), "unauditable", "undecidable", "unmatched")


def class_metrics(rows: DataFrame) -> DataFrame:
    """Per class seen on either side: tp, fp, fn, precision and recall with Wilson intervals."""
    pairs = comparable(rows)
    seen = pairs.select(F.explode(F.array_distinct(F.array("label", "verdict"))).alias("class"), "label", "verdict")
    hit = lambda a, b: F.count_if((F.col("label") == F.col("class")) == F.lit(a)) if b is None else F.count_if(((F.col("label") == F.col("class")) == F.lit(a)) & ((F.col("verdict") == F.col("class")) == F.lit(b)))
    n = seen.groupBy("class").agg(hit(True, True).alias("tp"), hit(False, True).alias("fp"), hit(True, False).alias("fn"))
    out = [F.col(c) for c in ("class", "tp", "fp", "fn")]
    for name, total in (("precision", F.col("tp") + F.col("fp")), ("recall", F.col("tp") + F.col("fn"))):
        low, high = wilson(F.col("tp"), total)
        out += [F.round(F.when(total > 0, F.col("tp") / total), 10).alias(name), F.round(low, 10).alias(f"{name}_lo"), F.round(high, 10).alias(f"{name}_hi")]
    return n.select(*out)


def attribution(rows: DataFrame) -> DataFrame:
    """Disagreements, those checked against the page's markup (known either way) and those that are the extractor's."""
    wrong = comparable(rows).where("label != verdict")
    return wrong.agg(F.count(F.lit(1)).alias("disagreements"), F.count_if(F.col("extraction_missed").isNotNull()).alias("checked"), F.count_if(F.coalesce(F.col("extraction_missed"), F.lit(False))).alias("attributable"))


def without_attributable(rows: DataFrame) -> DataFrame:
    """The rows without the disagreements that are the extractor's: what the judge itself is measured on."""
    fault = F.col("label").isin(*codes.VERDICTS) & (F.col("label") != F.col("verdict")) & F.col("extraction_missed")
    return rows.where(~F.coalesce(fault, F.lit(False)))


def in_time(labels: DataFrame, started_at: str) -> DataFrame:
    """The labels, or an error at the first blind one written after the judge's run began: it isn't blind."""
    late = F.col("blind") & (F.coalesce("labelled_at", F.lit("")) > started_at)
    why = F.concat(F.lit("blind label written after the judge's run: "), F.col("claim_id").cast("string"))
    return labels.withColumn("blind", F.when(late, F.raise_error(why).cast("boolean")).otherwise(F.col("blind")))


def coverage(spark: SparkSession, labels: DataFrame) -> DataFrame:
    """Labels per class, classes without any included."""
    every = classified(spark.createDataFrame([(x,) for x in codes.LABELS], "label string"), "script-output")
    return every.join(labels.groupBy("label").agg(F.count(F.lit(1)).alias("_n")), "label", "left").select("label", F.coalesce("_n", F.lit(0)).cast("long").alias("labels"))


def extraction_missed(passage, strict, permissive):
    """False if the strict text has the passage, true if only the permissive has, else unknown (null)."""
    has = lambda text: F.contains(text, passage)
    return F.when((passage == "") | strict.isNull(), F.lit(None).cast("boolean")).when(has(strict), False).when(has(permissive), True)
