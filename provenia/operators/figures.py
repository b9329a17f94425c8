"""What a run publishes, as one relation, and what each figure was worked out from.

A figure is a row (section, key, figure, hits, n, value, lo, hi, withheld, unit, producer): of the stratum, of each
product, publisher and answer, and of the judge against people. A figure that is withheld is a row without a value that
says why. Figures of the stratum and of products are sums over those of their answers, so the pairs are aggregated once
for them and once for publishers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenia import codes
from provenia.functions.stats import rate_columns, render_rate
from provenia.functions.text import registrable_domain
from provenia.operators import pairs as P

#: In the order of a readout.
SECTIONS = ("stratum", "product", "domain", "answer", "agreement")
#: Unit of each figure, and the function that it comes from.
PRODUCED = {
    "fabricated_span": ("pair", "pairs.fabricated_rate"),
    "drift": ("page", "pairs.drift_rate"),
    "unauditable": ("pair", "pairs.unauditable_rate"),
    "support": ("pair", "pairs.support_rate"),
    "claim_level": ("claim", "pairs.claim_level_rate"),
    "kappa": ("blind label", "agreement.agreement"),
}
NOTHING = "no publishable answer"
COLUMNS = ("section", "key", "figure", "hits", "n", "value", "lo", "hi", "withheld")


def _by_figure(k: int) -> Column:
    return F.coalesce(*[F.when(F.col("figure") == name, F.lit(x[k])) for name, x in PRODUCED.items()])


def _counted(section: Column) -> Column:
    """Whether an answer counts in a section: none from an interface; in the stratum none of a product whose vendor makes the judge."""
    return (F.col("origin") != "api") & ((section != "stratum") | ~F.coalesce(F.col("product").isin(*codes.CONFLICTED_PRODUCTS), F.lit(False)))


def _grains(rows: DataFrame, stratum: str) -> DataFrame:
    """Each row once for the stratum and once for its product."""
    sides = F.explode(F.array(F.struct(F.lit("stratum").alias("section"), F.lit(stratum).alias("key")), F.struct(F.lit("product").alias("section"), F.col("product").alias("key"))))
    return rows.withColumn("_side", sides).withColumns({"section": F.col("_side.section"), "key": F.col("_side.key")}).drop("_side")


def _domain(url: str = "url") -> Column:
    return F.coalesce(F.nullif(registrable_domain(F.col(url)), F.lit("")), F.lit("(no domain)"))


def figures(pairs: DataFrame, stratum: str, calibration: str = "", agreement: DataFrame | None = None) -> DataFrame:
    """Every figure of a run, published or withheld.

    pairs: as ``pairs.published_rates`` takes them. calibration: '' when the judge's gate passed, else the gate's words.
    agreement: the row of ``agreement.agreement``; without one that figure is withheld. One answer that may not publish
    its support rate withholds the rate of its product and of the stratum; a section none of whose answers counts says
    so. No pairs: no figures but the agreement's.
    """
    answers = P.published_rates(pairs, not calibration, calibration)
    each = answers.select(F.lit("answer").alias("section"), F.col("answer").cast("string").alias("key"), F.col("rate").alias("figure"), *COLUMNS[3:])
    counts = _counted(F.col("section"))
    total = lambda c: F.coalesce(F.sum(F.when(counts, F.col(c))), F.lit(0)).cast("long")
    sums = _grains(answers.where("rate = 'support'"), stratum).groupBy("section", "key").agg(total("hits").alias("_h"), total("n").alias("_n"), F.coalesce(F.max(F.when(counts, F.col("withheld"))), F.lit(NOTHING)).alias("withheld"))
    rolled = sums.select("section", "key", F.lit("support").alias("figure"), *rate_columns(F.col("_h"), F.col("_n")), "withheld")
    by_domain = P.domain_report(pairs.where("origin != 'api'"), calibration=calibration)
    domains = by_domain.select(F.lit("domain").alias("section"), F.col("domain").alias("key"), F.lit("support").alias("figure"), "hits", F.col("standing").alias("n"), "value", "lo", "hi", F.col("refused").alias("withheld"))
    if agreement is None:
        agreement = pairs.sparkSession.range(1).selectExpr("0L AS agree", "0L AS n", "CAST(NULL AS DOUBLE) AS kappa", "CAST(NULL AS DOUBLE) AS lo", "CAST(NULL AS DOUBLE) AS hi")
    why = F.when(F.col("n") == 0, "no gold set for this judge").when(F.col("kappa").isNull(), "not computable").otherwise("")
    judged = agreement.select(F.lit("agreement").alias("section"), F.lit("").alias("key"), F.lit("kappa").alias("figure"), F.col("agree").alias("hits"), "n", F.col("kappa").alias("value"), "lo", "hi", why.alias("withheld"))
    rows = rolled.select(*COLUMNS).unionByName(domains).unionByName(each).unionByName(judged)
    shown = {c: F.when(F.col("withheld") == "", F.col(c)) for c in ("value", "lo", "hi")}
    return rows.withColumns(shown).withColumns({"unit": _by_figure(0), "producer": _by_figure(1)})


def records(pairs: DataFrame, stratum: str) -> DataFrame:
    """(section, key, answer, sources): which answers each section's figures were worked out from, and over how many pairs."""
    n = F.count(F.lit(1)).alias("sources")
    answers = pairs.groupBy("answer", "product", "origin").agg(n)
    rolled = _grains(answers, stratum).where(_counted(F.col("section"))).select("section", "key", "answer", "sources")
    own = answers.select(F.lit("answer").alias("section"), F.col("answer").cast("string").alias("key"), "answer", "sources")
    domains = pairs.where("origin != 'api'").groupBy(F.lit("domain").alias("section"), _domain().alias("key"), "answer").agg(n)
    return rolled.unionByName(own).unionByName(domains)


def trace(figures: DataFrame, records: DataFrame) -> DataFrame:
    """Published figures with the function that each comes from, and the number of answers and pairs it is over.

    The agreement is over labels, not answers: it has neither.
    """
    over = records.groupBy("section", "key").agg(F.count(F.lit(1)).alias("answers"), F.sum("sources").alias("sources"))
    rows = figures.where("withheld = ''").join(over, ["section", "key"], "left")
    return rows.select("section", "key", "figure", "value", "lo", "hi", "n", "unit", "producer", "answers", "sources")


def lines(figures: DataFrame, caveats: dict[str, str] | None = None) -> DataFrame:
    """(section, key, figure, line) in the order of a readout: the sentence of each figure, or why it is withheld.

    caveats: by stratum, what its rate has to be read as; a stratum that isn't named may not be described at all.
    """
    said = F.coalesce(*[F.when(F.col("unit") == unit, render_rate(F.col("hits"), F.col("n"), unit, F.lit(1))) for unit in ("pair", "claim", "page")])
    kappa = F.format_string("kappa %.3f, n=%d", "value", "n")
    between = F.when(F.col("lo").isNotNull(), F.format_string("kappa %.3f (%.3f to %.3f), n=%d", "value", "lo", "hi", "n")).otherwise(kappa)
    line = F.when(F.col("withheld") != "", F.concat(F.lit("withheld: "), F.col("withheld"))).when(F.col("figure") == "kappa", between).otherwise(said)
    read_as = F.coalesce(*[F.when(F.col("key") == k, F.lit(v)) for k, v in (caveats or {}).items()], F.lit("an unnamed stratum: no rate over anything may be described"))
    conflict = F.col("key").isin(*codes.CONFLICTED_PRODUCTS)
    line = F.when(F.col("section") == "stratum", F.concat(line, F.lit("; reads as: "), read_as)).when((F.col("section") == "product") & conflict, F.concat(line, F.lit("; its vendor makes the judge: reported here only"))).otherwise(line)
    order = F.array_position(F.array(*[F.lit(s) for s in SECTIONS]), F.col("section"))
    return figures.select("section", "key", "figure", line.alias("line"), order.alias("_n")).orderBy("_n", "key", "figure").drop("_n")
