"""Queries of the rate, gate and agreement operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from provenia.operators import agreement, figures, gates
from provenia.operators import pairs as P
from provenia.operators.progress import Stages
from provenia.operators.provenance import field_table
from provenia.plans.catalogue import query, wilson_sql
from provenia.plans.standins import LABELS_SQL, PAIRS_SQL, human_labels, pairs

W = wilson_sql("hits", "n")


def _sql(body: str, *more: str) -> str:
    return "WITH " + ", ".join([PAIRS_SQL, *more]) + body


@query(_sql(f"""
, g AS (SELECT source AS domain, count(*) AS pairs, count(*) FILTER (st) AS n, count(*) FILTER (NOT st) AS unauditable, count(*) FILTER (su) AS hits FROM s GROUP BY source),
w AS (SELECT *, {W}, CASE WHEN n < 2 THEN 'fewer than 2 standing pairs' ELSE '' END AS refused FROM g)
SELECT domain, pairs, n AS standing, unauditable, hits, CASE WHEN refused = '' THEN value END AS value, CASE WHEN refused = '' THEN lo END AS lo, CASE WHEN refused = '' THEN hi END AS hi, refused FROM w"""))
def support_rate_by_source(spark, d):
    return P.by_domain(pairs(spark, d), "source")


@query(_sql(f", g AS (SELECT product, bool_or(st) AS m, bool_or(su) AS y FROM s GROUP BY product, claim_id), q AS (SELECT product, count(*) FILTER (y) AS hits, count(*) FILTER (m) AS n FROM g GROUP BY product) SELECT product, hits, n, {W} FROM q"))
def claim_level_rate(spark, d):
    return P.claim_level_rate(pairs(spark, d), "product")


@query(_sql(f", g AS (SELECT product, count(*) FILTER (NOT st) AS hits, count(*) AS n FROM s GROUP BY product) SELECT product, hits, n, {W} FROM g"))
def unauditable_rate(spark, d):
    return P.unauditable_rate(pairs(spark, d), "product")


@query(_sql(f", g AS (SELECT product, count(*) FILTER (void_reason = 'JUDGE_FABRICATED_SPAN') AS hits, count(*) FILTER (verdict IN ('SUPPORTED', 'PARTIALLY_SUPPORTED', 'CONTRADICTED')) AS n FROM s GROUP BY product) SELECT product, hits, n, {W} FROM g"))
def fabricated_span_rate(spark, d):
    return P.fabricated_rate(pairs(spark, d), "product")


@query(_sql(f", g AS (SELECT product, count(*) FILTER (drift = 'PAGE_CHANGED') AS hits, count(*) FILTER (drift IN ('NONE', 'PAGE_CHANGED', 'PAGE_REPLACED')) AS n, count(*) FILTER (drift = 'PAGE_REPLACED') AS replaced, count(*) FILTER (drift IN ('NO_SNAPSHOT', 'NOT_CHECKED')) AS unknown FROM s GROUP BY product) SELECT product, hits, n, {W}, replaced, unknown FROM g"))
def drift_rate(spark, d):
    return P.drift_rate(pairs(spark, d), "product")


KEY_SQL = "CASE WHEN source_code <> 'SOURCE_OK' THEN source_code WHEN verdict = '' THEN 'NOT_JUDGED' WHEN voided THEN 'VOID:' || void_reason ELSE verdict END"


@query(_sql(f" SELECT product, {KEY_SQL} AS key, count(*) AS pairs FROM s GROUP BY ALL"))
def verdict_counts(spark, d):
    return P.verdict_counts(pairs(spark, d), "product")


@query(_sql(" SELECT CASE WHEN void_reason <> '' THEN void_reason ELSE verdict END AS key, count(*) AS judgements FROM s WHERE verdict <> '' GROUP BY ALL"))
def void_counts(spark, d):
    return P.void_counts(pairs(spark, d))


LOW_SQL = "lc AS (SELECT answer, product, origin, claim_id, bool_or(st) AS m FROM s GROUP BY ALL), low AS (SELECT answer, product, origin, count(*) AS claims, count(*) FILTER (m) AS measured, count(*) FILTER (m) * 2 <= count(*) AS insufficient FROM lc GROUP BY ALL)"


@query(_sql(f", {LOW_SQL} SELECT answer, claims, measured, insufficient FROM low"))
def insufficient_evidence_by_answer(spark, d):
    return P.insufficient(pairs(spark, d), "answer")


LONG_SQL = f"""
, {LOW_SQL}, cl AS (SELECT answer, claim_id, bool_or(st) AS m, bool_or(su) AS y FROM s GROUP BY ALL),
g AS (
  SELECT answer, 'fabricated_span' AS rate, count(*) FILTER (void_reason = 'JUDGE_FABRICATED_SPAN') AS hits, count(*) FILTER (verdict IN ('SUPPORTED', 'PARTIALLY_SUPPORTED', 'CONTRADICTED')) AS n FROM s GROUP BY answer
  UNION ALL SELECT answer, 'drift', count(*) FILTER (drift = 'PAGE_CHANGED'), count(*) FILTER (drift IN ('NONE', 'PAGE_CHANGED', 'PAGE_REPLACED')) FROM s GROUP BY answer
  UNION ALL SELECT answer, 'unauditable', count(*) FILTER (NOT st), count(*) FROM s GROUP BY answer
  UNION ALL SELECT answer, 'support', count(*) FILTER (su), count(*) FILTER (st) FROM s GROUP BY answer
  UNION ALL SELECT answer, 'claim_level', count(*) FILTER (y), count(*) FILTER (m) FROM cl GROUP BY answer),
w AS (SELECT g.*, product, origin, {W}, CASE WHEN origin = 'api' THEN 'UNPUBLISHABLE_SOURCE' WHEN rate IN ('support', 'claim_level') AND insufficient THEN 'INSUFFICIENT_EVIDENCE' ELSE '' END AS withheld FROM g JOIN low USING (answer))"""


@query(_sql(f"""{LONG_SQL}
SELECT answer, product, origin, rate, hits, n, CASE WHEN withheld = '' THEN value END AS value, CASE WHEN withheld = '' THEN lo END AS lo, CASE WHEN withheld = '' THEN hi END AS hi, withheld FROM w"""))
def published_rates_long(spark, d):
    return P.published_rates(pairs(spark, d), calibrated=True)


AGG_SQL = f"""
, {LOW_SQL}, f AS (SELECT {{key}}, count(*) AS splits, bool_or(origin = 'api') AS api, bool_or(product IN ('google', 'google_aio', 'gemini')) AS conflict, bool_or(insufficient) AS lowest FROM low_k GROUP BY ALL),
g AS (SELECT {{key}}, count(*) FILTER (su) AS hits, count(*) FILTER (st) AS n FROM s_k GROUP BY ALL),
w AS (SELECT g.*, splits, {W}, CASE WHEN api THEN 'UNPUBLISHABLE_SOURCE' WHEN conflict AND {{strict}} THEN 'CONFLICTED_PRODUCT' WHEN lowest THEN 'INSUFFICIENT_EVIDENCE' ELSE '' END AS withheld FROM g JOIN f USING ({{key}}))
SELECT {{key}}, splits, hits, n, CASE WHEN withheld = '' THEN value END AS value, CASE WHEN withheld = '' THEN lo END AS lo, CASE WHEN withheld = '' THEN hi END AS hi, withheld FROM w"""


@query(_sql(AGG_SQL.format(key="stratum", strict="TRUE").replace("low_k", "(SELECT *, answer % 3 AS stratum FROM low)").replace("s_k", "(SELECT *, answer % 3 AS stratum FROM s)")))
def stratum_aggregate(spark, d):
    return P.aggregate_rates(pairs(spark, d).withColumn("stratum", F.col("answer") % 3), "stratum")


@query(_sql(AGG_SQL.format(key="product", strict="FALSE").replace("low_k", "(SELECT * FROM low WHERE origin = 'dom')").replace("s_k", "(SELECT * FROM s WHERE origin = 'dom')")))
def per_product_rate(spark, d):
    """Answers that may be published, conflicted products among them, each for itself."""
    return P.aggregate_rates(pairs(spark, d).where("origin = 'dom'"), "product", allow_conflicted=True)


STATE_SQL = """
, j AS (SELECT claim_id, bool_or(claim_id % 10 <> 3) AS cited, bool_or(verdict <> '' AND NOT voided) AS any_, bool_or(verdict IN ('SUPPORTED', 'PARTIALLY_SUPPORTED') AND NOT voided) AS yes,
  bool_or(verdict NOT IN ('', 'SUPPORTED', 'PARTIALLY_SUPPORTED') AND NOT voided) AS no, bool_and(verdict = 'SUPPORTED') FILTER (verdict <> '' AND NOT voided) AS all_ FROM p GROUP BY claim_id),
t AS (SELECT claim_id, CASE WHEN NOT cited THEN 'NOT_CHECKED' WHEN NOT any_ THEN 'COULD_NOT_VERIFY' WHEN yes AND no THEN 'MIXED' WHEN all_ THEN 'SUPPORTED' WHEN yes THEN 'PARTIALLY_SUPPORTED' ELSE 'NOT_SUPPORTED' END AS state FROM j)"""


def _states(spark, d):
    rows = pairs(spark, d)
    claims = rows.select("claim_id", (F.col("claim_id") % 10 != 3).alias("cited")).distinct()
    return P.claim_states(claims, rows.select("claim_id", "verdict", "voided"))


@query(_sql(STATE_SQL + " SELECT claim_id, state FROM t"))
def claim_state_rollup(spark, d):
    return _states(spark, d)


@query(_sql(STATE_SQL + " SELECT state, count(*) AS claims FROM t GROUP BY state"))
def state_counts(spark, d):
    return _states(spark, d).groupBy("state").agg(F.count(F.lit(1)).alias("claims"))


@query(_sql(" SELECT product, source_code, grouping_id(product, source_code) AS grain, CAST(count(*) FILTER (su) AS BIGINT) AS hits, CAST(count(*) FILTER (st) AS BIGINT) AS n FROM s GROUP BY CUBE (product, source_code)"))
def rate_grains(spark, d):
    return P.rate_grains(pairs(spark, d))


def _compared(spark, d):
    rows = pairs(spark, d)
    return agreement.compare(human_labels(rows), rows)


KAPPA_SQL = """
, m AS (SELECT (SELECT count(*) FROM c) AS n, (SELECT count(*) FROM c WHERE label = verdict) AS agree,
  (SELECT sum(x * y) FROM (SELECT label AS k, count(*) AS x FROM c GROUP BY 1) JOIN (SELECT verdict AS k, count(*) AS y FROM c GROUP BY 1) USING (k)) AS chance),
e AS (SELECT n, agree, agree::DOUBLE / n AS po, chance::DOUBLE / (n::DOUBLE * n) AS pe FROM m),
k AS (SELECT *, (po - pe) / (1 - pe) AS kappa, sqrt(po * (1 - po) / (n::DOUBLE * (1 - pe) * (1 - pe))) AS se FROM e)
SELECT n, agree, round(kappa, 10) AS kappa, round(greatest(-1.0::DOUBLE, kappa - 1.959963984540054::DOUBLE * se), 10) AS lo, round(least(1.0::DOUBLE, kappa + 1.959963984540054::DOUBLE * se), 10) AS hi,
  (SELECT count(*) FROM r WHERE label = 'UNAUDITABLE') AS unauditable, (SELECT count(*) FROM r WHERE label = 'UNDECIDABLE') AS undecidable,
  (SELECT count(*) FROM r WHERE verdict IS NULL AND label NOT IN ('UNAUDITABLE', 'UNDECIDABLE')) AS unmatched FROM k"""


@query(_sql(KAPPA_SQL, LABELS_SQL))
def agreement_summary(spark, d):
    return agreement.agreement(_compared(spark, d))


@query(_sql(" SELECT label, verdict, count(*) AS n FROM c GROUP BY ALL", LABELS_SQL))
def confusion_matrix(spark, d):
    return agreement.confusion(_compared(spark, d))


@query(_sql(f"""
, u AS (SELECT DISTINCT unnest([label, verdict]) AS class FROM c),
g AS (SELECT class, (SELECT count(*) FROM c WHERE label = class AND verdict = class) AS tp, (SELECT count(*) FROM c WHERE label <> class AND verdict = class) AS fp, (SELECT count(*) FROM c WHERE label = class AND verdict <> class) AS fn FROM u),
a AS (SELECT class, tp AS hits, tp + fp AS n FROM g), b2 AS (SELECT class, tp AS hits, tp + fn AS n FROM g),
pa AS (SELECT class, {W} FROM a), pb AS (SELECT class, {W} FROM b2)
SELECT g.class, tp, fp, fn, pa.value AS precision, pa.lo AS precision_lo, pa.hi AS precision_hi, pb.value AS recall, pb.lo AS recall_lo, pb.hi AS recall_hi FROM g JOIN pa USING (class) JOIN pb USING (class)""", LABELS_SQL))
def class_metrics(spark, d):
    return agreement.class_metrics(_compared(spark, d))


@query(_sql(KAPPA_SQL, LABELS_SQL.replace("c AS (SELECT * FROM r WHERE", "c AS (SELECT * FROM r WHERE NOT coalesce(label <> verdict AND extraction_missed, FALSE) AND")))
def kappa_of_the_judge(spark, d):
    """Agreement without the disagreements that are the extractor's."""
    return agreement.agreement(agreement.without_attributable(_compared(spark, d)))


@query(_sql("""
, t AS (SELECT source || '.example.org' AS host, st, CASE WHEN st THEN verdict WHEN void_reason <> '' THEN void_reason WHEN source_code <> 'SOURCE_OK' THEN source_code ELSE 'not judged' END AS key FROM s),
g AS (SELECT st, key, count(*) AS n FROM t GROUP BY ALL)
SELECT 'example.org' AS domain, string_agg(key || '=' || n, ' ' ORDER BY key) FILTER (st) AS verdicts, string_agg(key || '=' || n, ' ' ORDER BY key) FILTER (NOT st) AS reasons FROM g"""))
def domain_verdicts(spark, d):
    """By the addresses' registrable domain, which all stand-in addresses share: verdicts and reasons."""
    told = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), " ")
    return P.domain_maps(pairs(spark, d)).select("domain", told("verdicts").alias("verdicts"), told("reasons").alias("reasons"))


@query(_sql(f"""
, t AS (SELECT CASE WHEN doc_id % 29 = 0 THEN '(no domain)' ELSE 'site' || doc_id % 23 || '.org' END AS domain, st, su, CASE WHEN st THEN verdict WHEN void_reason <> '' THEN void_reason WHEN source_code <> 'SOURCE_OK' THEN source_code ELSE 'not judged' END AS key FROM s WHERE doc_id % 23 <> 5 OR doc_id < 30),
g AS (SELECT domain, st, key, count(*) AS k, count(*) FILTER (su) AS y FROM t GROUP BY ALL),
e AS (SELECT domain, sum(k)::BIGINT AS pairs, coalesce(sum(k) FILTER (st), 0)::BIGINT AS n, coalesce(sum(k) FILTER (NOT st), 0)::BIGINT AS unauditable, coalesce(string_agg(key || '=' || k, ' ' ORDER BY key) FILTER (st), '') AS verdicts, coalesce(string_agg(key || '=' || k, ' ' ORDER BY key) FILTER (NOT st), '') AS reasons, sum(y)::BIGINT AS hits FROM g GROUP BY domain),
w AS (SELECT *, {W}, CASE WHEN n < 2 THEN 'fewer than 2 standing pairs' ELSE '' END AS refused FROM e)
SELECT domain, pairs, n AS standing, unauditable, verdicts, reasons, hits, CASE WHEN refused = '' THEN value END AS value, CASE WHEN refused = '' THEN lo END AS lo, CASE WHEN refused = '' THEN hi END AS hi, refused FROM w"""))
def domain_report(spark, d):
    """The whole report by registrable domain, rates beside both maps; one domain keeps few pairs, some pairs name none."""
    i = F.col("doc_id")
    url = F.when(i % 29 == 0, "").otherwise(F.concat(F.lit("https://www.site"), (i % 23).cast("string"), F.lit(".org/"), i.cast("string")))
    rows = pairs(spark, d).where((i % 23 != 5) | (i < 30)).withColumn("url", url)
    told = lambda m: F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), " ").alias(m)
    return P.domain_report(rows, calibration="").select("domain", "pairs", "standing", "unauditable", told("verdicts"), told("reasons"), "hits", "value", "lo", "hi", "refused")


@query(_sql("""
, e AS (SELECT answer, claim_id, count(*) AS k, count(*) FILTER (st) AS stands, count(*) FILTER (st AND verdict = 'PARTIALLY_SUPPORTED' AND doc_id % 2 = 0) AS bare FROM s GROUP BY ALL)
SELECT answer, count(*) AS claims, count(*) FILTER (claim_id % 9 = 4) AS unlocatable, sum(k)::BIGINT AS pairs, sum(stands)::BIGINT AS standing, sum(k - stands)::BIGINT AS unauditable, count(*) FILTER (k > 1) AS multi_source_claims, sum(bare)::BIGINT AS partial_without_qualifiers FROM e GROUP BY answer"""))
def report_rollup(spark, d):
    """What a report counts beside its states, by answer."""
    rows = pairs(spark, d).withColumn("qualifiers", F.when(F.col("doc_id") % 2 == 1, F.array(F.lit("adults only"))))
    claims = rows.select("answer", "claim_id", (F.col("claim_id") % 9 != 4).alias("located")).distinct()
    return P.report_counts(rows, claims, "answer")


@query(_sql(" SELECT count(*) AS disagreements, count(extraction_missed) AS checked, count(*) FILTER (extraction_missed) AS attributable FROM c WHERE label <> verdict", LABELS_SQL))
def attribution_tristate(spark, d):
    return agreement.attribution(_compared(spark, d))


@query(_sql(", z AS (SELECT unnest(['SUPPORTED', 'PARTIALLY_SUPPORTED', 'NOT_FOUND_IN_SOURCE', 'CONTRADICTED', 'UNAUDITABLE', 'UNDECIDABLE']) AS label) SELECT z.label, count(h.claim_id) AS labels FROM z LEFT JOIN h USING (label) GROUP BY ALL", LABELS_SQL))
def label_coverage(spark, d):
    return agreement.coverage(spark, human_labels(pairs(spark, d)))


@query(_sql(", g AS (SELECT answer AS capture, count(*) AS n, count(*) FILTER (doc_id % 23 = 0) AS blank FROM p WHERE answer % 9 <> 4 GROUP BY 1), k AS (SELECT DISTINCT answer AS capture FROM p) SELECT capture, coalesce(n, 0) > 0 AND coalesce(blank, 0) = 0 AS passed, CASE WHEN coalesce(n, 0) > 0 AND coalesce(blank, 0) = 0 THEN '' ELSE 'NO_CITATIONS' END AS code FROM k LEFT JOIN g USING (capture)"))
def g0_citations(spark, d):
    rows = pairs(spark, d)
    cited = rows.where("answer % 9 != 4").select(F.col("answer").alias("capture"), F.when(F.col("doc_id") % 23 == 0, " ").otherwise(F.col("url")).alias("url"))
    return gates.has_citations(rows.select(F.col("answer").alias("capture")).distinct(), cited)


@query(_sql("""
, k AS (SELECT DISTINCT answer AS run FROM p),
t AS (SELECT run, list_filter([CASE WHEN run % 3 = 1 THEN 'judge differs' END, CASE WHEN run % 4 = 1 THEN 'model differs' END, CASE WHEN run % 5 = 1 THEN 'judge_prompt differs' END,
  CASE WHEN run % 10 > 6 THEN 'split not labelled' END, 'fewer than 30 blind comparable labels'], lambda x: x IS NOT NULL) AS l FROM k)
SELECT run, FALSE AS passed, 'NO_CALIBRATION' AS code, array_to_string(l, '; ') AS detail FROM t"""))
def g4_reasons(spark, d):
    runs = pairs(spark, d).select(F.col("answer").alias("run")).distinct()
    odd = lambda k, a: F.when(F.col("run") % k == 1, f"other-{a}").otherwise(a)
    runs = runs.select("run", odd(3, "rule").alias("judge"), odd(4, "m1").alias("model"), odd(5, "j2").alias("judge_prompt"), F.lit("c1").alias("claim_prompt"), (F.col("run") % 10).alias("split"))
    gold = spark.sql("SELECT 'rule' AS judge, 'm1' AS model, 'j2' AS judge_prompt, 'c1' AS claim_prompt, array(0L, 1L, 2L, 3L, 4L, 5L, 6L) AS splits, 35 AS blind, 29 AS blind_comparable")
    return gates.calibration(runs, gold)


@query(_sql(", q AS (SELECT answer AS run, doc_id AS seq, n_chars AS tokens FROM p), x AS (SELECT *, CAST(coalesce(sum(tokens) OVER (PARTITION BY run ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS spent_before FROM q) SELECT run, seq, tokens, spent_before, spent_before >= 9000 AS halted FROM x"))
def budget_halt(spark, d):
    calls = pairs(spark, d).select(F.col("answer").alias("run"), F.col("doc_id").alias("seq"), F.col("n_chars").alias("tokens"))
    return P.running_budget(calls, 9000)


FIELDS = {
    "claim_id": "model-inference", "url": "record", "source": "record", "answer": "record", "product": "record", "origin": "record",
    "source_code": "script-output", "verdict": "model-inference", "voided": "script-output", "drift": "script-output", "lang": "external-source",
    "label": "your-input", "extraction_missed": "script-output", "agrees": "model-inference", "truth": "missing",
}
UNDER = {"agrees": "your-input model-inference", "truth": ""}
FIELDS_SQL = " UNION ALL ".join(f"SELECT '{c}' AS field, '{k}' AS class, '{UNDER.get(c, k)}' AS rests_on, {k in ('model-inference', 'your-input', 'missing')} AS marked, count({c}) AS present, count(*) - count({c}) AS absent FROM x" for c, k in FIELDS.items())


@query(_sql(f", j AS (SELECT p.*, h.label, h.extraction_missed, CASE WHEN p.verdict <> '' THEN h.label = p.verdict END AS agrees, CAST(NULL AS BOOLEAN) AS truth FROM p LEFT JOIN (SELECT * FROM h WHERE blind) h ON p.claim_id = h.claim_id AND p.url = h.url), x AS (SELECT * FROM j) {FIELDS_SQL}", LABELS_SQL))
def field_classes(spark, d):
    """Every field of the joined pairs and labels with its class, what it rests on, and in how many rows it is there."""
    rows = pairs(spark, d)
    labels = human_labels(rows).where("blind").drop("blind")
    joined = rows.join(labels, ["claim_id", "url"], "left").withColumn("agrees", F.when(F.col("verdict") != "", F.col("label") == F.col("verdict")))
    return field_table(joined.withColumn("truth", F.lit(None).cast("boolean")).select(*FIELDS))


FIGURES_SQL = f"""{LONG_SQL}{KAPPA_SQL[:KAPPA_SQL.index("SELECT n, agree, round")].rstrip()},
kp AS (SELECT agree, n, round(kappa, 10) AS kappa, round(greatest(-1.0::DOUBLE, kappa - 1.959963984540054::DOUBLE * se), 10) AS lo, round(least(1.0::DOUBLE, kappa + 1.959963984540054::DOUBLE * se), 10) AS hi FROM k),
own AS (SELECT *, origin = 'dom' AS counted, origin = 'dom' AND product NOT IN ('google', 'google_aio', 'gemini') AS apart FROM w WHERE rate = 'support'),
sums AS (
  SELECT 'product' AS section, product AS key, sum(hits) FILTER (counted) AS hits, sum(n) FILTER (counted) AS n, max(withheld) FILTER (counted) AS withheld FROM own GROUP BY product
  UNION ALL SELECT 'stratum', 'documents', sum(hits) FILTER (apart), sum(n) FILTER (apart), max(withheld) FILTER (apart) FROM own
  UNION ALL SELECT 'domain', source || '.org', count(*) FILTER (su), count(*) FILTER (st), CASE WHEN count(*) FILTER (st) < 2 THEN 'fewer than 2 standing pairs' ELSE '' END FROM s WHERE origin = 'dom' GROUP BY source),
whole AS (SELECT section, key, CAST(coalesce(hits, 0) AS BIGINT) AS hits, CAST(coalesce(n, 0) AS BIGINT) AS n, coalesce(withheld, 'no publishable answer') AS withheld FROM sums),
fig AS (
  SELECT section, key, 'support' AS figure, hits, n, {W}, withheld FROM whole
  UNION ALL SELECT 'answer', CAST(answer AS VARCHAR), rate, hits, n, value, lo, hi, withheld FROM w
  UNION ALL SELECT 'agreement', '', 'kappa', agree, n, kappa, lo, hi, '' FROM kp),
named AS (SELECT section, key, figure, hits, n, CASE WHEN withheld = '' THEN value END AS value, CASE WHEN withheld = '' THEN lo END AS lo, CASE WHEN withheld = '' THEN hi END AS hi, withheld,
  CASE figure WHEN 'claim_level' THEN 'claim' WHEN 'drift' THEN 'page' WHEN 'kappa' THEN 'blind label' ELSE 'pair' END AS unit,
  CASE figure WHEN 'kappa' THEN 'agreement.agreement' WHEN 'fabricated_span' THEN 'pairs.fabricated_rate' ELSE 'pairs.' || figure || '_rate' END AS producer FROM fig)"""


def _figures(spark, d):
    rows = pairs(spark, d)
    rows = rows.withColumn("url", F.concat(F.lit("https://www."), F.col("source"), F.lit(".org/"), F.col("doc_id").cast("string")))
    return rows, figures.figures(rows, "documents", agreement=agreement.agreement(_compared(spark, d)))


@query(_sql(f"{FIGURES_SQL} SELECT * FROM named", LABELS_SQL))
def run_figures(spark, d):
    """Every figure of a run: of the stratum, each product, publisher and answer, and of the judge against people."""
    return _figures(spark, d)[1]


@query(_sql(f"""{FIGURES_SQL},
rec AS (
  SELECT 'answer' AS section, CAST(answer AS VARCHAR) AS key, answer FROM s UNION ALL SELECT 'product', product, answer FROM s WHERE origin = 'dom'
  UNION ALL SELECT 'stratum', 'documents', answer FROM s WHERE origin = 'dom' AND product NOT IN ('google', 'google_aio', 'gemini') UNION ALL SELECT 'domain', source || '.org', answer FROM s WHERE origin = 'dom'),
ov AS (SELECT section, key, count(DISTINCT answer) AS answers, count(*) AS sources FROM rec GROUP BY ALL)
SELECT section, key, figure, value, lo, hi, n, unit, producer, answers, sources FROM named LEFT JOIN ov USING (section, key) WHERE withheld = ''""", LABELS_SQL))
def run_trace(spark, d):
    """Every published figure traced to the function it comes from, and to its answers and pairs."""
    rows, found = _figures(spark, d)
    return figures.trace(found, figures.records(rows, "documents"))


CAVEATS = {"documents": "synthetic bindings of test tables, which say nothing about any product"}


@query()
def run_readout(spark, d):
    """The readout of a run, line by line; a withheld figure says why."""
    return figures.lines(_figures(spark, d)[1], CAVEATS)


@query(_sql(""" SELECT 'pairs' AS stage, 'rows' AS metric, count(*) AS value FROM p UNION ALL SELECT 'pairs', 'unread', count(*) FILTER (source_code <> 'SOURCE_OK') FROM p
UNION ALL SELECT 'judged', 'rows', count(*) FROM p WHERE verdict <> '' UNION ALL SELECT 'judged', 'voided', count(*) FILTER (voided) FROM p WHERE verdict <> '' UNION ALL SELECT 'standing', 'rows', count(*) FROM s WHERE st"""))
def stage_counts(spark, d):
    """What passed each stage of a run, counted on the way: pairs, those judged, those that stand."""
    run = Stages()
    rows = run.watch(pairs(spark, d), "pairs", unread=F.col("source_code") != "SOURCE_OK")
    judged = run.watch(rows.where("verdict != ''"), "judged", voided=F.col("voided"))
    run.watch(judged.where(P.standing()), "standing").write.format("noop").mode("overwrite").save()
    return run.counts(spark).select("stage", "metric", "value")
