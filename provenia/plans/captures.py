"""Queries of the operators around whole captures."""

from __future__ import annotations

from pyspark.sql import functions as F

from provenia import codes
from provenia.functions import text as X
from provenia.operators import captures as C
from provenia.operators import pairs as P
from provenia.plans.catalogue import query
from provenia.plans.standins import ANSWERS_SQL, PAIRS_SQL, answers, pairs, table


@query(f"WITH {ANSWERS_SQL}, n AS (SELECT query_id AS capture, conv_id, answer_text, CASE WHEN conv_id % 9 = 0 THEN 70 ELSE conv_id % 4 END AS k FROM a) SELECT capture, k <= 60 AND NOT conv_id % 11 = 5 AS passed, CASE WHEN k > 60 THEN 'too many citations' WHEN conv_id % 11 = 5 THEN 'hash differs' ELSE '' END AS why FROM n")
def capture_limits(spark, d):
    rows = answers(spark, d)
    n = F.when(F.col("conv_id") % 9 == 0, 70).otherwise(F.col("conv_id") % 4).cast("int")
    cites = rows.select(F.col("query_id").alias("capture"), F.explode(F.array_repeat(F.lit("u"), n)).alias("url"))
    hashed = F.when(F.col("conv_id") % 11 == 5, "0").otherwise(F.sha2("answer_text", 256))
    return C.within_limits(rows.select(F.col("query_id").alias("capture"), "answer_text", hashed.alias("answer_sha256")), cites)


@query("""WITH c AS (SELECT conv_id AS capture, turn AS pos, 'https://p/' || (conv_id * 7 + turn) % 60 AS url FROM conversations), k AS (SELECT capture, url, min(pos) AS pos FROM c GROUP BY ALL),
x AS (SELECT *, CAST(split_part(url, '/', 4) AS INT) AS i FROM k)
SELECT capture, pos, url, CASE WHEN i % 5 = 0 THEN '' WHEN i % 7 = 0 THEN 'SOURCE_EMPTY' WHEN i % 3 = 1 THEN 'SOURCE_DRIFTED' ELSE 'SOURCE_OK' END AS source_code,
 CASE WHEN i % 5 = 0 OR i % 7 = 0 THEN 'NOT_CHECKED' WHEN i % 3 = 0 THEN 'NO_SNAPSHOT' WHEN i % 3 = 1 THEN 'PAGE_REPLACED' ELSE 'NONE' END AS drift FROM x""")
def cited_sources(spark, d):
    cites = table(spark, d, "conversations").select(F.col("conv_id").alias("capture"), F.col("turn").alias("pos"), F.concat(F.lit("https://p/"), ((F.col("conv_id") * 7 + F.col("turn")) % 60).cast("string"), F.lit("?utm_source=x")).alias("url"))
    pages = spark.range(60).where("id % 5 != 0").select("id", F.concat(F.lit("https://p/"), F.col("id").cast("string")).alias("url"))
    fetched = pages.select("url", F.lit(1).alias("seq"), F.when(F.col("id") % 7 == 0, "SOURCE_EMPTY").otherwise(codes.SOURCE_OK).alias("source_code"), F.lit("one two three four five six seven").alias("text"))
    archived = pages.where("id % 3 != 0").select("url", F.when(F.col("id") % 3 == 1, "quite another page stood here before").otherwise("one two three four five six seven").alias("archived"))
    return C.cited_sources(cites, fetched, archived)


@query("SELECT c_custkey AS claim_id, u.url, CASE WHEN u.url % 3 = 0 THEN 'UNKNOWN' WHEN u.url % 2 = 0 THEN 'SOURCE_OK' ELSE 'SOURCE_EMPTY' END AS source_code FROM customer, LATERAL (SELECT unnest([c_custkey % 10, c_custkey % 10 + 1]) AS url) u")
def label_pool(spark, d):
    k = F.col("c_custkey")
    claims = table(spark, d, "customer").select(k.alias("claim_id"), F.array(k % 10, k % 10 + 1).alias("urls"))
    fetched = spark.range(12).where("id % 3 != 0").select(F.col("id").alias("url"), F.lit(1).alias("seq"), F.when(F.col("id") % 2 == 0, "SOURCE_OK").otherwise("SOURCE_EMPTY").alias("source_code"))
    return C.label_pool(claims, fetched).select("claim_id", "url", "source_code")


@query(f"WITH {PAIRS_SQL} SELECT DISTINCT answer FROM p WHERE answer % 6 <> 5 AND answer % 7 <> 3 AND answer % 8 <> 2 AND product <> 'gemini'")
def eligible_runs(spark, d):
    a = F.col("answer")
    runs = pairs(spark, d).select("answer", "product", "origin").distinct()
    runs = runs.select("*", F.when(a % 6 == 5, "failed").alias("error"), F.when(a % 7 == 3, "QUERY_UNKNOWN").otherwise("").alias("binding"), (a % 8 != 2).alias("rated"))
    return C.eligible(runs).select("answer")


@query(f"WITH {PAIRS_SQL} SELECT product, count(*) FILTER (source_code = 'SOURCE_OK') AS auditable, count(*) AS sources FROM p GROUP BY product")
def auditable_denominator(spark, d):
    return C.auditable_denominator(pairs(spark, d).withColumn("auditable", P.auditable()), "product")


@query("SELECT o_orderkey AS capture, CASE WHEN o_orderkey % 4 = 0 OR o_orderkey % 4 = 1 AND o_custkey = o_custkey % 50 THEN o_custkey % 50 WHEN o_orderkey % 4 = 1 THEN o_custkey ELSE o_custkey % 50 END AS query_id, o_orderkey % 4 = 1 AND o_custkey <> o_custkey % 50 AS refused FROM orders")
def rebind_captures(spark, d):
    o = table(spark, d, "orders")
    held = F.when(F.col("o_orderkey") % 4 == 1, F.col("o_custkey").cast("string")).otherwise("")
    captures = o.select(F.col("o_orderkey").alias("capture"), held.alias("query_id"), F.array().cast("array<string>").alias("history"))
    wanted = o.select(F.col("o_orderkey").alias("capture"), (F.col("o_custkey") % 50).cast("string").alias("query_id"))
    return C.rebind(captures, wanted).select("capture", F.col("query_id").cast("long").alias("query_id"), "refused")


@query("WITH a AS (SELECT conv_id AS capture, count(*) AS named FROM conversations WHERE turn % 2 = 0 GROUP BY 1), b AS (SELECT conv_id AS capture, count(*) AS linked FROM conversations WHERE turn > 2 GROUP BY 1) SELECT capture, coalesce(named, 0) AS named, coalesce(linked, 0) AS linked, coalesce(named, 0) > coalesce(linked, 0) AS floor FROM a FULL JOIN b USING (capture)")
def named_report(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("capture"), "turn")
    return C.named_report(c.where("turn % 2 = 0"), c.where("turn > 2"))


@query("SELECT conv_id * 1000 + turn AS answer, 1::BIGINT AS shared, 1::BIGINT AS api_only, 1::BIGINT AS dom_only, CASE WHEN (conv_id * 1000 + turn) % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0 END AS contained, CASE WHEN (conv_id * 1000 + turn) % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0 END AS jaccard, CASE WHEN (conv_id * 1000 + turn) % 2 = 0 THEN '' ELSE 'two different answers' END AS caveat FROM conversations")
def answer_fidelity(spark, d):
    t = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("answer"), "text")
    dom = t.select("answer", F.array(F.lit("a"), F.lit("b")).alias("urls"), "text")
    api = t.select("answer", F.array(F.lit("b"), F.lit("c")).alias("urls"), F.when(F.col("answer") % 2 == 0, F.col("text")).otherwise("nothing of the kind was said here at all").alias("text"))
    return C.fidelity(dom, api)


@query("SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN 'SOURCE_EMPTY' WHEN 1 THEN 'VOID' WHEN 2 THEN 'SUPPORTED' ELSE 'CONTRADICTED' END AS observed, event_id % 4 = 2 AS holds FROM events")
def adversarial_assessment(spark, d):
    i = F.col("event_id")
    rows = table(spark, d, "events").select(i.alias("id"), F.lit("SUPPORTED").alias("holds_if"), F.when(i % 4 == 0, "SOURCE_EMPTY").otherwise(codes.SOURCE_OK).alias("source_code"), F.when(i % 4 == 3, "CONTRADICTED").otherwise("SUPPORTED").alias("verdict"), (i % 4 == 1).alias("voided"))
    return C.assess(rows)


@query("""SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'okafor' WHEN 1 THEN 'annals' WHEN 2 THEN '' ELSE lower(c_mktsegment[1]) || 'arlow' END AS surname,
 CAST(CASE c_custkey % 4 WHEN 0 THEN 1950 + c_custkey % 70 WHEN 1 THEN 2000 + c_custkey % 25 END AS INT) AS year, CASE WHEN c_custkey % 4 = 3 THEN '10.5555/c' || c_custkey END AS doi FROM customer""")
def work_predicates(spark, d):
    """Customers as works named in prose: by first author, by journal, by nothing, by DOI."""
    k, t = F.col("c_custkey"), F.col("t")
    forms = [
        F.concat(F.lit("as Okafor et al. wrote, in "), (k % 70 + 1950).cast("string")),
        F.concat(F.lit("the Annals of it, "), (k % 25 + 2000).cast("string"), F.lit(" and 2031")),
        F.concat(F.lit("no one in "), (k % 1000 + 3000).cast("string")),
        F.concat(F.lit("doi 10.5555/c"), k.cast("string"), F.lit("; "), F.substring("c_mktsegment", 1, 1), F.lit("arlow")),
    ]
    rows = table(spark, d, "customer").select(k.alias("id"), F.element_at(F.array(*forms), (k % 4 + 1).cast("int")).alias("t"))
    return rows.select("id", X.surname_of(t).alias("surname"), X.year_of(t).alias("year"), X.doi_of(t).alias("doi"))


@query("SELECT page_id AS reply, 'api' AS source, 'Said of page ' || page_id AS answer_text, '$.output[0].text' AS answer_path, CAST(CASE WHEN page_id % 3 = 0 THEN 2 ELSE 1 END AS INT) AS n FROM pages")
def captures_from_replies(spark, d):
    """Stored interface replies as captures; each cites a page, and every third another one."""
    from provenia.plans.documents import replies

    rows = C.captures_from_replies(replies(spark, d))
    return rows.select("reply", "source", "answer_text", "answer_path", F.size("citations").alias("n"))


SKIP_SQL = """
WITH a AS (SELECT conv_id, turn, text, turn % 3 = 1 AS skipped FROM conversations),
u AS (SELECT conv_id, turn, skipped, unnest(list_filter(string_split(regexp_replace(text, '([.!?])\\s+([A-Z("''“])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: trim(s) <> '')) AS s FROM (SELECT conv_id, turn, skipped, trim(unnest(string_split(text, chr(10)))) AS text FROM a)),
n AS (SELECT conv_id, turn, any_value(skipped) AS skipped, count(*) AS n FROM u GROUP BY ALL)
SELECT a.conv_id, count(*) FILTER (a.skipped) AS skipped_blocks, count(*) FILTER (NOT a.skipped) AS claim_blocks, CAST(coalesce(sum(coalesce(n, 0)) FILTER (a.skipped), 0) AS BIGINT) AS skipped_units,
 CAST(coalesce(sum(greatest(coalesce(n, 0), 1)) FILTER (NOT a.skipped), 0) AS BIGINT) AS claim_units, round(count(*) FILTER (a.skipped) / count(*), 10) AS block_rate,
 round(coalesce(sum(coalesce(n, 0)) FILTER (a.skipped), 0) / (coalesce(sum(coalesce(n, 0)) FILTER (a.skipped), 0) + coalesce(sum(greatest(coalesce(n, 0), 1)) FILTER (NOT a.skipped), 0)), 10) AS unit_rate
FROM a LEFT JOIN n USING (conv_id, turn) GROUP BY a.conv_id"""


@query(SKIP_SQL)
def skip_rates(spark, d):
    """Turns as blocks of a split, every third of them skipped: the skip rate in blocks and in units."""
    blocks = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("pos"), "text", (F.col("turn") % 3 == 1).alias("skipped"))
    return C.skip_report(blocks, "conv_id").select("conv_id", "skipped_blocks", "claim_blocks", "skipped_units", "claim_units", "block_rate", "unit_rate")


@query(f"""WITH {PAIRS_SQL}, c AS (SELECT 'https://' || source || '.example.org/' || doc_id AS url, doc_id, strftime(TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 300 AS INT)), '%Y-%m-%d') AS fetched_at, CASE WHEN doc_id % 9 = 4 THEN NULL WHEN doc_id % 9 = 5 THEN ' ' ELSE text END AS text FROM documents),
a AS (SELECT DISTINCT url, doc_id, CASE WHEN doc_id % 10 = 7 THEN '' ELSE source_code END AS code FROM p),
j AS (SELECT a.url, CASE WHEN code = '' AND c.doc_id % 3 = 1 THEN 'SOURCE_PAYWALLED' ELSE code END AS code, CASE WHEN a.doc_id % 3 = 0 OR a.doc_id % 3 = 2 AND a.doc_id % 2 = 0 THEN 'cache' WHEN a.doc_id % 3 = 1 THEN 'fetched' ELSE 'missing' END AS origin, fetched_at, text FROM a JOIN c USING (url)),
k AS (SELECT url, code, origin, CASE WHEN origin <> 'missing' THEN fetched_at END AS cached_at, CASE WHEN origin <> 'missing' THEN text END AS text FROM j)
SELECT url, code, origin, cached_at, CAST(coalesce(length(text), 0) AS BIGINT) AS chars, coalesce(trim(regexp_replace(text, '\\s+', ' ', 'g')) <> '' AND code IN ('', 'SOURCE_OK'), FALSE) AS check_available,
 CASE WHEN origin = 'missing' THEN 'nothing stored, so nothing can be checked' WHEN text IS NULL THEN 'stored, and the body could not be decoded' WHEN trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' THEN 'stored, and nothing was extracted from it' WHEN code NOT IN ('', 'SOURCE_OK') THEN 'stored, and the source was ' || code ELSE '' END AS detail FROM k""")
def labelling_pages(spark, d):
    """The pages of all pairs as a labelling session meets them: most in the cache, some fetched now, some missing."""
    i = F.col("doc_id")
    sample = pairs(spark, d).select("url", F.when(i % 10 == 7, "").otherwise(F.col("source_code")).alias("source_code"))
    text = F.when(i % 9 == 5, " ").when(i % 9 != 4, F.col("text"))
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (i % 300).cast("int")), "yyyy-MM-dd")
    stored = table(spark, d, "documents").select("doc_id", F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/"), i.cast("string")).alias("url"), day.alias("fetched_at"), text.alias("text"))
    cache = stored.where((i % 3 == 0) | (i % 3 == 2) & (i % 2 == 0))
    fetched = stored.where(i % 3 == 1).withColumn("source_code", F.lit("SOURCE_PAYWALLED"))
    return C.prepare_pages(sample, cache, fetched)
