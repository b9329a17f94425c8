"""Queries of the operators on order, sets and joins: caches, ledgers, freezes, samples, drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from provenia import codes
from provenia.functions import text as X
from provenia.operators import captures, gates, joins, ordering
from provenia.operators import pairs as P
from provenia.operators.agreement import extraction_missed
from provenia.plans.catalogue import query, wilson_sql
from provenia.plans.standins import ANSWERS_SQL, PAIRS_SQL, answers, pairs, table


def _cache(spark, d):
    """events as a page cache: url per user, several bodies in a second told apart by seq."""
    return table(spark, d, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url"), F.date_trunc("hour", "ts").alias("fetched_at"), F.col("event_id").alias("seq"), F.round("value", 6).alias("body"))


@query("WITH c AS (SELECT 'u' || user_id AS url, date_trunc('hour', ts) AS fetched_at, event_id AS seq, round(value, 6) AS body FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY fetched_at DESC, seq DESC) AS k FROM c) SELECT url, seq, body FROM r WHERE k = 1")
def cache_latest(spark, d):
    return ordering.latest(_cache(spark, d), "url", "fetched_at", "seq").select("url", "seq", "body")


@query("SELECT 'u' || user_id AS url, count(*) AS entries FROM events GROUP BY ALL")
def cache_counts(spark, d):
    return ordering.entries(_cache(spark, d), "url")


LEDGER_SQL = """
cap AS (SELECT user_id AS capture, user_id % 40 AS answer, min(event_id) AS mtime FROM events GROUP BY ALL),
led AS (SELECT user_id AS capture, event_id AS seq, CASE WHEN event_type = 'purchase' THEN 'ok' ELSE 'failed' END AS status, CAST(event_id % 5 AS INT) AS attempts FROM events WHERE user_id % 3 <> 0),
lst AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY capture ORDER BY seq DESC) AS k FROM led) WHERE k = 1),
don AS (SELECT DISTINCT user_answer FROM (SELECT capture % 40 AS user_answer FROM lst WHERE status = 'ok')),
todo AS (SELECT cap.* FROM cap LEFT JOIN lst USING (capture) WHERE (status IS NULL OR status <> 'ok') AND coalesce(attempts, 0) < 3 AND answer NOT IN (SELECT user_answer FROM don))
SELECT capture, mtime FROM (SELECT *, row_number() OVER (PARTITION BY answer ORDER BY mtime, capture) AS k FROM todo) WHERE k = 1"""


@query("WITH " + LEDGER_SQL)
def ledger_pending(spark, d):
    e = table(spark, d, "events")
    key = (F.col("user_id") % 40).cast("string").alias("answer_sha256")
    files = e.groupBy(F.col("user_id").alias("capture"), key).agg(F.min("event_id").alias("mtime"))
    ledger = e.where("user_id % 3 != 0").select(F.col("user_id").alias("capture"), key, F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", "ok").otherwise("failed").alias("status"), (F.col("event_id") % 5).alias("attempts"))
    return ordering.pending(files, ledger).select("capture", "mtime")


@query("SELECT CASE WHEN event_id % 7 = 0 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN event_id % 7 = 0 THEN 'exception' WHEN event_id % 5 = 0 THEN 'not scored' WHEN event_id % 3 = 0 THEN 'no report' ELSE 'report' END AS outcome, count(*) AS firings FROM events GROUP BY ALL")
def watcher_outcomes(spark, d):
    i = F.col("event_id")
    status, outcome = ordering.watcher_outcome(F.when(i % 5 == 0, 1).otherwise(0), i % 3 != 0, i % 7 == 0)
    return table(spark, d, "events").groupBy(status.alias("status"), outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("firings"))


def _manifest(spark, d):
    return table(spark, d, "customer").select(F.col("c_mktsegment").alias("file"), F.col("c_custkey").alias("query_id"), F.sha2(F.concat_ws("\n", F.col("c_custkey").cast("string"), "c_name"), 256).alias("hash"))


def _disk(spark, d):
    edited = F.when(F.col("c_custkey") % 50 == 7, F.concat("c_name", F.lit(" edited"))).otherwise(F.col("c_name"))
    c = table(spark, d, "customer").where("c_custkey % 40 != 3").withColumn("c_name", edited)
    new = table(spark, d, "nation").select(F.lit("NEW").alias("c_mktsegment"), (F.col("n_nationkey") + 10_000_000).cast("long").alias("c_custkey"), F.col("n_name").alias("c_name"))
    return c.select("c_mktsegment", F.col("c_custkey").cast("long").alias("c_custkey"), "c_name").unionByName(new).select(F.col("c_mktsegment").alias("file"), F.col("c_custkey").alias("query_id"), F.sha2(F.concat_ws("\n", F.col("c_custkey").cast("string"), "c_name"), 256).alias("hash"))


@query("SELECT c_mktsegment AS file, c_custkey AS query_id, CASE WHEN c_custkey % 40 = 3 THEN 'removed' ELSE 'modified' END AS change FROM customer WHERE c_custkey % 40 = 3 OR c_custkey % 50 = 7 UNION ALL SELECT 'NEW', n_nationkey + 10000000, 'added' FROM nation")
def freeze_diff(spark, d):
    return gates.freeze_diff(_manifest(spark, d), _disk(spark, d), ["file", "query_id"])


@query("""SELECT c_mktsegment AS file, c_custkey AS query_id, CASE WHEN c_custkey % 40 = 3 THEN 'removed' ELSE 'modified' END AS problem FROM customer
WHERE c_mktsegment NOT IN ('MACHINERY', 'HOUSEHOLD') AND (c_custkey % 40 = 3 OR c_custkey % 50 = 7)
UNION ALL SELECT 'BUILDING', n_nationkey + 10000000, 'added' FROM nation UNION ALL SELECT DISTINCT c_mktsegment, NULL::BIGINT, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'file missing' ELSE 'ready but never frozen' END FROM customer WHERE c_mktsegment IN ('MACHINERY', 'HOUSEHOLD')""")
def freeze_problems(spark, d):
    """Customers as query sets by segment: one file was never frozen, one is gone, new queries stand in a frozen one and in a draft."""
    disk = _disk(spark, d).where("file != 'HOUSEHOLD'")
    new = disk.where("file = 'NEW'").drop("file").withColumn("file", F.explode(F.array(F.lit("BUILDING"), F.lit("DRAFT"))))
    disk = disk.where("file != 'NEW'").unionByName(new).withColumn("status", F.when(F.col("file") == "DRAFT", "draft").otherwise("ready"))
    return gates.freeze_problems(_manifest(spark, d).where("file != 'MACHINERY'"), disk)


@query("SELECT c_mktsegment AS file, c_custkey AS query_id FROM customer WHERE c_custkey % 40 <> 3 AND c_custkey % 60 <> 11")
def frozen_ids(spark, d):
    """Queries frozen and on disk, each in its own file; some stand in another file now."""
    disk = _disk(spark, d).withColumn("file", F.when(F.col("query_id") % 60 == 11, "MOVED").otherwise(F.col("file")))
    return gates.frozen(_manifest(spark, d), disk)


@query("SELECT o_orderkey AS capture, CASE WHEN o_orderkey % 9 = 0 THEN NULL WHEN o_orderkey % 9 = 1 THEN -o_orderkey WHEN o_orderkey % 9 = 2 THEN 10000000 + o_orderkey % 25 ELSE o_custkey END AS query_id, CASE WHEN o_orderkey % 9 = 0 THEN 'CAPTURE_UNBOUND' WHEN o_orderkey % 9 = 1 THEN 'QUERY_UNKNOWN' WHEN o_orderkey % 9 = 2 THEN 'QUERY_NOT_FROZEN' WHEN o_custkey IN (SELECT c_custkey FROM customer) THEN '' ELSE 'QUERY_UNKNOWN' END AS binding FROM orders")
def query_binding(spark, d):
    k = F.col("o_orderkey")
    q = F.when(k % 9 == 0, F.lit(None)).when(k % 9 == 1, -k).when(k % 9 == 2, F.lit(10_000_000) + k % 25).otherwise(F.col("o_custkey")).cast("long")
    rows = table(spark, d, "orders").select(k.alias("capture"), q.alias("query_id"))
    return gates.bind(rows, _manifest(spark, d), _disk(spark, d))


RULES_SQL = """
WITH p AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'a.toml' ELSE 'b.toml' END AS file, p_partkey AS place, CASE WHEN p_partkey % 23 = 5 THEN 'P-1' ELSE 'P-' || p_partkey END AS id,
  CASE WHEN p_partkey % 7 = 0 THEN 'other' ELSE p_brand END AS domain, p_brand, p_partkey AS k, trim(regexp_replace(p_name || ' ' || p_type, '\\s+', ' ', 'g')) AS text, trim(regexp_replace(p_name || ' ' || p_type || ' ' || p_name, '\\s+', ' ', 'g')) AS cost FROM part),
q AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY file, place) AS nth FROM p)
SELECT file, id, unnest(list_filter([
  CASE WHEN k % 29 = 0 THEN 'forbidden key' END, CASE WHEN k % 31 = 0 THEN 'required key missing' END,
  CASE WHEN k % 31 <> 0 AND k % 29 = 0 THEN 'unknown key' END, CASE WHEN k % 31 <> 0 AND nth > 1 THEN 'duplicate id' END,
  CASE WHEN k % 31 <> 0 AND k % 7 = 0 THEN 'domain not declared' END, CASE WHEN k % 31 <> 0 AND length(text) < 25 THEN 'text too short' END,
  CASE WHEN k % 31 <> 0 AND length(cost) < 60 THEN 'cost of error too short' END, CASE WHEN k % 31 <> 0 AND k % 11 = 0 THEN 'provenance against policy' END,
  CASE WHEN k % 31 <> 0 AND k % 11 = 0 AND k % 2 = 0 THEN 'no scrub notes' END, CASE WHEN k % 31 <> 0 AND k % 11 = 0 THEN 'no approximate wording' END,
  CASE WHEN k % 31 <> 0 AND k % 11 <> 0 AND k % 13 = 0 THEN 'synthetic with scrub notes' END], lambda x: x IS NOT NULL)) AS rule FROM q"""


@query(RULES_SQL)
def query_set_rules(spark, d):
    """Parts as a query set: keys, ids, domains, lengths and provenance against the rules of query sets."""
    k = F.col("p_partkey")
    full = F.array(*[F.lit(x) for x in gates.REQUIRED])
    keys = F.when(k % 31 == 0, F.slice(full, 2, 4)).otherwise(full)
    real = k % 11 == 0
    rows = table(spark, d, "part").select(
        F.when(k % 3 == 0, "a.toml").otherwise("b.toml").alias("file"), k.alias("place"), F.lit("ready").alias("status"), F.lit("synthetic").alias("provenance_policy"), F.lit("P").alias("id_prefix"),
        F.array("p_brand").alias("domains"), F.when(k % 29 == 0, F.array_append(keys, F.lit("Gold_label"))).otherwise(keys).alias("keys"), F.when(k % 23 == 5, "P-1").otherwise(F.concat(F.lit("P-"), k.cast("string"))).alias("id"),
        F.when(k % 7 == 0, "other").otherwise(F.col("p_brand")).alias("domain"), F.concat_ws(" ", "p_name", "p_type").alias("text"), F.concat_ws("  ", "p_name", "p_type", "p_name").alias("cost_of_error"),
        F.when(real, "real_scrubbed").otherwise("synthetic").alias("provenance"), F.when(real & (k % 2 != 0) | ~real & (k % 13 == 0), "names left out").alias("scrub_notes"), F.lit(None).cast("string").alias("asked_approx"),
    )
    return gates.query_violations(rows)


@query("WITH r AS (SELECT p_partkey, unnest(list_filter([CASE WHEN length(p_name) < 12 THEN 'name too short' END, CASE WHEN p_size > 45 THEN 'size out of range' END, CASE WHEN contains(lower(p_type), 'brass') THEN 'forbidden word' END, CASE WHEN count(*) OVER (PARTITION BY p_name) > 1 THEN 'duplicate name' END], lambda x: x IS NOT NULL)) AS rule FROM part) SELECT * FROM r")
def query_rule_violations(spark, d):
    from pyspark.sql import Window

    p = table(spark, d, "part").withColumn("same", F.count(F.lit(1)).over(Window.partitionBy("p_name")))
    rules = {"name too short": F.length("p_name") < 12, "size out of range": F.col("p_size") > 45, "forbidden word": F.contains(F.lower("p_type"), F.lit("brass")), "duplicate name": F.col("same") > 1}
    return gates.violations(p, "p_partkey", rules)


FIDELITY_SQL = "WITH x AS (SELECT DISTINCT url FROM pages WHERE page_id % 3 <> 0), y AS (SELECT DISTINCT url FROM pages WHERE page_id % 4 <> 1)"


@query(FIDELITY_SQL + " SELECT 'both' AS side, count(*) AS urls FROM (SELECT * FROM x INTERSECT SELECT * FROM y) UNION ALL SELECT 'api only', count(*) FROM (SELECT * FROM x EXCEPT SELECT * FROM y) UNION ALL SELECT 'dom only', count(*) FROM (SELECT * FROM y EXCEPT SELECT * FROM x)")
def capture_fidelity(spark, d):
    """Addresses of two captures of one answer: in both, and in either alone, in one full join."""
    pages = table(spark, d, "pages").select("page_id", "url")
    x = pages.where("page_id % 3 != 0").select("url", F.lit(1).alias("x")).distinct()
    y = pages.where("page_id % 4 != 1").select("url", F.lit(1).alias("y")).distinct()
    side = F.when(F.col("x").isNull(), "dom only").when(F.col("y").isNull(), "api only").otherwise("both")
    return x.join(y, "url", "full").groupBy(side.alias("side")).agg(F.count(F.lit(1)).alias("urls"))


@query(FIDELITY_SQL + " SELECT url, 'live' AS only_in FROM (SELECT * FROM x EXCEPT SELECT * FROM y) UNION ALL SELECT url, 'stored' FROM (SELECT * FROM y EXCEPT SELECT * FROM x)")
def parity_diff(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    return captures.parity(pages.where("page_id % 3 != 0"), pages.where("page_id % 4 != 1"), "url")


@query("WITH l AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id % 10 ORDER BY conv_id, turn) AS rank, conv_id % 10 AS stratum FROM conversations WHERE role = 'assistant'), r AS (SELECT c_custkey AS query_id, row_number() OVER (PARTITION BY c_custkey % 10 ORDER BY c_custkey) AS rank, c_custkey % 10 AS stratum FROM customer) SELECT coalesce(l.stratum, r.stratum) AS stratum, coalesce(l.rank, r.rank)::INT AS rank, conv_id, turn, query_id FROM l FULL JOIN r ON l.stratum = r.stratum AND l.rank = r.rank")
def in_order_binding(spark, d):
    """Captures in order of time zipped with a stratum's ids; whichever is longer shows its rest unbound."""
    left = answers(spark, d).select("conv_id", "turn", (F.col("conv_id") % 10).alias("stratum"))
    right = table(spark, d, "customer").select(F.col("c_custkey").alias("query_id"), (F.col("c_custkey") % 10).alias("stratum"))
    return ordering.zip_in_order(left, right, "stratum", ["conv_id", "turn"], ["query_id"])


SAMPLE_SQL = "WITH r AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY sha256('11:' || o_orderkey), o_orderkey) AS round FROM orders), s AS (SELECT * FROM r ORDER BY round, CASE WHEN o_orderstatus <> 'O' THEN 0 ELSE 1 END, o_orderstatus, o_orderpriority LIMIT 100)"


def _sample(spark, d):
    return ordering.stratified_sample(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], "o_orderkey", 100, 11, F.col("o_orderstatus") != "O")


@query(SAMPLE_SQL + " SELECT o_orderkey, o_orderstatus, o_orderpriority, CAST(round AS INT) AS round FROM s")
def stratified_sample(spark, d):
    return _sample(spark, d).select("o_orderkey", "o_orderstatus", "o_orderpriority", "round")


RESUME_SQL = """WITH r AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY sha256('11:' || o_orderkey), o_orderkey) AS round FROM orders),
o AS (SELECT *, row_number() OVER (ORDER BY round, CASE WHEN o_orderstatus <> 'O' THEN 0 ELSE 1 END, o_orderstatus, o_orderpriority) AS place FROM r),
done AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 1000 = 3 OR o_orderkey IN (SELECT o_orderkey FROM o WHERE place <= 40)),
drawn AS (SELECT * FROM o WHERE place <= 100 + (SELECT count(*) FROM done)),
rest AS (SELECT *, row_number() OVER (ORDER BY place) AS k FROM drawn WHERE o_orderkey NOT IN (SELECT o_orderkey FROM done))
SELECT o_orderkey, CAST(round AS INT) AS round FROM rest WHERE k <= 100 - (SELECT count(*) FROM done)"""


@query(RESUME_SQL)
def resume_sample(spark, d):
    """A sample of 100 of which the first 40 are done, and some rows from elsewhere: what is left to do."""
    o, buckets, first = table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], F.col("o_orderstatus") != "O"
    done = ordering.stratified_sample(o, buckets, "o_orderkey", 40, 11, first).select("o_orderkey").unionByName(o.where("o_orderkey % 1000 = 3").select("o_orderkey"))
    return ordering.resume_sample(o, done, buckets, "o_orderkey", 100, 11, first).select("o_orderkey", "round")


@query(f"WITH {PAIRS_SQL}, x AS (SELECT doc_id, source, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents), l AS (SELECT source, text FROM x WHERE k = 1) SELECT p.doc_id, CASE WHEN l.text IS NULL THEN 'no page' WHEN contains(lower(trim(regexp_replace(l.text, '\\s+', ' ', 'g'))), lower(p.void_reason)) THEN 'present' ELSE 'absent' END AS status FROM p LEFT JOIN l ON p.source = l.source AND p.doc_id % 4 <> 0 WHERE voided")
def void_reaudit(spark, d):
    """Voided verdicts against the first page of their source: would the span be found today?"""
    docs = table(spark, d, "documents").select("source", "doc_id", "text")
    page = ordering.keep_first(docs, ["source"], ["doc_id"]).select(F.col("source").alias("s"), "text")
    rows = pairs(spark, d).where("voided")
    joined = rows.join(page, (F.col("source") == F.col("s")) & (F.col("doc_id") % 4 != 0), "left")
    status = F.when(F.col("text").isNull(), "no page").when(X.span_present(F.col("void_reason"), F.col("text")), "present").otherwise("absent")
    return joined.select("doc_id", status.alias("status"))


@query(f"WITH {ANSWERS_SQL}, u AS (SELECT conv_id, turn, len(string_split(answer_text, ' ')) AS n FROM a) SELECT conv_id, min(n) AS low, max(n) AS high, max(n) - min(n) AS spread, round(avg(n), 8) AS mean, round(coalesce(stddev_samp(n), 0), 8) AS sd FROM u GROUP BY conv_id")
def split_spread(spark, d):
    u = answers(spark, d).select("conv_id", F.size(F.split("answer_text", " ")).cast("long").alias("n"))
    g = u.groupBy("conv_id").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.round(F.avg("n"), 8).alias("mean"), F.round(F.coalesce(F.stddev_samp("n"), F.lit(0.0)), 8).alias("sd"))
    return g.select("conv_id", "low", "high", (F.col("high") - F.col("low")).alias("spread"), "mean", "sd")


@query(f"WITH {PAIRS_SQL} SELECT product, CASE WHEN count(*) FILTER (doc_id % 3 <> 0) > 0 THEN count(*) FILTER (doc_id % 3 <> 0 AND source_code <> 'SOURCE_OK') END AS unauditable, count(*) FILTER (source_code = 'SOURCE_OK') AS checkable, sum(n_chars)::BIGINT AS chars FROM p GROUP BY product")
def prep_summary(spark, d):
    """What a labelling session would face; unauditable pairs are unknown where no code is known."""
    known = F.col("doc_id") % 3 != 0
    g = pairs(spark, d).groupBy("product").agg(F.count_if(known).alias("k"), F.count_if(known & ~P.auditable()).alias("u"), F.count_if(P.auditable()).alias("checkable"), F.sum("n_chars").alias("chars"))
    return g.select("product", F.when(F.col("k") > 0, F.col("u")).alias("unauditable"), "checkable", "chars")


COPIES_SQL = """
e AS (SELECT doc_id, replace(strip_accents(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))), 'ß', 'ss') AS t FROM documents),
w AS (SELECT doc_id, string_split(t, ' ') AS ws FROM e),
g AS (SELECT doc_id, CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS sh FROM w),
x AS (SELECT a.doc_id, a.sh, b.doc_id AS was, b.sh AS old FROM g a JOIN g b ON b.doc_id = a.doc_id - 1),
q AS (SELECT doc_id, was, len(list_intersect(old, sh))::DOUBLE / len(old) AS contained, len(list_intersect(old, sh))::DOUBLE / (len(old) + len(sh) - len(list_intersect(old, sh))) AS jaccard FROM x WHERE was IS NOT NULL)"""


def _drifts(spark, d):
    """Each document against the one before it by id, as a page against its snapshot; texts are shingled where they are
    read, and hashes are joined."""
    now = table(spark, d, "documents").select("doc_id", X.shingle_hashes(F.col("text")).alias("now"))
    then = now.select((F.col("doc_id") + 1).alias("doc_id"), F.col("doc_id").alias("was"), F.col("now").alias("old"))
    rows = now.join(then, "doc_id")
    contained, jaccard = X.containment(F.col("old"), F.col("now"))
    return rows.select("doc_id", "was", contained.alias("contained"), jaccard.alias("jaccard"))


@query(f"WITH {COPIES_SQL} SELECT doc_id, was, round(contained, 8) AS contained, round(jaccard, 8) AS jaccard FROM q")
def shingle_containment(spark, d):
    return _drifts(spark, d).select("doc_id", "was", F.round("contained", 8).alias("contained"), F.round("jaccard", 8).alias("jaccard"))


DRIFT_SQL = "CASE WHEN doc_id % 10 = 3 THEN 'NOT_CHECKED' WHEN doc_id % 10 = 4 THEN 'NO_SNAPSHOT' WHEN c < 0.1::DOUBLE THEN 'PAGE_REPLACED' WHEN c < 0.8::DOUBLE THEN 'PAGE_CHANGED' ELSE 'NONE' END"


def _statuses(spark, d):
    rows = _drifts(spark, d)
    i = F.col("doc_id")
    contained = F.when(i % 3 == 0, 0.5).when(i % 3 == 1, F.greatest("contained", F.lit(0.9))).otherwise(F.col("contained"))
    status = X.drift_status(F.when(i % 10 == 3, "SOURCE_EMPTY").otherwise(codes.SOURCE_OK), F.when(i % 10 != 4, "text"), contained)
    return rows.select("doc_id", status.alias("drift"))


CONTAINED_SQL = "(SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 0.5::DOUBLE WHEN doc_id % 3 = 1 THEN greatest(contained, 0.9::DOUBLE) ELSE contained END AS c FROM q)"


@query(f"WITH {COPIES_SQL} SELECT drift, count(*) AS pages FROM (SELECT {DRIFT_SQL} AS drift FROM {CONTAINED_SQL}) GROUP BY drift")
def drift_status(spark, d):
    return _statuses(spark, d).groupBy("drift").agg(F.count(F.lit(1)).alias("pages"))


@query(f"WITH {COPIES_SQL} SELECT doc_id, CASE WHEN {DRIFT_SQL} = 'PAGE_REPLACED' THEN 'SOURCE_DRIFTED' WHEN doc_id % 10 = 3 THEN 'SOURCE_EMPTY' ELSE 'SOURCE_OK' END AS code FROM {CONTAINED_SQL}")
def drift_applied(spark, d):
    """A replaced page is no longer the page that was cited."""
    code = F.when(F.col("drift") == "PAGE_REPLACED", "SOURCE_DRIFTED").when(F.col("doc_id") % 10 == 3, "SOURCE_EMPTY").otherwise(codes.SOURCE_OK)
    return _statuses(spark, d).select("doc_id", code.alias("code"))


@query("WITH c AS (SELECT conv_id AS claim, turn AS tn, ['M' || (conv_id % 7), ' m' || (turn % 5) || ' '] AS marks FROM conversations), m AS (SELECT claim, tn, lower(trim(unnest(marks))) AS mark, generate_subscripts(marks, 1) AS k FROM c), n AS (SELECT 'm' || (n_nationkey % 7) AS mark, n_nationkey AS pos, 'https://x/' || (n_nationkey % 11) AS url FROM nation), j AS (SELECT claim, tn, url, min(k * 1000 + pos) AS o FROM m JOIN n USING (mark) GROUP BY ALL) SELECT claim || '-' || tn AS claim_id, string_agg(url, ' ' ORDER BY o) AS urls FROM j GROUP BY claim, tn")
def marker_urls(spark, d):
    c = table(spark, d, "conversations")
    claims = c.select(F.concat_ws("-", "conv_id", "turn").alias("claim_id"), F.lit(1).alias("capture"), F.array(F.concat(F.lit("M"), (F.col("conv_id") % 7).cast("string")), F.concat(F.lit(" m"), (F.col("turn") % 5).cast("string"), F.lit(" "))).alias("markers"))
    n = table(spark, d, "nation").select(F.lit(1).alias("capture"), F.concat(F.lit("m"), (F.col("n_nationkey") % 7).cast("string")).alias("marker"), F.col("n_nationkey").alias("pos"), F.concat(F.lit("https://x/"), (F.col("n_nationkey") % 11).cast("string")).alias("url"))
    return P.marker_urls(claims, n).select("claim_id", F.array_join("urls", " ").alias("urls"))


@query("""WITH c AS (SELECT DISTINCT o_custkey AS claim_id, o_orderkey % 50 AS url FROM orders), f AS (SELECT url, code FROM (SELECT s_suppkey % 60 AS url, CASE WHEN s_suppkey % 4 = 0 THEN 'SOURCE_EMPTY' ELSE 'SOURCE_OK' END AS code, row_number() OVER (PARTITION BY s_suppkey % 60 ORDER BY s_suppkey DESC) AS k FROM supplier) WHERE k = 1),
j AS (SELECT claim_id, url, verdict FROM (SELECT o_custkey AS claim_id, o_orderkey % 50 AS url, CASE WHEN o_orderkey % 3 = 0 THEN 'SUPPORTED' ELSE 'NOT_FOUND_IN_SOURCE' END AS verdict, row_number() OVER (PARTITION BY o_custkey, o_orderkey % 50 ORDER BY o_orderkey DESC) AS k FROM orders WHERE o_orderkey % 5 <> 0) WHERE k = 1)
SELECT claim_id, url, coalesce(code, '') AS source_code, coalesce(verdict, '') AS verdict FROM c LEFT JOIN f USING (url) LEFT JOIN j USING (claim_id, url)""")
def pairs_build(spark, d):
    """Claims by their addresses with fetches and judgements; of repeated ones the last counts."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("claim_id"), (F.col("o_orderkey") % 50).alias("url"), F.col("o_orderkey").alias("seq"))
    claims = o.groupBy("claim_id").agg(F.collect_set("url").alias("urls"))
    s = table(spark, d, "supplier")
    fetches = s.select((F.col("s_suppkey") % 60).alias("url"), F.col("s_suppkey").alias("seq"), F.when(F.col("s_suppkey") % 4 == 0, "SOURCE_EMPTY").otherwise("SOURCE_OK").alias("source_code"))
    judged = o.where("seq % 5 != 0").select("claim_id", "url", "seq", F.when(F.col("seq") % 3 == 0, "SUPPORTED").otherwise("NOT_FOUND_IN_SOURCE").alias("verdict"), F.lit(False).alias("voided"), F.lit("").alias("void_reason"))
    return P.build_pairs(claims, fetches, judged).select("claim_id", "url", "source_code", "verdict")


@query("WITH m AS (SELECT o_orderkey, o_custkey, year(o_orderdate) AS y FROM orders WHERE o_orderkey % 20 = 0), w AS (SELECT c_custkey, 1990 + c_custkey % 12 AS y FROM customer), j AS (SELECT o_orderkey, count(w.c_custkey) AS n FROM m LEFT JOIN w ON m.o_orderkey % 60 <> 0 AND o_custkey % 400 = c_custkey % 400 AND abs(m.y - w.y) <= 1 OR m.o_orderkey % 60 = 0 AND c_custkey = o_custkey * 2 GROUP BY 1) SELECT o_orderkey, n AS candidates, CASE WHEN n = 0 THEN 'NOT_FOUND' WHEN n = 1 THEN 'FOUND' ELSE 'AMBIGUOUS' END AS outcome FROM j")
def existence_match(spark, d):
    """Named works (a stated query set: keys divisible by 20) against all of a catalogue: by DOI, or by author and year."""
    k, c = F.col("o_custkey"), F.col("c_custkey")
    doi = F.when(F.col("o_orderkey") % 60 == 0, F.concat(F.lit("10.1000/"), (k * 2).cast("string")))
    m = table(spark, d, "orders").where("o_orderkey % 20 = 0").select(F.col("o_orderkey").alias("mention"), doi.alias("doi"), (k % 400).alias("author"), F.year("o_orderdate").alias("year"))
    w = table(spark, d, "customer").select(c.alias("work"), F.concat(F.lit("10.1000/"), c.cast("string")).alias("doi"), (c % 400).alias("author"), (c % 12 + 1990).alias("year"))
    return captures.match_works(m, w).withColumnRenamed("mention", "o_orderkey")


@query("SELECT doc_id, CASE WHEN doc_id % 6 = 0 OR coalesce(substr(text, 5, 40), '') = '' THEN NULL WHEN doc_id % 5 = 0 AND NOT contains('nothing of it', substr(text, 5, 40)) THEN TRUE ELSE FALSE END AS missed FROM documents")
def extraction_missed_check(spark, d):
    """A person's passage against strict and permissive text: false, true or, without a passage, unknown."""
    rows = table(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    i = F.col("doc_id")
    passage = F.when(i % 6 == 0, "").otherwise(F.substring("text", 5, 40))
    strict = F.when(i % 5 == 0, "nothing of it").otherwise(F.col("text"))
    return rows.select("doc_id", extraction_missed(passage, strict, F.col("text")).alias("missed"))


@query(f"WITH {PAIRS_SQL}, g AS (SELECT answer, CASE WHEN answer % 3 = 0 THEN ['a', 'b'] WHEN answer % 3 = 1 THEN [] END AS held, count(DISTINCT claim_id) FILTER (st) * 2 <= count(DISTINCT claim_id) AS low FROM s GROUP BY 1) SELECT answer, CASE WHEN answer % 3 = 0 THEN 'withheld: a b' WHEN answer % 3 = 1 THEN 'published by the run' WHEN low THEN 'INSUFFICIENT_EVIDENCE' ELSE 'decided by the run' END AS reason FROM g")
def no_rate_reasons(spark, d):
    low = P.insufficient(pairs(spark, d), "answer")
    held = F.when(F.col("answer") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).when(F.col("answer") % 3 == 1, F.array().cast("array<string>"))
    return low.select("answer", gates.no_rate_reason(held, F.col("insufficient")).alias("reason"))


@query(f"WITH l AS (SELECT c_custkey, unnest(['a', 'b']) AS x FROM customer), r AS (SELECT x, count(*) FILTER (c_custkey % 7 = 0) AS hits, count(*) AS n FROM l GROUP BY x), w AS (SELECT x, hits, n, {wilson_sql('hits', 'n')} FROM r) SELECT x, hits, n, value, lo, hi FROM w")
def wilson_golden(spark, d):
    from provenia.functions.stats import rate_columns

    l = table(spark, d, "customer").select("c_custkey", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("x"))  # noqa: E741
    n = l.groupBy("x").agg(F.count_if(F.col("c_custkey") % 7 == 0).alias("h"), F.count(F.lit(1)).alias("k"))
    return n.select("x", *rate_columns(F.col("h"), F.col("k")))


VIEWS_SQL = """WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'),
v AS (SELECT user_id, ts AS seen, max(event_id) AS last_id, min(event_id) AS first_id FROM events WHERE event_type = 'view' GROUP BY ALL),
b AS (SELECT event_id, p.user_id, p.ts, v.seen AS back, v.last_id AS back_id FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.seen),
f AS (SELECT event_id, v.seen AS ahead, v.first_id AS ahead_id FROM p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts <= v.seen)"""


def _views(spark, d):
    """Purchases and views of the same user, as pages and the snapshots of their address."""
    e = table(spark, d, "events")
    return e.where("event_type = 'purchase'").select("event_id", "user_id", "ts"), e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("view_id"), F.col("ts").alias("seen"))


@query(VIEWS_SQL + " SELECT event_id, back_id AS view_id FROM b")
def last_view_before(spark, d):
    """Each purchase with the user's last view up to it: an as-of join, a day of a user at a time."""
    left, right = _views(spark, d)
    return joins.asof_join(left, right, "user_id", "ts", "seen", ["view_id"], joins.by_seconds(86400)).select("event_id", "match.view_id")


@query(VIEWS_SQL + " SELECT event_id, CASE WHEN ahead IS NOT NULL AND (back IS NULL OR epoch_us(ahead) - epoch_us(ts) < epoch_us(ts) - epoch_us(back)) THEN ahead_id ELSE back_id END AS view_id FROM b JOIN f USING (event_id)")
def nearest_view(spark, d):
    """Each purchase with the user's view nearest in time, the earlier of two as near."""
    left, right = _views(spark, d)
    return joins.nearest_join(left, right, "user_id", "ts", "seen", ["view_id"], joins.by_seconds(86400)).select("event_id", "match.view_id")


@query("WITH c AS (SELECT event_id, coalesce(sum(event_id % 97 + user_id) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS spent_before FROM events) SELECT event_id, spent_before, spent_before >= 100000 AS halted FROM c")
def budget_of_one_run(spark, d):
    """All events as the calls of a single run: sums of pieces first, then within them."""
    calls = table(spark, d, "events").select(F.lit("r").alias("run"), "event_id", (F.col("event_id") % 97 + F.col("user_id")).alias("tokens"))
    return P.running_budget(calls, 100_000, "run", "event_id").select("event_id", "spent_before", "halted")


@query("WITH c AS (SELECT 'u' || user_id AS key, strftime(date_trunc('hour', ts), '%Y%m%dT%H') AS stamp FROM events) SELECT key, stamp, count(*) AS entries, count(*) - 1 AS last_version, CASE WHEN count(*) = 1 THEN stamp ELSE stamp || '-' || (count(*) - 1) END AS last_name FROM c GROUP BY key, stamp")
def cache_versions(spark, d):
    """Fetches appended to a versioned store in two goes: no entry of an address and hour takes another's place."""
    from provenia.sources import versioned
    from provenia.streaming.queue import shared_folder

    e = table(spark, d, "events")
    rows = e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("key"), F.date_format("ts", "yyyyMMdd'T'HH").alias("stamp"), F.to_json(F.struct("event_type")).alias("meta"), F.col("props").alias("body"), "event_id")
    path = shared_folder(spark)
    for part in (0, 1):
        versioned.append(rows.where(F.col("event_id") % 2 == part), path)
    g = versioned.read(spark, path).groupBy("key", "stamp").agg(F.count(F.lit(1)).alias("entries"), F.max("version").alias("last_version"), F.max_by("name", "version").alias("last_name"))
    return g
