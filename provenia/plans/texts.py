"""Queries of the text and URL operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from provenia import codes
from provenia.functions import text as X
from provenia.operators import gates, joins, judge
from provenia.operators.ordering import claim_ids as with_claim_ids
from provenia.operators.ordering import keep_first
from provenia.operators.provenance import classified
from provenia.plans.catalogue import query, wilson_sql
from provenia.plans.standins import ANSWERS_SQL, answers, table
from provenia.sources import stores


def _values(spark, rows, schema):
    return classified(spark.createDataFrame(rows, schema), "your-input")


def _values_sql(rows, names) -> str:
    quote = lambda x: "NULL" if x is None else str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'"
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(quote, r)) + ')' for r in rows)}) v({names}))"


def _list_sql(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


NET = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
URL_SQL = f"""
u AS (SELECT page_id, url, regexp_replace(regexp_replace(url, '#.*$', ''), '\\?.*$', '') AS path, regexp_extract(regexp_replace(url, '#.*$', ''), '\\?(.*)$', 1) AS q, regexp_extract(url, '#(.*)$', 1) AS h FROM pages),
k AS (SELECT *, array_to_string(list_transform(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT list_contains({_list_sql(codes.TRACKING_PARAMS)}, lower(split_part(x, '=', 1)))), lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END), '&') AS kept FROM u),
n AS (SELECT page_id, url, path || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END || CASE WHEN h <> '' THEN '#' || h ELSE '' END AS url_norm FROM k)"""


@query(f"WITH {URL_SQL} SELECT page_id, url_norm FROM n")
def url_normalised(spark, d):
    return table(spark, d, "pages").select("page_id", X.normalise_url(F.col("url")).alias("url_norm"))


@query(f"WITH {URL_SQL} SELECT url_norm, min(page_id) AS page_id, count(*) AS cited FROM n GROUP BY 1")
def distinct_fetch_urls(spark, d):
    """One fetch per normalised address, the first citation of it named."""
    pages = table(spark, d, "pages").select("page_id", X.normalise_url(F.col("url")).alias("url_norm"))
    n = pages.groupBy("url_norm").agg(F.count(F.lit(1)).alias("cited"))
    return keep_first(pages, ["url_norm"], ["page_id"]).join(n, "url_norm").select("url_norm", "page_id", "cited")


ODD_URLS = [("https://www.bmc.example.co.uk/a",), ("http://user@Patients.Site.ORG:8080/x?y",), ("https://10.0.0.7/a",), ("not a url",), ("https://localhost/",), ("https://trust.nhs.uk",), ("https://gov.uk/",)]
DOMAIN_SQL = f"""
h AS (SELECT url, trim(lower(regexp_replace(regexp_replace({NET}, '^.*@', ''), ':\\d*$', '')), '.') AS host FROM a),
l AS (SELECT url, host, string_split(host, '.') AS p FROM h),
m AS (SELECT url, CASE WHEN regexp_full_match(host, '[0-9.]*') OR len(p) < 2 THEN host WHEN list_contains({_list_sql(codes.TWO_PART_SUFFIXES)}, array_to_string(p[-2:], '.')) AND len(p) >= 3 THEN array_to_string(p[-3:], '.') ELSE array_to_string(p[-2:], '.') END AS domain FROM l)"""


@query(f"WITH a AS (SELECT url FROM pages UNION ALL SELECT url FROM {_values_sql(ODD_URLS, 'url')}), {DOMAIN_SQL} SELECT domain, count(*) AS pages FROM m GROUP BY domain")
def registrable_domain_counts(spark, d):
    urls = table(spark, d, "pages").select("url").unionByName(_values(spark, ODD_URLS, "url string"))
    return urls.groupBy(X.registrable_domain(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("pages"))


@query("SELECT event_id, CASE WHEN s IN (404, 410) THEN 'SOURCE_DEAD_LINK' WHEN s IN (401, 403, 429) THEN 'SOURCE_BOT_BLOCKED' ELSE 'SOURCE_UNREACHABLE' END AS code FROM (SELECT event_id, list_extract([404, 410, 401, 403, 429, 500, 302, 0], CAST(event_id % 8 + 1 AS INT)) AS s FROM events)")
def http_code_map(spark, d):
    status = F.element_at(F.array(*[F.lit(s) for s in (404, 410, 401, 403, 429, 500, 302, 0)]), (F.col("event_id") % 8 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", X.status_code(status).alias("code"))


_HEADERS = ("text/html; charset=utf-8", None, "text/html", " Application/PDF ", codes.DOCX_TYPE, codes.DOCX_TYPE + "; v=1", "application/rss+xml", "image/png", "Text/Plain;", "application/xml")


@query(f"""WITH h AS (SELECT page_id, list_extract({_list_sql([h or '' for h in _HEADERS])}, CAST(page_id % 10 + 1 AS INT)) AS header,
 CASE page_id % 10 WHEN 2 THEN ' ' || chr(10) || '%PDF-1.7' WHEN 5 THEN 'PK' ELSE '' END || substr(html, 1, 1024) AS body FROM pages),
t AS (SELECT page_id, lower(trim(split_part(header, ';', 1))) AS named, regexp_matches(body, '^\\s*%PDF-') AS pdf, body[1:2] = 'PK' AS zipped FROM h)
SELECT page_id, CASE WHEN pdf OR named IN ('application/pdf', 'application/x-pdf') THEN 'pdf' WHEN named LIKE '%wordprocessingml.document' AND zipped THEN 'docx'
 WHEN named LIKE '%/%xml' AND named <> 'application/xhtml+xml' THEN 'xml' WHEN named = '' OR named LIKE 'text/%' OR named = 'application/xhtml+xml' THEN 'html' ELSE 'none' END AS kind FROM t""")
def content_kind(spark, d):
    """The pages under ten headers, some with the first bytes of a PDF file or of an archive before them."""
    i = F.col("page_id") % 10
    header = F.element_at(F.array(*[F.lit(h).cast("string") for h in _HEADERS]), (i + 1).cast("int"))
    head = F.concat(F.when(i == 2, " \n%PDF-1.7").when(i == 5, "PK").otherwise(""), F.substring("html", 1, 1024))
    return table(spark, d, "pages").select("page_id", X.document_kind(X.content_type(header), head).alias("kind"))


TEXT_SQL = r"""
t AS (SELECT page_id, html, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
  '<script\b.*?</script\s*>', ' ', 'gsi'), '<style\b.*?</style\s*>', ' ', 'gsi'), '<noscript\b.*?</noscript\s*>', ' ', 'gsi'), '<template\b.*?</template\s*>', ' ', 'gsi'), '<nav\b.*?</nav\s*>', ' ', 'gsi'),
  '<header\b.*?</header\s*>', ' ', 'gsi'), '<footer\b.*?</footer\s*>', ' ', 'gsi'), '<aside\b.*?</aside\s*>', ' ', 'gsi'), '<form\b.*?</form\s*>', ' ', 'gsi'), '<iframe\b.*?</iframe\s*>', ' ', 'gsi'), '<[^>]*>', ' ', 'gs'), '\s+', ' ', 'g')) AS body FROM pages)"""


@query(f"WITH {TEXT_SQL} SELECT page_id, body, CAST(length(body) AS BIGINT) AS chars FROM t")
def html_text_regex(spark, d):
    body = X.regex_text(F.col("html"))
    return table(spark, d, "pages").select("page_id", body.alias("body"), F.length(body).cast("long").alias("chars"))


WALLED = "CASE WHEN page_id % 10 = 1 THEN body || ' Subscribe to continue.' WHEN page_id % 10 = 2 THEN body || ' We value your privacy' WHEN page_id % 10 = 3 THEN substr(body, 1, 90) WHEN page_id % 10 = 4 THEN substr(body, 1, 50) ELSE body END"
HTML2 = "CASE WHEN page_id % 10 = 4 THEN html || '<IMG src=x>' WHEN page_id % 10 = 5 THEN repeat(html, 40) ELSE html END"
CASES_SQL = f"""w AS (SELECT page_id, {WALLED} AS body, {HTML2} AS html, CAST(CASE WHEN page_id % 10 = 6 THEN 404 WHEN page_id % 10 = 7 THEN 403 WHEN page_id % 20 = 8 THEN 500 ELSE 200 END AS INT) AS status,
 CASE WHEN page_id % 40 = 6 THEN 'abuse-detection' ELSE '' END AS header FROM t),
f AS (SELECT *, CASE WHEN {' OR '.join(f"contains(lower(body), '{m}')" for m in codes.PAYWALL_MARKERS)} THEN 'paywall' WHEN {' OR '.join(f"contains(lower(body), '{m}')" for m in codes.CONSENT_MARKERS)} THEN 'consent' END AS wall,
 length(body) < 200 AND ({' OR '.join(f"contains(lower(html), '{m}')" for m in codes.PICTURE_TAGS)}) AS pictures, strlen(html) >= 50000 AND length(body) < strlen(html) * 0.002::DOUBLE * 40 AS thin FROM w)"""


def _cases(spark, d):
    rows = table(spark, d, "pages").select("page_id", "html", X.regex_text(F.col("html")).alias("body"))
    rows = rows.selectExpr("page_id", f"{WALLED} AS body", f"{HTML2} AS html", "CASE WHEN page_id % 10 = 6 THEN 404 WHEN page_id % 10 = 7 THEN 403 WHEN page_id % 20 = 8 THEN 500 ELSE 200 END AS status", "CASE WHEN page_id % 40 = 6 THEN 'abuse-detection' ELSE '' END AS header")
    return rows.withColumn("wall", X.wall(F.col("body"))).withColumn("pictures", X.picture_only(F.col("html"), F.col("body")))


@query(f"WITH {TEXT_SQL}, {CASES_SQL} SELECT page_id, wall, pictures, thin FROM f")
def page_flags(spark, d):
    """Walls, pages of pictures and thin extractions; the ratio of the last is widened to meet the test pages."""
    rows = _cases(spark, d)
    return rows.select("page_id", "wall", "pictures", X.looks_thin(F.length("body") / 40, F.octet_length("html")).alias("thin"))


@query(f"WITH {TEXT_SQL}, {CASES_SQL} SELECT page_id, CASE WHEN status <> 200 AND header <> '' THEN 'SOURCE_BOT_BLOCKED' WHEN status = 404 THEN 'SOURCE_DEAD_LINK' WHEN status = 403 THEN 'SOURCE_BOT_BLOCKED' WHEN status <> 200 THEN 'SOURCE_UNREACHABLE' WHEN pictures THEN 'SOURCE_NO_TEXT_LAYER' WHEN wall IS NOT NULL THEN 'SOURCE_PAYWALLED' WHEN length(body) < 200 THEN 'SOURCE_EMPTY' ELSE 'SOURCE_OK' END AS code FROM f")
def source_classification(spark, d):
    rows = _cases(spark, d)
    code = X.source_code(F.col("status"), X.bot_marker(F.col("header"), F.lit("")), F.lit(True), F.lit("html"), F.lit(None).cast("string"), F.col("pictures"), F.col("wall"), F.length("body"))
    return rows.select("page_id", code.alias("code"))


BLOCK = "CASE WHEN turn % 4 = 1 AND conv_id % 3 = 0 THEN answer_text || chr(10) || 'Alpha Beta' || chr(9) || '2024' || chr(9) || ' ' || chr(10) || '- item with 55 percent' || chr(10) || '2) Copy' ELSE answer_text END"
UNITS_SQL = ANSWERS_SQL + f""",
l0 AS (SELECT query_id, string_split({BLOCK}, chr(10)) AS ls FROM a),
l1 AS (SELECT query_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS ln FROM l0),
l2 AS (SELECT * FROM l1 WHERE trim(regexp_replace(line, '\\s+', ' ', 'g')) <> ''),
l3 AS (SELECT query_id, ln, CASE
   WHEN contains(line, chr(9)) THEN [{{'text': array_to_string(list_filter(list_transform(string_split(line, chr(9)), lambda c: trim(c)), lambda c: c <> ''), ' | '), 'kind': 'row', 'cells': len(list_filter(string_split(line, chr(9)), lambda c: trim(c) <> ''))}}]
   WHEN regexp_matches(line, '^\\s*(?:[-*•–]|\\d+[.)])\\s+') THEN [{{'text': trim(regexp_replace(line, '^\\s*(?:[-*•–]|\\d+[.)])\\s+', '')), 'kind': 'item', 'cells': 1::BIGINT}}]
   ELSE list_transform(list_filter(string_split(regexp_replace(trim(line), '([.!?])\\s+([A-Z("''“])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: trim(s) <> ''), lambda s: {{'text': trim(s), 'kind': 'sentence', 'cells': 1::BIGINT}}) END AS us FROM l2),
l4 AS (SELECT query_id, ln, unnest(us) AS u, generate_subscripts(us, 1) AS k FROM l3),
un AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY ln, k) - 1 AS pos, u.text AS text, u.kind AS kind, CAST(u.cells AS BIGINT) AS cells FROM l4)"""


def _units(spark, d):
    rows = answers(spark, d).selectExpr("query_id", "turn", "conv_id", f"{BLOCK} AS block")
    return rows.select("query_id", "conv_id", F.posexplode(X.units(F.col("block"))).alias("pos", "u")).select("query_id", "conv_id", F.col("pos").cast("long").alias("pos"), "u.*")


@query(f"WITH {UNITS_SQL} SELECT * FROM un")
def sentence_units(spark, d):
    return _units(spark, d).select("query_id", "pos", "text", "kind", "cells")


PROPERS_SQL = "list_distinct(list_filter(regexp_extract_all(text, '[A-Za-z0-9_À-ÿ][A-Za-z0-9_À-ÿ''-]*'), lambda w: regexp_full_match(w, '[A-Z][A-Za-z''-]{3,}')))"
FACT_SQL = f"""
ft AS (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM un),
fu AS (SELECT *, rtrim(lower(flat), '.:') AS low FROM ft),
fx AS (SELECT *, list_contains({_list_sql(codes.FURNITURE)}, low) OR length(low) <= 2 AS furniture,
  len(list_filter(string_split(flat, ' '), lambda w: w <> '')) AS n_words,
  len(list_filter(regexp_extract_all(text, '\\d[\\d,.]*%?'), lambda w: length(regexp_replace(w, '\\D', '', 'g')) >= 2)) AS n_numbers FROM fu),
fy AS (SELECT *, NOT furniture AND n_words >= 4 AND n_numbers > 0 AS counted FROM fx)"""


@query(f"WITH {UNITS_SQL}, {FACT_SQL} SELECT kind, count(*) AS units, sum(cells)::BIGINT AS cells, count(*) FILTER (furniture) AS furniture, count(*) FILTER (counted) AS with_number FROM fy GROUP BY kind")
def skip_report(spark, d):
    """Units by kind, with furniture and those that state a number."""
    rows = _units(spark, d)
    t = F.col("text")
    counted = X.looks_factual(t) & (F.size(X.numbers(t)) > 0)
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("units"), F.sum("cells").alias("cells"), F.count_if(X.is_furniture(t)).alias("furniture"), F.count_if(counted).alias("with_number"))


@query(f"WITH {UNITS_SQL}, {FACT_SQL}, g AS (SELECT query_id, count(*) FILTER (pos % 3 = 0) AS uncited, count(*) FILTER (pos % 3 <> 0 AND counted) AS skipped_factual FROM fy GROUP BY 1) SELECT query_id, uncited, skipped_factual, uncited + skipped_factual AS floor FROM g")
def uncited_floor(spark, d):
    """At least so many statements of an answer stand without a citation."""
    t = F.col("text")
    rows = _units(spark, d)
    g = rows.groupBy("query_id").agg(F.count_if(F.col("pos") % 3 == 0).alias("uncited"), F.count_if((F.col("pos") % 3 != 0) & X.looks_factual(t) & (F.size(X.numbers(t)) > 0)).alias("skipped_factual"))
    return g.select("query_id", "uncited", "skipped_factual", (F.col("uncited") + F.col("skipped_factual")).alias("floor"))


#: Words with a capital each, one character for one as in the SQL: initcap makes 'Ssein' of 'ßein', a name that no text has.
_TITLED = "array_join(transform(split(text, ' '), w -> concat(CASE WHEN w LIKE 'ß%' THEN 'ẞ' WHEN length(upper(left(w, 1))) > 1 THEN left(w, 1) ELSE upper(left(w, 1)) END, lower(replace(substr(w, 2), 'İ', 'i')))), ' ')"
NAMED_UNIT = "CASE WHEN query_id LIKE '%1' THEN 'It is said that ' || {} ELSE text END"


@query(f"""WITH {UNITS_SQL}, v AS (SELECT * REPLACE ({NAMED_UNIT.format("array_to_string([upper(w[1]) || lower(w[2:]) FOR w IN string_split(text, ' ')], ' ')")} AS text) FROM un), {FACT_SQL.replace("FROM un)", "FROM v)")}
SELECT query_id, pos, NOT furniture AND n_words >= 4 AND (n_numbers > 0 OR len({PROPERS_SQL}) >= 2) AS factual, furniture FROM fy""")
def factual_units(spark, d):
    """The units of every answer: which state a fact, by a number or by two names, and which are furniture; some answers in capitals."""
    rows = _units(spark, d).withColumn("text", F.expr(NAMED_UNIT.format(_TITLED)))
    t = F.col("text")
    return rows.select("query_id", "pos", X.looks_factual(t).alias("factual"), X.is_furniture(t).alias("furniture"))


@query(f"""WITH {UNITS_SQL}, m AS (SELECT *, replace(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), 'ß', 'ss') AS canon FROM un JOIN (SELECT DISTINCT conv_id, query_id FROM a) USING (query_id)),
b AS (SELECT *, conv_id || '#' || substr(sha256(canon), 1, 8) AS base FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY query_id, pos) AS n FROM b)
SELECT query_id, pos, CASE WHEN n = 1 THEN base ELSE base || '.' || n END AS claim_id FROM r""")
def claim_ids(spark, d):
    """Content-addressed claim ids of each conversation, with suffixes for repeats."""
    rows = _units(spark, d).withColumn("canonical", X.canonical(F.col("text")))
    rows = rows.withColumn("capture", F.col("conv_id").cast("string")).withColumn("at", F.struct("query_id", "pos"))
    return with_claim_ids(rows, "capture", "canonical", "at").select("query_id", "pos", "claim_id")


@query(f"WITH {UNITS_SQL} SELECT query_id, sha256(string_agg(text || chr(31) || kind, chr(30) ORDER BY pos)) AS split_sha256, sha256(string_agg(sha256(to_json({{'label': kind, 'text': text}})::VARCHAR), ',' ORDER BY sha256(to_json({{'label': kind, 'text': text}})::VARCHAR))) AS labels_sha256 FROM un GROUP BY query_id")
def split_digest(spark, d):
    """Digest of an answer's split (order counts) and of its set of labels (it doesn't)."""
    claims = F.array_sort(F.collect_list(F.struct("pos", "text", F.array("kind").alias("markers"))))
    labels = F.collect_list(F.struct(F.col("kind").alias("label"), "text"))
    rows = _units(spark, d).groupBy("query_id").agg(claims.alias("claims"), labels.alias("labels"))
    return rows.select("query_id", stores.split_digest(F.col("claims")).alias("split_sha256"), stores.labels_digest(F.col("labels")).alias("labels_sha256"))


@query("SELECT p_partkey, sha256(p_partkey || chr(10) || p_brand || chr(10) || trim(regexp_replace(p_name, '\\s+', ' ', 'g')) || chr(10) || trim(regexp_replace(p_type, '\\s+', ' ', 'g'))) AS query_hash FROM part")
def query_hash(spark, d):
    """Parts as the queries of a stratum, hashed as a freeze does."""
    p = table(spark, d, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("query_id"), F.col("p_brand").alias("domain"), F.col("p_name").alias("text"), F.col("p_type").alias("cost_of_error"))
    return p.select("p_partkey", stores.query_hash().alias("query_hash"))


@query("""WITH e AS (SELECT doc_id, doc_id % 5 AS how, coalesce(text, '') AS text FROM documents)
SELECT doc_id, how, CASE WHEN how = 4 THEN FALSE WHEN how = 3 THEN contains(lower(text), 'zzqx') WHEN how = 1 THEN TRUE ELSE trim(regexp_replace(substr(text, 11, 80), '\\s+', ' ', 'g')) <> '' END AS present FROM e""")
def span_present(spark, d):
    """Spans cut out of documents: as they are, with curly quotes, with a footnote mark, changed, blank."""
    e = table(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("how", F.col("doc_id") % 5)
    cut = F.substring("text", 11, 80)
    doc = F.when(F.col("how") == 1, F.concat("text", F.lit(' said "yes" — it’s so'))).when(F.col("how") == 2, F.concat(F.substring("text", 1, 50), F.lit("[12]"), F.expr("substring(text, 51)"))).otherwise(F.col("text"))
    span = F.when(F.col("how") == 1, F.lit("SAID “yes” - it's  so")).when(F.col("how") == 3, F.concat(cut, F.lit(" zzqx"))).when(F.col("how") == 4, F.lit("  ")).otherwise(F.upper(cut))
    return e.select("doc_id", "how", X.span_present(span, doc).alias("present"))


@query(f"""WITH e AS (SELECT doc_id, doc_id % 8 AS how, coalesce(text, '') AS text FROM documents), v AS (SELECT *, trim(regexp_replace(substr(text, 11, 80), '\\s+', ' ', 'g')) <> '' AS quoted FROM e)
SELECT doc_id, how IN (0, 4, 5) AND quoted AS span_verified, CASE WHEN how IN (4, 5) AND quoted THEN how = 5 END AS predates,
 CASE WHEN how = 6 THEN '{codes.REFUSED}' WHEN how = 2 AND NOT contains(text, '4512') THEN '{codes.SUSPECT}' WHEN how IN (1, 7) OR how IN (0, 4, 5) AND NOT quoted THEN '{codes.FABRICATED}' WHEN how = 4 THEN '{codes.ADDED_LATER}' ELSE '' END AS void_reason FROM v""")
def g3_outcome(spark, d):
    """Verdicts on every document: quoted, misquoted, evidence lost in extraction, nothing found, quoted but not archived,
    quoted and archived, an unknown verdict, a blank quotation."""
    how = F.col("doc_id") % 8
    one_of = lambda *values: F.element_at(F.array(*[F.lit(v) if isinstance(v, str) else v for v in values]), (how + 1).cast("int"))
    rows = table(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    cut, text = F.substring("text", 11, 80), F.col("text")
    rows = rows.select(
        "doc_id",
        one_of("SUPPORTED", "SUPPORTED", "NOT_FOUND_IN_SOURCE", "NOT_FOUND_IN_SOURCE", "PARTIALLY_SUPPORTED", "CONTRADICTED", "MAYBE", "SUPPORTED").alias("verdict"),
        one_of(cut, F.concat(cut, F.lit(" zzqx")), "", "", cut, cut, cut, " ").alias("span"),
        F.lit("It reached 4512 cases").alias("claim"),
        "text",
        F.when(how == 2, F.concat(text, F.lit(" 4512 cases"))).otherwise(text).alias("raw"),
        F.when(how == 4, "only what was there before, zzqx").when(how == 5, text).alias("archived"),
    )
    return gates.span_outcome(rows).select("doc_id", "span_verified", "predates", "void_reason")


@query(f"WITH {TEXT_SQL}, r AS (SELECT page_id, body, lower(trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'gs'), '\\s+', ' ', 'g'))) || ' 4512 78%' AS raw FROM t) SELECT page_id, CASE WHEN contains(lower(body), '4512') AND contains(lower(body), '78%') THEN '' WHEN contains(lower(body), '4512') THEN '78%' WHEN contains(lower(body), '78%') THEN '4512' ELSE '4512|78%' END AS dropped FROM r")
def dropped_evidence(spark, d):
    """Two numbers appended to the markup only: what the extraction lost."""
    rows = table(spark, d, "pages").select("page_id", X.regex_text(F.col("html")).alias("body"), F.concat(F.regexp_replace("html", r"(?s)<[^>]*>", " "), F.lit(" 4512 78%")).alias("raw"))
    return rows.select("page_id", F.array_join(X.dropped_evidence(F.lit("Some 4512 of them, 78% in all, a 3"), F.col("body"), F.col("raw")), "|").alias("dropped"))


@query(f"""WITH {ANSWERS_SQL}, s AS (SELECT query_id, unnest(string_split(regexp_replace(answer_text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1))) AS sentence, generate_subscripts(string_split(regexp_replace(answer_text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), 1) AS k, length(answer_text) AS n FROM a),
w AS (SELECT *, len(list_intersect(['nicht', 'onth', 'reer', 'que', 'onon', 'zzz'], list_distinct(regexp_extract_all(lower(sentence), '[a-z0-9]+')))) AS shared FROM s),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, k) AS rank, count(*) OVER (PARTITION BY query_id) AS many FROM w)
SELECT query_id, CASE WHEN shared > 0 AND many > 1 THEN sentence END AS focus FROM b WHERE rank = 1""")
def span_focus(spark, d):
    return answers(spark, d).select("query_id", X.span_focus(F.col("answer_text"), F.lit("nicht the onth reer que onon of zzz")).alias("focus"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_name || '|in ' || (p_size + 1970) || '|scores of ' || p_type END AS kept, CASE WHEN p_partkey % 11 = 0 THEN '' ELSE 'confidence 0.' || p_size || '|the score of a ' || p_brand || '|' || p_size || '% sure of it' || CASE WHEN p_partkey % 3 = 0 THEN '|P =0.05' ELSE '' END END AS dropped FROM part")
def qualifier_split(spark, d):
    """What a judge might add about each part: qualifiers stay, scores in disguise go; every eleventh part has no entries."""
    text = lambda *parts: F.concat(*[F.lit(x[1:]) if x[0] == "=" else F.col(x).cast("string") for x in parts])
    year = F.concat(F.lit("in "), (F.col("p_size") + 1970).cast("string"))
    entries = F.array(text("= ", "p_name"), text("= confidence 0.", "p_size", "= "), F.lit(""), text("=the  score  of a ", "p_brand"), year, text("p_size", "=% sure\n of it"), text("=scores of ", "p_type"), F.when(F.col("p_partkey") % 3 == 0, "P =0.05").otherwise("  "))
    kept, dropped = X.clean_qualifiers(F.when(F.col("p_partkey") % 11 != 0, entries))
    return table(spark, d, "part").select("p_partkey", F.array_join(kept, "|").alias("kept"), F.array_join(dropped, "|").alias("dropped"))


FLAT = "trim(regexp_replace(answer_text, '\\s+', ' ', 'g'))"


@query(f"WITH {ANSWERS_SQL}, f AS (SELECT query_id, {FLAT} AS t FROM a), g AS (SELECT *, strpos(t, '. ') AS x, strpos(t, '? ') AS y, strpos(t, '! ') AS z FROM f) SELECT query_id, CASE WHEN x BETWEEN 1 AND 96 THEN substr(t, 1, x) WHEN y BETWEEN 1 AND 96 THEN substr(t, 1, y) WHEN z BETWEEN 1 AND 96 THEN substr(t, 1, z) WHEN length(t) > 96 THEN substr(t, 1, 96) || '...' ELSE t END AS first FROM g")
def first_sentence(spark, d):
    return answers(spark, d).select("query_id", X.first_sentence(F.col("answer_text")).alias("first"))


def _citations(spark, d):
    """Parts as works: a short form that a person wrote down, and the long one that a pattern found."""
    p = table(spark, d, "part")
    year = (F.col("p_size") + 1970).cast("string")
    marked = p.where("p_partkey % 3 = 0").select("p_partkey", F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("No "), F.col("p_brand"))).otherwise(F.concat_ws(" ", F.initcap("p_name"), F.lit("et al."), year)).alias("text"))
    found = p.where("p_partkey % 4 != 1").select("p_partkey", F.when(F.col("p_partkey") % 14 == 0, F.concat(F.lit("no  "), F.upper("p_brand"))).otherwise(F.concat_ws(", ", "p_name", "p_type", year)).alias("text"))
    return marked, found


CITATIONS_SQL = """
m AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'No ' || p_brand ELSE concat_ws(' ', array_to_string([upper(w[1]) || lower(w[2:]) FOR w IN string_split(p_name, ' ')], ' '), 'et al.', p_size + 1970) END AS text FROM part WHERE p_partkey % 3 = 0),
f AS (SELECT p_partkey, CASE WHEN p_partkey % 14 = 0 THEN 'no  ' || upper(p_brand) ELSE concat_ws(', ', p_name, p_type, p_size + 1970) END AS text FROM part WHERE p_partkey % 4 <> 1),
sm AS (SELECT DISTINCT text, lower(regexp_replace(text, '\\s+', ' ', 'g')) AS plain, list_distinct([lower(x) FOR x IN regexp_extract_all(text, '\\b([A-Za-z][A-Za-z]{3,}|(?:19|20)\\d{2})\\b')]) AS sig FROM m),
sf AS (SELECT DISTINCT text, lower(regexp_replace(text, '\\s+', ' ', 'g')) AS plain, list_distinct([lower(x) FOR x IN regexp_extract_all(text, '\\b([A-Za-z][A-Za-z]{3,}|(?:19|20)\\d{2})\\b')]) AS sig FROM f),
same AS (SELECT sm.text AS a, sf.text AS b FROM sm, sf WHERE CASE WHEN len(sm.sig) = 0 OR len(sf.sig) = 0 THEN sm.plain = sf.plain ELSE list_has_all(sf.sig, sm.sig) OR list_has_all(sm.sig, sf.sig) END)"""


@query(f"WITH {CITATIONS_SQL} SELECT a AS text, count(*) AS forms FROM same GROUP BY a")
def citation_overlap(spark, d):
    """How many found forms name the same work as each marked one: a containment join on the rarest token."""
    marked, found = _citations(spark, d)
    return joins.same_citations(marked, found).groupBy("text").agg(F.count(F.lit(1)).alias("forms"))


@query(f"WITH {CITATIONS_SQL}, r AS (SELECT 'recall' AS measure, count(*) FILTER (text IN (SELECT a FROM same)) AS hits, count(*) AS n FROM m UNION ALL SELECT 'precision', count(*) FILTER (text IN (SELECT b FROM same)), count(*) FROM f) SELECT measure, hits, n, {wilson_sql('hits', 'n')} FROM r")
def named_recall(spark, d):
    """Recall and precision of found citations against the marked ones."""
    from provenia.functions.stats import rate_columns

    marked, found = _citations(spark, d)
    same = joins.same_citations(marked, found)

    def share(rows, measure, column):
        known = same.select(F.col(column).alias("text"), F.lit(1).alias("hit")).distinct()
        return rows.join(known, "text", "left").groupBy(F.lit(measure).alias("measure")).agg(F.count("hit").alias("h"), F.count(F.lit(1)).alias("t"))

    return share(marked, "recall", "text").unionByName(share(found, "precision", "other")).select("measure", *rate_columns(F.col("h"), F.col("t")))


@query("SELECT event_id, round((event_id * 3.0::DOUBLE + user_id * 15.0::DOUBLE) / 1e6, 6) AS usd FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 0.0::DOUBLE FROM events WHERE event_id % 2 = 1")
def call_cost(spark, d):
    prices = _values(spark, [("known", 3.0, 15.0)], "model string, per_in double, per_out double")
    calls = table(spark, d, "events").select("event_id", "user_id", F.when(F.col("event_id") % 2 == 0, "known").otherwise("other").alias("model"))
    joined = calls.join(F.broadcast(prices), "model", "left")  # one row per priced model
    return joined.select("event_id", X.call_cost(F.col("event_id"), F.col("user_id"), F.col("per_in"), F.col("per_out")).alias("usd"))


@query("SELECT doc_id, doc_id % 50 = 0 OR n_chars > (CASE WHEN doc_id % 3 = 0 THEN n_chars * 0.9::DOUBLE ELSE n_chars * 0.99::DOUBLE END) * 1.05::DOUBLE AS incomplete FROM documents")
def capture_incomplete(spark, d):
    rendered = F.when(F.col("doc_id") % 3 == 0, F.col("n_chars") * F.lit(0.9)).otherwise(F.col("n_chars") * F.lit(0.99))
    return table(spark, d, "documents").select("doc_id", X.incomplete_capture(F.when(F.col("doc_id") % 50 == 0, 1).otherwise(0), F.col("n_chars"), rendered).alias("incomplete"))


class _Finder:
    """A judge that looks for the claim itself; a token is four characters of the text or one of the claim."""

    def complete(self, document: str, claim: str) -> dict:
        there = claim in document
        return {"verdict": "SUPPORTED" if there else "NOT_FOUND_IN_SOURCE", "span": claim if there else "", "tokens": len(document) // 4 + len(claim)}


@query("""WITH p AS (SELECT doc_id, coalesce(text, '') AS text, CASE WHEN doc_id % 3 = 0 THEN 'nothing of it' ELSE substr(coalesce(text, ''), 5, 20) END AS claim FROM documents WHERE doc_id % 11 <> 0),
c AS (SELECT *, CAST(length(text) // 4 + length(claim) AS BIGINT) AS cost, CAST(doc_id AS VARCHAR) AS claim_id, 'u' || doc_id AS url FROM p),
s AS (SELECT *, coalesce(sum(cost) OVER (PARTITION BY doc_id % 16 ORDER BY url, claim_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 160000 / 16 AS halted FROM c)
SELECT claim_id, CASE WHEN halted THEN '' WHEN contains(text, claim) THEN 'SUPPORTED' ELSE 'NOT_FOUND_IN_SOURCE' END AS verdict, CASE WHEN halted THEN 'budget of 160,000 tokens reached' ELSE '' END AS refusal, CASE WHEN halted THEN 0 ELSE cost END AS tokens, halted FROM s""")
def judged_within_budget(spark, d):
    """All readable documents given to a judge with a budget: what was judged, what was left out."""
    i = F.col("doc_id")
    text = F.coalesce("text", F.lit(""))
    claim = F.when(i % 3 == 0, "nothing of it").otherwise(F.substring(text, 5, 20))
    rows = table(spark, d, "documents").select("doc_id", i.cast("string").alias("claim_id"), F.concat(F.lit("u"), i.cast("string")).alias("url"), claim.alias("claim"), text.alias("text"), F.when(i % 11 == 0, "SOURCE_EMPTY").otherwise("SOURCE_OK").alias("source_code"))
    return judge.judge_metered(rows, _Finder(), 160_000, 16, i % 16).select("claim_id", "verdict", "refusal", "tokens", "halted")
