"""Queries of the document parsers, JSON walks, bodies and the capture queue. Python runs only here, in Arrow batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from provenia.functions import parse, reading
from provenia.functions import text as X
from provenia.operators import lookup
from provenia.operators.ordering import keep_first
from provenia.plans.catalogue import query
from provenia.plans.standins import ANSWERS_SQL, answers, table
from provenia.session import importable


@query()
def html_text_parsed(spark, d):
    """Text of the pages by a parser, strict and wide, with what a reader of the strict text would miss."""
    importable(spark)
    rows = table(spark, d, "pages").select("page_id", F.octet_length("html").cast("long").alias("html_bytes"), parse.html_texts("html").alias("t"))
    return rows.select("page_id", F.col("t.strict").alias("strict"), F.length("t.wide").cast("long").alias("wide_chars"), X.looks_thin(F.length("t.strict"), F.col("html_bytes")).alias("thin"))


def _containers(spark, d):
    importable(spark)
    find = parse.containers_in(["article", "main", "div p", "body"])
    # the test pages link to nothing outside: a passage with citations stands after each
    html = F.concat("html", F.lit(LINKED), F.col("page_id").cast("string"), F.lit('">Ministry figures +2</a><span data-pplx-citation-url="https://paper.example.com/a"><span>morning paper</span></span></main>'))
    return table(spark, d, "pages").select("page_id", F.explode(find(html)).alias("c")).select("page_id", "c.*")


LINKED = '<main><p>Said by</p><a href="/inside">x</a><a href="https://stats.ministry.gov.uk/t?utm_source=chat&id='


@query("WITH p AS (SELECT page_id FROM pages) SELECT page_id, 0::INT AS pos, 'Ministry figures' AS marker, 'https://stats.ministry.gov.uk/t?utm_source=chat&id=' || page_id AS url, 'ministry.gov.uk' AS domain FROM p UNION ALL SELECT page_id, 1, 'morning paper', 'https://paper.example.com/a', 'example.com' FROM p")
def html_links(spark, d):
    """Links of each page's body, first of each (marker, address)."""
    rows = _containers(spark, d).where("selector = 'main'").select("page_id", F.posexplode("links").alias("pos", "l"))
    return rows.select("page_id", "pos", "l.marker", "l.url", X.registrable_domain(F.col("l.url")).alias("domain"))


@query()
def container_choice(spark, d):
    """The container with most links, then most text, then the first."""
    rows = _containers(spark, d).withColumn("fewer", -F.col("n_links")).withColumn("shorter", -F.col("chars"))
    return keep_first(rows, ["page_id"], ["fewer", "shorter", "seq"]).select("page_id", "selector", "n_links", "chars")


PROSE = "As Okafor et al. (River Ecology, 2019) say (doi 10.5555/fish.7), NCT01020304 and PMID 12345678; a 2008 Harbour Survey report, published in Marine Letters (May 2011). "
_NAMED = [("AUTHOR_ETAL_YEAR", "Okafor et al. (River Ecology, 2019"), ("DOI", "10.5555/fish.7"), ("TRIAL_ID", "NCT01020304"), ("PUBLICATION_ID", "PMID 12345678"), ("YEAR_JOURNAL_STUDY", "2008 Harbour Survey report"), ("PUBLISHED_IN", "published in Marine Letters (May 2011")]
_NAMED_ROWS = ", ".join(f"('{k}', {PROSE.index(t)}::BIGINT, {PROSE.index(t) + len(t)}::BIGINT, '{t}')" for k, t in _NAMED)


@query(f"WITH {ANSWERS_SQL} SELECT query_id, kind, from_char, to_char, said FROM a, (VALUES {_NAMED_ROWS}) v(kind, from_char, to_char, said)")
def named_citations(spark, d):
    """Works named in prose, with offsets; the test answers name none, so a sentence that does stands before each."""
    importable(spark)
    rows = answers(spark, d).select("query_id", F.concat(F.lit(PROSE), F.col("answer_text")).alias("t"))
    return rows.select("query_id", F.explode(parse.named_in("t")).alias("c")).select("query_id", "c.kind", F.col("c.start").alias("from_char"), F.col("c.end").alias("to_char"), F.col("c.text").alias("said"))


@query("SELECT kind, n * k AS named FROM (SELECT count(*) AS n FROM conversations WHERE role = 'assistant'), (VALUES ('AUTHOR_ETAL_YEAR', 1), ('DOI', 1), ('TRIAL_ID', 1), ('PUBLICATION_ID', 1), ('YEAR_JOURNAL_STUDY', 1), ('PUBLISHED_IN', 1)) v(kind, k)")
def named_by_kind(spark, d):
    return named_citations(spark, d).groupBy("kind").agg(F.count(F.lit(1)).alias("named"))


def replies(spark, d):
    """Pages as interface replies: the page cited by an annotation, twice; every third reply lists another address bare."""
    k = F.col("page_id")
    address = F.concat(F.lit("https://p.example/"), k.cast("string"))
    note = F.struct(address.alias("url"), F.concat(F.lit("Page "), k.cast("string")).alias("title"))
    output = F.array(F.struct(F.concat(F.lit("Said of page "), k.cast("string")).alias("text"), F.array(note, note).alias("annotations")))
    bare = F.when(k % 3 == 0, F.array(F.concat(F.lit("https://q.example/"), k.cast("string")), F.lit("no address")))
    return table(spark, d, "pages").select(k.alias("reply"), F.to_json(F.struct(output.alias("output"), bare.alias("citations"))).alias("payload"))


@query("SELECT page_id AS reply, 'https://p.example/' || page_id AS url, 'Page ' || page_id AS title, '$.output[0].annotations[0]' AS path FROM pages UNION ALL SELECT page_id, 'https://q.example/' || page_id, '', '$.citations[0]' FROM pages WHERE page_id % 3 = 0")
def json_walk_citations(spark, d):
    importable(spark)
    rows = replies(spark, d)
    return rows.select("reply", F.explode(parse.citations_in_json("payload")).alias("c")).select("reply", "c.*")


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, '$.k' AS path FROM events")
def json_fixed_path(spark, d):
    """At a fixed depth a reply needs no walk: a variant path stays in the JVM."""
    return table(spark, d, "events").select("event_id", F.try_variant_get(F.parse_json("props"), "$.k", "string").alias("k"), F.lit("$.k").alias("path"))


@query("SELECT page_id AS reply, 'Said of page ' || page_id AS text, '$.output[0].text' AS path FROM pages")
def json_longest_text(spark, d):
    importable(spark)
    rows = replies(spark, d)
    return rows.select("reply", parse.longest_in_json("payload").alias("t")).select("reply", "t.*")


@query("SELECT doc_id, replace(strip_accents(lower(trim(regexp_replace(text, '\\s+', ' ', 'g')))), 'ß', 'ss') AS folded FROM documents")
def fold_full_text(spark, d):
    importable(spark)
    rows = table(spark, d, "documents")
    return rows.select("doc_id", parse.fold_text("text").alias("folded"))


@query("SELECT conv_id, turn, CASE WHEN length(text) > 60 AND substr(text, 6, 1) NOT IN (' ', chr(10)) AND substr(text, 35, 1) NOT IN (' ', chr(10)) THEN CAST(strpos(text, substr(text, 6, 30)) - 1 AS BIGINT) END AS start FROM conversations WHERE role = 'assistant'")
def claim_offsets(spark, d):
    """Where a claim stands in its answer: 30 characters of it, between blanks none, found again by folding; none, no place."""
    importable(spark)
    rows = answers(spark, d)
    claim = F.expr("CASE WHEN length(answer_text) > 60 AND substr(answer_text, 6, 1) NOT IN (' ', chr(10)) AND substr(answer_text, 35, 1) NOT IN (' ', chr(10)) THEN substr(answer_text, 6, 30) ELSE '' END")
    found = parse.locate_claim("answer_text", claim)
    return rows.select("conv_id", "turn", found["start"].alias("start"))


_PLAIN = "trim(regexp_replace(regexp_replace(coalesce(text, ''), '[<>&|]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"""WITH x AS (SELECT doc_id, length({_PLAIN}) AS n, doc_id % 6 AS way FROM documents)
SELECT doc_id, CAST(CASE way WHEN 0 THEN n WHEN 3 THEN n + 2 WHEN 5 THEN n END AS INT) AS chars, CASE way WHEN 1 THEN 'SOURCE_EMPTY' WHEN 2 THEN 'SOURCE_NOT_HTML' WHEN 4 THEN 'SOURCE_NO_TEXT_LAYER' END AS refusal FROM x""")
def body_readings(spark, d):
    """Documents as stored bodies, read by the routing of the fetcher: a page, one in an unknown encoding, a broken
    archive, XML with a title, a PDF without text, a page with furniture around it."""
    importable(spark)
    text = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), "[<>&|]", " "), r"\s+", " "))
    page = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts]).cast("binary")
    ways = [
        ("html", None, page("<html><body><article><p>", text, "</p></article></body></html>")), ("html", "br", page("<p>", text)), ("docx", None, page("PK", text)),
        ("xml", None, page("<rss><title>T</title><d>", text, "</d></rss>")), ("pdf", None, page("%PDF-1.4 nothing")), ("html", None, page("<nav>menu</nav><script>x</script><p>", text, "</p><footer>end")),
    ]
    dealt = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(e).cast("string").alias("encoding"), b.alias("body")) for k, e, b in ways])
    rows = table(spark, d, "documents").select("doc_id", F.element_at(dealt, (F.col("doc_id") % 6 + 1).cast("int")).alias("w")).select("doc_id", "w.*")
    return rows.select("doc_id", parse.body_texts("body", "encoding", "kind").alias("t")).select("doc_id", F.length("t.strict").alias("chars"), F.col("t.refusal").alias("refusal"))


@query(f"WITH {ANSWERS_SQL} SELECT DISTINCT sha256(answer_text) AS answer_sha256, 'ok' AS status, 1::INT AS attempts FROM a")
def capture_stream_queue(spark, d):
    """Assistant turns as a stream of capture files: each answer once, drained by a trigger that ends."""
    from provenia.streaming.queue import drain

    return drain(answers(spark, d)).drop("capture")


@query(f"WITH {ANSWERS_SQL}, k AS (SELECT DISTINCT answer_text, length(answer_text) % 5 + 1 AS k FROM a) SELECT sha256(answer_text) AS answer_sha256, CASE WHEN k <= 3 THEN 'ok' ELSE 'failed' END AS status, CAST(least(k, 3) AS INT) AS attempts FROM k")
def capture_retry_queue(spark, d):
    """The queue over several runs of one checkpoint: captures drop in two parts, and an answer passes at its first to fifth attempt, by its length."""
    from provenia.streaming.queue import drain

    passes = F.col("attempts") > F.length("answer_text") % 5
    return drain(answers(spark, d), lambda rows: rows.select("answer_sha256", F.when(passes, "ok").otherwise("failed").alias("status")), drops=2).drop("capture")


#: One part in so many names is said in a turn; the catalogue is the whole table of parts.
_SAID = "CASE WHEN turn % 5 = 0 THEN 'See 10.1234/p' || (conv_id * 7 % 5000) WHEN turn % 5 = 4 THEN 'See NCT' || lpad(CAST(conv_id % 1000 AS VARCHAR), 8, '0') || '.' ELSE 'See ' || w.author || ' et al., ' || w.title || ', ' || (w.year + CASE WHEN turn % 3 = 0 THEN 7 ELSE 1 END) || '.' END"
_WORKS = "works AS (SELECT p_partkey AS work, p_name || ' no' || p_partkey // 3 AS title, 'Sur' || chr(CAST(97 + p_partkey % 26 AS INT)) || chr(CAST(97 + p_size % 26 AS INT)) AS author, 1950 + p_partkey % 60 AS year, '10.1234/p' || p_partkey AS doi FROM part)"
_TERMS = "list_distinct(regexp_extract_all(lower({}), '[a-z0-9]+'))"


@query(f"""WITH {_WORKS}, {ANSWERS_SQL}, n AS (SELECT max(work) + 1 AS n FROM works),
q AS (SELECT query_id, turn, (conv_id * 31 + turn * 7) % (SELECT n FROM n) AS k, conv_id FROM a),
s AS (SELECT query_id, rtrim({_SAID}, '.') AS sentence, turn, conv_id FROM q JOIN works w ON w.work = q.k),
f AS (SELECT query_id, turn, conv_id, substr(sentence, 5) AS said FROM s),
m AS (SELECT DISTINCT said, turn % 5 = 0 AS by_doi, turn % 5 = 4 AS trial FROM f),
i AS (SELECT work, unnest({_TERMS.format("title || ' ' || author || ' ' || year")}) AS term FROM works),
g AS (SELECT term, count(*) AS n, length(bin((SELECT count(*) FROM works) // count(*))) AS weight FROM i GROUP BY 1),
t AS (SELECT said, term, n, weight FROM (SELECT said, unnest({_TERMS.format('said')}) AS term FROM m WHERE NOT by_doi) JOIN g USING (term)),
asked AS (SELECT said, term FROM t QUALIFY row_number() OVER (PARTITION BY said ORDER BY n, term) <= 4),
c AS (SELECT DISTINCT said, work FROM asked JOIN i USING (term)),
r AS (SELECT said, work, sum(weight) AS score FROM c JOIN t USING (said) JOIN i USING (work, term) GROUP BY said, work QUALIFY row_number() OVER (PARTITION BY said ORDER BY score DESC, work) <= 5),
h AS (SELECT said, work FROM r JOIN works w USING (work) WHERE NOT starts_with(said, 'NCT') AND lower(w.author) = lower(split_part(said, ' ', 1)) AND abs(w.year - CAST(right(said, 4) AS INT)) <= 1
  UNION ALL SELECT said, work FROM m JOIN works w ON m.by_doi AND w.doi = said),
o AS (SELECT said, count(work) AS k, min(work) AS work FROM (SELECT DISTINCT said FROM m) LEFT JOIN h USING (said) GROUP BY 1)
SELECT query_id AS capture, said, CASE WHEN starts_with(said, 'NCT') THEN 'CITATION_LOOKUP_FAILED' WHEN k = 0 THEN 'CITATION_NOT_FOUND' WHEN k = 1 THEN 'CITATION_RESOLVED' ELSE 'CITATION_AMBIGUOUS' END AS outcome, k AS candidates, CASE WHEN k = 1 THEN work END AS work FROM f JOIN o USING (said)""")
def named_lookup(spark, d):
    """From text to outcome: works named in every assistant turn against the whole table of parts as a catalogue."""
    works = _works(spark, d)
    last = works.agg(F.max("work")).scalar()
    rows = answers(spark, d).withColumn("k", (F.col("conv_id") * 31 + F.col("turn") * 7) % (last + 1))
    w = works.select(F.col("work").alias("k"), F.concat(F.lit("See "), F.element_at("authors", 1), F.lit(" et al., "), "title", F.lit(", ")).alias("head"), "year")
    turn = F.col("turn")
    named = F.concat("head", (F.col("year") + F.when(turn % 3 == 0, 7).otherwise(1)).cast("string"), F.lit(". "))
    doi = F.concat(F.lit("See 10.1234/p"), (F.col("conv_id") * 7 % 5000).cast("string"), F.lit(" as said. "))
    trial = F.concat(F.lit("See NCT"), F.lpad((F.col("conv_id") % 1000).cast("string"), 8, "0"), F.lit(". "))
    said = F.when(turn % 5 == 0, doi).when(turn % 5 == 4, trial).otherwise(named)
    told = rows.join(w.hint("merge"), "k").select(F.col("query_id").alias("capture"), F.concat(said, F.lit("\n"), F.coalesce("answer_text", F.lit(""))).alias("answer_text"))
    return lookup.named_existence(told, works).select("capture", "said", "outcome", "candidates", "work")


def _works(spark, d):
    k = F.col("p_partkey")
    letter = lambda c: F.char(F.lit(97) + c % 26)
    author = F.concat(F.lit("Sur"), letter(k), letter(F.col("p_size")))
    title = F.concat("p_name", F.lit(" no"), F.floor(k / 3).cast("string"))
    return table(spark, d, "part").select(k.alias("work"), title.alias("title"), F.array(author).alias("authors"), (k % 60 + 1950).cast("int").alias("year"), F.concat(F.lit("10.1234/p"), k.cast("string")).alias("doi"))


_PARTS = {
    "chatgpt": ('<div data-message-author-role="assistant"><p>Reply ', '</p><a href="https://one.example.net/', '">First note</a><a href="https://claude.ai/x">own</a></div>'),
    "perplexity": ('<section class="prose wide"><p>Found ', '</p><a href="https://two.example.net/', '">Second note</a></section>'),
    "google-ai-overviews": ('<div data-attrid="SrpAIOverviewBox"><p>Shown ', '</p><a href="https://three.example.net/', '">Third note</a></div>'),
}


def _product_pages(spark, d):
    """The stored pages, each followed by an answer in the markup of three products, and read as one of them."""
    k = F.col("page_id").cast("string")
    parts = [x for a, b, c in _PARTS.values() for x in (F.lit(a), k, F.lit(b), k, F.lit(c))]
    product = F.element_at(F.array(*[F.lit(p) for p in _PARTS]), (F.col("page_id") % 3 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", product.alias("product"), F.concat(F.coalesce("html", F.lit("")), *parts).alias("html"))


_PRODUCT = "list_extract(['chatgpt', 'perplexity', 'google-ai-overviews'], CAST(page_id % 3 + 1 AS INT))"


@query(f"SELECT page_id, {_PRODUCT} AS product, 0::INT AS pos, list_extract(['First note', 'Second note', 'Third note'], CAST(page_id % 3 + 1 AS INT)) AS marker, 'https://' || list_extract(['one', 'two', 'three'], CAST(page_id % 3 + 1 AS INT)) || '.example.net/' || page_id AS url FROM pages")
def adapter_links(spark, d):
    """Links of each product's answers, by the table function from SQL with the product's own selectors."""
    reading.register(spark)
    return spark.sql("SELECT page_id, product, r.* FROM {pages}, LATERAL read_page(html, 'links', product) r", pages=_product_pages(spark, d))


@query(f"SELECT page_id, {_PRODUCT} AS product, 0::INT AS seq, list_extract(['[data-message-author-role=\"assistant\"]', '.prose', '[data-attrid*=\"AIOverview\"]'], CAST(page_id % 3 + 1 AS INT)) AS selector, 1::INT AS n_links FROM pages")
def adapter_containers(spark, d):
    """Containers of each product's answers, by the table function from SQL."""
    reading.register(spark)
    return spark.sql("SELECT page_id, product, r.seq, r.selector, r.n_links FROM {pages}, LATERAL read_page(html, 'containers', product) r", pages=_product_pages(spark, d))
