"""Operators around whole captures: limits, drift, labelling pools, replies as captures, rebinding, pages of a labelling session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenia import codes
from provenia.functions import parse
from provenia.functions import text as X
from provenia.operators.ordering import keep_first, keep_last
from provenia.session import importable

MAX_BYTES, MAX_CITATIONS = 8_000_000, 60


def within_limits(captures: DataFrame, citations: DataFrame) -> DataFrame:
    """(capture, passed, why): size, number of citations, and the stored hash of the answer."""
    n = citations.groupBy("capture").agg(F.count(F.lit(1)).alias("n"))
    rows = captures.join(n, "capture", "left")
    why = (
        F.when(F.octet_length("answer_text") > MAX_BYTES, "too large")
        .when(F.coalesce("n", F.lit(0)) > MAX_CITATIONS, "too many citations")
        .when(F.col("answer_sha256") != F.sha2("answer_text", 256), "hash differs")
        .otherwise("")
    )
    return rows.select("capture", (why == "").alias("passed"), why.alias("why"))


def cited_sources(citations: DataFrame, fetched: DataFrame, archived: DataFrame | None = None) -> DataFrame:
    """One row per capture and normalised address, in order of citation, with its code after drift and the drift.

    fetched: url, source_code, text. archived: url, archived (a snapshot's text); without it nothing was checked.
    """
    cited = keep_first(citations.withColumn("url", X.normalise_url(F.col("url"))), ["capture", "url"], ["pos"])
    last = keep_last(fetched, ["url"], "seq")
    rows = cited.select("capture", "pos", "url").join(last.select("url", "source_code", "text"), "url", "left").withColumn("source_code", F.coalesce("source_code", F.lit("")))
    if archived is None:
        return rows.select("capture", "pos", "url", "source_code", F.lit("NOT_CHECKED").alias("drift"))
    rows = rows.join(archived.select("url", "archived"), "url", "left")
    contained, _ = X.containment(X.shingles(F.coalesce("archived", F.lit(""))), X.shingles(F.coalesce("text", F.lit(""))))
    rows = rows.withColumn("drift", X.drift_status(F.col("source_code"), F.col("archived"), contained))
    return rows.select("capture", "pos", "url", F.when(F.col("drift") == "PAGE_REPLACED", "SOURCE_DRIFTED").otherwise(F.col("source_code")).alias("source_code"), "drift")


def label_pool(claims: DataFrame, fetched: DataFrame) -> DataFrame:
    """claim x address with the last known code, UNKNOWN where there is none: what a labeller may be given."""
    last = keep_last(fetched, ["url"], "seq").select("url", "source_code")
    return claims.select("*", F.explode("urls").alias("url")).drop("urls").join(last, "url", "left").withColumn("source_code", F.coalesce("source_code", F.lit("UNKNOWN")))


def eligible(runs: DataFrame) -> DataFrame:
    """Runs that may enter an aggregate: no error, bound to a frozen query, rated, no conflict of vendor. Where a run came from is the publication gate's business."""
    return runs.where((F.coalesce("error", F.lit("")) == "") & (F.col("binding") == "") & F.col("rated") & ~F.col("product").isin(*codes.CONFLICTED_PRODUCTS))


def auditable_denominator(fetched: DataFrame, *keys: str, claim: str = "auditable") -> DataFrame:
    """(keys, auditable, sources): sources that say they could be read. A source of another code that says so is an error."""
    wrong = F.col(claim) & (F.col("source_code") != codes.SOURCE_OK)
    said = F.when(wrong, F.raise_error(F.concat(F.lit("counted as auditable: "), F.col("source_code")))).otherwise(F.col(claim))
    return fetched.groupBy(*keys).agg(F.count_if(said.cast("boolean")).alias("auditable"), F.count(F.lit(1)).alias("sources"))


def captures_from_replies(replies: DataFrame) -> DataFrame:
    """Interface replies as captures: answer text, citations (title or [pos:k] as marker), where each was found."""
    importable(replies.sparkSession)
    rows = replies.select("*", parse.longest_in_json("payload").alias("t"), parse.citations_in_json("payload").alias("c"))
    marked = F.transform("c", lambda c, i: F.struct(F.when(F.trim(c["title"]) != "", F.trim(c["title"])).otherwise(F.concat(F.lit("[pos:"), (i + 1).cast("string"), F.lit("]"))).alias("marker"), c["url"].alias("url"), c["path"].alias("path")))
    return rows.select(*[c for c in replies.columns if c != "payload"], F.lit("api").alias("source"), F.col("t.text").alias("answer_text"), F.col("t.path").alias("answer_path"), marked.alias("citations"), F.sha2("t.text", 256).alias("answer_sha256"))


def rebind(captures: DataFrame, wanted: DataFrame, allow: bool = False) -> DataFrame:
    """New versions of captures with their query: (capture, query_id, history, refused). Another id is refused unless allowed, and then remembered."""
    rows = captures.join(wanted.select("capture", F.col("query_id").alias("_to")), "capture")
    other = (F.coalesce("query_id", F.lit("")) != "") & (F.col("query_id") != F.col("_to"))
    refused = other & F.lit(not allow)
    history = F.when(other & ~refused, F.array_append("history", F.col("query_id"))).otherwise(F.col("history"))
    return rows.select("capture", F.when(refused, F.col("query_id")).otherwise(F.col("_to")).alias("query_id"), history.alias("history"), refused.alias("refused"))


def unfreeze(manifest: DataFrame, file: str, at: str, reason: str) -> tuple[DataFrame, DataFrame]:
    """(what stays frozen, a history row for each query let go)."""
    if not reason:
        raise ValueError("unfreezing needs a reason")
    gone = manifest.where(F.col("file") == file)
    return manifest.where(F.col("file") != file), gone.select("file", "query_id", "hash", F.lit(at).alias("at"), F.lit(reason).alias("reason"))


def marked_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a hand-marked file, without blank ones and comments."""
    return spark.read.text(path).select(F.trim("value").alias("a")).where("a != '' AND NOT a LIKE '#%'")


def with_lookup(rows: DataFrame, key: str, values: dict[str, str], name: str, default: str = "") -> DataFrame:
    """Adds a column from a short fixed table, with a default."""
    found = F.coalesce(*[F.when(F.col(key) == k, F.lit(v)) for k, v in values.items()], F.lit(default))
    return rows.withColumn(name, found)


def named_report(found: DataFrame, citations: DataFrame) -> DataFrame:
    """(capture, named, linked, floor): works named in prose beside the links; naming more than linking is a floor."""
    a = found.groupBy("capture").agg(F.count(F.lit(1)).alias("named"))
    b = citations.groupBy("capture").agg(F.count(F.lit(1)).alias("linked"))
    rows = a.join(b, "capture", "full").fillna(0, ["named", "linked"])
    return rows.select("capture", "named", "linked", (F.col("named") > F.col("linked")).alias("floor"))


def fidelity(dom: DataFrame, api: DataFrame) -> DataFrame:
    """Per answer: addresses shared, in one alone, how much of the text agrees, and a caveat where it hardly does.

    dom, api: answer, urls (array), text.
    """
    rows = dom.select("answer", F.col("urls").alias("u"), F.col("text").alias("t")).join(api.select("answer", F.col("urls").alias("v"), F.col("text").alias("s")), "answer")
    contained, jaccard = X.containment(X.shingles(F.col("t")), X.shingles(F.col("s")))
    size = lambda c: F.size(c).cast("long")
    rows = rows.select("answer", size(F.array_intersect("u", "v")).alias("shared"), size(F.array_except("v", "u")).alias("api_only"), size(F.array_except("u", "v")).alias("dom_only"), F.bround(contained, 4).alias("contained"), F.bround(jaccard, 4).alias("jaccard"))
    return rows.withColumn("caveat", F.when(F.col("jaccard") < 0.3, "two different answers").otherwise(""))


def parity(live: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """(key, only_in): what one of two readings of the same answer has and the other hasn't; nothing where they agree."""
    one, two = (df.select(key).distinct().withColumn(f"_{name}", F.lit(True)) for name, df in (("live", live), ("stored", stored)))
    return one.join(two, key, "full").where("_live IS NULL OR _stored IS NULL").select(key, F.when(F.col("_live"), "live").otherwise("stored").alias("only_in"))


def match_works(mentions: DataFrame, works: DataFrame) -> DataFrame:
    """(mention, candidates, outcome) of named works against a catalogue of works.

    mentions: mention, doi, author, year. works: work, doi, author, year. A mention with a DOI is found by it or not at
    all; any other by its author, an equal key, and a year at most one off, a range on top of it.
    """
    w = works.select(F.col("work").alias("_work"), F.col("doi").alias("_doi"), F.col("author").alias("_author"), F.col("year").alias("_year"))
    direct = mentions.where("doi IS NOT NULL").join(w, F.col("doi") == F.col("_doi"), "left")
    named = mentions.where("doi IS NULL").join(w, (F.col("author") == F.col("_author")) & (F.abs(F.col("year") - F.col("_year")) <= 1), "left")
    n = direct.select("mention", "_work").unionByName(named.select("mention", "_work")).groupBy("mention").agg(F.count("_work").alias("candidates"))
    return n.select("mention", "candidates", F.when(F.col("candidates") == 0, "NOT_FOUND").when(F.col("candidates") == 1, "FOUND").otherwise("AMBIGUOUS").alias("outcome"))


def skip_report(blocks: DataFrame, *keys: str, examples: int = 5) -> DataFrame:
    """What a split skipped, in blocks and in units, one row per key: counts, both rates, whole tables and their cells,
    furniture, factual units (a floor on what was never checked) and the first of them.

    blocks: keys, pos, text, skipped. A claim without any unit counts as one.
    """
    u = F.col("_units")
    rows = blocks.withColumn("_units", X.units(F.col("text")))
    table = F.exists(u, lambda x: x["kind"] == "row")
    cells = F.aggregate(F.filter(u, lambda x: x["kind"] == "row"), F.lit(0).cast("long"), lambda a, x: a + x["cells"])
    told = F.transform(F.filter(u, lambda x: X.looks_factual(x["text"])), lambda x: F.substring(X.blanks(x["text"]), 1, 200))
    rows = rows.select(*keys, "pos", "skipped", F.size(u).alias("_n"), table.alias("_table"), cells.alias("_cells"), F.size(F.filter(u, lambda x: X.is_furniture(x["text"]))).alias("_furniture"), told.alias("_told"))
    gone = F.col("skipped")
    only = lambda c: F.sum(F.when(gone, c).otherwise(0)).cast("long")
    n = rows.groupBy(*keys).agg(
        F.count_if(gone).alias("skipped_blocks"), F.count_if(~gone).alias("claim_blocks"),
        only(F.col("_n")).alias("skipped_units"), F.sum(F.when(~gone, F.greatest("_n", F.lit(1))).otherwise(0)).cast("long").alias("claim_units"),
        F.count_if(gone & F.col("_table")).alias("tables"), only(F.col("_cells")).alias("skipped_cells"),
        only(F.col("_furniture")).alias("furniture"), only(F.size("_told")).alias("factual"),
        F.slice(F.flatten(F.transform(F.array_sort(F.collect_list(F.when(gone & (F.size("_told") > 0), F.struct("pos", F.slice("_told", 1, examples).alias("t"))))), lambda x: x["t"])), 1, examples).alias("examples"),
    )
    rate = lambda a, b: F.when(a + b > 0, F.round(a / (a + b), 10))
    c = F.col
    return n.withColumns({"block_rate": rate(c("skipped_blocks"), c("claim_blocks")), "unit_rate": rate(c("skipped_units"), c("claim_units"))})


def assess(attempts: DataFrame) -> DataFrame:
    """Adversarial documents: whether what was declared before the run came true. attempts: id, holds_if (a code or verdict), source_code, verdict, voided."""
    seen = F.when(F.col("source_code") != codes.SOURCE_OK, F.col("source_code")).when(F.col("voided"), "VOID").otherwise(F.col("verdict"))
    return attempts.select("id", seen.alias("observed"), (seen == F.col("holds_if")).alias("holds"))


def prepare_pages(sample: DataFrame, cached: DataFrame, fetched: DataFrame | None = None) -> DataFrame:
    """(url, code, origin, cached_at, chars, check_available, detail) of each address that a labelling session will meet.

    sample: url, source_code ('' or null: unknown). cached, fetched: url, fetched_at, text (null: the body couldn't be
    decoded); fetched also has source_code. A stored copy wins over a fresh one, for a fresh one isn't what the judge
    read; of several the newest. An address of several codes is taken by the least that is known. A passage can be
    checked against a page that has text and isn't known to be something else than the document. No sample, no rows;
    null addresses count as one address that nothing is stored for.
    """
    code = F.coalesce(F.min(F.nullif("source_code", F.lit(""))), F.lit(""))
    pages = sample.groupBy("url").agg(code.alias("_known"))
    newest = lambda rows, name: rows.groupBy("url").agg(F.max_by(F.struct(*[c for c in ("fetched_at", "text", "source_code") if c in rows.columns]), "fetched_at").alias(name))
    rows = pages.join(newest(cached.select("url", "fetched_at", "text"), "_c"), "url", "left")
    if fetched is None:
        rows = rows.withColumn("_f", F.lit(None).cast("struct<fetched_at: string, text: string, source_code: string>"))
    else:
        rows = rows.join(newest(fetched, "_f"), "url", "left")
    stored = F.col("_c").isNotNull()
    origin = F.when(stored, "cache").when(F.col("_f").isNotNull(), "fetched").otherwise("missing")
    known = F.when((F.col("_known") == "") & ~stored, F.coalesce("_f.source_code", F.lit(""))).otherwise(F.col("_known"))
    text = F.when(stored, F.col("_c.text")).otherwise(F.col("_f.text"))
    rows = rows.select("url", known.alias("code"), origin.alias("origin"), F.when(stored, F.col("_c.fetched_at")).otherwise(F.col("_f.fetched_at")).alias("cached_at"), text.alias("_text"))
    text, here, readable = F.col("_text"), F.col("origin") != "missing", F.col("code").isin("", codes.SOURCE_OK)
    blank = F.trim(F.regexp_replace(text, r"(?U)\s+", " ")) == ""
    detail = (
        F.when(~here, "nothing stored, so nothing can be checked")
        .when(text.isNull(), "stored, and the body could not be decoded")
        .when(blank, "stored, and nothing was extracted from it")
        .when(~readable, F.concat(F.lit("stored, and the source was "), F.col("code")))
        .otherwise("")
    )
    return rows.select("url", "code", "origin", "cached_at", F.coalesce(F.length(text), F.lit(0)).cast("long").alias("chars"), (here & text.isNotNull() & ~blank & readable).alias("check_available"), detail.alias("detail"))
