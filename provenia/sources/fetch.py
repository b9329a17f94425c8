"""Fetching cited pages. Offline by default: a table of stored bodies answers; a live transport is passed in.

Addresses are dealt by host, so one task holds a host's whole queue and paces it; a host with very many addresses is
one queue by intent, because its rate limit is one request at a time.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from urllib.parse import urlsplit
from urllib.robotparser import RobotFileParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenia import codes
from provenia.functions import parse
from provenia.functions import text as X
from provenia.operators.joins import by_seconds, nearest_join
from provenia.session import importable

PAUSE, RETRIES, BACKOFF, TIMEOUT = 1.0, 2, (2.0, 8.0), 20.0
Transport = Callable[[str], tuple[int, dict, bytes]]


def allowed(robots: str | None, url: str, agent: str) -> bool:
    """Unreadable or missing rules allow."""
    if not robots:
        return True
    rules = RobotFileParser()
    rules.parse(robots.splitlines())
    return rules.can_fetch(agent, url)


def fetch_all(urls: DataFrame, transport: Transport, robots: Transport | None = None, agent: str = "provenia", pause: float = PAUSE, sleep=time.sleep) -> DataFrame:
    """(url, status, content_type, encoding, headers, body, attempts, excluded) of each distinct address; never raises for a page."""
    importable(urls.sparkSession)
    names = ["url", "status", "content_type", "encoding", "headers", "body", "attempts", "excluded"]
    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.int32(), pa.bool_()]

    def one(url: str):
        for attempt in range(1, RETRIES + 2):
            try:
                status, headers, body = transport(url)
            except Exception:
                status, headers, body = 0, {}, b""
            if status and status < 500 or attempt > RETRIES:
                break
            sleep(BACKOFF[attempt - 1])
        low = {k.lower(): v for k, v in headers.items()}
        return status, low.get("content-type"), low.get("content-encoding"), " ".join(map(str, low.values())), body, attempt

    def run(batches):
        last: dict[str, float] = {}
        rules: dict[str, str | None] = {}
        for batch in batches:
            rows = []
            for url in batch.column(0).to_pylist():
                host = urlsplit(url).netloc
                if robots and host not in rules:
                    try:
                        rules[host] = robots(url)[2].decode("utf-8", "replace")
                    except Exception:
                        rules[host] = None
                if not allowed(rules.get(host), url, agent):
                    rows.append((url, 0, None, None, "", b"", 0, True))
                    continue
                if (wait := last.get(host, -pause) + pause - time.monotonic()) > 0:
                    sleep(wait)
                last[host] = time.monotonic()
                rows.append((url, *one(url), False))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    host = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return urls.select("url").distinct().repartition(host).mapInArrow(run, "url string, status int, content_type string, encoding string, headers string, body binary, attempts int, excluded boolean")


def stored_transport(pages: dict[str, tuple[int, dict, bytes]]) -> Transport:
    """Answers from a dictionary; anything else is a 404."""
    return lambda url: pages.get(url, (404, {}, b""))


def classify(fetched: DataFrame) -> DataFrame:
    """Adds document_kind, text, raw, text_length, thin and source_code to fetched bodies; one Arrow pass reads them."""
    importable(fetched.sparkSession)
    body = F.decode(F.substring("body", 1, 1024), "iso-8859-1")
    rows = fetched.withColumn("content_type", X.content_type(F.col("content_type")))
    rows = rows.withColumn("document_kind", X.document_kind(F.col("content_type"), F.when(F.coalesce(F.lower("encoding"), F.lit("")).isin("", "identity"), body).otherwise("")))
    rows = rows.withColumn("_t", F.when((F.col("status") == 200) & ~F.col("excluded"), parse.body_texts("body", "encoding", "document_kind")))
    text = F.coalesce(F.col("_t.strict"), F.lit(""))
    bot = F.when(F.octet_length("body") <= codes.BOT_BYTES, X.first_marker(F.concat_ws(" ", "headers", F.decode("body", "iso-8859-1")), codes.BOT_MARKERS))
    code = X.source_code(F.col("status"), bot, F.lit(True), F.col("document_kind"), F.col("_t.refusal"), X.picture_only(F.decode("body", "iso-8859-1"), text), X.wall(text), F.length(text))
    rows = rows.withColumn("source_code", F.when(F.col("excluded"), "SOURCE_ROBOTS_EXCLUDED").otherwise(code))
    thin = (F.col("document_kind") == "html") & X.looks_thin(F.length(text), F.octet_length("body"))
    return rows.select("url", "status", "content_type", "document_kind", "attempts", "source_code", text.alias("text"), F.coalesce(F.col("_t.wide"), F.lit("")).alias("raw"), F.length(text).alias("text_length"), F.coalesce(thin, F.lit(False)).alias("thin"), F.sha2("body", 256).alias("content_sha256"))


def nearest_snapshot(snapshots: DataFrame, pages: DataFrame) -> DataFrame:
    """(url, generated_at, stamp, archived): of an address's snapshots the one nearest in time to when the answer was generated.

    snapshots: url, stamp (yyyyMMddHHmmss), archived. pages: url, generated_at (ISO). Pages without a snapshot are left out.
    """
    left = pages.select("url", "generated_at", F.to_timestamp("generated_at").alias("at"))
    right = snapshots.select("url", "stamp", "archived", F.to_timestamp("stamp", "yyyyMMddHHmmss").alias("taken"))
    rows = nearest_join(left, right, "url", "at", "taken", ["stamp", "archived"], by_seconds(30 * 86400))
    return rows.where("match IS NOT NULL").select("url", "generated_at", "match.stamp", "match.archived")


def original_bytes_url(url):
    """Address of a snapshot's bytes as they were crawled: 'id_' after the first stamp."""
    return F.regexp_replace(url, r"^(.*?/web/\d{14})/", "$1id_/")
