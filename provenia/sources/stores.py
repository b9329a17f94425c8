"""Readers and writers of the audit's stored relations: captures, splits, gold sets, query strata, caches, ledgers, runs.

Schemas are closed: JSON is read with an explicit one, and a digest that a document carries is checked against its
content when it is read. Sinks only append.
"""

from __future__ import annotations

import json
import tomllib
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenia import codes
from provenia.functions import parse
from provenia.operators.gates import publishable
from provenia.operators.ordering import keep_last
from provenia.operators.provenance import classified
from provenia.session import importable

CAPTURE = (
    "query_id string, product string, model_id string, generated_at string, captured_at string, source string, answer_text string, "
    "citations array<struct<marker: string, url: string>>, adapter string, adapter_verified boolean, chrome_links_excluded long, "
    "citations_possibly_hidden long, expanders_seen long, rendered_chars long, dom_chars long, page_file string, page_bytes long, answer_sha256 string"
)
SPLIT = "answer_sha256 string, query_id string, product string, created_at string, claim_prompt_version string, judge_class string, judge_model string, claims array<struct<text: string, markers: array<string>>>, skipped array<struct<text: string, reason: string>>, split_sha256 string"
GOLD = (
    "split_sha256s array<string>, split_sha256 string, judge_class string, judge_model string, judge_prompt_version string, claim_prompt_version string, created_at string, labeller string, "
    "labels array<struct<claim_id: string, url: string, label: string, labelled_at: string, labeller: string, blind: boolean, notes: string, human_span: string, extraction_missed: boolean>>, labels_sha256 string"
)
CACHE = "url string, status int, headers map<string, string>, fetched_at string, seq long, content_sha256 string, body binary"
LEDGER = "at string, capture string, status string, outcome string, attempts int, answer_sha256 string, detail string"


def _checked(df: DataFrame, stored: str, own: Column, what: str, written: Column | None = None) -> DataFrame:
    """The rows, or an error at the first whose stored digest is neither of its content's; no digest is no claim.

    A content has a digest of this library's own and, in some kinds, that of its JSON text as it is stored (``written``).
    """
    given = F.col(stored).isNotNull() & (F.col(stored) != "")
    bad = given & (F.col(stored) != own) & (F.lit(True) if written is None else F.col(stored) != written)
    return df.withColumn(stored, F.when(bad, F.raise_error(F.concat(F.lit(f"{what}: digest differs from content: "), F.col(stored)))).when(given, F.col(stored)).otherwise(own))


def quoted(text: Column) -> Column:
    """A string as JSON text: backslash, quotation mark and control characters escaped, all else as it is."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    plain = out
    for n in range(32):
        out = F.replace(out, F.lit(chr(n)), F.lit(json.dumps(chr(n))[1:-1]))
    return F.concat(F.lit('"'), F.when(plain.rlike(r"[\x00-\x1f]"), out).otherwise(plain), F.lit('"'))


def _json(value: Column, kind: str) -> Column:
    if kind == "boolean":
        return F.coalesce(value.cast("string"), F.lit("null"))
    return F.coalesce(quoted(value), F.lit("null"))


def split_digest_written(claims: Column) -> Column:
    """Digest of the claims' JSON text as stored splits have it: keys in order, a blank after colons and commas."""
    one = lambda c: F.concat(F.lit('{"markers": ['), F.array_join(F.transform(c["markers"], quoted), ", "), F.lit('], "text": '), quoted(c["text"]), F.lit("}"))
    return F.sha2(F.concat(F.lit("["), F.array_join(F.transform(claims, one), ", "), F.lit("]")), 256)


LABEL_FIELDS = {"blind": "boolean", "claim_id": "string", "extraction_missed": "boolean", "human_span": "string", "label": "string", "labelled_at": "string", "labeller": "string", "notes": "string", "url": "string"}


def labels_digest_written(labels: Column) -> Column:
    """Digest of a set of labels as stored gold sets have it: each label's JSON text, sorted, as a list of strings.

    A field that a file leaves out has its default: blind true, the other texts empty.
    """
    default = lambda x, name: F.coalesce(x[name], F.lit(True)) if name == "blind" else x[name] if name == "extraction_missed" else F.coalesce(x[name], F.lit(""))
    one = lambda x: F.concat(F.lit("{"), F.concat_ws(", ", *[F.concat(F.lit(f'"{n}": '), _json(default(x, n), k)) for n, k in LABEL_FIELDS.items()]), F.lit("}"))
    return F.sha2(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.transform(labels, one)), quoted), ", "), F.lit("]")), 256)


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """Every capture document of a folder (splits beside them left out); keys that begin with _ aren't read."""
    df = spark.read.schema(CAPTURE).option("multiLine", True).option("mode", "FAILFAST").option("pathGlobFilter", "*.json").option("recursiveFileLookup", True).json(path)
    df = df.where(~F.input_file_name().endswith(".split.json"))
    df = df.withColumns({"source": F.coalesce("source", F.lit("dom")), "query_id": F.coalesce("query_id", F.lit("")), "citations_possibly_hidden": F.coalesce("citations_possibly_hidden", F.lit(0)), "rendered_chars": F.coalesce("rendered_chars", F.lit(0)), "dom_chars": F.coalesce("dom_chars", F.lit(0))})
    return classified(_checked(df, "answer_sha256", F.sha2("answer_text", 256), "capture"), "record")


def citations(captures: DataFrame, key: str = "answer_sha256") -> DataFrame:
    return captures.select(F.col(key).alias("capture"), F.posexplode("citations").alias("pos", "c")).select("capture", "pos", "c.marker", "c.url")


def split_digest(claims: Column) -> Column:
    """Digest of (text, markers) in order; own canonical form, version 1."""
    return F.sha2(F.array_join(F.transform(claims, lambda c: F.concat(c["text"], F.lit("\x1f"), F.array_join(c["markers"], "\x1d"))), "\x1e"), 256)


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema(SPLIT).option("multiLine", True).option("mode", "FAILFAST").option("pathGlobFilter", "*.split.json").json(path)
    df = _checked(df, "split_sha256", split_digest(F.col("claims")), "split", split_digest_written(F.col("claims")))
    return classified(classified(df, "local-evidence"), {"claims": "model-inference"})


def bind_split(captures: DataFrame, splits: DataFrame, claim_prompt: str) -> DataFrame:
    """(answer_sha256, bound, why): a stored split counts for an answer only under the same claim prompt."""
    rows = captures.select("answer_sha256").distinct().join(splits.select("answer_sha256", "claim_prompt_version").distinct(), "answer_sha256", "left")
    why = F.when(F.col("claim_prompt_version").isNull(), "no stored split").when(F.col("claim_prompt_version") != claim_prompt, "split by another claim prompt").otherwise("")
    return rows.select("answer_sha256", (why == "").alias("bound"), why.alias("why"))


def claims_of(captures: DataFrame, splits: DataFrame, claim_prompt: str) -> tuple[DataFrame, DataFrame]:
    """(claims by stored split, captures that a splitter has to split): a capture whose stored split was made under
    another claim prompt is an error, never split afresh."""
    rows = captures.join(splits.select("answer_sha256", F.col("claim_prompt_version").alias("_prompt"), "claims").dropDuplicates(["answer_sha256"]), "answer_sha256", "left")
    other = F.concat(F.lit("split by another claim prompt: "), F.col("answer_sha256"))
    stored = rows.where("_prompt IS NOT NULL").withColumn("claims", F.when(F.col("_prompt") != claim_prompt, F.raise_error(other).cast(rows.schema["claims"].dataType)).otherwise(F.col("claims")))
    claims = stored.select("answer_sha256", F.posexplode("claims").alias("pos", "c")).select("answer_sha256", "pos", "c.text", "c.markers")
    return claims, rows.where("_prompt IS NULL").select(*captures.columns)


def labels_digest(labels: Column) -> Column:
    """Digest of a set of labels, whatever their order."""
    return F.sha2(F.array_join(F.array_sort(F.transform(labels, lambda x: F.sha2(F.to_json(x), 256))), ","), 256)


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold sets with their splits as a list (older ones name a single split) and labels of the known vocabulary."""
    df = spark.read.schema(GOLD).option("multiLine", True).option("mode", "FAILFAST").json(path)
    df = df.withColumn("split_sha256s", F.coalesce("split_sha256s", F.array("split_sha256"))).drop("split_sha256")
    odd = F.filter("labels", lambda x: ~x["label"].isin(*codes.LABELS))
    df = df.withColumn("labels", F.when(F.size(odd) > 0, F.raise_error(F.concat(F.lit("unknown label: "), odd[0]["label"]))).otherwise(F.col("labels")))
    df = _checked(df, "labels_sha256", labels_digest(F.col("labels")), "gold set", labels_digest_written(F.col("labels")))
    return classified(classified(df, "local-evidence"), {"labels": "your-input"})


def read_strata(spark: SparkSession, folder: str) -> DataFrame:
    """Query strata from TOML files, by file name: configuration, so read by the driver."""
    rows = []
    for path in sorted(Path(folder).glob("*.toml")):
        doc = tomllib.loads(path.read_text("utf-8"))
        head = doc.get("stratum", doc)
        rows += [(path.name, head.get("id", ""), head.get("status", ""), q.get("id", ""), q.get("domain", ""), q.get("text", ""), q.get("cost_of_error", ""), q.get("provenance", "")) for q in doc.get("query", doc.get("queries", []))]
    return classified(spark.createDataFrame(rows, "file string, stratum string, status string, query_id string, domain string, text string, cost_of_error string, provenance string"), "your-input")


def query_hash() -> Column:
    flat = lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    return F.sha2(F.concat_ws("\n", "query_id", "domain", flat(F.col("text")), flat(F.col("cost_of_error"))), 256)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(file, query_id, hash) of a freeze manifest."""
    df = spark.read.schema("frozen map<string, struct<frozen_at: string, query_hashes: map<string, string>>>").option("multiLine", True).json(path)
    return classified(df.select(F.explode("frozen").alias("file", "f")).select("file", F.explode("f.query_hashes").alias("query_id", "hash")), "local-evidence")


def freeze(strata: DataFrame, manifest: DataFrame, at: str, force: bool = False, reason: str = "") -> DataFrame:
    """New manifest rows (file, query_id, hash, frozen_at, reason). Only ready strata; frozen ones only by force with a reason."""
    ready = strata.where("status = 'ready'")
    if force and not reason:
        raise ValueError("freezing again needs a reason")
    if not force:
        ready = ready.join(manifest.select("file").distinct(), "file", "left_anti")
    return ready.select("file", "query_id", query_hash().alias("hash"), F.lit(at).alias("frozen_at"), F.lit(reason).alias("reason"))


def append_cache(entries: DataFrame, path: str) -> None:
    """Appends fetched bodies, dealt into folders by the first byte of the address's hash."""
    entries.withColumn("shard", F.substring(F.sha2("url", 256), 1, 2)).write.mode("append").partitionBy("shard").parquet(path)


def read_cache(spark: SparkSession, path: str, url: str | None = None) -> DataFrame:
    """The cache; with ``url`` only the folder that can hold it is read."""
    df = spark.read.parquet(path)
    df = classified(df, "local-evidence")
    return df if url is None else df.where((F.col("shard") == F.substring(F.sha2(F.lit(url), 256), 1, 2)) & (F.col("url") == url))


def latest_cached(cache: DataFrame) -> DataFrame:
    return keep_last(cache, ["url"], "fetched_at", "seq")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Last entry of each capture; lines that aren't JSON are skipped."""
    df = spark.read.schema(LEDGER).option("mode", "DROPMALFORMED").json(path).where("capture IS NOT NULL")
    place = df.withColumn("seq", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))
    return classified(keep_last(place, ["capture"], "seq").drop("seq"), "record")


def read_replies(spark: SparkSession, path: str) -> DataFrame:
    """Stored interface replies as they came: (path, payload)."""
    return classified(spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path).select(F.input_file_name().alias("path"), F.col("value").alias("payload")), "record")


VERDICT_KEYS = ("verdict", "verdicts", "judgement", "judgements", "span_verified", "void_reason", "judged")


def prior_artefacts(spark: SparkSession, answers: DataFrame, roots: list[str]) -> DataFrame:
    """(path, answer_sha256, key, outcome): files under the roots that name an answer and carry a verdict, or can't be read.

    The hashes that a file names are joined to those of the answers; only files that hit are parsed. outcome: 'prior'
    with the verdict's key, or 'not checked' where the file isn't readable JSON, nor a page that holds some.
    """
    importable(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{json,html}").load(roots).select("path", F.decode("content", "utf-8").alias("text"))
    named = files.select("path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("(?<![0-9a-f])([0-9a-f]{64})(?![0-9a-f])"), F.lit(1)))).alias("answer_sha256"))
    hits = named.join(answers.select("answer_sha256").distinct(), "answer_sha256")
    read = files.join(hits.select("path").distinct(), "path").select("path", parse.first_key_in(VERDICT_KEYS)("text").alias("key"))
    found = hits.join(read, "path").select("path", "answer_sha256", F.coalesce("key", F.lit("")).alias("key"), F.when(F.col("key").isNull(), "not checked").otherwise("prior").alias("outcome"))
    return found.where("key != '' OR outcome = 'not checked'")


def blind_inputs(spark: SparkSession, path: str) -> DataFrame:
    """(path, key): files that a labeller may not be given, for a judge's key is present in them, whatever its value."""
    importable(spark)
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(path)
    return files.select(F.input_file_name().alias("path"), parse.first_key_in(VERDICT_KEYS, truthy=False)("value").alias("key")).where("key != ''")


def write_run(rates: DataFrame, folder: str, readout: str | DataFrame = "", trace: DataFrame | None = None) -> None:
    """Appends a run's figures, its readout (one text, or a relation with ``line``) and its trace, after the gate on field names."""
    publishable(rates)
    if trace is not None:
        publishable(trace).write.mode("append").parquet(f"{folder}/trace")
    rates.write.mode("append").parquet(f"{folder}/rates")
    if isinstance(readout, DataFrame):
        publishable(readout).write.mode("append").json(f"{folder}/readout_lines")
    elif readout:
        rates.sparkSession.createDataFrame([(readout,)], "value string").coalesce(1).write.mode("append").text(f"{folder}/readout")


def report_payload(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """One JSON document per answer: claims with state and their sources, and counts by state.

    claims: answer, claim_id, text, state. sources: claim_id, url, code, verdict, span. Spans pass the field gate
    because the gate is on names.
    """
    per_claim = sources.groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("url", "code", "verdict", "span"))).alias("sources"))
    rows = claims.join(per_claim, "claim_id", "left")
    counts = claims.groupBy("answer", "state").agg(F.count(F.lit(1)).alias("n")).groupBy("answer").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("state", "n")))).alias("counts"))
    nested = rows.groupBy("answer").agg(F.array_sort(F.collect_list(F.struct("claim_id", "text", "state", "sources"))).alias("claims")).join(counts, "answer")
    return publishable(nested).select("answer", F.to_json(F.struct("answer", "claims", "counts")).alias("payload"))


def to_html(payload: str) -> str:
    """A page that embeds a report; the data can't close its script element early."""
    return f'<!doctype html><meta charset="utf-8"><script type="application/json" id="report">{json.dumps(json.loads(payload), ensure_ascii=False).replace("</", "<\\/")}</script>'
