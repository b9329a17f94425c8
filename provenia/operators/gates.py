"""Refusals as relations: every gate gives rows with passed, code and detail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from provenia import codes
from provenia.functions.text import dropped_evidence, span_present


def has_citations(captures: DataFrame, citations: DataFrame) -> DataFrame:
    """(capture, passed, code): at least one citation, none without an address."""
    n = citations.groupBy("capture").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.trim(F.coalesce("url", F.lit(""))) == "").alias("blank"))
    passed = (F.coalesce("n", F.lit(0)) > 0) & (F.coalesce("blank", F.lit(0)) == 0)
    return captures.join(n, "capture", "left").select("capture", passed.alias("passed"), F.when(passed, "").otherwise(codes.NO_CITATIONS).alias("code"))


def span_outcome(judgements: DataFrame) -> DataFrame:
    """Adds span_verified, predates, voided, void_reason: the verdict's quoted span checked against the page.

    Input: verdict, span, claim, text (extracted), raw (the page's permissive text), archived (null: unknown).
    """
    need = F.col("verdict").isin(*codes.SPAN_REQUIRED)
    rows = judgements.withColumn("span_verified", need & span_present(F.col("span"), F.col("text")))
    known = F.col("archived").isNotNull() & (F.col("archived") != "") & (F.trim("span") != "")
    rows = rows.withColumn("predates", F.when(need & F.col("span_verified") & known, span_present(F.col("span"), F.col("archived"))))
    lost = F.size(dropped_evidence(F.col("claim"), F.col("text"), F.col("raw"))) > 0
    reason = (
        F.when(~F.col("verdict").isin(*codes.VERDICTS), codes.REFUSED)
        .when(~need & lost, codes.SUSPECT)
        .when(need & ~F.col("span_verified"), codes.FABRICATED)
        .when(need & (F.col("predates") == F.lit(False)), codes.ADDED_LATER)
        .otherwise("")
    )
    return rows.withColumn("void_reason", reason).withColumn("voided", F.col("void_reason") != "")


def calibration(runs: DataFrame, gold: DataFrame) -> DataFrame:
    """Each run against its gold set: passed, and every mismatch in ``detail``, joined by '; '.

    runs: run, judge, model, judge_prompt, claim_prompt, split. gold: judge, model, judge_prompt, claim_prompt, splits
    (array), blind (labels), blind_comparable; at most one row.
    """
    g = gold.select(*[F.col(c).alias(f"g_{c}") for c in gold.columns])
    rows = runs.join(F.broadcast(g), F.lit(True), "left")  # one gold set at most
    differs = [F.when(F.col(c) != F.col(f"g_{c}"), F.lit(f"{c} differs")) for c in ("judge", "model", "judge_prompt", "claim_prompt")]
    tests = [
        F.when(F.col("g_judge").isNull(), "no gold set"),
        *differs,
        F.when(~F.array_contains("g_splits", F.col("split")), "split not labelled"),
        F.when(F.col("g_blind") < 1, "no blind label"),
        F.when(F.col("g_blind_comparable") < codes.MIN_BLIND, F.lit(f"fewer than {codes.MIN_BLIND} blind comparable labels")),
    ]
    detail = F.array_join(F.filter(F.array(*tests), lambda x: x.isNotNull()), "; ")
    return rows.select("run", (detail == "").alias("passed"), F.when(detail == "", "").otherwise(codes.NO_CALIBRATION).alias("code"), detail.alias("detail"))


def banned_keys(schema: T.DataType, path: str = "$") -> list[str]:
    """Paths of fields that look like a confidence number; found in the schema, without reading a row."""
    if isinstance(schema, T.StructType):
        own = [f"{path}.{f.name}" for f in schema if any(b in f.name.lower() for b in codes.BANNED_KEYS)]
        return own + [p for f in schema for p in banned_keys(f.dataType, f"{path}.{f.name}")]
    if isinstance(schema, T.ArrayType):
        return banned_keys(schema.elementType, f"{path}[]")
    if isinstance(schema, T.MapType):
        return banned_keys(schema.valueType, f"{path}{{}}")
    return []


def publishable(df: DataFrame) -> DataFrame:
    """The frame itself, or an error that names the fields that may not be published."""
    if bad := banned_keys(df.schema):
        raise ValueError("not publishable: " + ", ".join(bad))
    return df


def freeze_diff(manifest: DataFrame, disk: DataFrame, keys: list[str]) -> DataFrame:
    """added, removed and modified rows between (keys, hash) relations; nothing where they agree."""
    rows = manifest.withColumnRenamed("hash", "was").join(disk.withColumnRenamed("hash", "now"), keys, "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "modified")
    return rows.withColumn("change", change).where("change IS NOT NULL").select(*keys, "change")


#: What may be wrong with a freeze.
FREEZE_PROBLEMS = ("nothing is frozen", "file missing", "added", "removed", "modified", "ready but never frozen")


def freeze_problems(manifest: DataFrame, strata: DataFrame) -> DataFrame:
    """(file, query_id, problem): where the query sets on disk aren't what was frozen; nothing where they are.

    manifest: file, query_id, hash. strata: file, status, query_id, hash. Queries are compared within frozen files only; a
    frozen file that isn't there is one problem, as is a ready file that was never frozen. A draft file may change.
    Without any frozen query there is one row, without a file.
    """
    was = manifest.select("file", "query_id", F.col("hash").alias("was"))
    now = strata.select("file", "query_id", F.col("hash").alias("now"))
    was_files, now_files = was.select("file").distinct(), now.select("file").distinct()
    compared = was.join(now_files, "file", "left_semi").join(now.join(was_files, "file", "left_semi"), ["file", "query_id"], "full")
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "modified")
    changed = compared.select("file", "query_id", change.alias("problem")).where("problem IS NOT NULL")
    none = F.lit(None).cast(manifest.schema["query_id"].dataType).alias("query_id")
    gone = was_files.join(now_files, "file", "left_anti").select("file", none, F.lit("file missing").alias("problem"))
    bare = strata.where("status = 'ready'").select("file").distinct().join(was_files, "file", "left_anti").select("file", none, F.lit("ready but never frozen").alias("problem"))
    empty = manifest.agg(F.count(F.lit(1)).alias("_n")).where("_n = 0").select(F.lit(None).cast("string").alias("file"), none, F.lit("nothing is frozen").alias("problem"))
    return changed.unionByName(gone).unionByName(bare).unionByName(empty)


def require_freeze(manifest: DataFrame, strata: DataFrame, shown: int = 20) -> None:
    """Refuses to go on where a query set isn't what was frozen, naming the first ``shown`` problems."""
    found = freeze_problems(manifest, strata).limit(shown).collect()
    if found:
        raise ValueError("the query sets aren't the frozen ones: " + "; ".join(" ".join(str(x) for x in (r["file"], r["query_id"], r["problem"]) if x is not None) for r in found))


def frozen(manifest: DataFrame, disk: DataFrame) -> DataFrame:
    """(file, query_id) of the queries both frozen and on disk, each in its own file."""
    return manifest.select("file", "query_id").intersect(disk.select("file", "query_id"))


def bind(captures: DataFrame, frozen: DataFrame, on_disk: DataFrame) -> DataFrame:
    """(capture, query_id, binding): '' when frozen, else which of the three ways it isn't."""
    f = frozen.select("query_id", F.lit(True).alias("_frozen")).distinct()
    d = on_disk.select("query_id", F.lit(True).alias("_disk")).distinct()
    rows = captures.join(f, "query_id", "left").join(d, "query_id", "left")
    code = F.when(F.coalesce(F.col("query_id").cast("string"), F.lit("")) == "", codes.BINDINGS[0]).when(F.col("_frozen"), "").when(F.col("_disk"), codes.BINDINGS[1]).otherwise(codes.BINDINGS[2])
    return rows.select("capture", "query_id", code.alias("binding"))


#: Fixed values of the query sets: what a query has to have, may have and may never have.
REQUIRED = ("id", "domain", "text", "cost_of_error", "provenance")
OPTIONAL = ("scrub_notes", "asked_approx")
FORBIDDEN = ("expected", "predicted", "verdict", "gold", "score", "confidence", "hypothesis")
STATUSES = ("draft", "ready")
PROVENANCES = ("synthetic", "real_scrubbed")
LEAST_TEXT, LEAST_COST = 25, 60


def query_violations(queries: DataFrame) -> DataFrame:
    """(file, id, rule) for each rule of the query sets that a query breaks.

    queries: file, status, provenance_policy, id_prefix, domains (array), keys (array of the names a query gives), and
    id, domain, text, cost_of_error, provenance, scrub_notes, asked_approx. A query that lacks a required key is judged
    by its keys alone. An id that several queries have breaks its rule in all but the first by (file, place).
    """
    keys, words = F.col("keys"), lambda c: F.length(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))
    listed = lambda values: F.array(*[F.lit(v) for v in values])
    lacking = F.size(F.array_except(listed(REQUIRED), keys)) > 0
    real = F.col("provenance") == "real_scrubbed"
    first = F.row_number().over(Window.partitionBy("id").orderBy("file", "place")) == 1
    whole = {
        "unknown key": F.size(F.array_except(keys, listed(REQUIRED + OPTIONAL))) > 0,
        "duplicate id": ~F.col("_first"),
        "id without its prefix": ~F.startswith(F.col("id"), F.concat("id_prefix", F.lit("-"))),
        "domain not declared": ~F.array_contains("domains", F.col("domain")),
        "text too short": words(F.col("text")) < LEAST_TEXT,
        "cost of error too short": words(F.col("cost_of_error")) < LEAST_COST,
        "provenance unknown": ~F.col("provenance").isin(*PROVENANCES),
        "provenance against policy": F.col("provenance").isin(*PROVENANCES) & (F.col("provenance") != F.col("provenance_policy")),
        "no scrub notes": real & (words(F.col("scrub_notes")) == 0),
        "no approximate wording": real & (words(F.col("asked_approx")) == 0),
        "synthetic with scrub notes": ~real & (F.coalesce("scrub_notes", F.lit("")) != ""),
    }
    rules = {
        "status unknown": ~F.col("status").isin(*STATUSES),
        "policy unknown": ~F.col("provenance_policy").isin(*PROVENANCES),
        "forbidden key": F.exists(keys, lambda k: F.lower(k).rlike("|".join(FORBIDDEN))),
        "required key missing": lacking,
    } | {name: ~lacking & broken for name, broken in whole.items()}
    broken = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]), lambda x: x.isNotNull())
    return queries.withColumn("_first", first).select("file", "id", F.explode(broken).alias("rule"))


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for each rule that a row breaks."""
    broken = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]), lambda x: x.isNotNull())
    return rows.select(key, F.explode(broken).alias("rule"))


def no_rate_reason(withheld: Column, insufficient: Column) -> Column:
    """Why an answer shows no rate: a list of reasons quotes them, an empty one points elsewhere, null is unknown."""
    return (
        F.when(F.size(withheld) > 0, F.concat(F.lit("withheld: "), F.array_join(withheld, " ")))
        .when(withheld.isNotNull(), "published by the run")
        .when(insufficient, codes.INSUFFICIENT)
        .otherwise("decided by the run")
    )
