"""The unit of every rate: a claim with one cited page. Built by joins, never in the driver.

Relations: claims (claim_id, urls array, ...), fetches (url, source_code), judgements (claim_id, url, verdict,
voided, void_reason). A column ``seq`` says which of several rows for a key came last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenia import codes
from provenia.functions.stats import rate_columns
from provenia.functions.text import registrable_domain
from provenia.operators.ordering import keep_first, keep_last


def build_pairs(claims: DataFrame, fetches: DataFrame, judgements: DataFrame) -> DataFrame:
    """claim x url, with the last fetch code and the last judgement; what is missing is ''."""
    pairs = claims.select("*", F.explode("urls").alias("url")).drop("urls")
    fetched = keep_last(fetches, ["url"], "seq").select("url", "source_code")
    judged = keep_last(judgements, ["claim_id", "url"], "seq").select("claim_id", "url", "verdict", "voided", "void_reason")
    joined = pairs.join(fetched, "url", "left").join(judged, ["claim_id", "url"], "left")
    return joined.fillna("", ["source_code", "verdict", "void_reason"]).fillna(False, ["voided"])


def judgeable(claims: DataFrame, fetches: DataFrame) -> DataFrame:
    """Only pairs whose page could be read reach a judge."""
    pairs = claims.select("*", F.explode("urls").alias("url")).drop("urls")
    return pairs.join(fetches.where(auditable()), "url")


def marker_urls(claims: DataFrame, citations: DataFrame) -> DataFrame:
    """(claim_id, urls): the addresses behind a claim's markers, distinct, in order of marker, then citation."""
    norm = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    marks = claims.select("claim_id", "capture", F.posexplode("markers").alias("at", "mark")).withColumn("mark", norm(F.col("mark")))
    named = citations.select("capture", norm(F.col("marker")).alias("mark"), "pos", "url")
    hits = keep_first(marks.join(named, ["capture", "mark"]), ["claim_id", "url"], ["at", "pos"])
    lists = hits.groupBy("claim_id").agg(F.sort_array(F.collect_list(F.struct("at", "pos", "url"))).alias("u"))
    return claims.select("claim_id").join(lists, "claim_id", "left").select("claim_id", F.coalesce(F.col("u.url"), F.array().cast("array<string>")).alias("urls"))


def auditable(code: str = "source_code") -> Column:
    return F.col(code) == codes.SOURCE_OK


def standing() -> Column:
    """A verdict that counts: the page was read, there is a verdict, and it isn't voided."""
    return auditable() & (F.col("verdict") != "") & ~F.col("voided")


def supported() -> Column:
    return standing() & (F.col("verdict") == "SUPPORTED")


def support_rate(pairs: DataFrame, *keys: str) -> DataFrame:
    n = pairs.groupBy(*keys).agg(F.count_if(supported()).alias("_h"), F.count_if(standing()).alias("_n"))
    return n.select(*keys, *rate_columns(F.col("_h"), F.col("_n")))


def unauditable_rate(pairs: DataFrame, *keys: str) -> DataFrame:
    n = pairs.groupBy(*keys).agg(F.count_if(~standing()).alias("_h"), F.count(F.lit(1)).alias("_n"))
    return n.select(*keys, *rate_columns(F.col("_h"), F.col("_n")))


def fabricated_rate(pairs: DataFrame, *keys: str) -> DataFrame:
    """Spans that aren't in the page, over all verdicts that need one, voided ones included."""
    need = F.col("verdict").isin(*codes.SPAN_REQUIRED)
    n = pairs.groupBy(*keys).agg(F.count_if(need & F.col("voided") & (F.col("void_reason") == codes.FABRICATED)).alias("_h"), F.count_if(need).alias("_n"))
    return n.select(*keys, *rate_columns(F.col("_h"), F.col("_n")))


def drift_rate(drifts: DataFrame, *keys: str) -> DataFrame:
    """Changed pages over those compared; replaced and unknown ones are counted beside it."""
    status = F.col("drift")
    n = drifts.groupBy(*keys).agg(
        F.count_if(status == "PAGE_CHANGED").alias("_h"),
        F.count_if(status.isin("NONE", "PAGE_CHANGED", "PAGE_REPLACED")).alias("_n"),
        F.count_if(status == "PAGE_REPLACED").alias("replaced"),
        F.count_if(status.isin("NO_SNAPSHOT", "NOT_CHECKED")).alias("unknown"),
    )
    return n.select(*keys, *rate_columns(F.col("_h"), F.col("_n")), "replaced", "unknown")


def per_claim(pairs: DataFrame, *keys: str) -> DataFrame:
    return pairs.groupBy(*keys, "claim_id").agg(F.bool_or(standing()).alias("measured"), F.bool_or(supported()).alias("supported"))


def claim_level_rate(pairs: DataFrame, *keys: str) -> DataFrame:
    """Claims that some page supports, over claims that some page measures."""
    n = per_claim(pairs, *keys).groupBy(*keys).agg(F.count_if("supported").alias("_h"), F.count_if("measured").alias("_n"))
    return n.select(*keys, *rate_columns(F.col("_h"), F.col("_n")))


def insufficient(pairs: DataFrame, *keys: str) -> DataFrame:
    """(keys, claims, measured, insufficient): half of the claims or more unmeasured, or no claim."""
    n = per_claim(pairs, *keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("claims"), F.count_if("measured").alias("measured"))
    return n.withColumn("insufficient", F.col("measured") * 2 <= F.col("claims"))


def verdict_key() -> Column:
    """What a pair is counted under. A refusal's own words stay out of the keys."""
    reason = F.when(F.col("void_reason").isin(codes.FABRICATED, codes.SUSPECT, codes.ADDED_LATER), F.col("void_reason")).otherwise(codes.REFUSED)
    return (
        F.when(F.col("source_code") == "", "NOT_FETCHED")
        .when(~auditable(), F.col("source_code"))
        .when(F.col("verdict") == "", "NOT_JUDGED")
        .when(F.col("voided"), F.concat(F.lit("VOID:"), reason))
        .otherwise(F.col("verdict"))
    )


def verdict_counts(pairs: DataFrame, *keys: str) -> DataFrame:
    return pairs.groupBy(*keys, verdict_key().alias("key")).agg(F.count(F.lit(1)).alias("pairs"))


def void_counts(judgements: DataFrame) -> DataFrame:
    key = F.coalesce(F.nullif("void_reason", F.lit("")), F.col("verdict"))
    return judgements.where("verdict != ''").groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("judgements"))


def by_domain(pairs: DataFrame, domain: str, reasons: Column | None = None, floor: int = codes.MIN_STANDING) -> DataFrame:
    """One row per publisher, largest first. Below the floor of standing pairs, or with a reason, the value is null and says why."""
    n = pairs.groupBy(F.when(F.col(domain) == "", "(no domain)").otherwise(F.col(domain)).alias("domain")).agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(standing()).alias("standing"), F.count_if(~standing()).alias("unauditable"), F.count_if(supported()).alias("_h")
    )
    why = F.coalesce(reasons if reasons is not None else F.lit(None).cast("string"), F.when(F.col("standing") < floor, F.lit(f"fewer than {floor} standing pairs")))
    rated = n.withColumn("refused", why).select("domain", "pairs", "standing", "unauditable", "refused", *rate_columns(F.col("_h"), F.col("standing")))
    shown = [F.when(F.col("refused").isNull(), F.col(c)).alias(c) for c in ("value", "lo", "hi")]
    return rated.select("domain", "pairs", "standing", "unauditable", "hits", *shown, F.coalesce("refused", F.lit("")).alias("refused")).orderBy(F.desc("pairs"), "domain")


def domain_maps(pairs: DataFrame, url: str = "url") -> DataFrame:
    """(domain, verdicts, reasons) by the registrable domain of the address: how many standing pairs of each verdict, and
    how many others of each reason (void reason, else source code, else 'not judged'). Both maps have closed key sets,
    but for a refusal's own words."""
    return domain_report(pairs, url).select("domain", "verdicts", "reasons")


def domain_report(pairs: DataFrame, url: str = "url", calibration: str | None = None, floor: int = codes.MIN_STANDING) -> DataFrame:
    """One relation per publisher, the busiest first: pairs, standing, unauditable, both maps of ``domain_maps``, the
    rate with its interval, and why there is none.

    calibration: '' when the judge's gate passed, else the gate's own words, null where none was supplied. The gate is a
    fact about the run, so it is named before the floor of standing pairs. Counts and maps are shown whatever is refused.
    One shuffle by (domain, key) carries everything; what follows has a row per domain and key.
    """
    domain = F.coalesce(F.nullif(registrable_domain(F.col(url)), F.lit("")), F.lit("(no domain)"))
    reason = F.coalesce(F.nullif("void_reason", F.lit("")), F.when(~auditable(), F.nullif("source_code", F.lit(""))), F.lit("not judged"))
    key = F.when(standing(), F.col("verdict")).otherwise(reason)
    n = pairs.groupBy(domain.alias("domain"), standing().alias("_stands"), key.alias("_key")).agg(F.count(F.lit(1)).alias("_n"), F.count_if(supported()).alias("_hits"))
    held = lambda stands: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("_stands") == stands, F.struct("_key", "_n")))))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    stands = F.when(F.col("_stands"), F.col("_n"))
    rows = n.groupBy("domain").agg(total("_n").alias("pairs"), total(stands).alias("standing"), total(F.when(~F.col("_stands"), F.col("_n"))).alias("unauditable"), held(True).alias("verdicts"), held(False).alias("reasons"), total("_hits").alias("_h"))
    gate = "no calibration supplied" if calibration is None else calibration
    why = F.lit(gate) if gate else F.when(F.col("standing") < floor, F.lit(f"fewer than {floor} standing pairs"))
    rated = rows.withColumn("refused", why).select("domain", "pairs", "standing", "unauditable", "verdicts", "reasons", "refused", *rate_columns(F.col("_h"), F.col("standing")))
    shown = [F.when(F.col("refused").isNull(), F.col(c)).alias(c) for c in ("value", "lo", "hi")]
    return rated.select("domain", "pairs", "standing", "unauditable", "verdicts", "reasons", "hits", *shown, F.coalesce("refused", F.lit("")).alias("refused")).orderBy(F.desc("pairs"), "domain")


def report_counts(pairs: DataFrame, claims: DataFrame, *keys: str) -> DataFrame:
    """(keys, claims, unlocatable, pairs, standing, unauditable, multi_source_claims, partial_without_qualifiers) of a report.

    claims: keys, claim_id, located. pairs: keys, claim_id, url and the pair's columns, with ``qualifiers`` (array).
    """
    bare = standing() & (F.col("verdict") == "PARTIALLY_SUPPORTED") & (F.coalesce(F.size("qualifiers"), F.lit(0)) <= 0)
    each = pairs.groupBy(*keys, "claim_id").agg(F.count(F.lit(1)).alias("_pairs"), F.count_if(standing()).alias("_standing"), F.count_if(bare).alias("_bare"))
    rows = claims.join(each, [*keys, "claim_id"], "left").fillna(0, ["_pairs", "_standing", "_bare"])
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("claims"),
        F.count_if(~F.col("located")).alias("unlocatable"),
        F.sum("_pairs").alias("pairs"),
        F.sum("_standing").alias("standing"),
        F.sum(F.col("_pairs") - F.col("_standing")).alias("unauditable"),
        F.count_if(F.col("_pairs") > 1).alias("multi_source_claims"),
        F.sum("_bare").alias("partial_without_qualifiers"),
    )


def claim_states(claims: DataFrame, judgements: DataFrame) -> DataFrame:
    """(claim_id, state) as a reader sees it; here a verdict stands whatever the page's code."""
    stands = (F.col("verdict") != "") & ~F.col("voided")
    yes = stands & F.col("verdict").isin("SUPPORTED", "PARTIALLY_SUPPORTED")
    rows = claims.join(judgements, "claim_id", "left").groupBy("claim_id", "cited").agg(
        F.bool_or(F.coalesce(stands, F.lit(False))).alias("any"),
        F.bool_or(F.coalesce(yes, F.lit(False))).alias("yes"),
        F.bool_or(F.coalesce(stands & ~F.col("verdict").isin("SUPPORTED", "PARTIALLY_SUPPORTED"), F.lit(False))).alias("no"),
        F.bool_and(F.when(stands, F.col("verdict") == "SUPPORTED")).alias("all"),
    )
    state = F.when(~F.col("cited"), "NOT_CHECKED").when(~F.col("any"), "COULD_NOT_VERIFY").when(F.col("yes") & F.col("no"), "MIXED").when(F.col("all"), "SUPPORTED").when(F.col("yes"), "PARTIALLY_SUPPORTED").otherwise("NOT_SUPPORTED")
    return rows.select("claim_id", state.alias("state"))


RATES = ("fabricated_span", "drift", "unauditable", "support", "claim_level")


def published_rates(pairs: DataFrame, calibrated: bool, reason: str = "") -> DataFrame:
    """Long form: one row per answer and rate. A withheld number is a row with its reason, never a missing row.

    ``pairs`` has answer, product, origin and drift besides the pair's own columns. An answer from an interface
    ('api') publishes nothing. The first three rates need no judge; support rates need enough evidence, then a
    calibrated judge.
    """
    keys = ["answer", "product", "origin"]
    need, drift = F.col("verdict").isin(*codes.SPAN_REQUIRED), F.col("drift")
    sums = {  # hits and n of each rate over pairs; those of claims follow from the two flags
        "fabricated_span": (need & F.col("voided") & (F.col("void_reason") == codes.FABRICATED), need),
        "drift": (drift == "PAGE_CHANGED", drift.isin("NONE", "PAGE_CHANGED", "PAGE_REPLACED")),
        "unauditable": (~standing(), F.lit(True)),
        "support": (supported(), standing()),
    }
    by_claim = pairs.groupBy(*keys, "claim_id").agg(*[F.count_if(c).alias(f"_{k}{i}") for k, x in sums.items() for i, c in enumerate(x)])
    claim = F.col("_support0") > 0, F.col("_support1") > 0
    one = by_claim.groupBy(*keys).agg(
        *[F.sum(f"_{k}{i}").alias(f"_{k}{i}") for k in sums for i in (0, 1)],
        *[F.count_if(c).alias(f"_claim_level{i}") for i, c in enumerate(claim)],
        F.count(F.lit(1)).alias("_claims"),
    )
    long = F.explode(F.array(*[F.struct(F.lit(k).alias("rate"), F.col(f"_{k}0").alias("h"), F.col(f"_{k}1").alias("n")) for k in RATES]))
    rows = one.select(*keys, (F.col("_claim_level1") * 2 <= F.col("_claims")).alias("insufficient"), long.alias("r"))
    rows = rows.select(*keys, "insufficient", "r.rate", *rate_columns(F.col("r.h"), F.col("r.n")))
    judged = F.col("rate").isin("support", "claim_level")
    why = (
        F.when(F.col("origin") == "api", codes.UNPUBLISHABLE)
        .when(judged & F.col("insufficient"), codes.INSUFFICIENT)
        .when(judged & F.lit(not calibrated), F.lit(f"{codes.NO_CALIBRATION}: {reason}".rstrip(": ")))
    )
    rows = rows.withColumn("withheld", why)
    shown = [F.when(F.col("withheld").isNull(), F.col(c)).alias(c) for c in ("value", "lo", "hi")]
    return rows.select(*keys, "rate", "hits", "n", *shown, F.coalesce("withheld", F.lit("")).alias("withheld"))


def aggregate_rates(pairs: DataFrame, key: str, allow_conflicted: bool = False) -> DataFrame:
    """Support over all answers of a key. One answer that can't be published withholds the whole figure."""
    answers = insufficient(pairs, key, "answer", "product", "origin")
    flags = answers.groupBy(key).agg(
        F.count(F.lit(1)).alias("splits"),
        F.bool_or(F.col("origin") == "api").alias("_api"),
        F.bool_or(F.col("product").isin(*codes.CONFLICTED_PRODUCTS)).alias("_conflict"),
        F.bool_or("insufficient").alias("_low"),
    )
    why = F.when(F.col("_api"), codes.UNPUBLISHABLE).when(F.col("_conflict") & F.lit(not allow_conflicted), codes.CONFLICTED).when(F.col("_low"), codes.INSUFFICIENT)
    rows = support_rate(pairs, key).join(flags, key).withColumn("withheld", why)
    shown = [F.when(F.col("withheld").isNull(), F.col(c)).alias(c) for c in ("value", "lo", "hi")]
    return rows.select(key, "splits", "hits", "n", *shown, F.coalesce("withheld", F.lit("")).alias("withheld"))


def rate_grains(pairs: DataFrame) -> DataFrame:
    """Standing and supported pairs by product and source code, by each alone, and in all: one pass of grouping sets."""
    rows = pairs.withColumn("st", standing().cast("int")).withColumn("su", supported().cast("int"))
    out = rows.cube("product", "source_code").agg(F.grouping_id().cast("long").alias("grain"), F.sum("su").cast("long").alias("hits"), F.sum("st").cast("long").alias("n"))
    return out.select("product", "source_code", "grain", "hits", "n")


def running_total(rows: DataFrame, value: str, key: str, order: str, pieces: int = 64) -> DataFrame:
    """Adds before: the sum of ``value`` over the rows of the key that stand before a row by ``order`` (a number, unique in a key).

    Two passes: totals of the pieces that quantiles of the order cut a key into, then sums within each piece on top of
    the totals before it. A single long key is so many tasks.
    """
    parts = [k / pieces for k in range(1, pieces)] or [0.5]
    bounds = sorted(set(rows.agg(F.percentile_approx(order, parts, 1000)).first()[0] or []))
    piece = F.size(F.filter(F.lit(bounds).cast("array<double>"), lambda b: b <= F.col(order))) if bounds else F.lit(0)
    dealt = rows.withColumn("_piece", piece)
    so_far = Window.rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy(key, "_piece").agg(F.sum(value).alias("_total"))
    start = totals.select(key, "_piece", F.coalesce(F.sum("_total").over(so_far.partitionBy(key).orderBy("_piece")), F.lit(0)).alias("_start"))
    within = F.coalesce(F.sum(value).over(so_far.partitionBy(key, "_piece").orderBy(order)), F.lit(0))
    return dealt.withColumn("_within", within).join(start, [key, "_piece"]).withColumn("before", F.col("_start") + F.col("_within")).drop("_piece", "_start", "_within")


def running_budget(calls: DataFrame, budget: int, key: str = "run", order: str = "seq") -> DataFrame:
    """Adds spent_before and halted: the total before a call decides whether it may run."""
    spent = running_total(calls, "tokens", key, order).withColumn("spent_before", F.col("before").cast("long")).drop("before")
    return spent.withColumn("halted", F.col("spent_before") >= budget)
