"""Statistics as column expressions over counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from provenia.codes import Z95


def ratio(hits: Column, n: Column) -> Column:
    """hits / n as double; null over n = 0."""
    return F.when(n > 0, hits.cast("double") / F.nullif(n.cast("double"), F.lit(0.0)))


def wilson(hits: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    """Bounds of the Wilson interval, within [0, 1]; null over n <= 0."""
    h, k = hits.cast("double"), F.nullif(n.cast("double"), F.lit(0.0))
    p, z2 = h / k, z * z
    middle = p + z2 / (2 * k)
    half = F.lit(z) * F.sqrt(p * (1 - p) / k + z2 / (4 * k * k))
    scale = 1 + z2 / k
    low = F.greatest(F.lit(0.0), (middle - half) / scale)
    high = F.least(F.lit(1.0), (middle + half) / scale)
    return F.when(n > 0, low), F.when(n > 0, high)


def rate_columns(hits: Column, n: Column) -> list[Column]:
    """hits, n, value, lo, hi: no rate is published without its count and interval."""
    low, high = wilson(hits, n)
    return [hits.cast("long").alias("hits"), n.cast("long").alias("n"), F.round(ratio(hits, n), 10).alias("value"), F.round(low, 10).alias("lo"), F.round(high, 10).alias("hi")]


def kappa(n: Column, agree: Column, chance: Column) -> tuple[Column, Column, Column]:
    """Cohen's kappa and its interval from n, the number that agree and the sum of products of marginals.

    Chance agreement of 1: kappa 1 or 0 and no interval; no variance: no interval; n = 0: nulls.
    """
    k = F.nullif(n.cast("double"), F.lit(0.0))
    po, pe = agree.cast("double") / k, chance.cast("double") / (k * k)
    value = F.when(n <= 0, F.lit(None)).when(pe >= 1, F.when(po >= 1, 1.0).otherwise(0.0)).otherwise((po - pe) / F.nullif(1 - pe, F.lit(0.0)))
    spread = F.when((n > 0) & (pe < 1) & (po > 0) & (po < 1), F.sqrt(po * (1 - po) / F.nullif(k * (1 - pe) * (1 - pe), F.lit(0.0))))
    low, high = F.greatest(F.lit(-1.0), value - Z95 * spread), F.least(F.lit(1.0), value + Z95 * spread)
    return value, F.when(spread.isNotNull(), low), F.when(spread.isNotNull(), high)


def render_rate(hits: Column, n: Column, unit: str, splits: Column) -> Column:
    """The sentence that a rate is published as."""
    low, high = wilson(hits, n)
    plural = F.when(splits == 1, "").otherwise("s")
    percent = lambda x: F.format_string("%.1f%%", x * 100)
    said = F.format_string(f"%d of %d {unit}s (%s, 95%% CI %s to %s, n=%d, over %d split%s)", hits, n, percent(ratio(hits, n)), percent(low), percent(high), n, splits, plural)
    return F.when(n > 0, said).otherwise(F.lit(f"no {unit}s to measure (n=0)"))
