"""Every query of the citation-audit operators, by name, with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name; ``sql`` gives the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def wilson_sql(hits: str, n: str) -> str:
    """value, lo, hi of the Wilson interval, rounded as the operators round them."""
    h, k, z = f"CAST({hits} AS DOUBLE)", f"CAST({n} AS DOUBLE)", "1.959963984540054::DOUBLE"
    middle = f"({h} / {k} + {z} * {z} / (2 * {k}))"
    half = f"({z} * sqrt({h} / {k} * (1 - {h} / {k}) / {k} + {z} * {z} / (4 * {k} * {k})))"
    scale = f"(1 + {z} * {z} / {k})"
    case = lambda x: f"CASE WHEN {n} > 0 THEN round({x}, 10) END"
    return f"{case(f'{h} / {k}')} AS value, {case(f'greatest(0.0::DOUBLE, ({middle} - {half}) / {scale})')} AS lo, {case(f'least(1.0::DOUBLE, ({middle} + {half}) / {scale})')} AS hi"


for _name in ("rates", "texts", "orders", "captures", "documents"):
    import_module(f"provenia.plans.{_name}")
