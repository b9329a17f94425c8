"""Stored pages read from SQL: a table function whose columns depend on what is asked for.

``read_page(html, what, how)``, for use after LATERAL:

* ``containers``: every node that the selectors of product ``how`` find: seq, selector, n_links, chars;
* ``links``: the links of the best container (most links, then most text, then the first): pos, marker, url;
* ``text``: text and chars by the extractor named ``how``.

What is asked for has to be a constant, for it decides the columns; an unknown one, an unknown extractor or a constant
product without selectors refuses before anything runs. A product that comes from a column and has no selectors is read
as ``generic``. A null or empty page has no containers and no links, and an empty text.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from provenia import codes
from provenia.functions import parse
from provenia.session import importable

COLUMNS = {"containers": "seq int, selector string, n_links int, chars int", "links": "pos int, marker string, url string", "text": "text string, chars int"}

#: Ways to get a page's text; another one is added by name when the function is registered.
EXTRACTORS: dict[str, Callable[[str], str]] = {"strict": parse.html_text, "wide": parse.html_text_wide}

DEFAULT = "generic"


def best(found: Sequence[dict]) -> dict | None:
    """The container with most links, then most text, then the first; None of none."""
    return min(found, key=lambda c: (-c["n_links"], -c["chars"], c["seq"]), default=None)


def register(spark: SparkSession, name: str = "read_page", adapters: Mapping[str, Sequence[str]] = codes.ADAPTERS, extractors: Mapping[str, Callable[[str], str]] | None = None) -> None:
    """Makes the table function known to a session, with its selector lists and extractors; these travel with it."""
    importable(spark)
    lists, ways, hosts = {k: list(v) for k, v in adapters.items()}, {**EXTRACTORS, **(extractors or {})}, frozenset(codes.OWN_HOSTS)
    columns = {k: StructType.fromDDL(v) for k, v in COLUMNS.items()}

    class ReadPage:
        @staticmethod
        def analyze(html: AnalyzeArgument, what: AnalyzeArgument, how: AnalyzeArgument) -> AnalyzeResult:
            if not what.isConstantExpression or what.value not in columns:
                raise ValueError(f"what is read has to be one of {', '.join(columns)}, as a constant")
            known = ways if what.value == "text" else lists
            if how.isConstantExpression and how.value not in known:
                raise ValueError(f"unknown: {how.value}; known are {', '.join(known)}")
            if what.value == "text" and not how.isConstantExpression:
                raise ValueError("an extractor has to be a constant")
            return AnalyzeResult(columns[what.value])

        def eval(self, html: str, what: str, how: str):
            if what == "text":
                text = ways[how](html or "")
                yield text, len(text)
                return
            found = parse.containers(html or "", lists.get(how, lists[DEFAULT]), hosts)
            if what == "containers":
                yield from ((c["seq"], c["selector"], c["n_links"], c["chars"]) for c in found)
            elif chosen := best(found):
                yield from ((i, link["marker"], link["url"]) for i, link in enumerate(chosen["links"]))

    spark.udtf.register(name, udtf(ReadPage))
