"""Pages read by a table function: columns by what is asked for, selectors by product, extractors by name."""

import pytest

from provenia import codes
from provenia.functions import reading

PAGE = '<body><main><a href="https://a.net/1">One</a><a href="https://claude.ai/z">own</a></main><div class="prose">long words here</div><div class="prose"><a href="https://b.net/2">Two</a></div></body>'


@pytest.fixture
def ask(spark):
    reading.register(spark, extractors={"shout": lambda html: html.upper()})
    spark.createDataFrame([(1, "generic", PAGE), (2, "perplexity", PAGE), (3, "unheard of", PAGE), (4, "generic", None), (5, "claude", "")], "id int, product string, html string").createOrReplaceTempView("stored")
    return lambda what, how: spark.sql(f"SELECT id, r.* FROM stored, LATERAL read_page(html, '{what}', {how}) r ORDER BY 1, 2")


def test_links_by_the_products_own_selectors(ask):
    both = [("One", "https://a.net/1"), ("Two", "https://b.net/2")]
    assert [tuple(r) for r in ask("links", "product").collect()] == [(1, 0, *both[0]), (1, 1, *both[1]), (2, 0, *both[1]), (3, 0, *both[0]), (3, 1, *both[1])]


def test_containers(ask):
    rows = ask("containers", "'perplexity'").where("id = 2").collect()
    assert [(r["seq"], r["selector"], r["n_links"]) for r in rows] == [(0, ".prose", 0), (1, ".prose", 1)]


def test_text_by_a_named_extractor(ask):
    assert [r["text"] for r in ask("text", "'shout'").collect()] == [PAGE.upper()] * 3 + ["", ""]
    assert "long words here" in ask("text", "'strict'").first()["text"]


@pytest.mark.parametrize("what, how", [("colour", "product"), ("links", "'nobody'"), ("text", "'nobody'"), ("text", "product")])
def test_refuses_before_anything_runs(ask, what, how):
    with pytest.raises(Exception, match="has to be|unknown"):
        ask(what, how)


def test_every_product_has_selectors():
    assert all(codes.ADAPTERS.values()) and reading.DEFAULT in codes.ADAPTERS
