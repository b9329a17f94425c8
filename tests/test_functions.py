import gzip
import io
import json
import zipfile
import zlib

import pytest
from hypothesis import given
from hypothesis import settings as hypothesis_settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from provenia.functions import markup, parse, pdf, stats
from provenia.functions import text as X


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(column.alias("x")).first().x


def test_wilson_known_values_and_bounds(spark):
    rows = spark.createDataFrame([(19, 54), (23, 47), (0, 6), (8, 8), (0, 0)], "h long, n long")
    lo, hi = stats.wilson(F.col("h"), F.col("n"))
    got = [(r.lo, r.hi) for r in rows.select(lo.alias("lo"), hi.alias("hi")).collect()]
    assert (round(got[0][0], 4), round(got[0][1], 4)) == (0.2382, 0.4852)
    assert (round(got[1][0], 3), round(got[1][1], 3)) == (0.353, 0.628)
    assert got[4] == (None, None) and all(0 <= a <= b <= 1 for a, b in got[:4])


@pytest.mark.parametrize(("n", "agree", "chance", "want"), [(17, 15, 143, 0.767123), (10, 10, 100, 1.0), (10, 0, 50, -1.0), (0, 0, 0, None)])
def test_kappa(spark, n, agree, chance, want):
    value, lo, hi = stats.kappa(F.lit(n), F.lit(agree), F.lit(chance))
    r = spark.range(1).select(value.alias("k"), lo.alias("lo"), hi.alias("hi")).first()
    assert (r.k if r.k is None else round(r.k, 6)) == want
    assert (r.lo is None) == (want != 0.767123) and (r.lo is None or -1 <= r.lo <= r.k <= r.hi <= 1)


def test_rate_sentence(spark):
    assert one(spark, stats.render_rate(F.lit(19), F.lit(54), "pair", F.lit(1))) == "19 of 54 pairs (35.2%, 95% CI 23.8% to 48.5%, n=54, over 1 split)"
    assert "n=0" in one(spark, stats.render_rate(F.lit(0), F.lit(0), "claim", F.lit(2)))


@pytest.mark.parametrize(("url", "want"), [("https://www.bmc.org/x", "bmc.org"), ("https://a.b.co.uk/", "b.co.uk"), ("http://10.1.2.3/a", "10.1.2.3"), ("mailto:x", ""), ("https://HOST:80/", "host"), ("https://x.nhs.uk.", "x.nhs.uk"), ("", "")])
def test_registrable_domain(spark, url, want):
    assert one(spark, X.registrable_domain(F.col("u")), u=url) == want


@pytest.mark.parametrize(("url", "want"), [("https://a.b/c?utm_source=x&id=1#t", "https://a.b/c?id=1#t"), ("https://a.b/c?UTM_Source=x", "https://a.b/c"), ("https://a.b/?q=&z", "https://a.b/?q=&z="), ("https://a.b/c", "https://a.b/c")])
def test_normalised_url_in_both_forms(spark, url, want):
    assert one(spark, X.normalise_url(F.col("u")), u=url) == want == parse.normalise_url_full(url)


def test_parsers_of_awkward_addresses():
    assert parse.normalise_url_full("http://[bad") == "http://[bad" and parse.normalise_url_full("http://a/?q=a%20b&gclid=1") == "http://a/?q=a+b"


@pytest.mark.parametrize(("a", "b"), [("21–day", "21-day"), ("“Résumé”", '"resume"'), ("co­operate", "cooperate"), ("ﬁve", "five"), ("Straße", "STRASSE"), ("é", "é"), ("wait…", "WAIT..."), ("a \n b", "a b")])
def test_folds_alike(a, b):
    assert parse.fold_full(a) == parse.fold_full(b)


def test_fold_keeps_marks_that_change_the_word():
    assert parse.fold_full("क्") == "क्"


@hypothesis_settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_fold_is_idempotent_and_locates(text):
    folded = parse.fold_full(text)
    assert parse.fold_full(folded) == folded
    if folded:
        start, end = parse.locate("x. " + text + " y", text)
        assert parse.fold_full(("x. " + text + " y")[start:end]) == folded


def test_plain_fold_agrees_with_the_full_one_on_latin_text(spark):
    text = "Cafés — “naïve” Über\tGröße… l’été\n"
    assert one(spark, X.fold(F.col("t")), t=text) == parse.fold_full(text)


def test_span_present(spark):
    page = "The rate,[44] as said, was 78% in “2022”."
    for span, want in [("the rate, as said", True), ('WAS 78% in "2022"', True), ("was 79%", False), (" ", False), ("[44]", True)]:
        assert one(spark, X.span_present(F.col("s"), F.col("p")), s=span, p=page) is want, span


def test_html_reading():
    html = "<nav><p>menu<nav>x</nav></nav><script>if (a < b) '<p>'</script><p>One &amp; <b>two<p>three<aside title='t'>side</aside><img alt='a chart'><table><tr><td>k</td><td></td><td>v</td></tr></table><footer>f"
    assert markup.html_text(html) == "One & two\nthree\na chart\n\nk | v"
    assert "side" in markup.html_text_wide(html) and "menu" not in markup.html_text_wide(html)


def test_other_formats():
    assert markup.xml_text(b"<rss><title>T</title><d>D</d></rss>") == "T\nD"
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("word/document.xml", "<w:p><w:t>Head</w:t></w:p><w:tr><w:tc><w:p><w:t>a</w:t></w:p></w:tc><w:tc><w:p><w:t>b</w:t></w:p></w:tc></w:tr>")
    assert markup.docx_text(z.getvalue()) == ("Head\na | b", "")
    assert markup.docx_text(b"PK")[0] == "" and markup.docx_text(b"PK")[1]


def a_pdf(content: bytes, extra: bytes = b"", head: bytes = b"") -> bytes:
    body = zlib.compress(content)
    return b"%PDF-1.4\n1 0 obj<</Type /Page>>endobj\n2 0 obj<</Filter /FlateDecode" + head + b">>stream\n" + body + b"\nendstream endobj\n" + extra


def test_pdf_reading():
    read = pdf.pdf_text(a_pdf(rb"BT (Adults \(all\) who lived) Tj 5 0 Td ( here) Tj 0 -12 Td [(for t) -20 (en ye)] TJ T* (a \225 b hyphen-) Tj 0 -1 Td (ated) Tj ET"))
    assert read["code"] == pdf.PDF_OK and read["text"] == "Adults (all) who lived here\nfor ten ye\na • b hyphenated"
    assert pdf.pdf_text(b"%PDF-1.4 /Encrypt 1 0 R")["code"] == pdf.PDF_ENCRYPTED
    assert pdf.pdf_text(a_pdf(b"(short) Tj"))["code"] == pdf.PDF_NO_TEXT
    assert pdf.pdf_text(a_pdf(b"(" + b"enough words here " * 3 + b") Tj", b"/Subtype /Image"))["code"] == pdf.PDF_NO_TEXT
    assert pdf.pdf_text(a_pdf(b"(" + b"qzxkvwpj" * 30 + b") Tj"))["code"] == pdf.PDF_GARBLED


def test_pdf_two_byte_fonts():
    table = b"1 beginbfchar <0078> <2022> endbfchar 1 beginbfrange <0001> <0003> <0041> endbfrange"
    extra = b"3 0 obj<</X 1>>stream\n" + table + b"\nendstream endobj /Identity-H"
    read = pdf.pdf_text(a_pdf(b"<0078> Tj ( Adults who lived in the country for years) Tj <000100020003> Tj", extra))
    assert read["text"] == "• Adults who lived in the country for yearsABC"
    clash = extra + b"4 0 obj<</X 1>>stream\n1 beginbfchar <0078> <0058> endbfchar\nendstream endobj"
    assert pdf.pdf_text(a_pdf(b"<0078> Tj ( Adults who lived in the country for years) Tj", clash))["two_byte_conflicts"] == 1


def test_unclosed_furniture_and_tables():
    assert markup.html_text("<div><nav>menu</div><p>lost") == "" and markup.html_text("<div><nav>menu</nav></div></p><p>kept<br>on") == "kept\non"
    assert markup.html_text("<table><tr><th></th><th>a</th></tr><tr><td>b</td><td>c</td></tr></table>x | y|z") == "a\n\nb | c\nx | y|z"
    assert markup.xml_text(b"<rss><link>https://a.example</link><t>b<br/>c</t></rss>") == "https://a.example\nb\nc"


def test_pdf_syntax():
    content = rb"% (no)\nBT [(Nested \(paren\) and (balanced) ones) -250 (, \101\053, one two three)] TJ (next) ' <</A 1>> BDC 0 0 Td (same line) Tj ET"
    read = pdf.pdf_text(a_pdf(content.replace(rb"\n", b"\n")))
    assert read["text"] == "Nested (paren) and (balanced) ones, A+, one two three\nnextsame line" and read["pages"] == 1
    table = b"3 0 obj<</X 1>>stream\n1 beginbfrange <0001> <0002> [<0058> <0059>] endbfrange\nendstream endobj /Identity-H"
    assert pdf.pdf_text(a_pdf(b"(Letters of a list of texts: ) Tj <00010002> Tj", table))["text"].endswith(": XY")
    assert pdf.pdf_text(b"%PDF 1 0 obj << /Filter /FlateDecode >> stream\nbroken endstream endobj 2 0 obj (unended")["code"] == pdf.PDF_NO_TEXT


@hypothesis_settings(max_examples=200, deadline=None)
@given(st.binary(max_size=80))
def test_parsers_never_raise(data):
    pdf.pdf_text(b"1 0 obj<</A 1>>stream\n" + data + b"endstream endobj" + data)
    markup.xml_text(data)
    markup.html_text(data.decode("latin-1"))
    markup.docx_text(data)


def test_encodings():
    assert parse.decode_body(gzip.compress(b"x"), "GZIP") == b"x" and parse.decode_body(b"x", None) == b"x"
    assert parse.decode_body(zlib.compress(b"x"), "deflate") == b"x" and parse.decode_body(zlib.compress(b"x")[2:-4], "deflate") == b"x"
    assert parse.decode_body(b"x", "br") is None and parse.decode_body(b"x", "gzip") is None


def test_selectors_and_containers():
    html = '<div class="a prose" id="m"><p data-x="abc">t<br>u</p><a href="https://s.example/1?utm_source=z">One +3</a><a href="https://s.example/1">One</a><a href="/in">in</a></div><main><p>long text without links at all</p></main>'
    root = markup.dom(html)
    assert [len(markup.select(root, s)) for s in ("div.prose", "#m p", "[data-x^='ab']", '[data-x*="c"]', "[data-x=abc]", "main a", "p")] == [1, 1, 1, 1, 1, 0, 2]
    for bad in ("a > b", "a:hover", "[x", "[x~=y]", "", "#", "p,a", "[a^=]"):
        with pytest.raises(ValueError):
            markup.select(root, bad)
    assert [len(markup.select(root, s)) for s in ("div p a", "div #m", "div.a.prose[id]", "[ data-x ^= 'ab' ]", "div[class='a prose'] br")] == [0, 0, 1, 1, 1]
    best = max(parse.containers(html, ["main", "div.prose"]), key=lambda c: (c["n_links"], c["chars"], -c["seq"]))
    assert best["selector"] == "div.prose" and best["links"] == [{"marker": "One", "url": "https://s.example/1?utm_source=z"}]


def test_named_citations():
    text = "Moreno, Okafor, Lindqvist et al., Optics Letters, 2018; see arXiv:2303.04567 and PMC4561237. In 2016 we met Al."
    assert [c["kind"] for c in parse.named_citations(text)] == ["AUTHOR_ETAL_YEAR", "PUBLICATION_ID", "PUBLICATION_ID"]
    assert all(text[c["start"] : c["end"]].split() == c["text"].split() for c in parse.named_citations(text))


def test_json_walks():
    payload = json.dumps({"a": [{"url": 5, "link": "https://no.example"}, {"uri": "https://yes.example", "name": "N"}], "sources": ["https://bare.example", "x"], "t": "some longer prose", "judged": False})
    assert [c["url"] for c in parse.json_citations(payload)] == ["https://yes.example", "https://bare.example"]
    assert parse.json_longest_text(payload) == ("some longer prose", "$.t")
    assert parse.json_first_key(payload, ("judged",)) == "" and parse.json_first_key(payload, ("judged",), truthy=False) == "judged"


def test_damaged_json_gives_nothing():
    for bad in ('{"url": ', "", "[" * 100_000):
        assert parse.json_citations(bad) == [] and parse.json_longest_text(bad) == ("", "") and parse.json_first_key(bad, ("a",)) == ""


@pytest.mark.parametrize("text", ["Straße  ΟΔΟΣ", "ﬁve ŉ ǰ", "İstanbul ſ", "plain Text", "ΰ Ꭰ"])
def test_canonical_is_case_folded(spark, text):
    assert one(spark, X.canonical(F.col("t")), t=text) == " ".join(text.split()).lower().casefold()


def test_units_and_facts(spark):
    text = "Cases rose. \"Why?\" he asked.\nName\t78%\t \n• an item\n3) third\n\n"
    got = [(u.text, u.kind, u.cells) for u in one(spark, X.units(F.col("t")), t=text)]
    assert got == [("Cases rose.", "sentence", 1), ('"Why?" he asked.', "sentence", 1), ("Name | 78%", "row", 2), ("an item", "item", 1), ("third", "item", 1)]
    assert one(spark, X.units(F.lit(None).cast("string"))) == []


def test_shingles_and_containment(spark):
    a, b = (X.shingles(F.lit(t)) for t in ("a b c d e f", "a b c d e g"))
    assert one(spark, a) == ["a b c d e", "b c d e f"] and one(spark, X.shingles(F.lit("A b"))) == ["a b"] and one(spark, X.shingles(F.lit(" "))) == []
    c, j = X.containment(a, b)
    assert (one(spark, c), round(one(spark, j), 4)) == (0.5, 0.3333)
    empty = X.shingles(F.lit(""))
    assert [one(spark, x) for x in X.containment(empty, empty)] == [1.0, 1.0] and [one(spark, x) for x in X.containment(empty, a)] == [0.0, 0.0]


def test_first_sentence(spark):
    assert one(spark, X.first_sentence(F.lit("A?  b. c"))) == "A? b."
    assert one(spark, X.first_sentence(F.lit("x" * 120))) == "x" * 96 + "..."
    assert one(spark, X.first_sentence(F.lit("short"))) == "short"
