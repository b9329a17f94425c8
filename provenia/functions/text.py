"""Text and URL scalars as column expressions: nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from provenia import codes

NUMBER = r"\d[\d,.]*%?"
PROPER = r"\b[A-Z][A-Za-z\-']{3,}\b"
SCORE_SHAPED = r"(?i)\b(confidence|certainty|probability|likelihood|score|p\s*=|\d{1,3}\s*%\s*(sure|confident))\b"
FOOTNOTE = r"\[\d{1,3}\]"
BULLET = r"^\s*(?:[-*•–]|\d+[.)])\s+"
SENTENCE = r"""(?<=[.!?])\s+(?=[A-Z("'“])"""


def _any(column: Column, values) -> Column:
    return column.isin(*values)


def let(value: Column, use) -> Column:
    """use(value) with the value worked out once, also where ``use`` needs it inside a lambda over an array."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def blanks(text: Column) -> Column:
    """Runs of white space (Unicode's, as on a page) to one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


#: Lower-case characters that case folding changes further, by rule: to one character, and to several.
_CHANGED = {c: c.casefold() for c in map(chr, range(0x80, 0x1_0000)) if c == c.lower() != c.casefold()}
_FOLD_ONE = "".join(c for c, to in _CHANGED.items() if len(to) == 1), "".join(to for to in _CHANGED.values() if len(to) == 1)
_FOLD_MANY = {c: to for c, to in _CHANGED.items() if len(to) > 1}


def canonical(text: Column) -> Column:
    """What a claim's identity rests on: white space and case alone (full case folding, as in 'Straße' and 'STRASSE')."""
    plain = F.translate(F.lower(blanks(text)), *_FOLD_ONE)
    wide = plain
    for c, to in _FOLD_MANY.items():
        wide = F.replace(wide, F.lit(c), F.lit(to))
    return F.when(plain.rlike(f"[{''.join(_FOLD_MANY)}]"), wide).otherwise(plain)


def fold(text: Column) -> Column:
    """Text as spans are compared: typography, case and white space folded, combining marks of Latin letters dropped.

    Exact for text whose case folding and compatibility form are what ``lower`` and this table give (ASCII and Latin
    letters with marks); ``provenia.functions.parse.fold_full`` covers all of Unicode.
    """
    plain = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"
    alike = {c: to for c, to in codes.FOLDED.items() if len(to) == 1}
    dropped = "".join(c for c, to in codes.FOLDED.items() if not to)
    out = F.translate(F.lower(text), plain[0] + "".join(alike) + dropped, plain[1] + "".join(alike.values()))
    for c, to in codes.FOLDED.items():
        if len(to) > 1:
            out = F.replace(out, F.lit(c), F.lit(to))
    out = F.regexp_replace(out, r"[̀-ͯ]", "")
    return blanks(F.replace(out, F.lit("ß"), F.lit("ss")))


def content_type(header: Column) -> Column:
    return F.lower(F.trim(F.split_part(F.coalesce(header, F.lit("")), F.lit(";"), F.lit(1))))


def document_kind(kind: Column, head: Column) -> Column:
    """html, pdf, docx, xml or none; ``head`` is the body's beginning as text. The bytes overrule the header."""
    return (
        F.when(F.startswith(F.ltrim(F.regexp_replace(F.substring(head, 1, 1024), r"^\s+", "")), F.lit("%PDF-")), "pdf")
        .when(_any(kind, codes.PDF_TYPES), "pdf")
        .when((kind == codes.DOCX_TYPE) & F.startswith(head, F.lit("PK")), "docx")
        .when(_any(kind, codes.XML_TYPES), "xml")
        .when((kind == "") | _any(kind, codes.HTML_TYPES), "html")
        .otherwise("none")
    )


def first_marker(text: Column, markers: tuple[str, ...]) -> Column:
    """The first of the markers, in their order, that the lower-cased text holds; else null."""
    low = F.lower(text)
    return F.coalesce(*[F.when(F.contains(low, F.lit(m)), F.lit(m)) for m in markers])


def bot_marker(headers: Column, body: Column) -> Column:
    return F.when(F.octet_length(body) <= codes.BOT_BYTES, first_marker(F.concat_ws(" ", headers, body), codes.BOT_MARKERS))


def wall(text: Column) -> Column:
    return F.when(first_marker(text, codes.PAYWALL_MARKERS).isNotNull(), "paywall").when(first_marker(text, codes.CONSENT_MARKERS).isNotNull(), "consent")


def looks_thin(text_length: Column, html_bytes: Column) -> Column:
    return (html_bytes >= codes.THIN_BYTES) & (text_length < html_bytes * F.lit(codes.THIN_RATIO))


def picture_only(html: Column, text: Column) -> Column:
    return (F.length(text) < codes.EMPTY_CHARS) & first_marker(html, codes.PICTURE_TAGS).isNotNull()


def status_code(status: Column) -> Column:
    return F.when(_any(status, codes.DEAD_STATUSES), "SOURCE_DEAD_LINK").when(_any(status, codes.BLOCKED_STATUSES), "SOURCE_BOT_BLOCKED").otherwise("SOURCE_UNREACHABLE")


def source_code(status: Column, bot: Column, decoded: Column, kind: Column, refusal: Column, pictures: Column, walled: Column, text_length: Column) -> Column:
    """The one ordered decision about a fetched page; the order is part of the meaning (a wall before emptiness)."""
    return (
        F.when((status != 200) & bot.isNotNull(), "SOURCE_BOT_BLOCKED")
        .when(status != 200, status_code(status))
        .when(~decoded, "SOURCE_EMPTY")
        .when(kind == "none", "SOURCE_NOT_HTML")
        .when(refusal.isNotNull(), refusal)
        .when((kind == "html") & pictures, "SOURCE_NO_TEXT_LAYER")
        .when(walled.isNotNull(), "SOURCE_PAYWALLED")
        .when(text_length < codes.EMPTY_CHARS, "SOURCE_EMPTY")
        .otherwise(codes.SOURCE_OK)
    )


def normalise_url(url: Column) -> Column:
    """Without the tracking parameters; order, blank values and fragment stay. For queries without % and +."""
    body, hash_ = F.split_part(url, F.lit("#"), F.lit(1)), F.regexp_extract(url, r"#(.*)$", 1)
    query = F.regexp_extract(body, r"\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~_any(F.lower(F.split_part(p, F.lit("="), F.lit(1))), codes.TRACKING_PARAMS))
    kept = F.transform(kept, lambda p: F.when(F.contains(p, F.lit("=")), p).otherwise(F.concat(p, F.lit("="))))
    joined = F.array_join(kept, "&")
    path = F.regexp_replace(body, r"\?.*$", "")
    return F.concat(path, F.when(joined != "", F.concat(F.lit("?"), joined)).otherwise(""), F.when(hash_ != "", F.concat(F.lit("#"), hash_)).otherwise(""))


def registrable_domain(url: Column) -> Column:
    """Publisher of a URL: the last two labels of the host, or three after a known two-part suffix; '' without host."""
    net = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    host = F.lower(F.regexp_replace(F.regexp_replace(net, r"^.*@", ""), r":\d*$", ""))
    host = F.btrim(host, F.lit("."))
    labels = F.split(host, r"\.")
    last = lambda k: F.array_join(F.slice(labels, -k, k), ".")
    return F.when(host.rlike(r"^[0-9.]*$") | (F.size(labels) < 2), host).when(_any(last(2), codes.TWO_PART_SUFFIXES) & (F.size(labels) >= 3), last(3)).otherwise(last(2))


def clean_qualifiers(entries: Column) -> tuple[Column, Column]:
    """(kept, dropped): entries that are a score in disguise go to the second."""
    flat = F.filter(F.transform(F.coalesce(entries, F.array().cast("array<string>")), blanks), lambda e: e != "")
    return F.filter(flat, lambda e: ~e.rlike(SCORE_SHAPED)), F.filter(flat, lambda e: e.rlike(SCORE_SHAPED))


def span_present(span: Column, document: Column) -> Column:
    """Whether a quoted span stands in the document, both folded; footnote marks may differ. Blank spans never do."""
    wanted, held = fold(span), fold(document)
    bare = F.trim(F.regexp_replace(wanted, FOOTNOTE, ""))
    return F.when(wanted == "", False).when(F.contains(held, wanted), True).otherwise((bare != "") & F.contains(F.regexp_replace(held, FOOTNOTE, ""), bare))


def numbers(text: Column) -> Column:
    """Distinct numbers of two digits or more."""
    found = F.regexp_extract_all(text, F.lit(f"({NUMBER})"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda t: F.length(F.regexp_replace(t, r"\D", "")) >= 2))


def propers(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"({PROPER})"), F.lit(1)))


def dropped_evidence(claim: Column, extracted: Column, raw: Column) -> Column:
    """The claim's numbers and names that the raw page has and the extracted text hasn't: sorted, numbers first."""
    none = F.array().cast("array<string>")

    def within(texts: Column) -> Column:
        lost = lambda tokens: F.array_sort(F.filter(tokens, lambda t: ~F.contains(texts["have"], F.lower(t)) & F.contains(texts["could"], F.lower(t))))
        found = F.struct(lost(numbers(claim)).alias("n"), lost(propers(claim)).alias("p"))
        return let(found, lambda x: F.when(F.size(x["n"]) > 0, F.concat(x["n"], x["p"])).when(F.size(x["p"]) >= 2, x["p"]).otherwise(none))

    folded = [fold(F.coalesce(t, F.lit(""))).alias(name) for t, name in ((extracted, "have"), (raw, "could"))]
    return let(F.struct(*folded), within)


def is_furniture(text: Column) -> Column:
    flat = F.rtrim(F.lower(blanks(text)), F.lit(".:"))
    return _any(flat, codes.FURNITURE) | (F.length(flat) <= 2)


def looks_factual(text: Column) -> Column:
    words = F.size(F.filter(F.split(blanks(text), " "), lambda w: w != ""))
    return ~is_furniture(text) & (words >= 4) & ((F.size(numbers(text)) > 0) | (F.size(propers(text)) >= 2))


def units(text: Column) -> Column:
    """Array of (text, kind, cells): what a reader would count in a block. Lines with tabs are rows, bullets items, the rest sentences."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")) != "")

    def unit(text: Column, kind: str, cells: Column) -> Column:
        return F.struct(text.alias("text"), F.lit(kind).alias("kind"), cells.cast("long").alias("cells"))

    def per_line(line: Column) -> Column:
        cells = F.filter(F.transform(F.split(line, "\t"), lambda c: F.trim(c)), lambda c: c != "")
        parts = F.filter(F.transform(F.split(F.trim(line), SENTENCE), lambda p: F.trim(p)), lambda p: p != "")
        row = F.array(unit(F.array_join(cells, " | "), "row", F.size(cells)))
        item = F.array(unit(F.trim(F.regexp_replace(line, BULLET, "")), "item", F.lit(1)))
        return F.when(F.contains(line, F.lit("\t")), row).when(line.rlike(BULLET), item).otherwise(F.transform(parts, lambda p: unit(p, "sentence", F.lit(1))))

    return F.flatten(F.transform(lines, per_line))


def content_words(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(w) for w in codes.STOPWORDS]))


def span_focus(span: Column, claim: Column) -> Column:
    """The sentence of the span that shares most content words with the claim, the first on ties; null if none does or the span is one sentence."""
    sentences = F.split(span, r"(?<=[.!?])\s+")

    def choose(wanted: Column) -> Column:
        return F.array_max(F.transform(sentences, lambda s, i: F.struct(F.size(F.array_intersect(wanted, content_words(s))).alias("shared"), (-i).alias("order"), s.alias("text"))))

    best = let(content_words(claim), choose)
    return F.when((best["shared"] > 0) & (F.size(sentences) > 1), best["text"])


def first_sentence(text: Column, limit: int = 96) -> Column:
    flat = blanks(text)
    cuts = [F.locate(mark, flat) for mark in (". ", "? ", "! ")]
    out = F.when(F.length(flat) > limit, F.concat(F.substring(flat, 1, limit), F.lit("..."))).otherwise(flat)
    for cut in reversed(cuts):
        out = F.when((cut > 0) & (cut <= limit), F.substr(flat, F.lit(1), cut)).otherwise(out)
    return out


def shingles(text: Column, n: int = codes.SHINGLE_WORDS) -> Column:
    """Distinct n-grams of the folded words; a shorter text is one gram, an empty one none."""

    def grams(words: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))
        return F.when(F.size(words) == 0, F.array().cast("array<string>")).otherwise(F.array_distinct(many))

    return let(F.filter(F.split(fold(text), " "), lambda w: w != ""), grams)


def shingle_hashes(text: Column, n: int = codes.SHINGLE_WORDS) -> Column:
    """Distinct 64-bit hashes of the same n-grams: what is compared when no one reads the grams.

    Each word is hashed once and a gram is a hash of its words' hashes, so no gram is ever built as text. Two texts of
    a million grams each meet by chance in one of them with a probability below 10^-7.
    """

    def grams(words: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - n + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, n)))
        return F.when(F.size(words) == 0, F.array().cast("array<bigint>")).otherwise(F.array_distinct(many))

    return let(F.transform(F.filter(F.split(fold(text), " "), lambda w: w != ""), lambda w: F.xxhash64(w)), grams)


def containment(snapshot: Column, current: Column) -> tuple[Column, Column]:
    """(containment of the snapshot, Jaccard) of two shingle sets: both empty 1 and 1, one empty 0 and 0."""
    a, b = F.size(snapshot), F.size(current)
    empty = (a == 0) | (b == 0)
    edge = F.when((a == 0) & (b == 0), 1.0).otherwise(0.0)
    both = lambda n: F.struct((n / a).alias("of_snapshot"), (n / (a + b - n)).alias("jaccard"))
    shared = let(F.size(F.array_intersect(snapshot, current)).cast("double"), both)
    return F.when(empty, edge).otherwise(shared["of_snapshot"]), F.when(empty, edge).otherwise(shared["jaccard"])


def drift_status(code: Column, archived: Column, contained: Column) -> Column:
    return (
        F.when(code != codes.SOURCE_OK, "NOT_CHECKED")
        .when(archived.isNull() | (archived == ""), "NO_SNAPSHOT")
        .when(contained < codes.REPLACED_BELOW, "PAGE_REPLACED")
        .when(contained < codes.CHANGED_BELOW, "PAGE_CHANGED")
        .otherwise("NONE")
    )


def call_cost(tokens_in: Column, tokens_out: Column, per_in: Column, per_out: Column) -> Column:
    """US dollars for prices a million tokens; an unknown model (null price) costs 0."""
    return F.round((tokens_in * F.coalesce(per_in, F.lit(0.0)) + tokens_out * F.coalesce(per_out, F.lit(0.0))) / 1e6, 6)


def incomplete_capture(hidden: Column, dom: Column, rendered: Column) -> Column:
    return (hidden > 0) | ((dom > 0) & (dom > rendered * F.lit(1.05)))


def surname_of(text: Column) -> Column:
    """The name before 'et al', else the first capitalised word; lower case, '' if none."""
    named = F.regexp_extract(text, r"\b([A-Z][A-Za-z'’\-]{2,})\s+et\s+al", 1)
    return F.lower(F.when(named != "", named).otherwise(F.regexp_extract(text, r"\b([A-Z][A-Za-z'’\-]{2,})\b", 1)))


def year_of(text: Column) -> Column:
    """The first year of 1900 to 2099 as int; null if none."""
    return F.nullif(F.regexp_extract(text, r"\b((?:19|20)\d{2})\b", 1), F.lit("")).cast("int")


def doi_of(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"\b(10\.\d{4,9}/[^\s,;)\]]+)", 1), F.lit(""))


def signature(text: Column) -> Column:
    """Tokens that identify a citation: names, years, long numbers, DOIs; lower case."""
    found = F.regexp_extract_all(text, F.lit(r"\b([A-Za-z][A-Za-z'’\-]{3,}|(?:19|20)\d{2}|\d{6,}|10\.\d{4,9}/\S+)\b"), F.lit(1))
    return F.array_except(F.array_distinct(F.transform(found, F.lower)), F.array(*[F.lit(w) for w in codes.SIGNATURE_IGNORED]))


def same_citation(a: Column, b: Column) -> Column:
    """Whether the tokens of one written form all stand in the other; without tokens, equal texts."""
    x, y = signature(a), signature(b)
    subset = (F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), (canonical(a) != "") & (canonical(a) == canonical(b))).otherwise(subset)


def regex_text(html: Column) -> Column:
    """Fast text of a page by patterns: an approximation of ``parse.html_text``, without a parser's nesting."""
    dropped = F.regexp_replace(html, r"(?is)<(script|style|noscript|template|nav|header|footer|aside|form|iframe)\b.*?</\1\s*>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(dropped, r"(?s)<[^>]*>", " "), r"\s+", " "))
