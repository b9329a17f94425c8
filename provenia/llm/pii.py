"""Personal data: base spans by pattern, and terms that give a protected value away. DataFrame functions only.

Base spans are found kind by kind, leftmost and not overlapping; those that fail their check are dropped. The
patterns are written so that matching takes linear time (possessive runs that begin where a run begins or where the
last match ended) and give the same matches as the plain ones.

Information-theoretic sanitisation: over the corpus, the pointwise mutual information of a word and a base value (a
protected entity) that stand in the same documents, as a share of the entity's own information content, says how much
of the entity the word discloses. A word that stands beside an entity in several different texts and discloses
DISCLOSED of it or more gets a span of kind ``term`` wherever it stands in a text that holds the entity, to be
generalised or removed with the base spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenia.llm.common import cut

KINDS = ("email", "ip", "card", "phone")

_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9]){15,}+",  # shorter runs fail the check
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: Words that can be terms; those that touch a base span aren't.
TERM = r"(?<!\p{L})\p{L}{4,40}(?!\p{L})"
#: Different texts in which a word must stand near the same entity.
SUPPORT = 3
DISCLOSED = 0.8


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substr(F.reverse(digits), i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _small(part: Column) -> Column:
    """A number of at most 255, however many zeros it begins with."""
    value = F.ltrim(part, F.lit("0"))
    return (F.length(value) <= 3) & (F.coalesce(value.try_cast("int"), F.lit(0)) <= 255)


CHECKS = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\."), _small),
    "card": lambda m: F.length(_digits(m)).between(16, 19) & _luhn(_digits(m)),
    "phone": lambda m: F.length(_digits(m)).between(8, 15),
}

_SPAN = "struct<kind: string, start: long, end: long, value: string>"


def spans_of(text: Column, kind: str, pattern: str, check) -> Column:
    """Array of (kind, start, end, value) of the matches that pass; code points, end exclusive."""
    none = F.array().cast(f"array<{_SPAN}>")
    # in an array of one, so that the lambda below has both as values and doesn't match again for each span
    cut_up = F.array(F.struct(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)).alias("found"), F.split(text, pattern, -1).alias("between")))

    def walk(parts: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            value = F.get(parts["found"], i)
            start = acc["at"] + F.length(F.get(parts["between"], i))
            end = start + F.length(value)
            span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), value.alias("value"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

        begin = F.struct(F.lit(0).cast("long").alias("at"), none.alias("out"))
        indexes = F.sequence(F.lit(0), F.size(parts["found"]) - 1)
        return F.when(F.size(parts["found"]) > 0, F.aggregate(indexes, begin, step, lambda acc: acc["out"])).otherwise(none)

    return F.filter(F.flatten(F.transform(cut_up, walk)), lambda s: check(s["value"]))


def _only(text: Column, mark: Column, spans: Column) -> Column:
    return F.when(mark, spans).otherwise(F.array().cast(f"array<{_SPAN}>"))


def base_spans(text: Column) -> Column:
    """All base spans, by kind as in KINDS, then start."""
    marks = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"(?:[0-9][\x20-]?){16}"), "phone": text.rlike(r"\+[0-9]")}
    return F.concat(*[_only(text, marks[k], spans_of(text, k, PATTERNS[k], CHECKS[k])) for k in KINDS])


def entity(span: Column) -> Column:
    """The protected value behind a span, whatever its spelling."""
    value = F.when(span["kind"] == "email", F.lower(span["value"])).when(span["kind"] == "ip", span["value"]).otherwise(_digits(span["value"]))
    return F.concat(span["kind"], F.lit(":"), value)


def _scan(docs: DataFrame) -> DataFrame:
    """(doc_id, content, base, text): content tells texts apart; the text of those with base spans only."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text")).withColumn("base", base_spans(F.col("text")))
    return rows.select("doc_id", F.md5("text").alias("content"), "base", F.when(F.size("base") > 0, F.col("text")).alias("text"))


def holders(scanned: DataFrame) -> DataFrame:
    """(entity, content, docs, with_entity): the texts that hold an entity of at least SUPPORT different texts, their documents, and all of the entity's."""
    found = scanned.where(F.size("base") > 0).select("doc_id", "content", F.explode("base").alias("b")).select("doc_id", "content", entity(F.col("b")).alias("entity")).distinct()
    each = cut(found.groupBy("entity", "content").agg(F.count(F.lit(1)).alias("docs")))
    often = cut(each.groupBy("entity").agg(F.sum("docs").alias("with_entity"), F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= SUPPORT).select("entity", "with_entity"))
    return each.join(often, "entity")


def words_of(texts: DataFrame) -> DataFrame:
    """(content, term, start, end) of every word of the texts (content, text, base) that touches no base span."""
    found = texts.select("content", "base", F.regexp_extract_all("text", F.lit(f"({TERM})"), F.lit(1)).alias("found"), F.split("text", TERM, -1).alias("between"))
    rows = found.select("content", "base", F.posexplode(F.arrays_zip("found", "between")).alias("i", "x")).where("x.found IS NOT NULL")
    size = F.length("x.found").cast("long")
    before = F.sum(size + F.length("x.between")).over(Window.partitionBy("content").orderBy("i"))
    placed = rows.select("content", "base", F.lower("x.found").alias("term"), (before - size).alias("start"), before.alias("end"))
    return placed.where(~F.exists("base", lambda b: (F.col("start") < b["end"]) & (F.col("end") > b["start"]))).drop("base")


def disclosing(held: DataFrame, words: DataFrame, docs: DataFrame) -> DataFrame:
    """(entity, term) pairs in which the term discloses at least DISCLOSED of the entity."""
    terms = words.select("content", "term").distinct()
    pairs = held.join(terms, "content").groupBy("entity", "term", "with_entity").agg(F.sum("docs").alias("both"), F.count(F.lit(1)).alias("texts")).where(F.col("texts") >= SUPPORT)
    total = docs.count()
    all_words = docs.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(f"({TERM})"), F.lit(1)))).alias("term"))
    in_docs = all_words.groupBy("term").agg(F.count(F.lit(1)).alias("with_term"))
    joined = pairs.join(in_docs, "term")
    shared = F.log(F.col("both") * F.lit(float(total)) / (F.col("with_entity") * F.col("with_term")))
    content = F.log(F.lit(float(total)) / F.col("with_entity"))
    return joined.where((content > 0) & (shared >= DISCLOSED * content)).select("entity", "term")


def spans_by_document(docs: DataFrame) -> DataFrame:
    """(doc_id, content, base, terms): the base spans, and the (start, end) of the terms to be removed, by start."""
    scanned = cut(_scan(docs))
    held = cut(holders(scanned))
    rows = scanned.select("doc_id", "content", "base")
    if held.isEmpty():
        return rows.withColumn("terms", F.lit(None).cast("array<struct<start: long, end: long>>"))
    texts = scanned.where("text IS NOT NULL").join(held.select("content").distinct(), "content", "left_semi").dropDuplicates(["content"])
    words = cut(words_of(texts))
    pairs = disclosing(held, words, docs)
    here = held.join(pairs, "entity").select("content", "term").distinct()
    hits = cut(words.join(here, ["content", "term"]).groupBy("content").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("terms")))
    return rows.join(hits, "content", "left").select("doc_id", "content", "base", "terms")


def _listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def _count(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Null and empty texts: zeros, the hash of nothing, no spans. Repeated rows are one row each, with the same spans.
    Empty input: no rows. Other columns aren't read. ``spans`` lists the base spans and then the terms.
    """
    counts = [_count("base", k).alias(f"n_{k}") for k in KINDS]
    base = _listed(F.col("base"))
    terms = F.transform("terms", lambda s: F.struct(F.lit("term").alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    both = F.when(F.col("terms").isNull(), base).when(F.size("base") == 0, _listed(terms)).otherwise(F.concat_ws(",", base, _listed(terms)))
    return spans_by_document(docs).select("doc_id", *counts, F.sha2(base, 256).alias("base_sha256"), both.alias("spans"))


def sanitised(docs: DataFrame) -> DataFrame:
    """(doc_id, text): base spans replaced by their kind in brackets, terms that give them away by [TERM]."""
    spans = spans_by_document(docs).distinct().select(F.col("doc_id").alias("_doc"), F.col("content").alias("_content"), "base", "terms")
    found = F.concat(
        F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.upper(s["kind"]).alias("kind"))),
        F.transform(F.coalesce("terms", F.array().cast("array<struct<start: long, end: long>>")), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit("TERM").alias("kind"))),
    )

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        gap = F.substr("text", (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        out = F.when(fresh, F.concat(acc["out"], gap, F.lit("["), s["kind"], F.lit("]"))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    text = F.aggregate(F.array_sort(found), begin, step, lambda acc: F.concat(acc["out"], F.substr("text", (acc["at"] + 1).cast("int"), F.length("text"))))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    joined = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.md5("text") == F.col("_content")))
    return joined.select("doc_id", text.alias("text"))
