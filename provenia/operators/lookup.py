"""Works named in prose looked up in a catalogue: ranked candidates, then author and year. Existence only, never support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenia.functions import parse
from provenia.functions import text as X
from provenia.session import cut, importable

#: Outcomes of a lookup.
OUTCOMES = ("CITATION_RESOLVED", "CITATION_NOT_FOUND", "CITATION_AMBIGUOUS", "CITATION_LOOKUP_FAILED")

#: Candidates ranked for a mention, and how many of its rarest terms find them.
TOP, ASKED = 5, 4

#: A term, or several together, that more works hold is met together with one more; up to how many.
COMMON, WIDEST = 64, 3


def terms(text: Column) -> Column:
    """Distinct lower-case words of letters and digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))


def _weigh(known: Column) -> Column:
    return F.aggregate(known, F.lit(0).cast("long"), lambda total, x: total + x["weight"])


def _rarer() -> Column:
    """The mention's known terms before place i."""
    return F.slice("known", 1, F.col("i"))


def sought(said: DataFrame, top: int = TOP, asked: int = ASKED) -> DataFrame:
    """(mention, known, i, term): the terms that meet the index, of said (mention, known: n, term, weight, the rarest first)."""
    rest = _weigh(F.slice("known", F.col("i") + 1, F.size("known")))
    rows = said.select("mention", "known", F.posexplode(F.slice("known", 1, asked)).alias("i", "x")).select("mention", "known", "i", F.col("x.term").alias("term"), rest.alias("rest"))
    return rows.where(~F.exists(_rarer(), lambda x: (x["n"] >= top) & (x["weight"] > F.col("rest")))).drop("rest")


def _after(terms: Column, i: Column) -> Column:
    """What stands behind place i."""
    return F.slice(terms, i + 2, F.size(terms))


def _widened(asks: DataFrame) -> DataFrame:
    """Each set of terms with one more of the mention's later terms; ``most``: what a work can score whose rarest terms they are."""
    rows = asks.select("mention", "terms", "weight", "reached", "later", F.posexplode("later").alias("i", "x"))
    most = F.col("weight") + _weigh(F.slice("later", F.col("i") + 1, F.size("later")))
    return rows.select("mention", F.concat("terms", F.array("x.term")).alias("terms"), (F.col("weight") + F.col("x.weight")).alias("weight"), most.alias("most"), "reached", _after(F.col("later"), F.col("i")).alias("later"))


def _holders(sets: DataFrame) -> DataFrame:
    """(terms, work, later): each work's sets of terms with one more of its later terms."""
    rows = sets.select("terms", "work", "later", F.posexplode("later").alias("i", "x"))
    return rows.select(F.concat("terms", F.array("x")).alias("terms"), "work", _after(F.col("later"), F.col("i")).alias("later"))


def _placed(rows: DataFrame, key: str) -> DataFrame:
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("work")))


def met_works(said: DataFrame, index: DataFrame, top: int = TOP, asked: int = ASKED, common: int = COMMON, widest: int = WIDEST) -> DataFrame:
    """(mention, work): works among which are the best ``top`` of each mention; some may come twice.

    said: mention, known (n, term, weight of its terms that the index has, the rarest first). index: work, term. Of a set
    of the mention's terms that more than ``common`` works hold, the first ``top`` works are met, which are the best of
    those that share nothing else, and the set is widened by each later term; the works of any other set are all met, and
    so are those of sets of ``widest`` terms. A set is left out if ``top`` works hold terms that weigh more than all that
    its works can share: they rank behind.
    """
    common = max(top, common)
    x = F.element_at("known", F.col("i") + 1)
    heavier = F.exists(_rarer(), lambda y: (y["n"] >= top) & (y["weight"] > x["weight"]))
    alone = sought(said, top, asked).where((x["n"] <= common) | ~heavier).select("mention", "term", F.when(x["n"] <= common, common).otherwise(top).alias("upto"))
    met = alone.join(_placed(index, "term").where(F.col("place") <= common).hint("merge"), "term").where(F.col("place") <= F.col("upto")).select("mention", "work")

    wide = said.select(F.explode("known").alias("x")).where(F.col("x.n") > common).select("x.n", "x.term").distinct()
    held = index.join(wide.hint("merge"), "term").groupBy("work").agg(F.sort_array(F.collect_list(F.struct("n", "term"))).alias("held"))
    held = cut(held.select("work", F.col("held.term").alias("later")))
    sets = _holders(held.select(F.array().cast("array<string>").alias("terms"), "work", "later"))
    reached = F.aggregate(F.slice("known", 1, asked), F.lit(0).cast("long"), lambda most, x: F.greatest(most, F.when(x["n"] >= top, x["weight"]).otherwise(0)))
    asks = said.select("mention", "known", reached.alias("reached"), F.posexplode(F.slice("known", 1, asked)).alias("i", "x")).where(F.col("x.n") > common)
    asks = asks.select("mention", F.array("x.term").alias("terms"), F.col("x.weight").alias("weight"), "reached", _after(F.col("known"), F.col("i")).alias("later"))
    for width in range(2, widest + 1):
        sets = _holders(sets.join(asks.select("terms").distinct().hint("merge"), "terms"))
        counts = sets.groupBy("terms").agg(F.count(F.lit(1)).alias("n"))
        asks = _widened(asks).where("most >= reached").join(counts.hint("merge"), "terms")
        best = F.max(F.when(F.col("n") >= top, F.col("weight"))).over(Window.partitionBy("mention"))
        asks = cut(asks.withColumn("reached", F.greatest("reached", best)).where("most >= reached"))
        whole = F.lit(width == widest) | (F.col("n") <= common)
        met = met.unionByName(asks.where(whole).select("mention", "terms").join(sets.hint("merge"), "terms").select("mention", "work"))
        if width < widest:
            asks = asks.where(~whole)
            met = met.unionByName(asks.select("mention", "terms").join(_placed(sets, "terms").where(F.col("place") <= top).hint("merge"), "terms").select("mention", "work"))
    return met


def ranked_candidates(mentions: DataFrame, works: DataFrame, top: int = TOP, asked: int = ASKED, common: int = COMMON) -> DataFrame:
    """(mention, work, score, rank): the best ``top`` works of each mention by the terms they share.

    mentions: mention, text. works: work, described (all that the catalogue says of it, as text). A term that n of N
    works hold weighs the binary digits of N div n, so a common word counts little; the score is the sum over shared
    terms, ties go to the smaller work. Candidates share one of the mention's ``asked`` rarest terms (ties by term);
    those that ``met_works`` leaves are scored by all their terms. Keys have to be distinct; null texts have no terms; a
    mention without a known term has no candidate. Joins with a catalogue are merge joins: the size that Spark guesses
    of exploded works is a fraction of theirs, and the driver would be sent them whole.
    """
    parts = works.sparkSession.sparkContext.defaultParallelism  # few rows meet in many: left to their size, one task would do it all
    held = works.select("work", "described").repartition(parts, "work").select("work", terms(F.coalesce("described", F.lit(""))).alias("held"))
    index = held.select("work", F.explode("held").alias("term"))
    counts = index.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    size = works.agg(F.count(F.lit(1))).scalar()
    weights = counts.select("term", "n", F.length(F.bin(((size - size % F.col("n")) / F.col("n")).cast("long"))).cast("long").alias("weight"))
    said = mentions.select("mention", F.explode(terms(F.coalesce("text", F.lit("")))).alias("term")).join(weights.hint("merge"), "term")
    said = said.groupBy("mention").agg(F.sort_array(F.collect_list(F.struct("n", "term", "weight"))).alias("known"))
    met = held.join(met_works(cut(said), index, top, asked, common).hint("merge"), "work").repartition(parts, "mention")
    met = said.join(met.hint("merge"), "mention")  # mention, known and work come from where nothing is cut, so their provenance stays
    scores = met.select("mention", "work", _weigh(F.filter("known", lambda x: F.array_contains("held", x["term"]))).alias("score")).distinct()
    place = F.row_number().over(Window.partitionBy("mention").orderBy(F.desc("score"), "work"))
    return scores.withColumn("rank", place).where(F.col("rank") <= top)


def look_up(mentions: DataFrame, works: DataFrame, top: int = TOP, asked: int = ASKED) -> DataFrame:
    """(mention, outcome, candidates, work, doi): what a catalogue says of each mention, one row each.

    mentions: mention, text. works: work, title, authors (array of family names), year, doi. A mention with a DOI is
    found by it or not at all. Any other needs an author: its ranked candidates that have that author, and a year at
    most one off where the mention has one. Several are AMBIGUOUS and none of them is named; without an author there is
    nothing to match on and the lookup FAILED. Null texts fail; works without a year match no mention that has one.
    """
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")
    doi = F.regexp_replace(X.doi_of(text), r"[.,;)]+$", "")
    m = mentions.select("mention", F.col("text"), doi.alias("_doi"), F.nullif(X.surname_of(text), F.lit("")).alias("_author"), X.year_of(text).alias("_year"))
    authors = F.transform(F.coalesce("authors", F.array().cast("array<string>")), F.lower)
    direct = m.where("_doi IS NOT NULL").join(works.select("work", "doi").hint("merge"), F.lower("_doi") == F.lower("doi"), "left").select("mention", "work", "doi")
    described = F.concat_ws(" ", "title", F.concat_ws(" ", "authors"), F.col("year").cast("string"))
    named = m.where("_doi IS NULL AND _author IS NOT NULL")
    ranked = ranked_candidates(named.select("mention", "text"), works.select("work", described.alias("described")), top, asked)
    known = works.select("work", "doi", authors.alias("_authors"), F.col("year").alias("_published"))
    near = F.col("_year").isNull() | F.coalesce(F.abs(F.col("_published") - F.col("_year")) <= 1, F.lit(False))
    matched = ranked.join(known.hint("merge"), "work").join(named.select("mention", "_author", "_year").hint("merge"), "mention").where(F.array_contains("_authors", F.col("_author")) & near)
    hits = direct.unionByName(matched.select("mention", "work", "doi")).groupBy("mention").agg(F.count("work").alias("n"), F.min("work").alias("_work"), F.min("doi").alias("_one"))
    rows = m.join(hits.hint("merge"), "mention", "left").withColumn("candidates", F.coalesce("n", F.lit(0)).cast("long"))
    failed = F.col("_doi").isNull() & F.col("_author").isNull()
    outcome = F.when(failed, OUTCOMES[3]).when(F.col("candidates") == 0, OUTCOMES[1]).when(F.col("candidates") == 1, OUTCOMES[0]).otherwise(OUTCOMES[2])
    only = F.col("candidates") == 1
    return rows.select("mention", outcome.alias("outcome"), "candidates", F.when(only, F.col("_work")).alias("work"), F.when(only, F.col("_one")).alias("doi"))


def named_existence(answers: DataFrame, works: DataFrame) -> DataFrame:
    """(capture, pos, kind, said, outcome, candidates, work, doi): every work named in the answers, looked up.

    answers: capture, answer_text. Equal wordings are looked up once, however many answers name them.
    """
    importable(answers.sparkSession)
    found = answers.select("capture", F.posexplode(parse.named_in("answer_text")).alias("pos", "c")).select("capture", "pos", "c.kind", F.col("c.text").alias("said"))
    once = found.select(F.col("said").alias("mention")).distinct().withColumn("text", F.col("mention"))
    return found.join(look_up(once, works).withColumnRenamed("mention", "said").hint("merge"), "said").select("capture", "pos", "kind", "said", "outcome", "candidates", "work", "doi")


def outcome_counts(found: DataFrame, *keys: str) -> DataFrame:
    """(keys, outcome, mentions): existence counts; they enter no rate."""
    return found.groupBy(*keys, "outcome").agg(F.count(F.lit(1)).alias("mentions"))
