"""Named works looked up: ranks against brute force, then author and year."""

import random
from collections import Counter

from pyspark.sql import functions as F

from provenia.operators import lookup
from provenia.operators.provenance import classified, lineage

MENTION, WORK = "mention string, text string", "work int, title string, authors array<string>, year int, doi string"


def outcomes(spark, mentions, works, **more):
    rows = lookup.look_up(spark.createDataFrame(mentions, MENTION), spark.createDataFrame(works, WORK), **more).collect()
    return {r["mention"]: (r["outcome"], r["candidates"], r["work"], r["doi"]) for r in rows}


def test_ranks_equal_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(40)]
    draw = lambda n: " ".join(rng.choice(words[: rng.choice([5, 20, 40])]) for _ in range(n))
    works, mentions = {i: draw(6) for i in range(60)}, {str(i): draw(5) for i in range(40)}
    got = lookup.ranked_candidates(spark.createDataFrame(list(mentions.items()), MENTION), spark.createDataFrame(list(works.items()), "work int, described string")).collect()
    held = Counter(t for w in works.values() for t in set(w.split()))
    weight = {t: len(bin(len(works) // n)) - 2 for t, n in held.items()}
    want = set()
    for m, text in mentions.items():
        known = sorted((t for t in set(text.split()) if t in held), key=lambda t: (held[t], t))
        scores = [(-sum(weight[t] for t in set(known) & set(w.split())), k) for k, w in works.items() if set(known[: lookup.ASKED]) & set(w.split())]
        want |= {(m, k, -s, place) for place, (s, k) in enumerate(sorted(scores)[: lookup.TOP], 1)}
    assert {(r["mention"], r["work"], r["score"], r["rank"]) for r in got} == want and len(want) > 100


def test_sets_of_common_terms_lose_no_candidate(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(24)]
    draw = lambda n: " ".join(rng.choice(words[: rng.choice([4, 8, 24])]) for _ in range(n))
    works, mentions = {i: draw(7) for i in range(400)}, {str(i): draw(6) for i in range(40)}
    found = {c: lookup.ranked_candidates(spark.createDataFrame(list(mentions.items()), MENTION), spark.createDataFrame(list(works.items()), "work int, described string"), top=3, common=c).collect() for c in (3, 30, 1000)}
    held = Counter(t for w in works.values() for t in set(w.split()))
    weight = {t: len(bin(len(works) // n)) - 2 for t, n in held.items()}
    want = set()
    for m, text in mentions.items():
        known = sorted((t for t in set(text.split()) if t in held), key=lambda t: (held[t], t))
        scores = [(-sum(weight[t] for t in set(known) & set(w.split())), k) for k, w in works.items() if set(known[: lookup.ASKED]) & set(w.split())]
        want |= {(m, k, -s, place) for place, (s, k) in enumerate(sorted(scores)[:3], 1)}
    for rows in found.values():
        assert {(r["mention"], r["work"], r["score"], r["rank"]) for r in rows} == want and len(want) == 120


def test_a_mention_of_common_terms_meets_few_works(spark):
    works = spark.range(40_960).selectExpr("id AS work", "concat_ws(' ', 'a' || id % 8, 'b' || id DIV 8 % 8, 'c' || id DIV 64 % 8, 'd' || id DIV 512 % 8, 'e' || id) AS described")
    index = works.select("work", F.explode(lookup.terms(F.col("described"))).alias("term")).cache()
    known = [(5_120, t, 4) for t in ("a1", "b2", "c3", "d4")]
    said = spark.createDataFrame([("m", known)], "mention string, known array<struct<n: long, term: string, weight: long>>")
    assert index.where("term IN ('a1', 'b2', 'c3', 'd4')").select("work").distinct().count() > 16_000
    assert lookup.met_works(said, index).distinct().count() < 400


def test_classes_of_provenance_stay(spark):
    words = F.concat(F.lit("w"), (F.col("id") % 9).cast("string"), F.lit(" v"), (F.col("id") % 4).cast("string"))
    mentions = classified(spark.range(3).withColumn("text", words), {"id": "record", "text": "your-input"}).select(F.col("id").cast("string").alias("mention"), "text")
    works = classified(spark.range(900).withColumn("described", words), {"id": "record", "described": "external-source"}).select((F.col("id") + 0).alias("work"), "described")
    found = {c: (value, under) for c, value, under in lineage(lookup.ranked_candidates(mentions, works))}
    assert found["work"] == ("script-output", ["record"]) and found["mention"][1] == ["record"]
    assert "your-input" in found["score"][1] and "external-source" in found["score"][1] and found["rank"][0]


def test_author_and_year_are_both_needed(spark):
    works = [(1, "Cold rivers", ["Tarn", "Quill"], 2001, "10.5/a"), (2, "Warm rivers", ["Tarn"], 2010, "10.5/b"), (3, "Grey hills", ["Moor"], None, None)]
    mentions = [("hit", "Tarn et al., Cold rivers, 2002"), ("second author", "Quill, Cold rivers, 2001"), ("wrong year", "Tarn et al., Cold rivers, 2005"), ("wrong name", "Fenn et al., Cold rivers, 2001"),
                ("no year", "Tarn et al., rivers"), ("undated work", "Moor et al., Grey hills, 1999"), ("undated both", "Moor et al., Grey hills")]
    assert outcomes(spark, mentions, works) == {
        "hit": ("CITATION_RESOLVED", 1, 1, "10.5/a"),
        "second author": ("CITATION_RESOLVED", 1, 1, "10.5/a"),
        "wrong year": ("CITATION_NOT_FOUND", 0, None, None),
        "wrong name": ("CITATION_NOT_FOUND", 0, None, None),
        "no year": ("CITATION_AMBIGUOUS", 2, None, None),
        "undated work": ("CITATION_NOT_FOUND", 0, None, None),
        "undated both": ("CITATION_RESOLVED", 1, 3, None),
    }


def test_dois_failures_and_empty_inputs(spark):
    works = [(1, None, None, None, "10.1234/Ab"), (2, "Tarn", [], 2000, None)]
    mentions = [("doi", "see 10.1234/aB."), ("unknown doi", "Tarn 10.1234/zz"), ("nobody", "in 1999"), ("null", None), ("empty", "")]
    want = {"doi": ("CITATION_RESOLVED", 1, 1, "10.1234/Ab"), "unknown doi": ("CITATION_NOT_FOUND", 0, None, None)} | dict.fromkeys(("nobody", "null", "empty"), ("CITATION_LOOKUP_FAILED", 0, None, None))
    assert outcomes(spark, mentions, works) == want
    assert outcomes(spark, [("a", "Tarn 2000")], []) == {"a": ("CITATION_NOT_FOUND", 0, None, None)}
    assert outcomes(spark, [], works) == {}


def test_counts_per_outcome_of_whole_answers(spark):
    works = spark.createDataFrame([(1, "Cold rivers", ["Tarn"], 2001, "10.5/a")], WORK)
    answers = spark.createDataFrame([("x", "As Tarn et al., Cold rivers, 2001 say. And NCT00000001."), ("y", "As Tarn et al., Cold rivers, 2001 say."), ("z", "nothing named"), ("n", None)], "capture string, answer_text string")
    found = lookup.named_existence(answers, works)
    assert {(r["outcome"], r["mentions"]) for r in lookup.outcome_counts(found).collect()} == {("CITATION_RESOLVED", 2), ("CITATION_LOOKUP_FAILED", 1)}
    assert "CartesianProduct" not in found._jdf.queryExecution().executedPlan().toString()
