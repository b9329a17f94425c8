import random

from pyspark.sql import functions as F

from provenia.functions.text import same_citation
from provenia.operators import joins
from provenia.operators.pairs import running_total


def _sides(spark, seed):
    rng = random.Random(seed)
    key = lambda: rng.choice(["a", "a", "a", "b", "c", None])
    left = [(i, key(), rng.choice([rng.randrange(60), None] if rng.random() < 0.1 else [rng.randrange(60)])) for i in range(120)]
    right = [(rng.choice(["a", "a", "b", "d", None]), rng.randrange(60), i, "x") for i in range(80)]
    at = lambda df, c: df.withColumn(c, F.timestamp_seconds(c))
    return left, right, at(spark.createDataFrame(left, "i long, k string, t long"), "t"), at(spark.createDataFrame(right, "k string, s long, j long, t string"), "s")


def test_asof_and_nearest_match_all_pairs(spark):
    left, right, a, b = _sides(spark, 3)
    for piece in (joins.by_seconds(1), joins.by_seconds(7), lambda at: F.lit(0)):
        back = {r.i: r.j for r in joins.asof_join(a, b, "k", "t", "s", ["j"], piece).select("i", "match.j").collect()}
        ahead = {r.i: r.j for r in joins.asof_join(a, b, "k", "t", "s", ["j"], piece, forward=True).select("i", "match.j").collect()}
        near = {r.i: r.j for r in joins.nearest_join(a, b, "k", "t", "s", ["j"], piece).select("i", "match.j").collect()}
        assert len(back) == len(ahead) == len(near) == len(left)
        for i, k, t in left:
            own = [(s, j) for q, s, j, _ in right if q == k and k is not None and t is not None]
            one, two = max((x for x in own if x[0] <= t), default=None), min((x for x in own if x[0] >= t), default=None)
            assert (back[i], ahead[i]) == (one and one[1], two and two[1])
            best = two if one is None or two is not None and two[0] - t < t - one[0] else one
            assert near[i] == (best and best[1])


def test_asof_forms_no_product(spark):
    _, _, a, b = _sides(spark, 4)
    plan = joins.asof_join(a, b, "k", "t", "s", ["j"], joins.by_seconds(7))._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_containment_matches_all_pairs(spark):
    rng = random.Random(6)
    sets = lambda n, most: [(i, rng.sample("abcdefgh", rng.randrange(most)) + [None] * rng.randrange(2)) for i in range(n)]
    left, right = sets(60, 4), sets(50, 7)
    got = joins.contained_in(*(spark.createDataFrame(x, "id long, tokens array<string>") for x in (left, right))).collect()
    strip = lambda x: {t for t in x if t}
    assert sorted(map(tuple, got)) == sorted((i, j) for i, x in left for j, y in right if strip(x) and strip(x) <= strip(y))
    empty = spark.createDataFrame([], "id long, tokens array<string>")
    assert joins.contained_in(empty, empty).collect() == []


def test_same_citations_is_same_citation_of_all_pairs(spark):
    rng = random.Random(7)
    words = ["Moreno", "Okafor", "2019", "2020", "et al.", "Optics Letters", "no", "a", "", "10.1000/xy1"]
    text = lambda: " ".join(rng.choices(words, k=rng.randrange(5)))
    a, b = (spark.createDataFrame([(text(),) for _ in range(80)] + [(None,)], "text string") for _ in range(2))
    want = a.distinct().crossJoin(b.distinct().withColumnRenamed("text", "other")).where(same_citation(F.col("text"), F.col("other")))
    assert sorted(map(tuple, joins.same_citations(a, b).collect())) == sorted(map(tuple, want.collect()))


def test_running_total_of_one_key_in_many_pieces(spark):
    rng = random.Random(9)
    rows = [(k, i, rng.randrange(9)) for k in ("a", "b") for i in rng.sample(range(1000), 200)]
    df = spark.createDataFrame(rows, "k string, i long, v long")
    for pieces in (1, 5, 64):
        got = {(r.k, r.i): r.before for r in running_total(df, "v", "k", "i", pieces).collect()}
        assert got == {(k, i): sum(v for q, j, v in rows if q == k and j < i) for k, i, _ in rows}
    assert running_total(df.limit(0), "v", "k", "i").collect() == []
