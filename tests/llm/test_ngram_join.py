import random
import re
from itertools import combinations

import numpy as np
import pytest

from provenia.llm import common, ngram_join
from provenia.llm.ngram_join import compared, near_components, shingle_set


def brute(rows):
    def own(text):
        parts = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return {tuple(parts[i : i + 5]) for i in range(len(parts) - 4)} or ({tuple(parts)} if parts else set())

    sets = [own(t) for _, t in rows]
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            top[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return sorted(((i, len(s), low.get(find(k))) for k, ((i, _), s) in enumerate(zip(rows, sets))), key=str)


def run(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, sid long, size long, tokens string").repartition(3)
    return sorted((tuple(r) for r in near_components(df).collect()), key=str)


def edited(rng, words, share):
    words = list(words)
    for k in range(len(words)):
        if rng.random() < share:
            words[k] = f"w{rng.randrange(10**6)}"
    return words


def corpus(seed, n=250):
    """Texts around the threshold: edits and cuts of a few texts, shared lines, templates, crowds, short ones."""
    rng = random.Random(seed)
    vocabulary = [f"v{i}" for i in range(3000)]
    text = lambda k: rng.choices(vocabulary, k=k)
    base = [text(rng.choice([6, 12, 30, 80, 200])) for _ in range(20)]
    line, template = text(30), text(120)
    out = []
    for _ in range(n):
        kind = rng.randrange(7)
        own = edited(rng, rng.choice(base), rng.choice([0, 0.005, 0.01, 0.02, 0.03]))
        if kind == 0:
            own = text(rng.randrange(1, 60))
        elif kind == 1:
            own = text(40) + line + text(20)
        elif kind == 2:
            own = edited(rng, template, 0.01)
        elif kind == 3:
            own = template + text(rng.randrange(1, 50))
        elif kind == 4:
            own = own[: max(1, len(own) * rng.randrange(75, 101) // 100)]
        elif kind == 5:
            own = line[:14] + text(rng.randrange(4))
        out.append(" ".join(w.upper() if rng.random() < 0.1 else w for w in own))
    return list(enumerate(out))


@pytest.mark.parametrize("seed", range(4))
def test_matches_brute_force(spark, seed):
    rows = corpus(seed)
    want = brute(rows)
    assert run(spark, rows) == want
    assert len({w[2] for w in want}) < 0.9 * len(rows)


@pytest.mark.parametrize("few, members", [(2, 3), (1, 256), (3, 1)])
def test_small_groups_and_shuffles(spark, monkeypatch, few, members):
    monkeypatch.setattr(ngram_join, "FEW", few)
    monkeypatch.setattr(ngram_join, "MEMBERS", members)
    monkeypatch.setattr(ngram_join, "TOGETHER", 4)
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 0)
    monkeypatch.setattr(ngram_join, "BROADCAST_KEYS", 0)
    rows = corpus(9, 200)
    assert run(spark, rows) == brute(rows)


def test_awkward_rows(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    rows += [(500, "A b\tc"), (501, "a B\x0bc "), (None, "a b c"), (502, "a b"), (503, "É x"), (504, "é x"), (None, "alone here"), (None, None), (7, "other text of a repeated id")]
    assert run(spark, rows) == brute(rows)


def test_empty(spark, empty):
    assert near_components(empty).collect() == []
    one = spark.createDataFrame([(3, "one"), (4, "")], "doc_id long, text string")
    assert sorted(map(tuple, near_components(one).collect())) == [(3, 1, 3), (4, 0, 4)]


def test_exact_threshold():
    sets = [np.arange(0, 9), np.arange(1, 10), np.arange(0, 10), np.arange(100, 104), np.array([100, 101, 102, 103, 104])]
    a, b = compared(sets, np.zeros(5, bool))
    assert len(a) == 3 and {frozenset(x) for x in zip(a.tolist(), b.tolist())} >= {frozenset((3, 4))}
    a, b = compared(sets, np.array([True, True, False, True, False]))
    assert len(a) == 3


def test_shingles_of_few_words_are_of_their_own():
    assert len(shingle_set("a b")) == 1 and len(shingle_set("a b c d e f")) == 2 and len(shingle_set(" \n")) == 0
    assert shingle_set("a b")[0] != shingle_set("a b c")[0]
    assert common.BROADCAST_KEYS


def test_tokens_move_once_to_be_compared(spark, monkeypatch):
    """Few members are sent to the sets: the tokens aren't shuffled by the sets' ids first. Many give the same links."""
    from provenia.llm import ngram_join

    sets = spark.createDataFrame([(k, sorted({*range(20), 100 + k})) for k in range(6)], "sid long, tokens array<long>")
    units = spark.createDataFrame([(k // 3, k // 3, k, False) for k in range(6)], "g long, h long, sid long, asking boolean")
    plans, real = [], ngram_join.tight
    monkeypatch.setattr(ngram_join, "tight", lambda df, *rows: (plans.append(df._jdf.queryExecution().toString()), real(df, *rows))[1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = sorted(map(tuple, ngram_join.verified(units, sets).collect()))
        assert not any("hashpartitioning(sid" in p for p in plans)
        monkeypatch.setattr(ngram_join, "BROADCAST_UNITS", 0)
        many = sorted(map(tuple, ngram_join.verified(units, sets).collect()))
        assert any("hashpartitioning(sid" in p for p in plans)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert few == many == [(0, 1), (0, 2), (3, 4), (3, 5)]


def test_sets_are_told_apart_where_they_lie(spark, monkeypatch):
    """Shared tokens are found by maps of bits, however many there are: neither the sets nor their tokens are shuffled to be counted."""
    tokens = [[1, 2, 3 + k, ngram_join.BELOW + 100 + k // 2] for k in range(10)]  # 1 and 2 in all, 3 + k in one, the last in two
    sets = spark.createDataFrame([(k, 4, 3, t) for k, t in enumerate(tokens)], "sid long, size long, below long, tokens array<long>")
    plans, real = [], ngram_join.tight
    monkeypatch.setattr(ngram_join, "tight", lambda df, *rows: (plans.append(df._jdf.queryExecution().toString()), real(df, *rows))[1])
    monkeypatch.setattr(ngram_join, "BROADCAST_KEYS", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        met = ngram_join.meeting(sets)
        plans.append(met._jdf.queryExecution().toString())
        assert not any("Exchange" in p for p in plans)
        found = {r["sid"]: r for r in met.collect()}
        assert [(found[k]["common"], found[k]["many"], found[k]["first"], found[k]["few"]) for k in range(10)] == [(2, 2, t[3], t[3:]) for t in tokens]
        monkeypatch.setattr(ngram_join, "LEAST_BITS", 1 << 40)
        assert {r["sid"]: r.asDict() for r in ngram_join.meeting(sets).collect()} == {k: r.asDict() for k, r in found.items()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_crowded_maps_give_the_same_links(spark, monkeypatch):
    """Bits that let half of all other keys through; joins by shuffle beyond every limit."""
    real, rows = ngram_join.bit_map, corpus(11, 150)
    noise = np.random.default_rng(3)
    with monkeypatch.context() as m:
        m.setattr(ngram_join, "bit_map", lambda keys, held: (bits := real(keys, held)) | noise.integers(0, 256, bits.shape, np.uint8) | noise.integers(0, 256, bits.shape, np.uint8))
        assert run(spark, rows) == brute(rows)
    for name, value in {"LEAST_BITS": 1 << 40, "BROADCAST_IDS": 0, "BROADCAST_KEYS": 0, "BROADCAST_UNITS": 0, "NAMED_ROWS": 0}.items():
        monkeypatch.setattr(ngram_join, name, value)
    assert run(spark, rows) == brute(rows)


def test_copies_beyond_a_broadcast_move_no_tokens(spark, monkeypatch):
    rows = spark.createDataFrame([(k % 7 if k else None, [k], k) for k in range(30)], "sid long, tokens array<long>, row long").repartition(3)
    lows = spark.createDataFrame([(k % 7, k) for k in range(7, 14)], "sid long, row long")
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 3)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = common.cut(rows)
        kept = ngram_join.distinct_sets(rows, lows)
        assert sorted(map(tuple, kept.collect())) == [(k % 7, [k]) for k in range(7, 14)]
        assert "Exchange" not in kept._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
