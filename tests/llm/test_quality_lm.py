import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from provenia.llm import quality_lm as lm
from provenia.llm.common import cut, weighed

from .conftest import prose


def brute_table(texts):
    """log2 p of a gram (w1 w2 w3 w4) as a function, straight from the definition."""
    counts = Counter()
    for t in texts:
        s = lm.START + t.encode()
        counts.update(tuple(s[i - 3 : i + 1]) for i in range(3, len(s)))
    levels = [counts]
    for _ in range(3):
        levels.append(Counter(g[1:] for g in levels[-1]))

    def discounts(c):
        n = [sum(v == k for v in c.values()) for k in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        out = []
        for k in (1, 2, 3):
            out.append(min(k - 0.05, max(0.05, k - (k + 1) * y * n[k] / n[k - 1])) if n[k - 1] and n[k] else k / 2)
        return out

    parts = []
    for c in levels:
        d = discounts(c)
        held, total = Counter(), Counter()
        for g, v in c.items():
            held[g[:-1]] += min(d[min(v, 3) - 1], v)
            total[g[:-1]] += v
        parts.append((c, d, held, total))

    def p(g, level=0):
        if level == 4:
            return 1 / 256
        c, d, held, total = parts[level]
        lower = p(g[1:], level + 1)
        if not total[g[:-1]]:
            return lower
        v = c[g]
        return (v - min(d[min(v, 3) - 1], v) if v else 0) / total[g[:-1]] + held[g[:-1]] / total[g[:-1]] * lower

    return lambda g: math.log2(p(g))


def test_document_sums_match_the_definition(spark, monkeypatch):
    rng = random.Random(2)
    texts = [prose(rng, 40) + rng.choice(["!", ".", " É 5"]) for _ in range(30)]
    others = [prose(rng, 10).upper(), "日本語", "", None, texts[0] + " \x00\n", "a"]
    rows = spark.createDataFrame([(t, True) for t in texts] + [(t, False) for t in others], "text string, good boolean").repartition(3)
    counts = cut(lm.gram_counts(rows))
    model = lm.kneser_ney(counts.where("trained > 0").select("code", F.col("trained").alias("n")))
    table = cut(lm.bits_of(counts.select("code", "n"), model))
    want = brute_table(texts)
    for r in table.collect():
        assert r.bits == pytest.approx(-want(tuple(r.code.to_bytes(4, "big"))), rel=1e-9)
    docs = rows.select(F.struct(F.col("text").alias("name")).alias("doc"), "text")
    for most in (1_000_000, 200, 1):  # all by broadcast, some, hardly any
        both = weighed(lm.document_grams(docs), "doc", "code", table.withColumn("tail", F.greatest(F.col("bits") - lm.DEAR, F.lit(0.0))), "bits", most, ("tail",)).collect()
        got = {r.doc.name: (r.total, r.times) for r in both}
        tails = {r.doc.name: r.tail for r in both}
        assert len(got) == len(texts) + len(others)
        for t in texts + others:
            s = lm.START + (t or "").encode()
            assert got[t] == (pytest.approx(-sum(want(tuple(s[i - 3 : i + 1])) for i in range(3, len(s)))), len(s) - 3)
            assert tails[t] == pytest.approx(sum(max(0, -want(tuple(s[i - 3 : i + 1])) - lm.DEAR) for i in range(3, len(s))))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randint(5, 200)), "en") for i in range(300)]
    junk = [(1000 + i, " ".join("$%&#*"[rng.randrange(5)] * 3 + w.upper() + "!!" for w in prose(rng, 40).split()), "en") for i in range(20)]
    odd = [(2000, None, "en"), (2001, "", None), (2002, "river stone", None), (2003, prose(rng, 50), "xx"), (None, prose(rng, 20), "en"), (2004, "x", "en"), (2005, prose(rng, 30_000), "en"), (5, rows[5][1], "en")]
    docs = spark.createDataFrame([(*r, 0, 0, 0.5) for r in rows + junk + odd], "doc_id long, text string, lang string, kept int, n int, bits double")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 300, 2)] + [(1000, 0, 0), (1001, 0, 1), (7, None, 0), (None, 1, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_rejects_junk_and_keeps_clean_documents(corpus):
    docs, labels = corpus
    got = lm.classify(docs, labels).collect()
    assert len(got) == docs.count()
    gone = {r.doc_id for r in got if not r.kept}
    assert gone >= set(range(1000, 1020)) and len(gone) <= 20 + 0.04 * 300
    assert all(r.kept for r in got if r.n_symbols == 0)
    left = lm.drop_low_quality(docs, labels)
    assert left.columns == docs.columns and {r.kept for r in left.collect()} == {0}
    assert sorted(str(r.doc_id) for r in left.collect()) == sorted(str(r.doc_id) for r in got if r.kept)


def test_rejects_a_few_words_that_trusted_text_does_not_have(spark, corpus):
    docs, labels = corpus
    rng = random.Random(8)
    rows = []
    for i in range(20):
        parts = prose(rng, 150).split()
        for at in (10, 60, 110):
            parts[at] = ("xqzzk", "vjyqq", "kwzxj")[at % 3]
        rows.append((3000 + i, " ".join(parts), "en", 0, 0, 0.5))
    both = docs.unionByName(spark.createDataFrame(rows, docs.schema))
    found = {r.doc_id: r for r in lm.classify(both, labels).collect()}
    assert not any(found[3000 + i].kept for i in range(20))
    assert sum(found[i].kept for i in range(1, 300, 2)) >= 0.96 * 150


def test_held_out_accuracy(corpus):
    docs, labels = corpus
    held = [r for r in lm.classify(docs, labels).collect() if r.doc_id is not None and (r.doc_id % 2 and r.doc_id < 300 or 1002 <= r.doc_id < 1020)]
    assert sum(r.kept == (r.doc_id < 300) for r in held) >= 0.96 * len(held)


def test_shuffled_ids_give_the_same(corpus, monkeypatch):
    docs, labels = corpus
    one = sorted(map(str, lm.classify(docs, labels).collect()))
    monkeypatch.setattr(lm, "BROADCAST_IDS", 0)
    assert sorted(map(str, lm.classify(docs, labels).collect())) == one


def test_without_trusted_text_everything_stays(spark, corpus, empty):
    docs, labels = corpus
    got = lm.classify(docs, labels.limit(0)).collect()
    assert len(got) == docs.count() and all(r.kept and r.perplexity is None for r in got)
    assert lm.drop_low_quality(docs, labels.limit(0)).count() == docs.count()
    assert lm.classify(empty, labels).collect() == []
