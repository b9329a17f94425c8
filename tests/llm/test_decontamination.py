import random

import numpy as np

from provenia.llm import decontamination
from provenia.llm.common import words
from provenia.llm.decontamination import contaminated, drop_contaminated, tiled, tiles


def brute_tiles(item, text, least):
    free_i, free_t, total = [True] * len(item), [True] * len(text), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and free_i[i + n] and free_t[j + n] and item[i + n] == text[j + n] >= 0:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < least:
            return total
        n, i, j = best
        free_i[i : i + n], free_t[j : j + n] = [False] * n, [False] * n
        total += n


def test_tiles_cover_about_what_an_exhaustive_search_does():
    rng = random.Random(1)
    for _ in range(200):
        item = [rng.randrange(4) for _ in range(rng.randint(3, 25))]
        text = [rng.randrange(-1, 4) for _ in range(rng.randint(3, 40))]
        found = tiles(np.array(item), np.array(text), 3)
        spots = [(i + k, j + k) for i, j, n in found for k in range(n)]
        assert all(item[i] == text[j] for i, j in spots) and len({i for i, _ in spots}) == len(spots) == len({j for _, j in spots})
        # among matches of one length either search takes the first it sees
        assert abs(len(spots) - brute_tiles(item, text, 3)) <= 8 and bool(spots) == bool(brute_tiles(item, text, 3))


ITEM = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa quebec romeo sierra tango"


def test_reordered_passages_count_in_full():
    w = ITEM.split()
    text = "start " + " ".join(w[10:]) + " something between " + " ".join(w[:10]) + " end"
    assert tiled(words(ITEM), words(text)) == (20, 2)


def test_flags_and_keeps(spark):
    bench = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, None), (3, ""), (4, "too short")], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, "x " + ITEM.upper().replace(" ", ", ") + "! y"), (2, " ".join(ITEM.split()[:6])), (3, None), (4, ""), (5, "too short"), (None, ITEM), (6, "z " * 50_000 + ITEM)],
        "doc_id long, text string",
    )
    got = contaminated(docs, bench).collect()
    assert sorted((r.doc_id or 0, r.item_id, r.coverage) for r in got) == [(0, 1, 1.0), (0, 1, 1.0), (1, 1, 1.0), (1, 1, 1.0), (6, 1, 1.0), (6, 1, 1.0)]
    left = drop_contaminated(docs, bench)
    assert left.columns == docs.columns and sorted(r.doc_id or 0 for r in left.collect()) == [2, 3, 4, 5]


def test_query_matches_tiling_of_all_pairs(spark, monkeypatch):
    from provenia.llm import decontamination

    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(30)]
    common = "one seed that all items share"
    items = [(i, common + " " + " ".join(rng.choices(vocabulary, k=rng.randint(0, 40)))) for i in range(25)]
    rows = []
    for i in range(60):
        parts = []
        for _, text in rng.sample(items, 2):
            w = text.split()
            cut_at = rng.randint(0, len(w))
            parts.append(w[cut_at:] + w[:cut_at] if i % 3 else rng.choices(vocabulary, k=20) + w[: len(w) // 2])
        rows.append((i // 2, " ".join(sum(parts, [])), i))
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id long").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = []
    for doc_id, text, _ in rows:
        for item_id, item in items:
            n, k = tiled(words(item), words(text))
            if n >= 0.5 * len(words(item)):
                want.append((doc_id, item_id, len(words(item)), n, k))
    assert sorted(tuple(r)[:5] for r in contaminated(docs, bench).collect()) == sorted(want) and len(want) > 30
    kept = sorted(r.item_id for r in drop_contaminated(docs, bench).collect())
    monkeypatch.setattr(decontamination, "BROADCAST_SEEDS", 0)
    monkeypatch.setattr(decontamination, "BROADCAST_NAMES", 0)
    assert sorted(tuple(r)[:5] for r in contaminated(docs, bench).collect()) == sorted(want)
    assert sorted(r.item_id for r in drop_contaminated(docs, bench).collect()) == kept


def test_empty(spark, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert contaminated(empty, bench).collect() == []


def exhaustive(item, text, least):
    """The longest free match again and again, by trying every pair of places."""
    free_i, free_t, found = [True] * len(item), [True] * len(text), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for j in range(len(text)):
                n = 0
                while i + n < len(item) and j + n < len(text) and free_i[i + n] and free_t[j + n] and item[i + n] == text[j + n]:
                    n += 1
                best = min(best, (-n, i, j))
        n = -best[0]
        if n < least:
            return found
        _, i, j = best
        free_i[i : i + n] = free_t[j : j + n] = [False] * n
        found.append((i, j, n))


def test_tiling_is_exhaustive():
    assert sum(n for *_, n in tiles(np.arange(20), np.array([*range(12, 20), -1, *range(7, 14), -1, *range(15, 20)]), 5)) == 13
    rng = np.random.default_rng(8)
    for k in range(1500):
        item = rng.permutation(24) if k % 2 else rng.integers(0, 6, 24)
        parts = [item[s : s + rng.integers(2, 12)] for s in rng.integers(0, 22, 4)]
        text = np.concatenate([x for p in parts for x in (p, [-1] * int(rng.integers(0, 2)))]).astype(np.int64)
        assert tiles(item, text, 4) == exhaustive(item.tolist(), text.tolist(), 4)


def test_hot_seeds_and_large_items(spark, monkeypatch):
    """A passage that all items share, left out of the join, and items joined by shuffle, give the same rows."""
    from provenia.llm import decontamination as module

    rng = random.Random(4)
    hot = [f"hot{k}" for k in range(12)]
    items = [(k, " ".join([f"i{k}w{j}" for j in range(30)] + hot)) for k in range(12)]
    docs = []
    for k in range(60):
        own = items[k % 12][1].split()
        part = own[: rng.randrange(5, 42)]
        docs.append((k, " ".join(hot + [f"d{k}"] + part[len(part) // 2 :] + ["x"] + part[: len(part) // 2])))
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = sorted((d, i, *tiled([w.encode() for w in u.split()], [w.encode() for w in t.split()])) for d, t in docs for i, u in items)
    want = [x for x in want if x[2] >= 0.5 * 42]
    for limit in (64 << 20, 0):
        monkeypatch.setattr(module, "BROADCAST_BYTES", limit)
        got = sorted((r.doc_id, r.item_id, r.matched_words, r.tiles) for r in contaminated(a, b).collect())
        assert got == want and 10 < len(want) < 60


def test_wanted_seeds_hash_only_runs_of_known_words(monkeypatch):
    """Seeds picked by the benchmark's words are those that hashing every run gives, and other words aren't hashed."""
    import random

    rng = random.Random(4)
    item = [b"w%d" % rng.randrange(40) for _ in range(60)]
    text = [b"w%d" % rng.randrange(60) for _ in range(3000)] + item[10:30] + [b"other"] + item[10:16]
    runs = np.unique(decontamination.window_hashes(decontamination.word_hashes(item), 5))[::2]
    by_all = decontamination.Wanted(runs)(text, 5)
    picked = decontamination.Wanted(runs, sorted(set(item)))
    monkeypatch.setattr(decontamination, "word_hashes", None)
    assert len(by_all) > 5 and np.array_equal(picked(text, 5), by_all)
    assert not len(picked([b"other"] * 9 + item[:4], 5)) and not len(picked(item[:3], 5))


def test_query_is_the_same_without_named_words(spark, monkeypatch):
    docs = spark.createDataFrame([(k, f"some words {k} the old mill by the river turns all night long {k}") for k in range(6)] + [(9, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "The old mill by the river turns all night long"), (2, " ")], "item_id long, text string")
    want = sorted(map(tuple, decontamination.contaminated(docs, items).collect()))
    monkeypatch.setattr(decontamination, "BROADCAST_WORDS", 0)
    assert len(want) == 6 and sorted(map(tuple, decontamination.contaminated(docs, items).collect())) == want
