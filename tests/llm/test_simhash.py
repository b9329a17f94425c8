import random

import numpy as np
import xxhash

from provenia.llm import simhash
from provenia.llm.simhash import drop_near_copies, fingerprint, fingerprint_links, golay_decode, golay_keys, near_links, pigeonhole_keys, simhash_components


def brute_fingerprint(text):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, near):
    top = {i: i for i in ids}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in near:
        a, b = sorted((find(a), find(b)))
        top[b] = a
    return {i: find(i) for i in ids}


def test_decodes_up_to_three_errors():
    rng = np.random.default_rng(0)
    assert set(np.bincount(golay_decode(np.arange(1 << 23)), minlength=4096)) == {2048}


def test_words_within_two_bits_share_a_key():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 23, 500)
    keys = golay_keys(a)
    assert set((keys >= 0).sum(1).tolist()) <= {1, 6}
    for i in range(23):
        for j in range(23):
            other = golay_keys(a ^ (1 << i) ^ (1 << j))
            shared = [(set(x[x >= 0].tolist()) & set(y[y >= 0].tolist())) for x, y in zip(keys, other)]
            assert all(shared)


def test_fingerprints_within_two_bits_share_a_key():
    rng = random.Random(2)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
        row, key = pigeonhole_keys(np.array([a, b], np.uint64))
        assert set(key[row == 0].tolist()) & set(key[row == 1].tolist())


def test_fingerprint_matches_brute_force(docs):
    for r in docs.collect():
        if len(r.text or "") < 50_000:
            assert fingerprint(r.text) == brute_fingerprint(r.text), r.doc_id


def test_links_connect_exactly_what_brute_force_does(spark):
    rng = random.Random(4)
    fps = {0}
    for _ in range(12):
        base = rng.getrandbits(64)
        cloud = [base]
        for _ in range(60):  # crowded buckets: chains and stars around one word
            x = rng.choice(cloud)
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
            cloud.append(x)
        fps |= set(cloud)
    signed = sorted(x - (1 << 64) if x >> 63 else x for x in fps)
    got = simhash.components(fingerprint_links(spark.createDataFrame([(x,) for x in signed], "fp long"))).collect()
    near = [(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= 2]
    want = {k: v for k, v in brute_components(signed, near).items() if any(k in p for p in near)}
    assert {r.node: r.component for r in got} == want


def test_components_of_documents(docs):
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect() if len(r.text or "") < 50_000]
    got = [r for r in simhash_components(docs.where("length(coalesce(text, '')) < 50000")).collect()]
    ids = sorted({f for _, f in rows})
    tops = brute_components(ids, [(a, b) for a in ids for b in ids if a < b and bin(a ^ b).count("1") <= 2])
    least = {}
    for i, f in rows:
        if i is not None:
            least[tops[f]] = min(i, least.get(tops[f], i))
    assert sorted((r.doc_id or -1, r.fingerprint, r.component_id or -1) for r in got) == sorted((i or -1, f"{f:016x}", least.get(tops[f], -1)) for i, f in rows)


def test_near_copies_are_found_and_others_stay(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdefghilmnoprstuv", k=rng.randint(2, 9))) for _ in range(4000)]
    rows, want = [], set()
    for g in range(80):
        base = rng.choices(vocabulary, k=rng.randint(30, 400))
        rows.append((g * 10, " ".join(base)))
        copy = list(base)
        for _ in range(max(1, len(copy) // 80)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        rows.append((g * 10 + 1, " ".join(copy).capitalize() + "."))
        want.add((g * 10, g * 10 + 1))
        rows.append((g * 10 + 2, " ".join(rng.choices(vocabulary, k=120))))
    rows += [(None, rows[0][1]), (5000, None), (5001, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")

    def jaccard(a, b):
        x, y = ({tuple(t.lower().rstrip(".").split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
        return len(x & y) / len(x | y)

    texts = {i: t for i, t in rows if t}
    found = {(r.a, r.b) for r in near_links(docs).collect()}
    sure = {p for p in want if jaccard(texts[p[0]], texts[p[1]]) >= 0.86}
    assert len(sure) > 50 and len(sure & found) >= 0.98 * len(sure) and found <= want
    left = {r.doc_id for r in drop_near_copies(docs).collect()}
    assert left == {i for i, _ in rows} - {b for _, b in found}


def test_large_bucket_of_near_copies(spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefghilmnoprstuv", k=6)) for _ in range(900)]
    base = rng.choices(vocabulary, k=300)
    rows = []
    for i in range(60):
        copy = list(base)
        copy[rng.randrange(300)] = f"new{i}"
        rows.append((i, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.doc_id for r in drop_near_copies(docs).collect()] == [0]


def test_empty(empty):
    assert simhash_components(empty).collect() == [] and drop_near_copies(empty).collect() == []


def test_star_of_near_copies_leaves_one(spark):
    rng = random.Random(21)
    base = ["".join(rng.choices("abcdefghilmnoprstuv", k=7)) for _ in range(60)]
    rows = [(i, " ".join(base[:k] + [f"new{i}"] + base[k + 1 :]) if i != 150 else " ".join(base)) for i in range(301) for k in [rng.randrange(60)]]
    left = [r.doc_id for r in drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert left == [0]


def test_appended_and_cut_off_copies_share_a_key():
    rng = random.Random(31)
    vocabulary = ["".join(rng.choices("abcdefghilmnoprstuv", k=7)) for _ in range(20_000)]
    for n in (10_000, 200_000, 10**8):
        bands, exact = simhash.bands_for(n)
        golay, either, total = 0, 0, 300
        for i in range(total):
            base = rng.choices(vocabulary, k=rng.randint(60, 300))
            shingles = len(base) - 4
            longer, shorter = base + rng.choices(vocabulary, k=shingles // 4), base[: -(-shingles * 4 // 5) + 4]
            one, two = (simhash.features(" ".join(w), bands * (23 + exact)) for w in (base, longer if i % 2 else shorter))
            row, key = simhash.band_keys(np.frombuffer(one[0] + two[0], np.uint8).reshape(2, -1), bands, exact)
            assert (key >= 0).all()
            met = bool(set(key[row == 0].tolist()) & set(key[row == 1].tolist()))
            golay += met
            either += met or bool(set(np.frombuffer(one[2], np.int64).tolist()) & set(np.frombuffer(two[2], np.int64).tolist()))
        print(n, "of", total, "by Golay keys", golay, "by either", either)
        assert either >= 0.985 * total
