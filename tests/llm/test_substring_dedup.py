import random

import numpy as np

from provenia.llm import common
from provenia.llm.common import words
from provenia.llm.substring_dedup import _least, band_keys, drop_repeats, paragraphs, repeated_paragraphs, repeats, shingle_hashes

from .conftest import WORDS


def line(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (words(a), words(b)))
    return len(x & y) / len(x | y)


def brute(rows):
    """{(doc_id, line): (members, keep)} by comparing every pair of paragraphs."""
    occ = [(i is not None, i or 0, n, " ".join(p.decode() for p in parts)) for i, t in rows for n, _, _, parts in paragraphs(t or "", 5)]
    texts = sorted({o[3] for o in occ})
    top = {t: t for t in texts}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for k, a in enumerate(texts):
        for b in texts[:k]:
            if jaccard(a, b) >= 0.8:
                top[find(a)] = find(b)
    groups = {}
    for o in occ:
        groups.setdefault(find(o[3]), []).append(o[:3])
    return sorted((*o, len(g), min(g)) for g in groups.values() if len(g) > 1 for o in g)


def rows_of(rng):
    common, long = line(rng, 60), line(rng, 20_000)
    rows = [(i, "\n".join([line(rng, 30), common if i % 3 == 0 else line(rng, 25), "short line", ""])) for i in range(40)]
    for i in range(8):  # near copies of one passage
        w = common.split()
        w[rng.randrange(60)] = f"changed{i}"
        rows.append((100 + i, line(rng, 15) + "\n" + " ".join(w).upper() + "!"))
    return rows + [(200, long), (201, long), (202, None), (203, ""), (204, common + "\n" + common), (None, common), (205, "\n\n"), (206, "é " * 40), (40, rows[1][1]), (41, rows[1][1])]


def test_matches_brute_force(spark):
    rows = rows_of(random.Random(3))
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, line int, pid int").repartition(4)
    got = repeated_paragraphs(docs, 5).collect()
    seen = sorted((r.doc_id is not None, r.doc_id or 0, r.line, r.members, (r.keep_doc_id is not None, r.keep_doc_id or 0, r.keep_line)) for r in got)
    assert seen == brute(rows)
    texts = dict((i, t) for i, t in rows)
    for r in got:
        assert r.removed == ((r.doc_id, r.line) != (r.keep_doc_id, r.keep_line))
        assert texts[r.doc_id][r.start : r.start + r.length] == texts[r.doc_id].split("\n")[r.line]


def test_long_runs_are_found_wherever_they_stand(spark):
    rng = random.Random(12)
    run = line(rng, 50)
    rows = []
    for i in range(12):
        before, after = line(rng, rng.randint(0, 40)), line(rng, rng.randint(1, 40))
        rows.append((i, f"{before} é {run.title() if i % 2 else run.replace(' ', chr(10), 3)}, {after}"))
    rows += [(100 + i, line(rng, 120)) for i in range(20)] + [(200, " ".join(run.split()[:24])), (300, None), (301, ""), (302, "few words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = repeats(docs).collect()
    assert {r.doc_id for r in got} == set(range(12))
    texts = dict(rows)
    for r in got:
        assert r.unit == "passage" and words(texts[r.doc_id])[r.at : r.at + 25] == words(texts[r.doc_id][r.start : r.start + r.length])
        assert words(texts[r.keep_doc_id])[r.keep_at : r.keep_at + 25] == words(texts[r.doc_id][r.start : r.start + r.length])
        assert r.removed == ((r.doc_id, r.at) != (r.keep_doc_id, r.keep_at))


def test_a_word_said_over_and_over_is_cut_apart(spark):
    docs = spark.createDataFrame([(1, "again " * 500), (2, "again " * 60)], "doc_id long, text string")
    got = [(r.doc_id, r.at) for r in repeats(docs).where("unit = 'passage'").collect()]
    assert {d for d, _ in got} == {1, 2} and len(got) <= 500 / 25 + 60 / 25
    for d in (1, 2):
        places = sorted(a for x, a in got if x == d)
        assert all(b - a >= 25 for a, b in zip(places, places[1:]))


def test_least_of_each_run():
    rng = np.random.default_rng(1)
    for n, width in ((1, 5), (4, 5), (5, 5), (40, 7), (40, 1), (40, 26)):
        x = rng.integers(0, 9, n)
        w = min(width, n)
        assert x[_least(x, width)].tolist() == [min(x[i : i + w]) for i in range(n - w + 1)]


def test_removed_spans_leave_and_the_rest_stays(spark):
    rows = rows_of(random.Random(3))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {}
    for r in repeats(docs).where("removed").collect():
        spans.setdefault(r.doc_id, set()).update(range(r.start, r.start + r.length))
    assert spans
    left = {r.doc_id: r.text for r in drop_repeats(docs).collect()}
    for i, t in rows:
        assert left[i] == (t and "".join(c for k, c in enumerate(t) if i is None or k not in spans.get(i, ())))


def test_bands_reach_high_recall_at_the_threshold():
    rng = random.Random(8)
    hits = total = 0
    for _ in range(300):
        w = line(rng, 90).split()
        v = list(w)
        for k in (20, 60):
            v[k] = "other"
        if 0.78 <= jaccard(" ".join(w), " ".join(v)) <= 0.85:
            keys = band_keys(*shingle_hashes([words(" ".join(w)), words(" ".join(v))]))
            hits, total = hits + bool((keys[0] == keys[1]).any()), total + 1
    assert total > 250 and hits >= 0.98 * total


def test_shingles_stay_inside_their_paragraph():
    many = [words(line(random.Random(i), 25 + i)) for i in range(5)]
    joint, starts = shingle_hashes(many)
    for part, own in zip(np.split(joint, starts[1:]), many):
        assert part.tolist() == shingle_hashes([own])[0].tolist()


def test_star_of_near_copies_is_one_cluster(spark):
    rng = random.Random(4)
    base = line(rng, 60).split()
    rows = [(i, " ".join(base[:k] + [f"new{i}"] + base[k + 1 :]) if i != 150 else " ".join(base)) for i in range(301) for k in [rng.randrange(60)]]
    keys = band_keys(*shingle_hashes([words(t) for _, t in rows]))
    assert (keys == keys[150]).any(axis=1).all()
    got = repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()
    assert len(got) == 301 and {(r.members, r.keep_doc_id) for r in got} == {(301, 0)}


def test_short_lines_that_repeat_are_found(spark):
    rng = random.Random(14)
    notice, five = "All rights reserved by the owners of this work.", "Read the whole story here"
    rows = [(i, "\n".join([line(rng, 30), notice, line(rng, 12), five, line(rng, 8)])) for i in range(500)] + [(900, notice.upper()), (901, "four words are few"), (902, "four words are few")]
    got = repeated_paragraphs(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 5).collect()
    assert sorted((r.doc_id, r.line, r.members) for r in got) == sorted([(i, 1, 501) for i in range(500)] + [(900, 0, 501)] + [(i, 3, 500) for i in range(500)])
    assert sum(not r.removed for r in got) == 2


def test_spanning_links_connect_what_all_pairs_do(monkeypatch):
    monkeypatch.setattr(common, "COLUMNS", 7)
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 30, 25)).astype(np.uint32) for _ in range(60)]
    near = {(i, j) for i in range(60) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) >= 0.6 * len(np.union1d(sets[i], sets[j]))}
    a, b = common.spanning_links(sets, 0.6)
    assert {(max(p), min(p)) for p in zip(a.tolist(), b.tolist())} <= near and near

    def groups(pairs):
        top = list(range(60))
        for i, j in pairs:
            x, y = top[i], top[j]
            top = [x if t == y else t for t in top]
        return [top.index(t) for t in top]

    assert groups(zip(a, b)) == groups(near)


def test_empty(empty):
    assert repeats(empty).collect() == [] and drop_repeats(empty).collect() == []
