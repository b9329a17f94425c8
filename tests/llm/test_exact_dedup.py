import re
from hashlib import sha256

from provenia.llm.exact_dedup import drop_copies, exact_groups


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]", "", t or "") for _, t in rows]
    groups = {}
    for (i, t), n in zip(rows, norm):
        groups.setdefault(n, []).append((-len(t or ""), i is None, i or 0))
    out = []
    for (i, _), n in zip(rows, norm):
        best = min(groups[n])
        keep = None if best[1] else best[2]
        out.append((i, keep, len(groups[n]), i == keep, sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


def test_matches_brute_force(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, exact_groups(docs).collect()), key=str) == brute(rows)


def test_negative_and_extreme_ids(spark):
    rows = [(-(2**63), "a b"), (2**63 - 1, "ab"), (-5, "a  b"), (0, "a  b")]
    got = exact_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.keep_id, r.kept) for r in got} == {(-(2**63), -5, False), (2**63 - 1, -5, False), (-5, -5, True), (0, -5, False)}


def test_one_row_of_each_text_stays_with_its_columns(docs):
    left = drop_copies(docs)
    assert left.columns == docs.columns
    texts = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in left.collect()]
    assert sorted(texts) == sorted({re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in docs.collect()})


def test_empty(empty):
    assert exact_groups(empty).collect() == [] and drop_copies(empty).collect() == []
