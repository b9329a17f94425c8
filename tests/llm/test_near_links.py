"""Near dedup walks the links of its candidates once."""

from provenia.llm import simhash


def test_found_links_are_walked_as_stars(spark, docs, monkeypatch):
    seen, walk = [], simhash.components
    base = " ".join(f"word{i}" for i in range(400))
    group = [(1000 + i, base.replace(f"word{i * 9} ", "other ", 1), "en", "s", 1, 1, "k") for i in range(7)]
    both = docs.unionByName(spark.createDataFrame(group, docs.schema))
    monkeypatch.setattr(simhash, "components", lambda links, *names: seen.append(links.count()) or walk(links, *names))
    left = {r.doc_id for r in simhash.drop_near_copies(both).select("doc_id").collect()}
    assert 1000 in left and not left & set(range(1001, 1007))
    assert len(seen) == 2 and seen[1] < seen[0]
