import math
import zlib
from collections import Counter, defaultdict
from hashlib import md5

from pyspark.sql import functions as F

from provenia.llm.sharding import rendezvous, shard_documents


def brute(key, weights):
    name = "null" if key is None else str(key)
    costs = [(-math.log((int(md5(f"{name}:{s}".encode()).hexdigest()[:12], 16) + 0.5) / 2**48) / w, s) for s, w in enumerate(weights) if w > 0]
    return min(costs)[1]


def test_matches_brute_force_and_slots_are_gapless(docs):
    rows = shard_documents(docs, [1.0] * 5).collect()
    assert len(rows) == docs.count()
    slots = defaultdict(list)
    for r in rows:
        assert (r.shard, r.grown_shard, r.law) == (brute(r.doc_id, [1.0] * 5), brute(r.doc_id, [1.0] * 6), "key")
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_size_and_checksum(docs):
    texts = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in shard_documents(docs, [1.0, 1.0]).collect()) == texts


def test_one_more_shard_takes_rows_only_into_itself(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    moved = [r for r in shard_documents(rows, [1.0] * 16).collect() if r.shard != r.grown_shard]
    assert all(r.grown_shard == 16 for r in moved) and 150 < len(moved) < 330


def test_weights_share_the_keys(spark):
    got = Counter(r.s for r in spark.range(6000).select(rendezvous(F.col("id"), [1.0, 2.0, 0.0, 3.0]).alias("s")).collect())
    assert got[2] == 0 and abs(got[0] - 1000) < 150 and abs(got[1] - 2000) < 200 and abs(got[3] - 3000) < 200


def test_empty(empty):
    assert shard_documents(empty, [1.0]).collect() == []
