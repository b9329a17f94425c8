"""SimHash near-dedup with Golay-code fuzzy hashing.

The perfect binary Golay code [23, 12, 7] puts each 23-bit word within distance 3 of exactly one codeword. The keys
of a word are the 12-bit indices of the codewords that its ball of radius 1 decodes to: one, or six. Two words at
distance 2 or less have a common word within distance 1 of both, and so a common key.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits. If two fingerprints differ in at most 2 bits, then
by the pigeonhole principle one of the three segments is equal, and the next one (in a circle) differs in at most 2
bits: (that segment exactly, a Golay key of the next) is a key of both. Collisions are verified on all 64 bits.
"""

from __future__ import annotations

import math
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenia.llm.common import SMALL_BUCKET, colliding, components, cut, large_bucket_links, links_by_bucket, ready, small_pairs, words

MAX_BITS = 2

# ---------------------------------------------------------------- Golay code


@lru_cache(1)
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and high 11 bits, and the error pattern of each syndrome. Generated by x^11 + x^9 + x^7 + x^6 + x^5 + x + 1."""

    def rest(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= 0b101011100011 << (bit - 11)
        return word

    unit = [rest(1 << i) for i in range(23)]

    def table(units: list[int]) -> np.ndarray:
        out = np.zeros(1, np.int32)
        for u in units:
            out = np.concatenate([out, out ^ u])
        return out

    errors = np.zeros(2048, np.int32)
    for i in range(23):
        errors[unit[i]] = 1 << i
        for j in range(i):
            errors[unit[i] ^ unit[j]] = 1 << i | 1 << j
            for k in range(j):
                errors[unit[i] ^ unit[j] ^ unit[k]] = 1 << i | 1 << j | 1 << k
    return table(unit[:12]), table(unit[12:]), errors


def golay_decode(word: np.ndarray) -> np.ndarray:
    """12-bit index of the codeword nearest to each 23-bit word."""
    low, high, errors = _golay()
    word = word.astype(np.int32)
    return (word ^ errors[low[word & 0xFFF] ^ high[word >> 12]]) >> 11


def golay_keys(word: np.ndarray) -> np.ndarray:
    """(n, 24) indices that the radius-1 ball decodes to; repeats within a row are -1."""
    word = word.astype(np.int32)
    flips = np.concatenate([[0], 1 << np.arange(23)]).astype(np.int32)
    found = np.sort(golay_decode(word[:, None] ^ flips[None, :]), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return found


# ---------------------------------------------------------------- fingerprints


_UPPER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of the word shingles, repeats included, each hashed by XXH64 with seed 42; no word: 0."""
    import xxhash

    parts = (text or "").encode("utf-8", "replace").translate(_UPPER).split()
    if not parts:
        return 0
    if len(parts) < shingle:
        grams = iter([b" ".join(parts)])
        n = 1
    else:
        grams = map(b" ".join, zip(*[parts[i:] for i in range(shingle)]))
        n = len(parts) - shingle + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        ones += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long."""
    ready(docs.sparkSession)

    def run(batches):
        for batch in batches:
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def pigeonhole_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of each fingerprint: three circular pairs of an exact segment and a Golay key of the next."""
    fp = fp.view(np.uint64)
    parts = [(fp >> np.uint64(s) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in ((0, 23), (23, 23), (46, 18))]
    rows, keys = [], []
    for i in range(3):
        fuzzy = golay_keys(parts[(i + 1) % 3])
        at, col = np.nonzero(fuzzy >= 0)
        rows.append(at)
        keys.append(np.int64(i) << 36 | parts[i][at] << 12 | fuzzy[at, col])
    return np.concatenate(rows), np.concatenate(keys)


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) that connect exactly the distinct fingerprints ``fp`` at MAX_BITS or fewer differing bits.

    Small buckets: every pair, verified. Members of large buckets: each names the 65 words within distance 1, and
    those that name one word (all within distance 2 of each other) are linked to the smallest of them. That loses no
    connection, and the rows grow with the number of fingerprints, not with its square.
    """
    ready(fps.sparkSession)

    def keyed(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy()
            at, key = pigeonhole_keys(fp)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[at])], names=["key", "fp"])

    def around(batches):
        flips = np.concatenate([[0], np.uint64(1) << np.arange(64, dtype=np.uint64)]).astype(np.uint64)
        for batch in batches:
            fp = batch.column(0).to_numpy()
            mid = (fp.view(np.uint64)[:, None] ^ flips[None, :]).ravel().view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(mid), pa.array(np.repeat(fp, 65))], names=["mid", "fp"])

    met = cut(colliding(fps.select("fp").mapInArrow(keyed, "key long, fp long"), "key", "fp"))
    near = small_pairs(met, "key", "fp").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)
    crowd = met.where(F.col("n") > SMALL_BUCKET).select("fp").distinct().mapInArrow(around, "mid long, fp long")
    star = crowd.join(crowd.groupBy("mid").agg(F.min("fp").alias("low"), F.count(F.lit(1)).alias("c")).where("c > 1"), "mid")
    star = star.where("fp != low").select(F.col("low").alias("a"), F.col("fp").alias("b"))
    return near.unionByName(star).distinct()


def simhash_components(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Null or blank text: fingerprint zero, linked like any other. A null doc_id joins its component but never names
    it, unless it is alone (component_id null). Repeated rows share a component. Empty input: no rows.
    """
    fps = cut(fingerprints(docs))
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("low"))
    found = components(fingerprint_links(nodes)).withColumnRenamed("node", "fp")
    nodes = nodes.join(found, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = nodes.groupBy("component").agg(F.min("low").alias("component_id"))
    named = nodes.join(least, "component").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- near duplicates among long documents

SHINGLE = 5
#: Near copies keep this share of their words, as the Jaccard similarity j of their 5-word shingles has it: a word edited
#: breaks five shingles, so the share of words kept is about 1 + ln(2 j / (1 + j)) / 5 (the Mash similarity).
KEPT = 0.9
#: j at KEPT: 0.435.
JACCARD = 1 / (2 * math.exp(SHINGLE * (1 - KEPT)) - 1)
#: Share of pairs of original and edited copy that may miss all bands of the wide fingerprint, and their share of
#: differing bits (measured: the median over pairs with 3 to 5 words edited in a hundred). MinHash finds most of those missed.
MISSED = 0.05
DIFFERING = 0.09
#: Chance that two 23-bit segments of such a pair share a Golay key (measured).
FUZZY = 0.72
#: Bins of the sketch of 5-word shingles that candidates must pass; its standard error at JACCARD is 0.044, so this is four below.
BINS = 128
SKETCHED = 0.26
#: A bin without a shingle.
EMPTY = 0xFF
#: Documents whose shingles are compared exactly are named to the tasks up to this many (8 MB); beyond, they are joined by shuffle.
BROADCAST_IDS = 1_000_000


def bands_for(n: int) -> tuple[int, int]:
    """(bands, exact bits of each) for n documents. Each band of the wide fingerprint is a 23-bit segment, fuzzy by
    its Golay keys, and some bits as they are: so many more with each doubling that chance meetings a document stay
    as few, and so many bands that a similar pair still meets."""
    exact = max(12, math.ceil(math.log2(max(2, n))) - 3)
    return math.ceil(math.log(MISSED) / math.log(1 - FUZZY * (1 - DIFFERING) ** exact)), exact


#: MinHash bands beside the Golay keys, and minima in each: a pair of Jaccard similarity j misses them all
#: with (1 - j^3)^8, 0.003 at 0.8 and 0.14 at 0.6.
BANDS = 8
ROWS = 3
_ODD = np.random.default_rng(5).integers(1, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def features(text: str | None, bits: int) -> tuple[bytes, bytes, bytes] | None:
    """(wide fingerprint of the set of words, sketch of the set of 5-word shingles, MinHash keys of it); None without words.

    Single words give near copies a far smaller angle than shingles do, which lets the fuzzy keys reach edited
    copies; the similarity of 5-word shingles itself is read off the sketch (bins of the hash range, least hash of
    each).
    """
    import xxhash

    parts = words(text or "")
    if not parts:
        return None
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, len(parts))
    own = np.unique(hashed)
    factors = np.arange(1, 2 * -(-bits // 64), 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    ones = np.zeros(64 * len(factors), np.int64)
    for at in range(0, len(own), 8192):
        wide = _mix(own[at : at + 8192, None] * factors[None, :])
        ones += np.unpackbits(wide.view(np.uint8), axis=1).sum(0, dtype=np.int64)
    sig = np.packbits(ones * 2 > len(own)).tobytes()
    grams = np.sort(_shingles(hashed))
    sketch = np.full(BINS, EMPTY, np.uint8)
    bins = (grams // np.uint64(2**64 // BINS)).astype(np.int64)
    first = np.concatenate([[True], bins[1:] != bins[:-1]])
    sketch[bins[first]] = np.minimum((grams[first] >> np.uint64(16)) & np.uint64(0xFF), EMPTY - 1).astype(np.uint8)
    return sig, sketch.tobytes(), minhash_keys(grams).tobytes()


def minhash_keys(grams: np.ndarray) -> np.ndarray:
    """Keys of the BANDS bands. Whether two texts share one depends on the Jaccard similarity of their shingles only:
    not on where they differ, as the angle of the word sets does, and not on the number of documents. Negative, which
    keys of ``band_keys`` never are."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 8192):
        least = np.minimum(least, _mix(grams[at : at + 8192, None] * _ODD[None, :]).min(0))
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in range(ROWS):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + least[row::ROWS])
    return (key | np.uint64(1 << 63)).view(np.int64)


def _shingles(hashed: np.ndarray) -> np.ndarray:
    """Hashes of the 5-word shingles of a text given by its words' hashes; fewer words: one of them all."""
    n = max(1, len(hashed) - SHINGLE + 1)
    grams = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(hashed))):
        grams = grams * np.uint64(0x100000001B3) + hashed[k : k + n]
    return _mix(grams)


def shingle_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, shingles) of the documents in ``ids``: sorted 32-bit hashes of their distinct 5-word shingles."""
    import xxhash

    few = ids.count() <= BROADCAST_IDS
    wanted = docs.sparkSession.sparkContext.broadcast({r["doc_id"] for r in ids.toLocalIterator()}) if few else None

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if wanted is None or doc_id in wanted.value:
                    parts = words(text.as_py() or "")
                    own = np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, len(parts))
                    rows.append((doc_id, np.unique((_shingles(own) >> np.uint64(32)).astype(np.uint32)).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["doc_id", "shingles"])

    found = docs.mapInArrow(run, "doc_id long, shingles binary")
    return found if few else found.join(ids, "doc_id", "left_semi")


def band_keys(sig: np.ndarray, bands: int, exact_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) for wide fingerprints given as rows of bytes."""
    bits = np.unpackbits(sig, axis=1).astype(np.int64)
    width = 23 + exact_bits
    rows, keys = [], []
    for band in range(bands):
        part = bits[:, band * width : (band + 1) * width]
        fuzzy = golay_keys(part[:, :23] @ (1 << np.arange(23)))
        exact = part[:, 23:] @ (1 << np.arange(exact_bits))
        at, col = np.nonzero(fuzzy >= 0)
        rows.append(at)
        keys.append(np.int64(band) << (exact_bits + 12) | exact[at] << 12 | fuzzy[at, col])
    return np.concatenate(rows), np.concatenate(keys)


def sketch_similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of the 5-word shingles, row by row, of (n, BINS) sketches."""
    used = (a != EMPTY) | (b != EMPTY)
    return ((a == b) & used).sum(1) / np.maximum(1, used.sum(1))


def near_links(docs: DataFrame) -> DataFrame:
    """(a, b): pairs of doc_ids of near copies that connect their groups."""
    links, _, more = _near_links(docs)
    return links.unionByName(more).distinct()


def _near_links(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Links (a, b) of the candidates, the components (node, component) they make, and links of large buckets beyond them."""
    ready(docs.sparkSession)
    rows = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    bands, exact = bands_for(rows.count())
    bits = bands * (23 + exact)

    def describe(batches):
        for batch in batches:
            rows = [(i, f) for i, t in zip(batch.column(0).to_pylist(), batch.column(1)) if (f := features(t.as_py(), bits))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1][0] for r in rows], pa.binary()), pa.array([r[1][1] for r in rows], pa.binary()), pa.array([r[1][2] for r in rows], pa.binary())], names=["doc_id", "sig", "sketch", "minima"])

    def keyed(batches):
        for batch in batches:
            if batch.num_rows:
                ids = batch.column(0).to_numpy()
                at, key = band_keys(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(batch.num_rows, -1), bands, exact)
                minima = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([key, minima])), pa.array(np.concatenate([ids[at], np.repeat(ids, BANDS)]))], names=["key", "doc_id"])

    def promising(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in (2, 3))
                yield batch.filter(pa.array(sketch_similarity(x, y) >= SKETCHED)).select([0, 1])

    def verified(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(z.as_py(), np.uint32) for z in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= JACCARD * (len(x) + len(y) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    def beside(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
        one = table.select(F.col("doc_id").alias("a"), F.col(column).alias("x"))
        two = table.select(F.col("doc_id").alias("b"), F.col(column).alias("y"))
        return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y")

    described = cut(rows.mapInArrow(describe, "doc_id long, sig binary, sketch binary, minima binary"))
    met = cut(colliding(described.select("doc_id", "sig", "minima").mapInArrow(keyed, "key long, doc_id long"), "key", "doc_id"))
    pairs = links_by_bucket(met, "key", "doc_id")
    pairs = cut(beside(pairs, described, "sketch").mapInArrow(promising, "a long, b long").distinct())
    ids = cut(pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct())
    links = cut(beside(pairs, shingle_sets(rows, ids), "shingles").mapInArrow(verified, "a long, b long").distinct())
    tops = cut(components(links))
    more = large_bucket_links(met, tops, "key", "doc_id", lambda ids: shingle_sets(rows, ids).dropDuplicates(["doc_id"]), JACCARD)
    return links, tops, more


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The documents, columns as they were, without those of a group of near copies that aren't its smallest doc_id.

    Documents without words and those with a null doc_id stay. Rows that share a doc_id are one document.
    """
    # a component's links aren't walked again: a star of each holds its documents together
    _, tops, more = _near_links(docs)
    gone = components(tops.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)).where("node != component").select(F.col("node").alias("doc_id"))
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
