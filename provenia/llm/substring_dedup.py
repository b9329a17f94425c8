"""Substring dedup: paragraphs and passages that repeat, exactly or nearly, within and across documents.

A paragraph is a line of at least ``least`` words (lower case, punctuation left out), SHINGLE unless more are asked for.
MinHash over its 5-word shingles is cut into BANDS bands of ROWS minima: at similarity 0.8 a pair shares a band with probability 0.997, and
unrelated prose shares practically no shingle at all. Colliding paragraphs are verified by exact Jaccard similarity
of their shingle sets, linked ones are clustered by components, and every occurrence but a cluster's first is marked.

A passage may also repeat inside longer paragraphs or across short ones. Of any SPREAD windows of MIN_WORDS words in
a row, the one with the least hash is selected (winnowing), so a run of MIN_WORDS + SPREAD - 1 = 50 words that stands
in two places selects a common window in both. Selected windows are compared exactly, through the hash of their words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenia.llm.common import colliding, components, cut, large_bucket_links, links_by_bucket, ready, words

#: Words of a shingle, and the fewest that a paragraph can have.
SHINGLE = 5
#: Words of a window.
MIN_WORDS = 25
SPREAD = 26
SIMILARITY = 0.8
BANDS = 8
ROWS = 3
#: Paragraph ids that need their shingles are sent to the tasks up to this many (8 MB); beyond, they are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Characters of text whose shingles are hashed at once.
BLOCK = 2_000_000

_ODD = np.random.default_rng(20240229).integers(1, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def paragraphs(text: str, least: int) -> list[tuple[int, int, int, list[bytes]]]:
    """(number of the line, start, length, words) of each line with at least ``least`` words; code points."""
    out, start = [], 0
    for number, line in enumerate(text.split("\n")):
        if len(line) >= 2 * least - 1 and len(parts := words(line)) >= least:
            out.append((number, start, len(line), parts))
        start += len(line) + 1
    return out


def identity(parts: list[bytes]) -> tuple[int, int]:
    """128 bits of the words, as two signed longs."""
    import xxhash

    n = xxhash.xxh3_128_intdigest(b" ".join(parts))
    return (n >> 64) - ((n >> 127) << 64), (n & (1 << 64) - 1) - ((n >> 63 & 1) << 64)


def shingle_hashes(many: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all paragraphs, one after another, and where each paragraph starts."""
    import xxhash

    sizes = np.array([len(p) for p in many])
    own = np.fromiter((xxhash.xxh64_intdigest(w) for p in many for w in p), np.uint64, int(sizes.sum()))
    total = np.zeros(max(0, len(own) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        total = total * np.uint64(0x100000001B3) + own[k : k + len(total)]
    ends = np.cumsum(sizes)
    inside = np.ones(len(own), bool)
    for k in range(1, SHINGLE):
        inside[ends - k] = False  # windows that would reach into the next paragraph
    starts = np.concatenate([[0], np.cumsum(sizes - SHINGLE + 1)[:-1]])
    return _mix(total[inside[: len(total)]]), starts


def band_keys(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(paragraphs, BANDS) signed keys."""
    out = np.empty((len(starts), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(starts), band + 1, np.uint64)
        for row in range(ROWS):
            low = np.minimum.reduceat(_mix(hashes * _ODD[band * ROWS + row]), starts)
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + low)
        out[:, band] = key
    return out.view(np.int64)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def occurrences(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, line, start, length, pid, check) of every paragraph; pid and check are the halves of its identity."""
    kinds = [("doc_id", pa.int64()), ("line", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("pid", pa.int64()), ("check", pa.int64())]

    def run(batches):
        for batch in batches:
            rows = [(i, n, s, k, *identity(p)) for i, t in zip(batch.column(0).to_pylist(), batch.column(1)) for n, s, k, p in paragraphs(t.as_py() or "", least)]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, (_, k) in enumerate(kinds)], names=[n for n, _ in kinds])

    return _texts(docs).mapInArrow(run, "doc_id long, line int, start long, length long, pid long, check long")


def _distinct(batch: pa.RecordBatch, least: int):
    """Blocks of the different paragraphs of a batch: (pids, words of each)."""
    seen: set[int] = set()
    pids: list[int] = []
    many: list[list[bytes]] = []
    held = 0
    for t in batch.column(1):
        for _, _, size, parts in paragraphs(t.as_py() or "", least):
            pid = identity(parts)[0]
            if pid not in seen:
                seen.add(pid)
                pids.append(pid)
                many.append(parts)
                held += size
        if held > BLOCK:
            yield pids, many
            pids, many, held = [], [], 0
    if pids:
        yield pids, many


def keyed(docs: DataFrame, least: int) -> DataFrame:
    """(key, pid): the bands of the paragraphs; a paragraph may come once from each batch."""

    def run(batches):
        for batch in batches:
            for pids, many in _distinct(batch, least):
                keys = band_keys(*shingle_hashes(many))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(np.array(pids, np.int64), BANDS))], names=["key", "pid"])

    return _texts(docs).mapInArrow(run, "key long, pid long")


def shingles_of(docs: DataFrame, ids: DataFrame, least: int) -> DataFrame:
    """(pid, shingles) of the paragraphs in ``ids``: sorted 32-bit hashes."""
    few = ids.count() <= BROADCAST_IDS
    wanted = docs.sparkSession.sparkContext.broadcast({r["pid"] for r in ids.toLocalIterator()}) if few else None

    def run(batches):
        for batch in batches:
            for pids, many in _distinct(batch, least):
                if wanted:
                    both = [(p, m) for p, m in zip(pids, many) if p in wanted.value]
                    pids, many = [p for p, _ in both], [m for _, m in both]
                if pids:
                    hashes, starts = shingle_hashes(many)
                    sets = [np.unique((x >> np.uint64(32)).astype(np.uint32)).tobytes() for x in np.split(hashes, starts[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array(pids, pa.int64()), pa.array(sets, pa.binary())], names=["pid", "shingles"])

    found = _texts(docs).mapInArrow(run, "pid long, shingles binary")
    return (found if few else found.join(ids, "pid", "left_semi")).dropDuplicates(["pid"])


def verified(pairs: DataFrame, shingles: DataFrame) -> DataFrame:
    """The pairs (a, b) whose exact Jaccard similarity is at least SIMILARITY."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (np.frombuffer(z.as_py(), np.uint32) for z in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= SIMILARITY * (len(x) + len(y) - both))
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    one = shingles.select(F.col("pid").alias("a"), F.col("shingles").alias("x"))
    two = shingles.select(F.col("pid").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def near_paragraphs(docs: DataFrame, least: int) -> DataFrame:
    """Verified links (a, b) between different paragraphs."""
    rows = keyed(docs, least)
    hit = rows.groupBy("key").agg(F.min("pid").alias("lo"), F.max("pid").alias("hi")).where("lo < hi").select("key")
    met = cut(colliding(cut(rows.join(hit, "key").distinct()), "key", "pid"))
    pairs = cut(links_by_bucket(met, "key", "pid"))
    ids = pairs.select(F.col("a").alias("pid")).unionByName(pairs.select(F.col("b").alias("pid"))).distinct()
    shingles = cut(shingles_of(docs, cut(ids), least))
    links = cut(verified(pairs, shingles))
    return links.unionByName(large_bucket_links(met, components(links), "key", "pid", lambda ids: shingles_of(docs, ids, least), SIMILARITY))


def windows(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first word, start, length) of the selected windows of a text; code points."""
    import xxhash

    parts = words(text)
    n = len(parts) - MIN_WORDS + 1
    if n < 1:
        return (np.zeros(0, np.int64),) * 4
    own = np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, len(parts))
    grams = np.zeros(n, np.uint64)
    for k in range(MIN_WORDS):
        grams = grams * np.uint64(0x100000001B3) + own[k : k + n]
    grams = _mix(grams)
    chosen = _apart(grams, np.unique(_least(grams, SPREAD)))
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    inside = np.concatenate([[False], WORD[raw], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # code points before each byte
    starts, ends = points[edges[::2][chosen]], points[edges[1::2][chosen + MIN_WORDS - 1]]
    return grams[chosen].view(np.int64), chosen, starts, ends - starts


#: Bytes that belong to words, as ``words`` has them.
WORD = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the least value of each run of ``width`` (of all, if fewer); the last on ties."""
    at = np.arange(len(values))
    have = 1
    while have < min(width, len(values)):
        step = min(have, min(width, len(values)) - have)
        left, right = at[:-step], at[step:]
        at = np.where(values[left] < values[right], left, right)
        have += step
    return at


def _apart(values: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The chosen places without those that overlap an earlier one of the same value, as in a word said over and over."""
    _, group, sizes = np.unique(values[chosen], return_inverse=True, return_counts=True)
    if len(sizes) == len(chosen):
        return chosen
    last: dict[int, int] = {}
    keep = np.ones(len(chosen), bool)
    for k in np.flatnonzero(sizes[group] > 1).tolist():
        place, g = int(chosen[k]), int(group[k])
        if place - last.get(g, -MIN_WORDS) < MIN_WORDS:
            keep[k] = False
        else:
            last[g] = place
    return chosen[keep]


def selected_windows(docs: DataFrame) -> DataFrame:
    """(hash, doc_id, word, start, length) of all documents."""
    names = ["hash", "doc_id", "word", "start", "length"]

    def run(batches):
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            ids = batch.column(0).to_pylist()
            for doc_id, text in zip(ids, batch.column(1)):
                found = windows(text.as_py() or "")
                columns[0].append(found[0])
                columns[1] += [doc_id] * len(found[0])
                for k in (1, 2, 3):
                    columns[k + 1].append(found[k])
            flat = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in (columns[0], *columns[2:])]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
            arrays = [pa.array(x.astype(k.to_pandas_dtype()), k) for x, k in zip(flat, kinds)]
            yield pa.RecordBatch.from_arrays([arrays[0], pa.array(columns[1], pa.int64()), *arrays[1:]], names=names)

    return _texts(docs).mapInArrow(run, "hash long, doc_id long, word int, start long, length long")


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(doc_id, word, start, length, cluster_id, members, keep) of selected windows that stand in several places."""
    rows = cut(selected_windows(docs))
    # both tables of counts are written, so that the joins shuffle plainly and a window with very many places is split
    often = cut(rows.groupBy("hash").agg(F.count(F.lit(1)).alias("members")).where("members > 1"))
    hits = cut(rows.join(often, "hash"))
    first = cut(hits.groupBy("hash").agg(F.min(F.struct("doc_id", F.col("word").alias("at"))).alias("keep")))
    return hits.join(first, "hash").select("doc_id", "word", "start", "length", F.col("hash").alias("cluster_id"), "members", "keep")


def repeats(docs: DataFrame, least: int = SHINGLE) -> DataFrame:
    """Repeated paragraphs and passages, one row per occurrence.

    Columns: doc_id, unit ('paragraph' or 'passage'), at (line of the paragraph, first word of the passage), start,
    length, cluster_id, members, keep_doc_id, keep_at, removed. See repeated_paragraphs for nulls and ties.
    """
    ready(docs.sparkSession)
    one = repeated_paragraphs(docs, least).select("doc_id", F.lit("paragraph").alias("unit"), F.col("line").alias("at"), "start", "length", "cluster_id", "members", "keep_doc_id", F.col("keep_line").alias("keep_at"), "removed")
    here = F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("word") == F.col("keep.at"))
    two = repeated_windows(docs).select("doc_id", F.lit("passage").alias("unit"), F.col("word").alias("at"), "start", "length", "cluster_id", "members", F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.at").alias("keep_at"), (~here).alias("removed"))
    return one.unionByName(two)


def repeated_paragraphs(docs: DataFrame, least: int = SHINGLE) -> DataFrame:
    """One row per occurrence of a paragraph whose cluster has several.

    Columns: doc_id, line, start, length (code points of the text), cluster_id, members, keep_doc_id, keep_line,
    removed. The first occurrence by (doc_id, line) stays; a null doc_id comes first. Rows that repeat a doc_id and
    its text are all the same occurrence, so none of them is removed on behalf of the other. Null and empty
    lines, and those of fewer than ``least`` words, never take part. Empty input: no rows. Other columns aren't read.
    """
    ready(docs.sparkSession)
    occ = cut(occurrences(docs, least))
    each = occ.groupBy("pid", "check").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "line")).alias("first"))
    top = components(near_paragraphs(docs, least)).withColumnRenamed("node", "pid")
    each = cut(each.join(top, "pid", "left").withColumn("cluster_id", F.coalesce("component", "pid")).withColumn("alone", F.when(F.col("component").isNull(), F.col("check")).otherwise(0)))
    clusters = each.groupBy("cluster_id", "alone").agg(F.sum("n").alias("members"), F.min("first").alias("keep")).where("members > 1")
    named = cut(each.join(clusters, ["cluster_id", "alone"]).select("pid", "check", "cluster_id", "members", "keep"))
    out = occ.join(named, ["pid", "check"])
    here = F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & (F.col("line") == F.col("keep.line"))
    return out.select("doc_id", "line", "start", "length", "cluster_id", "members", F.col("keep.doc_id").alias("keep_doc_id"), F.col("keep.line").alias("keep_line"), (~here).alias("removed"))


def drop_repeats(docs: DataFrame, least: int = SHINGLE) -> DataFrame:
    """The documents, columns as they were, their texts without the removed paragraphs and passages.

    Overlapping spans are removed once; line feeds between removed lines stay.
    """
    gone = repeats(docs, least).where("removed AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start", "length"))).alias("_gone"))

    def step(acc, s):
        gap = F.substr("text", (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        return F.struct(F.greatest(acc["at"], s["start"] + s["length"]).alias("at"), F.concat(acc["out"], gap).alias("out"))

    begin = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    left = F.aggregate("_gone", begin, step, lambda acc: F.concat(acc["out"], F.substr("text", (acc["at"] + 1).cast("int"), F.length("text"))))
    rows = docs.join(gone, "doc_id", "left").withColumn("text", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(left))
    return rows.select(*docs.columns)
