"""Benchmark decontamination by greedy string tiling.

Seeds are the runs of LEAST words. Documents and benchmark items are joined on their seeds, and a pair goes on if it
shares enough of them for tiles over the threshold; a seed that all items share therefore costs one row a pair and no
tiling. Tiling marks, longest first, non-overlapping matches of at least LEAST words; windows are compared by
Karp-Rabin hashes. The share of the item's words that the tiles cover doesn't depend on their order, so reordered
passages count in full. Only documents over the threshold come out.
"""

from __future__ import annotations

from heapq import heapify, heappop, heappush
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenia.llm.common import cut, ready, words

LEAST = 5
COVERAGE = 0.5
#: Different seeds of the benchmark that are sent to the tasks (8 MB), so that they emit only those; with more, all seeds are joined by shuffle.
BROADCAST_SEEDS = 1_000_000
#: Different words of the benchmark that are sent to the tasks with them (some 20 MB in each), so that only runs of such words are hashed; with more, all runs are.
BROADCAST_WORDS = 200_000
#: Pairs of names, or names, that are sent to the tasks (some 150 MB at most); with more, they are joined by shuffle.
BROADCAST_NAMES = 1_000_000
#: Bytes of the benchmark's texts that are sent to the tasks; with more, items are joined by shuffle.
BROADCAST_BYTES = 64 << 20
#: Rows of a batch of seeds.
ROWS = 200_000

_BASE = np.uint64(0x9E3779B97F4A7C15)


_KEPT: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """The first n powers of the base, modulo 2^64; up to a million of them are kept for the next text."""
    held = _KEPT.get(int(base))
    if held is None or len(held) < n:
        held = np.ones(max(n, 4096), np.uint64)
        np.cumprod(np.full(len(held) - 1, base), out=held[1:])
        if len(held) <= 1_000_000:
            _KEPT[int(base)] = held
    return held[:n]


def prefix_hashes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Karp-Rabin: h[i], the hash of the first i ids, and the powers of the base, both modulo 2^64."""
    powers = _powers(_BASE, len(ids) + 1)
    # h[i] = sum of id[j] * base^j for j < i; a window's hash is divided by its first power by bringing both to one
    h = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum((ids + 1).astype(np.uint64) * powers[:-1], out=h[1:])
    return h, powers


_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def window_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """Hash of each window of ``size`` ids, the same wherever the window stands."""
    if len(ids) < size:
        return np.zeros(0, np.uint64)
    h, _ = prefix_hashes(ids)
    return (h[size:] - h[:-size]) * _powers(_INVERSE, len(ids) - size + 1)


def tiles(item: np.ndarray, text: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start in item, start in text, length) of the greedy tiling; negative ids match nothing.

    Always the longest match of free words is marked next, ties by place; window sizes only find the long ones quickly.
    """
    free_i, free_t = item >= 0, text >= 0
    size = max(least, min(len(item), len(text)))
    found: list[tuple[int, int, int]] = []
    while size >= least:
        places: dict[int, list[int]] = {}
        hash_t = window_hashes(text, size)
        for j in np.flatnonzero(_free_runs(free_t, size)).tolist():
            places.setdefault(int(hash_t[j]), []).append(j)
        hash_i = window_hashes(item, size)

        def free_match(i: int, j: int) -> int:
            n = 0
            while i + n < len(item) and j + n < len(text) and free_i[i + n] and free_t[j + n] and item[i + n] == text[j + n]:
                n += 1
            return n

        heap = [(-n, i, j) for i in np.flatnonzero(_free_runs(free_i, size)).tolist() for j in places.get(int(hash_i[i]), ()) if (n := free_match(i, j)) >= size]
        heapify(heap)
        while heap:
            n, i, j = heappop(heap)
            left = free_match(i, j)  # an earlier tile may have taken its tail
            if left < -n:
                if left >= size:
                    heappush(heap, (-left, i, j))
            else:
                free_i[i : i + left] = free_t[j : j + left] = False
                found.append((i, j, left))
        size = size // 2 if size > 2 * least else least if size > least else 0
    return found


def _free_runs(free: np.ndarray, size: int) -> np.ndarray:
    """Where a window of ``size`` free places starts."""
    if len(free) < size:
        return np.zeros(0, bool)
    total = np.concatenate([[0], np.cumsum(free)])
    return total[size:] - total[:-size] == size


def word_hashes(parts: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh64_intdigest, parts), np.uint64, len(parts))


def _named(df: DataFrame, key: str) -> DataFrame:
    """(name, text): the name is the id and the MD5 of the text, so that rows that share an id are kept apart."""
    return df.select(_name(df, key).alias("name"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")


def _name(df: DataFrame, key: str) -> Column:
    return F.struct(F.col(key).isNull().alias("void"), F.coalesce(F.col(key).cast("long"), F.lit(0)).alias("id"), F.md5(F.col("text").cast("string")).alias("md5"))


_NAME = "struct<void: boolean, id: bigint, md5: string>"


class Wanted:
    """Seeds that a task emits, a sorted array. Where their words are named too, runs with any other word aren't hashed."""

    def __init__(self, seeds: np.ndarray, parts: list[bytes] | None = None) -> None:
        self.seeds = seeds
        self.bits = np.uint64((1 << (16 * len(seeds)).bit_length()) - 1)
        self.some = np.zeros(int(self.bits) + 1, bool)  # most other seeds are told by their low bits, without a search
        self.some[seeds & self.bits] = True
        self.place = None if parts is None else {w: k for k, w in enumerate(parts)}
        self.hashes = None if parts is None else word_hashes(parts)

    def __call__(self, parts: list[bytes], least: int) -> np.ndarray:
        """The wanted seeds of a text's words, as often as they stand there."""
        if self.place is None:
            own = window_hashes(word_hashes(parts), least)
        else:
            at = np.fromiter(map(self.place.get, parts, repeat(-1)), np.int64, len(parts))
            starts = np.flatnonzero(_free_runs(at >= 0, least))
            if not len(starts):
                return np.zeros(0, np.uint64)
            own = sum((self.hashes[at[starts + k]] + 1) * power for k, power in enumerate(_powers(_BASE, least)))  # as window_hashes, of these places
        own = own[self.some[own & self.bits]]
        found = np.minimum(np.searchsorted(self.seeds, own), len(self.seeds) - 1)
        return own[self.seeds[found] == own]


def seeds(rows: DataFrame, least: int, wanted=None) -> DataFrame:
    """(name, seed, n, words): each seed of a text, how often it stands there, and the text's words; of ``wanted`` seeds (a broadcast (sorted array, words or None)) only."""

    def run(batches):
        take = None if wanted is None else Wanted(*wanted.value)
        for batch in batches:
            names, found, times, sizes = [], [], [], []
            for name, text in zip(batch.column(0), batch.column(1)):
                parts = words(text.as_py())
                if len(parts) < least:
                    continue
                own = window_hashes(word_hashes(parts), least) if take is None else take(parts, least)
                if not len(own):
                    continue
                own, n = np.unique(own, return_counts=True)
                names.append(pa.repeat(name, len(own)))
                found.append(own)
                times.append(n)
                sizes.append(np.full(len(own), len(parts)))
                if sum(map(len, found)) > ROWS:
                    yield batch_of(names, found, times, sizes)
                    names, found, times, sizes = [], [], [], []
            if names:
                yield batch_of(names, found, times, sizes)

    def batch_of(names, found, times, sizes):
        return pa.RecordBatch.from_arrays([pa.concat_arrays(names), pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(times)), pa.array(np.concatenate(sizes))], names=["name", "seed", "n", "words"])

    return rows.mapInArrow(run, f"name {_NAME}, seed long, n long, words long")


def item_words(items: DataFrame) -> DataFrame:
    """(word): the different words of the texts, as UTF-8."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array({w for text in batch.column(0) for w in words(text.as_py())}, pa.binary())], names=["word"])

    return items.select("text").mapInArrow(run, "word binary").distinct()


def candidates(docs: DataFrame, items: DataFrame, coverage: float, least: int) -> DataFrame:
    """(doc, item): names of the pairs that share enough seeds. ``docs`` and ``items`` are rows (name, text).

    Tiles of ``coverage`` of an item's words hold at least a ``least``-th as many of its seeds' places, whatever their
    lengths. All places but one less than that many must so hold one that is shared: the seeds that most items have
    are left out of the join as far as that goes, and counted as if each document had them.
    """
    each = cut(seeds(items.dropDuplicates(["name"]), least))
    often = each.join(each.groupBy("seed").agg(F.count(F.lit(1)).alias("items")), "seed")
    before = F.sum("n").over(Window.partitionBy("name").orderBy("items", "seed")) - F.col("n")
    places = F.col("words") - least + 1
    of_items = cut(often.withColumn("open", places - F.ceil(F.lit(coverage) * F.col("words") / least) + 1 - before).where("open > 0").select("name", "seed", "n", "words"))
    left_out = F.max("words") - least + 1 - F.sum("n")
    of_items = of_items.join(of_items.groupBy("name").agg(left_out.alias("others")), "name")
    distinct = cut(of_items.select("seed").distinct())
    wanted = None
    found = distinct.count()
    if not found:
        return docs.sparkSession.createDataFrame([], f"doc {_NAME}, item {_NAME}")
    if found <= BROADCAST_SEEDS:
        named = cut(item_words(items))
        parts = named.toArrow()["word"].to_pylist() if named.count() <= BROADCAST_WORDS else None
        wanted = docs.sparkSession.sparkContext.broadcast((np.sort(distinct.toPandas()["seed"].to_numpy().view(np.uint64)), parts))
    of_docs = seeds(docs, least, wanted).select(F.col("name").alias("doc"), "seed").distinct() if wanted is None else seeds(docs, least, wanted).select(F.col("name").alias("doc"), "seed")
    met = of_docs.join(of_items.select(F.col("name").alias("item"), "seed", "n", "words", "others"), "seed")
    # repeated rows of a document bring its seeds again; they only raise the sum
    return met.groupBy("doc", "item").agg((F.sum("n") + F.max("others")).alias("shared"), F.max("words").alias("words")).where(F.col("shared") * least >= coverage * F.col("words")).select("doc", "item")


def tiled(item: list[bytes], text: list[bytes], least: int = LEAST) -> tuple[int, int]:
    """(words of the item that tiles cover, number of tiles)."""
    vocabulary: dict[bytes, int] = {}
    own = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in item], np.int64)
    ids = np.fromiter(map(vocabulary.get, text, repeat(-1)), np.int64, len(text))
    starts = np.flatnonzero(_free_runs(ids >= 0, least))
    if len(own) < least or not len(starts):
        return 0, 0
    at = starts[np.isin(window_hashes(ids, least)[starts], window_hashes(own, least))]
    if not len(at):
        return 0, 0
    # matches of at least ``least`` words lie within the seeds' words; the rest of the document is left out
    part = np.unique((at[:, None] + np.arange(least)[None, :]).ravel())
    zones = np.split(part, np.flatnonzero(np.diff(part) > 1) + 1)
    near = np.concatenate([x for z in zones for x in (ids[z], [-1])])
    found = tiles(own, near, least)
    return sum(n for *_, n in found), len(found)


def contaminated_names(docs: DataFrame, benchmark: DataFrame, coverage: float, least: int) -> DataFrame:
    """(doc, item, item_words, matched_words, tiles, coverage): ``contaminated`` with the names of both; a row for each pair of names."""
    ready(docs.sparkSession)
    rows, items = _named(docs, "doc_id"), _named(benchmark, "item_id")
    pairs = cut(candidates(rows, items, coverage, least))
    few = pairs.count() <= BROADCAST_NAMES

    def run(batches):
        for batch in batches:
            out = []
            for k, (item, text) in enumerate(zip(batch.column(2), batch.column(3))):
                item = words(item.as_py())
                n, tiles = tiled(item, words(text.as_py()), least)
                if n >= coverage * len(item):
                    out.append((k, len(item), n, tiles, n / len(item)))
            at = pa.array([r[0] for r in out], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array([r[i] for r in out], pa.int64()) for i in (1, 2, 3)), pa.array([r[4] for r in out], pa.float64())], names=["doc", "item", "item_words", "matched_words", "tiles", "coverage"])

    own = items.dropDuplicates(["name"]).select(F.col("name").alias("item"), F.col("text").alias("item_text"))
    small = (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= BROADCAST_BYTES
    texts = rows.select(F.col("name").alias("doc"), "text").join(F.broadcast(pairs) if few else pairs, "doc")
    both = texts.join(F.broadcast(own) if small else own, "item").select("doc", "item", "item_text", "text")
    return both.mapInArrow(run, f"doc {_NAME}, item {_NAME}, item_words long, matched_words long, tiles long, coverage double")


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = LEAST) -> DataFrame:
    """(doc_id, item_id, item_words, matched_words, tiles, coverage) of documents that hold ``coverage`` of an item.

    Items of fewer than ``least`` words, null or blank texts match nothing. Repeated items and documents give a row
    each. Empty tables: no rows. Other columns aren't read.
    """
    found = contaminated_names(docs, benchmark, coverage, least)
    times = _named(benchmark, "item_id").groupBy(F.col("name").alias("item")).agg(F.count(F.lit(1)).alias("times"))
    each = found.join(times, "item").withColumn("_each", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    own = [F.when(~F.col(f"{c}.void"), F.col(f"{c}.id")).alias(f"{c}_id") for c in ("doc", "item")]
    return each.select(*own, "item_words", "matched_words", "tiles", "coverage")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, columns as they were, that hold no benchmark item. Null texts stay.

    The contaminated are named to the tasks up to BROADCAST_NAMES, so that no text moves; beyond, documents are shuffled to them.
    """
    bad = cut(contaminated_names(docs, benchmark, COVERAGE, LEAST).select(F.xxhash64("doc").alias("_key"), F.col("doc").alias("_doc")).distinct())
    if bad.count() <= BROADCAST_NAMES:
        bad = F.broadcast(bad)
    return docs.join(bad, (F.col("_key") == F.xxhash64(_name(docs, "doc_id"))) & (F.col("_doc") == _name(docs, "doc_id")), "left_anti")
