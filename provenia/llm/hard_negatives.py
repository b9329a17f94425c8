"""Hard-negative mining over a vector-approximation file.

Every row is indexed: each dimension is cut into 16 cells at the quantiles of all rows, and two cells make a byte. For
an anchor, a table gives the least and the greatest contribution to the score of each pair of cells, so a row's score
is bounded by one lookup a byte. Only rows whose bounds leave them a chance to be among the best of the anchor's label,
or to enter the window of scores below a positive, are scored exactly. Any cells give exact results; the quantiles
only decide how many rows that spares.

Anchors are sent to the tasks in blocks of a fixed number of bytes, and each block scans the index twice: for the
positives, then for the negatives. A task keeps the few best rows of each anchor and gives those only.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from provenia.llm.common import cut, ready

CELLS = 16
#: Whole numbers of a component lie within this (a component of 131,072 at a scale of 256), so that a score fits 64 bits; larger ones count as it.
MOST = 1 << 25
#: Bytes of anchors sent to the tasks at once.
ANCHOR_BYTES = 16 << 20
#: Anchors whose tables a task holds at once (8 MB a table at 64 dimensions), and the most rows that are bounded at once.
TABLES = 256
ROWS = 1024


def quantised(rows: DataFrame, scale: float = 256) -> DataFrame:
    """(vec_id, label, vector) with whole components, of the rows that take part."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    used = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(sound)
    whole = lambda x: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(x.cast("double") * scale))).cast("int")
    return used.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.transform("embedding", whole).alias("vector"))


def cells(vectors: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(edges, least, greatest): CELLS - 1 inner edges of each dimension, and the ends of each cell. The dimensions are even in number."""
    part = [k / CELLS for k in range(1, CELLS)]
    each = vectors.select(F.posexplode("vector").alias("d", "x")).groupBy("d").agg(F.percentile_approx("x", part, 1000).alias("edges"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    found = {r["d"]: r for r in each.collect()}  # a row a dimension
    size = len(found) + len(found) % 2
    edges = np.array([found[d]["edges"] if d in found else [0] * (CELLS - 1) for d in range(size)], np.int64).reshape(size, CELLS - 1)
    ends = np.array([(found[d]["lo"], found[d]["hi"]) if d in found else (0, 0) for d in range(size)], np.int64).reshape(size, 2)
    least = np.concatenate([np.minimum(ends[:, :1], 0), edges], axis=1)  # a shorter vector counts as followed by zeros
    return edges, least, np.concatenate([edges - 1, np.maximum(ends[:, 1:], 0)], axis=1)


def matrix(column, size: int) -> np.ndarray:
    """Rows of an Arrow list column as a matrix of ``size`` columns, short ones filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (lengths == size).all():
        return flat.reshape(len(column), size)
    out = np.zeros((len(column), size), np.int64)
    row = np.repeat(np.arange(len(column)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def index(vectors: DataFrame, edges: np.ndarray) -> DataFrame:
    """Adds the approximation of each row: a byte for two dimensions."""
    size = len(edges)

    def run(batches):
        for batch in batches:
            x = matrix(batch.column(2), size)
            code = np.empty(x.shape, np.uint8)
            for d in range(size):
                code[:, d] = np.searchsorted(edges[d], x[:, d], side="right")
            both = code[:, ::2] | code[:, 1::2] << 4
            yield batch.append_column("codes", pa.array([r.tobytes() for r in both], pa.binary()))

    return vectors.mapInArrow(run, "vec_id long, label long, vector array<int>, codes binary")


def tables(anchors: np.ndarray, least: np.ndarray, greatest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of a code, 256, anchors): least and greatest contribution of each pair of cells to each anchor's score."""
    one, two = anchors.T[:, None, :] * least[:, :, None], anchors.T[:, None, :] * greatest[:, :, None]

    def paired(ends: np.ndarray) -> np.ndarray:
        return (ends[1::2, :, None, :] + ends[::2, None, :, :]).reshape(len(ends) // 2, CELLS * CELLS, -1)

    low, high = paired(np.minimum(one, two)), paired(np.maximum(one, two))
    small = max(np.abs(low).max(axis=(1, 2)).sum(), np.abs(high).max(axis=(1, 2)).sum()) < 1 << 31 if low.size else True
    return (low.astype(np.int32), high.astype(np.int32)) if small else (low, high)


def looked_up(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """(rows, anchors): the sum of the table's entries for each row's codes."""
    total = np.zeros((len(codes), table.shape[2]), table.dtype)
    part = np.empty_like(total)
    for j in range(len(table)):
        np.take(table[j], codes[:, j], axis=0, out=part, mode="clip")
        total += part
    return total


class Best:
    """The ``k`` highest scores of each key, ties by smaller id."""

    def __init__(self, keys: int, k: int, floor: np.ndarray | None = None) -> None:
        self.k, self.keys = k, keys
        self.key = self.id = self.score = np.zeros(0, np.int64)
        #: A row of a key must reach this to change it.
        self.floor = np.full(keys, np.iinfo(np.int64).min) if floor is None else floor

    def add(self, key: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        if not len(key):
            return
        key, ids, score = np.concatenate([self.key, key]), np.concatenate([self.id, ids]), np.concatenate([self.score, score])
        order = np.lexsort((ids, -score, key))
        key, ids, score = key[order], ids[order], score[order]
        first = np.searchsorted(key, key)
        keep = np.arange(len(key)) - first < self.k
        self.key, self.id, self.score = key[keep], ids[keep], score[keep]
        last = np.arange(len(key)) - first == self.k - 1
        self.floor[key[last]] = np.maximum(self.floor[key[last]], score[last])


def _certain(low: np.ndarray, k: int) -> np.ndarray | None:
    """The k-th highest lower bound of each column: so many rows reach it."""
    return np.partition(low, len(low) - k, axis=0)[len(low) - k] if len(low) >= k else None


def scan(batches, block: dict, kind: str, size: int, ends: tuple[np.ndarray, np.ndarray], k: int):
    """The best rows of a task for each key of the block: of the anchor's own label, or of the other labels within its windows.

    ``block``: id, label, vector of each anchor; for windows also lo and hi (anchors, windows), the ends of each.
    """
    parts = [slice(s, s + TABLES) for s in range(0, len(block["id"]), TABLES)]
    windows = block["lo"].shape[1] if kind == "windows" else 1
    best = [Best(len(block["id"][p]) * windows, k, block["lo"][p].ravel().copy() if kind == "windows" else None) for p in parts]
    lowest = np.iinfo(np.int64).min
    seen = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, labels = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        vectors = matrix(batch.column(2), size)
        codes = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(len(ids), size // 2)
        steps, at = [], 0
        while at < len(ids):  # few rows at first: what they hold spares many of the next
            steps.append(slice(at, at + min(ROWS, max(64, seen + at))))
            at = steps[-1].stop
        seen += len(ids)
        for p, top in zip(parts, best):
            anchors = block["vector"][p]
            low_table, high_table = tables(anchors, *ends)
            for s in steps:
                low, high = looked_up(low_table, codes[s]), looked_up(high_table, codes[s])
                same = labels[s][:, None] == block["label"][p][None, :]
                other = ids[s][:, None] != block["id"][p][None, :]
                if kind == "label":
                    part = same & other
                    sure = _certain(np.where(part, low, lowest), k)
                    floor = top.floor if sure is None else np.maximum(top.floor, sure)
                    r, a = np.nonzero(part & (high >= floor[None, :]))
                    top.add(a, ids[s][r], np.einsum("ij,ij->i", vectors[s][r], anchors[a]))
                    continue
                part = ~same & other
                chance = np.zeros(part.shape, bool)
                for w in range(windows):
                    lo, hi = block["lo"][p][:, w], block["hi"][p][:, w]
                    floor = top.floor[w::windows]
                    sure = _certain(np.where(part & (low >= lo) & (high <= hi), low, lowest), k)
                    floor = floor if sure is None else np.maximum(floor, sure)
                    chance |= (high >= floor) & (low <= hi)
                r, a = np.nonzero(part & chance)
                score = np.einsum("ij,ij->i", vectors[s][r], anchors[a])
                for w in range(windows):
                    fits = (score >= np.maximum(block["lo"][p][a, w], top.floor[a * windows + w])) & (score <= block["hi"][p][a, w])
                    top.add(a[fits] * windows + w, ids[s][r[fits]], score[fits])
    for p, top in zip(parts, best):
        yield top.key + p.start * windows, top.id, top.score


def _highest(found: DataFrame, key: str, k: int) -> DataFrame:
    """The k best rows of each key with their rank; Spark limits each task's rows before it shuffles them."""
    order = W.partitionBy(key).orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _numbered(rows: DataFrame) -> tuple[DataFrame, int]:
    """A written table with the column ``number`` without gaps, and how many rows it has."""
    counts = {r["p"]: r["n"] for r in rows.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a partition
    before = np.cumsum([0] + [counts.get(p, 0) for p in range(max(counts, default=-1) + 1)])
    place = F.element_at(F.lit(before.tolist()), F.spark_partition_id() + 1) + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    return rows.withColumn("number", place.cast("long")), int(before[-1])


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, lower: int = 50, upper: int = 95, scale: float = 256) -> DataFrame:
    """Hard negatives of each anchor and positive: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` has vec_id, label (whole numbers) and embedding; other columns aren't read. A score is the inner product
    of the components times ``scale``, rounded down. An anchor's positives are its best ``positives`` other rows of its
    label, its negatives the best ``negatives`` rows of other labels with lower % to upper % of the positive's score;
    fewer, if there are no more. Ties go to the smaller vec_id.

    Rows with a null vec_id, label, vector or component, or one that isn't finite, take no part. A shorter vector
    counts as followed by zeros. A row never meets one of its own vec_id; rows that repeat a vec_id are otherwise rows
    of their own, so a repeated anchor repeats its results. Empty input, or no anchor: no rows.
    """
    ready(rows.sparkSession)
    sc = rows.sparkSession.sparkContext
    vectors = quantised(rows, scale)
    edges, *ends = cells(vectors)
    size = len(edges)
    table = cut(index(vectors, edges))
    anchors, n = _numbered(cut(table.where(is_anchor).select("vec_id", "label", "vector")))
    at_once = max(1, ANCHOR_BYTES // (4 * max(1, size)))
    parts = []
    for start in range(0, n, at_once):
        own = anchors.where((F.col("number") >= start) & (F.col("number") < start + at_once)).toArrow().sort_by("number")
        block = {"id": own["vec_id"].to_numpy(), "label": own["label"].to_numpy(), "vector": matrix(own["vector"], size)}
        shared = sc.broadcast(block)

        def of_label(batches, shared=shared):
            for key, ids, score in scan(batches, shared.value, "label", size, ends, positives):
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids), pa.array(score)], names=["key", "id", "score"])

        best = _highest(table.mapInArrow(of_label, "key long, id long, score long"), "key", positives).toArrow()  # so many rows an anchor of the block
        place = (best["key"].to_numpy(), best["rank"].to_numpy() - 1)
        lo, hi = np.full((len(own), positives), 1), np.full((len(own), positives), 0)  # no window
        named, scored = np.zeros(lo.shape, np.int64), np.zeros(lo.shape, np.int64)
        score = best["score"].to_numpy()
        lo[place], hi[place] = -(-lower * score // 100), upper * score // 100
        named[place], scored[place] = best["id"].to_numpy(), score
        wide = sc.broadcast(block | {"lo": lo, "hi": hi, "positive": named.ravel(), "positive_score": scored.ravel()})

        def of_others(batches, wide=wide):
            own = wide.value
            for key, ids, score in scan(batches, own, "windows", size, ends, negatives):
                columns = [key, own["id"][key // positives], own["positive"][key], own["positive_score"][key], ids, score]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "anchor_id", "positive_id", "positive_score", "id", "score"])

        found = _highest(table.mapInArrow(of_others, "key long, anchor_id long, positive_id long, positive_score long, id long, score long"), "key", negatives)
        parts.append(found if n <= at_once else cut(found))
    if not parts:
        return rows.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    found = reduce(DataFrame.unionByName, parts)
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
