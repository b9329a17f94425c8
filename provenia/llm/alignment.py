"""Alignment of two tokenizers over the bytes they share.

The documents of a batch are laid one after another, each by its byte offset. The ends of all A and all B tokens are
counted once over these bytes; where both end, a cut falls, and the running number of cuts names each token's group.
Sums over groups up to a document's first and last byte give the results per document, so that no loop runs over
documents or tokens. Documents are described once: their distinct linked pairs are written with the digests, counted
over the corpus, and the counts joined back (frequent pairs by broadcast, rare ones by shuffle).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenia.llm.common import cut, ready, weighed
from provenia.llm.packing import byte_bpe
from provenia.llm.token_counts import check_model, pre_tokens

#: Bytes of text that are laid side by side at once; a longer text by itself.
BLOCK = 2_000_000
#: Links of a group from which on its pairs are counted by distinct ids instead of one by one.
WIDE = 4096
#: Distinct pre-tokens whose pieces a task keeps.
KEPT = 400_000

KINDS = [("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64()))]


class Pieces:
    """Ids of a SentencePiece model, with their bytes. Pre-tokens are encoded once: no piece crosses the start of a run of blanks."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        check_model(self.model)
        self.size = self.model.get_piece_size()
        name = self.model.id_to_piece
        self.bytes = [bytes([int(name(i)[3:5], 16)]) if self.model.is_byte(i) else name(i).replace("▁", " ").encode() for i in range(self.size)]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.flat, self.ends, self.same = np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, bool)

    def __call__(self, texts: list[str]) -> list[np.ndarray | None]:
        """Ids of each text; None where its pieces don't give it back byte by byte."""
        if len(self.place) > KEPT:
            self._forget()
        split = [pre_tokens(t) for t in texts]
        fresh = list(dict.fromkeys(p for own in split for p in own if p not in self.place))
        blank = self.model.piece_to_id("▁")
        found = [x if p else [blank] for p, x in zip(fresh, self.model.encode(fresh, num_threads=1))]  # "": a blank by itself
        self.place.update(zip(fresh, range(len(self.place), len(self.place) + len(fresh))))
        self.flat = np.concatenate([self.flat, *(np.array(x, np.int64) for x in found)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum([len(x) for x in found], dtype=np.int64)])
        self.same = np.concatenate([self.same, np.array([b"".join(self.bytes[i] for i in x) == b" " + p.encode("utf-8", "replace") for p, x in zip(fresh, found)], bool)])
        out: list[np.ndarray | None] = []
        for text, own in zip(texts, split):
            at = np.fromiter(map(self.place.__getitem__, own), np.int64, len(own))
            out.append(self.flat[_ranges(self.ends[at], self.ends[at + 1])] if "▁" not in text and self.same[at].all() else None)
        return out


class Bytes:
    """Ids of a byte-level vocabulary for a blank and the text, and the length of each id's bytes."""

    def __init__(self, ranks_path: str) -> None:
        self.encode = byte_bpe(ranks_path, {})
        self.lengths = self.encode.lengths
        self.size = len(self.lengths)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(self.encode(" " + t), np.int64) for t in texts]


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers start[i] to end[i], one range after another."""
    size = end - start
    return np.arange(size.sum()) + np.repeat(start - np.cumsum(size) + size, size)


def groups(ends_a: np.ndarray, ends_b: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group of each A token, of each B token, number of cuts up to each byte offset)."""
    both = (np.bincount(ends_a, minlength=total + 1) > 0) & (np.bincount(ends_b, minlength=total + 1) > 0)
    cuts = np.cumsum(both)
    before = cuts - both
    return before[ends_a], before[ends_b], cuts


def links(a: np.ndarray, b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, doc: np.ndarray, size_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, pair, times): distinct pairs of ids linked in each document. ``doc`` is the document of each group."""
    first_b = np.cumsum(n_b) - n_b
    wide = n_a * n_b > WIDE
    plain = np.flatnonzero(~wide[group_a])
    of = group_a[plain]
    many = n_b[of]
    pair = np.repeat(a[plain], many) * size_b + b[_ranges(first_b[of], first_b[of] + many)]
    rows = [np.repeat(doc[of], many)], [pair], [np.ones(len(pair), np.int64)]
    first_a = np.cumsum(n_a) - n_a
    for g in np.flatnonzero(wide).tolist():
        (x, i), (y, j) = (np.unique(v[s[g] : s[g] + n[g]], return_counts=True) for v, s, n in ((a, first_a, n_a), (b, first_b, n_b)))
        for out, new in zip(rows, (np.full(len(x) * len(y), doc[g]), (x[:, None] * size_b + y).ravel(), (i[:, None] * j).ravel())):
            out.append(new)
    d, p, t = (np.concatenate(r) for r in rows)
    order = np.lexsort((p, d))
    d, p, t = d[order], p[order], t[order]
    new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (p[1:] != p[:-1])])[: len(d)])
    return d[new], p[new], np.add.reduceat(t, new) if len(new) else t


def described(texts: list[bytes | None], ids_a: list[np.ndarray], ids_b: list[np.ndarray], lengths_a: np.ndarray, lengths_b: np.ndarray, names: np.ndarray) -> list[list]:
    """n_a, n_b, n_groups, n_links, groups_sha256, pairs, times of documents laid side by side, as columns.

    ``names`` holds the decimal ids of A followed by a comma, by "|", then those of B by a comma, by ";".
    """
    sizes = np.array([len(t) for t in texts])
    start, end = np.cumsum(sizes) - sizes, np.cumsum(sizes)
    a, b = np.concatenate(ids_a), np.concatenate(ids_b)
    count_a, count_b = np.array([len(x) for x in ids_a]), np.array([len(x) for x in ids_b])
    group_a, group_b, cuts = groups(np.cumsum(lengths_a[a]), np.cumsum(lengths_b[b]), int(end[-1]))
    lo, hi = cuts[start], cuts[end]
    n_a, n_b = np.bincount(group_a, minlength=hi[-1]), np.bincount(group_b, minlength=hi[-1])
    linked = np.concatenate([[0], np.cumsum(n_a * n_b)])
    doc = np.repeat(np.arange(len(texts)), hi - lo)
    d, pairs, times = links(a, b, group_a, group_b, n_a, n_b, doc, len(lengths_b))
    edges = np.searchsorted(d, np.arange(len(texts) + 1))
    # the text of the groups: A tokens of a group, then its B tokens, each with the sign that follows it
    until_a, until_b = np.cumsum(n_a), np.cumsum(n_b)
    order = np.empty(len(a) + len(b), np.int64)
    last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    last_a[until_a - 1], last_b[until_b - 1] = True, True
    order[np.arange(len(a)) + (until_b - n_b)[group_a]] = a + len(lengths_a) * last_a
    order[np.arange(len(b)) + until_a[group_b]] = 2 * len(lengths_a) + b + len(lengths_b) * last_b
    signs = names[order]
    stop = np.cumsum(count_a + count_b)
    digests = [hashlib.sha256("".join(signs[s:e].tolist())[:-1].encode()).hexdigest() for s, e in zip((stop - count_a - count_b).tolist(), stop.tolist())]
    cut_up = lambda x: [x[s:e] for s, e in zip(edges[:-1], edges[1:])]
    return [count_a.tolist(), count_b.tolist(), (hi - lo).tolist(), (linked[hi] - linked[lo]).tolist(), digests, cut_up(pairs), cut_up(times)]


def aligned(docs: DataFrame, ranks_path: str, model_path: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times): a row per document; pair = a x size of B + b."""
    ready(docs.sparkSession)

    def run(batches):
        one, two = Bytes(ranks_path), Pieces(model_path)
        names = np.array([f"{i}{s}" for size, signs in ((one.size, ",|"), (two.size, ",;")) for s in signs for i in range(size)], object)

        def block(ids: list, texts: list[str]) -> pa.RecordBatch:
            rows = [[i, 0, 0, 0, 0, "", [], []] for i in ids]
            ids_a, ids_b = one(texts), two(texts)
            raw = [b" " + t.encode("utf-8", "replace") for t in texts]
            used = [k for k, t in enumerate(texts) if t and ids_b[k] is not None and one.lengths[ids_a[k]].sum() == len(raw[k])]
            if used:
                pick = lambda x: [x[k] for k in used]
                for k, *row in zip(used, *described(pick(raw), pick(ids_a), pick(ids_b), one.lengths, two.lengths, names)):
                    rows[k][1:] = row
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(KINDS)], names=[n for n, _ in KINDS])

        for batch in batches:
            ids, texts, held = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids.append(doc_id)
                texts.append(text.as_py() or "")
                held += len(texts[-1])
                if held > BLOCK:
                    yield block(ids, texts)
                    ids, texts, held = [], [], 0
            if ids:
                yield block(ids, texts)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>")


def pair_counts(rows: DataFrame, size_b: int) -> DataFrame:
    """(pair, n, best): in how many documents each pair is linked, and 1 where that is the most of its A id's pairs."""
    counts = cut(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")))
    a = F.floor(F.col("pair") / size_b)
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    return cut(counts.withColumn("a", a).join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best")))


def alignment(docs: DataFrame, ranks_path: str, model_path: str) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A reads a blank and the text, B the text, which puts the blank there by itself. Null and empty texts, and those
    that the tokens don't give back byte by byte, have no tokens: zeros and ''. Repeated rows, with or without a
    doc_id, count as documents each. Empty input: no rows. Other columns aren't read.
    """
    import sentencepiece

    size_b = sentencepiece.SentencePieceProcessor(model_file=model_path).get_piece_size()
    # written, so that the number of a row stays the same in both uses
    rows = cut(aligned(docs, ranks_path, model_path)).withColumn("row", F.monotonically_increasing_id())
    table = pair_counts(rows, size_b)
    each = rows.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("n"))
    sums = weighed(each, "row", "pair", table, "n", also=("best",)).select("row", F.col("best").alias("n_best"), F.col("total").alias("count_sum"))
    found = rows.drop("pairs", "times").join(sums, "row", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
