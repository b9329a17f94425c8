"""Packing of token sequences into windows by best-fit decreasing.

Overlong documents are first cut into full windows; what is left over (one piece a document at most) goes, longest
first, into the open window with the least room that still holds it. A segment tree over the remaining capacities
finds that window. Pieces are dealt into groups of about GROUP_PIECES by their place in a written table, and each
group is packed by itself: a group's memory is bounded and its loss is a few half-filled windows among thousands.
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenia.llm.common import cut, ready

WINDOW = 1024
GROUP_PIECES = 16384
END = 0


def byte_bpe(ranks_path: str, special: dict[str, int]):
    """text -> ids of a byte-level BPE vocabulary (.decode back, .lengths of the ids in bytes); strings of ``special`` inside texts become their ids.

    The ranks file gives the same ids as the JSON file of the vocabulary beside it (tests compare them), several times
    faster. Its pattern can't be matched over runs of about a million blanks; such a text goes to ``tokenizers`` and the JSON file.
    """
    import public_tokenizers
    import tiktoken
    import tokenizers

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
    patient: list[tokenizers.Tokenizer] = []

    def encode(text: str) -> list[int]:
        try:
            return own.encode(text, allowed_special="all", disallowed_special=())
        except ValueError:
            if not patient:
                patient.append(tokenizers.Tokenizer.from_file(os.path.splitext(ranks_path)[0] + ".json"))
                patient[0].encode_special_tokens = not special
            return patient[0].encode(text, add_special_tokens=False).ids

    encode.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for piece, i in ranks.items():
        encode.lengths[i] = len(piece)
    encode.decode = lambda ids: own.decode_bytes(ids).decode("utf-8", "replace")
    return encode


def pieces(docs: DataFrame, ranks_path: str, special: dict[str, int], window: int = WINDOW) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids): the windows of each document's ids and END; ids are little-endian uint32."""
    ready(docs.sparkSession)

    def run(batches):
        encode = byte_bpe(ranks_path, special)
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), END], "<u4")
                out += [(doc_id, s, min(window, len(ids) - s), len(ids), ids[s : s + window].tobytes()) for s in range(0, len(ids), window)]
                held += len(ids)
                if held > 1_000_000:
                    yield _batch(out)
                    out, held = [], 0
            if out:
                yield _batch(out)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, start long, length long, doc_tokens long, ids binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], names=[n for n, _ in kinds])


def best_fit_decreasing(lengths: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(window number, offset) of each length."""
    size = 1
    while size <= window:
        size *= 2
    tree = bytearray(2 * size)  # tree[size + r]: whether some open window has r left; inner nodes: any below
    open_at: list[list[int]] = [[] for _ in range(window + 1)]
    number, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    n = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        if not 0 < need <= window:
            raise ValueError(f"length {need} is not in 1..{window}")
        node = size + need
        if not tree[node]:
            while node > 1 and (node & 1 or not tree[node + 1]):
                node >>= 1
            if node > 1:  # the tightest lies below the next node to the right
                node += 1
                while node < size:
                    node = 2 * node if tree[2 * node] else 2 * node + 1
        if node > 1:
            room = node - size
            bin_no = open_at[room].pop()
            if not open_at[room]:
                _mark(tree, node, 0)
        else:
            room, bin_no = window, n
            n += 1
        number[i], offset[i] = bin_no, window - room
        if left := room - need:
            if not open_at[left]:
                _mark(tree, size + left, 1)
            open_at[left].append(bin_no)
    return number, offset


def _mark(tree: bytearray, node: int, value: int) -> None:
    tree[node] = value
    while node > 1:
        node >>= 1
        now = tree[2 * node] | tree[2 * node + 1]
        if tree[node] == now:
            break
        tree[node] = now


def place(cuts: DataFrame, window: int = WINDOW) -> DataFrame:
    """Adds sequence_id and offset to a written table of pieces with a column length."""
    groups = max(1, -(-cuts.count() // GROUP_PIECES))
    # the table is written, so the numbering of its rows doesn't change when a task runs again
    dealt = cuts.withColumn("_group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        number, offset = best_fit_decreasing(table.column("length").to_numpy(), window)
        first = table.column("_group")[0].as_py() << 32
        return table.drop_columns(["_group"]).append_column("sequence_id", pa.array(number + first)).append_column("offset", pa.array(offset))

    kinds = ", ".join(f"{n} {t}" for n, t in cuts.dtypes)
    return dealt.groupBy("_group").applyInArrow(pack, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, ranks_path: str, special: dict[str, int], window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null or empty text: the single id END. Repeated rows are packed each. Empty input: no rows. Other columns of
    ``docs`` aren't read. A sequence holds at most ``window`` ids and is padded to that.
    """
    cuts = pieces(docs, ranks_path, special, window)
    cuts = cut(cuts.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"))
    return place(cuts, window)


def sequences(docs: DataFrame, placed: DataFrame, ranks_path: str, special: dict[str, int], window: int = WINDOW) -> DataFrame:
    """(sequence_id, ids): the windows themselves, padded with END; for documents whose doc_id is unique."""
    ids = pieces(docs, ranks_path, special, window).select("doc_id", "start", "ids")
    parts = placed.join(ids, ["doc_id", "start"]).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    body = F.aggregate("parts", F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    return parts.select("sequence_id", F.rpad(body, 4 * window, F.lit(b"\x00").cast("binary")).alias("ids"))
