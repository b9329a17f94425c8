"""Token counts of documents without their ids, by a SentencePiece BPE vocabulary.

No piece of such a vocabulary has a blank after another character, so merges never cross the start of a run of
blanks, and a text's count is the sum over its pre-tokens (a run of blanks and what follows it up to the next). Each
pre-token that is frequent in the corpus is counted once by the library; the table of counts is joined to the
documents' pre-token frequencies and summed up. Rare pre-tokens are counted where they stand: to bring their counts to
them would shuffle more than the text (measured; see the README).
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenia.llm.common import cut, ready

#: Distinct pre-tokens that a task gathers, or keeps the counts of, before it begins anew.
KEPT = 400_000
#: Occurrences in the corpus from which on a pre-token is frequent, and the most that are joined by broadcast (some 50 MB).
FREQUENT = 8
MOST = 1_000_000
#: Rows of a batch of frequencies.
ROWS = 200_000

_RUN = re.compile(" +[^ ]*")


def pre_tokens(text: str) -> list[str]:
    """Pre-tokens of a text, each without its first blank; the library puts that in front by itself."""
    text = text.replace("▁", " ")
    if not text:
        return []
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [run[1:] for run in _RUN.findall(" " + text)]


def check_model(model) -> None:
    """Raises if a piece could cross the start of a run of blanks."""
    for i in range(model.get_piece_size()):
        if re.search("[^▁]▁", model.id_to_piece(i)):
            raise ValueError(f"piece {i} has a blank after another character")


def frequent_pieces(docs: DataFrame, model_path: str, seed: int) -> DataFrame:
    """(key, tokens) of the pre-tokens that stand FREQUENT times or more in the corpus, the MOST most frequent of them at
    most (by powers of two), each counted once by the library; written."""

    def found(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(pre_tokens(text.as_py() or ""))
                if len(seen) > KEPT:
                    yield _pieces(seen)
                    seen = Counter()
        yield _pieces(seen)

    def counted(batches):
        model = _model(model_path)
        for batch in batches:
            pieces = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(keys_of(pieces, seed)), pa.array(_tokens(model, pieces), pa.int64())], names=["key", "tokens"])

    each = docs.select(F.col("text").cast("string")).mapInArrow(found, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    often = cut(each.where(F.col("n") >= FREQUENT).withColumn("step", F.floor(F.log2("n"))))
    least, held = 64, 0
    for row in often.groupBy("step").agg(F.count(F.lit(1)).alias("pieces")).orderBy(F.desc("step")).collect():  # 64 at most
        held += row["pieces"]
        if held > MOST:
            break
        least = row["step"]
    return cut(often.where(F.col("step") >= least).select("piece").mapInArrow(counted, "key long, tokens long"))


def _model(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    check_model(model)
    return model


def _tokens(model, pieces: list[str]) -> list[int]:
    return [len(x) if p else 1 for p, x in zip(pieces, model.encode(pieces, num_threads=1))]  # "": a blank by itself


def _pieces(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["piece", "n"])


def keys_of(pieces, seed: int) -> np.ndarray:
    import xxhash

    hashed = (xxhash.xxh3_64_intdigest(p.encode("utf-8", "replace"), seed) for p in pieces)
    return np.fromiter(hashed, np.uint64, len(pieces)).view(np.int64)


def piece_table(docs: DataFrame, model_path: str) -> tuple[DataFrame, int]:
    """The table of frequent pre-tokens and the seed of its hash: the first under which no two of them share a key."""
    for seed in range(16):
        table = frequent_pieces(docs, model_path, seed)
        if table.count() == table.select("key").distinct().count():
            return table, seed
    raise ValueError("pre-tokens share 64-bit keys under every seed")


def frequencies(docs: DataFrame, model_path: str, table: DataFrame, seed: int) -> DataFrame:
    """(doc, key, n, rest): how often each pre-token of the table stands in a document, and in one row with a null key
    the tokens of its other, rare pre-tokens, which are counted where they stand."""
    names = np.sort(table.select("key").toPandas()["key"].to_numpy(np.int64))  # MOST at most
    frequent = docs.sparkSession.sparkContext.broadcast(names)

    def run(batches):
        model, names = _model(model_path), frequent.value
        kept: dict[str, int] = {}

        def emit(block):
            rare = list({p for _, own, known in block for p, k in zip(own, known[1]) if not k} - kept.keys())
            kept.update(zip(rare, _tokens(model, rare)))
            docs, keys, n, rest = [], [], [], []
            for doc, own, (key, known) in block:
                times = np.fromiter(own.values(), np.int64, len(own))
                docs.append(pa.repeat(doc, 1 + int(known.sum())))
                keys += [pa.nulls(1, pa.int64()), pa.array(key[known])]
                n += [np.zeros(1, np.int64), times[known]]
                rest += [np.array([sum(t * kept[p] for p, k, t in zip(own, known.tolist(), times.tolist()) if not k)], np.int64), np.zeros(int(known.sum()), np.int64)]
            if len(kept) > KEPT:
                kept.clear()
            return pa.RecordBatch.from_arrays([pa.concat_arrays(docs), pa.concat_arrays(keys), pa.array(np.concatenate(n)), pa.array(np.concatenate(rest))], names=["doc", "key", "n", "rest"])

        for batch in batches:
            block, held = [], 0
            for doc, text in zip(batch.column(0), batch.column(1)):
                own = Counter(pre_tokens(text.as_py() or ""))
                key = keys_of(own, seed)
                at = np.minimum(np.searchsorted(names, key), max(0, len(names) - 1))
                block.append((doc, own, (key, names[at] == key if len(names) else np.zeros(len(own), bool))))
                held += len(own)
                if held > ROWS:
                    yield emit(block)
                    block, held = [], 0
            if block:
                yield emit(block)

    return docs.select("doc", F.col("text").cast("string")).mapInArrow(run, f"doc {docs.schema['doc'].dataType.simpleString()}, key long, n long, rest long")


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null and empty texts: 0. Repeated rows are counted each. Empty input: no rows. Other columns aren't read. The
    result has no begin or end token, and control strings inside texts are ordinary text.
    """
    ready(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    table, seed = piece_table(docs.select(text.alias("text")), model_path)
    # a row's own number keeps repeated rows apart; it only has to differ within one run of the task
    doc = F.struct(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"))
    rows = frequencies(docs.select(doc.alias("doc"), text.alias("text")), model_path, table, seed)
    joined = rows.join(F.broadcast(table), "key", "left")  # MOST rows at most
    counts = joined.groupBy("doc").agg(F.sum(F.coalesce(F.col("tokens") * F.col("n"), F.lit(0)) + F.col("rest")).alias("n_tokens"))
    return counts.select("doc.doc_id", "doc.n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
