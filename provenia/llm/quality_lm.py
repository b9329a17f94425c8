"""Quality classifier: an interpolated modified Kneser-Ney model of order 4 over the bytes of UTF-8.

The model is trained on trusted text (labelled good and not toxic). Counts are sharded by n-gram, the quantities of
each context by context, and joined there: first among themselves, then with the distinct n-grams of the whole
corpus, whose log probabilities make a table. That table is joined to the n-grams of each document and summed up. A
document's perplexity is 2 to the mean of its bits a symbol. A few words that trusted text doesn't have hardly move that
mean, so the same join also sums up the bits of each symbol beyond DEAR, which ordinary text hardly has: the tail. A
document is rejected when either is above a quantile of the trusted documents of its language. One trusted document in HELD_OUT, by its id's hash, stays out of the training and gives the
quantiles, so that they hold for text the model hasn't seen, however little it was trained on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenia.llm.common import cut, ready, weighed

ORDER = 4
SYMBOLS = 256
#: Before a text's first symbol; no UTF-8 text has this byte.
START = b"\xff" * (ORDER - 1)

#: The thresholds: this quantile of the trusted documents of the language.
QUANTILE = 0.99
#: Bits from which on a symbol counts into the tail: the model gave it less than one chance in 1,024.
DEAR = 10
HELD_OUT = 5
#: A document's mean counts as if it had so many symbols more at its language's mean, and its tail as many of none, so a short one isn't rejected by chance.
PRIOR = 200
#: Ids are broadcast up to this many (16 MB of longs); beyond, they are joined by shuffle.
BROADCAST_IDS = 2_000_000
#: Thresholds are broadcast up to this many languages; beyond, the scored documents are shuffled to them.
BROADCAST_LANGS = 10_000
#: Bytes of text whose n-grams are counted at once.
BLOCK = 4_000_000


def codes(text: str | None) -> np.ndarray:
    """The 4-gram of each byte of the text, as a number of 32 bits."""
    flat = np.frombuffer(START + (text or "").encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    return flat[:-3] << 24 | flat[1:-2] << 16 | flat[2:-1] << 8 | flat[3:]


def gram_counts(docs: DataFrame) -> DataFrame:
    """(code, n, trained) of the 4-grams of ``docs`` (text, good): how often in all and in good texts; summed within each task first."""
    ready(docs.sparkSession)

    def run(batches):
        keys, sums = np.zeros(0, np.uint32), np.zeros((2, 0), np.int64)

        def add(block):
            nonlocal keys, sums
            flat = np.concatenate([keys, *[c for c, _ in block]])
            good = np.concatenate([np.zeros(0, bool), *[np.full(len(c), g) for c, g in block]])
            old = len(keys)
            keys, at = np.unique(flat, return_inverse=True)
            n = [np.concatenate([s, w]) for s, w in zip(sums, (np.ones(len(flat) - old), good))]
            sums = np.array([np.bincount(at, w, len(keys)).astype(np.int64) for w in n])

        for batch in batches:
            block, held = [], 0
            for text, good in zip(batch.column(0), batch.column(1).to_pylist()):
                block.append((codes(text.as_py()), good))
                held += len(block[-1][0])
                if held > BLOCK:
                    add(block)
                    block, held = [], 0
            if block:
                add(block)
        yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int64)), pa.array(sums[0]), pa.array(sums[1])], names=["code", "n", "trained"])

    each = docs.select(F.col("text").cast("string"), "good").mapInArrow(run, "code long, n long, trained long")
    return each.groupBy("code").agg(F.sum("n").alias("n"), F.sum("trained").alias("trained"))


def kneser_ney(counts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For order 4, 3, 2, 1, of (code, n): (code, alpha) of the grams seen and (context, gamma) of their contexts.

    p(w | context) = alpha(context w) + gamma(context) p(w | shorter context); the three discounts of each order come
    from its counts of counts. Below the highest order a gram counts the different symbols seen before it.
    """
    out = []
    for order in range(ORDER, 0, -1):
        if order < ORDER:
            counts = cut(counts.groupBy(F.col("code").bitwiseAND(SYMBOLS**order - 1).alias("code")).agg(F.count(F.lit(1)).alias("n")))
        n1, n2, n3, n4 = (x or 0 for x in counts.agg(*[F.count_if(F.col("n") == k) for k in (1, 2, 3, 4)]).first())
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        d1, d2, d3 = (min(k - 0.05, max(0.05, k - (k + 1) * y * b / a)) if a and b else k / 2 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4)))
        discount = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        grams = counts.withColumn("context", F.shiftright("code", 8)).withColumn("d", F.least(discount, F.col("n")))
        contexts = grams.groupBy("context").agg(F.sum("n").alias("total"), F.sum("d").alias("held"))
        alpha = grams.join(contexts, "context").select("code", ((F.col("n") - F.col("d")) / F.col("total")).alias("alpha"))
        out.append((alpha, contexts.select("context", (F.col("held") / F.col("total")).alias("gamma"))))
    return out


def bits_of(grams: DataFrame, model: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Adds bits, -log2 p of its last symbol, to the rows (code) of ``grams``; by a join with each order's counts."""
    p = F.lit(1 / SYMBOLS)
    for order, (alpha, gamma) in zip(range(1, ORDER + 1), reversed(model)):
        short = F.col("code").bitwiseAND(SYMBOLS**order - 1)
        a = alpha.select(F.col("code").alias(f"_c{order}"), F.col("alpha").alias(f"_a{order}"))
        g = gamma.select(F.col("context").alias(f"_x{order}"), F.col("gamma").alias(f"_g{order}"))
        grams = grams.join(a, short == F.col(f"_c{order}"), "left").join(g, F.shiftright(short, 8) == F.col(f"_x{order}"), "left").drop(f"_c{order}", f"_x{order}")
        p = F.coalesce(f"_a{order}", F.lit(0.0)) + F.coalesce(f"_g{order}", F.lit(1.0)) * p
    return grams.withColumn("bits", -F.log2(p)).drop(*[f"_{c}{order}" for c in "ag" for order in range(1, ORDER + 1)])


def document_grams(docs: DataFrame) -> DataFrame:
    """(doc, code, n): the 4-grams of each document; one without text has one row with a null code."""

    def run(batches):
        for batch in batches:
            docs, keys, n, held = [], [], [], 0
            for doc, text in zip(batch.column(0), batch.column(1)):
                own, times = np.unique(codes(text.as_py()), return_counts=True)
                docs.append(pa.repeat(doc, max(1, len(own))))
                keys.append(pa.array(own.astype(np.int64)) if len(own) else pa.nulls(1, pa.int64()))
                n.append(times if len(own) else np.zeros(1, np.int64))
                held += len(own)
                if held > BLOCK // 16:
                    yield pa.RecordBatch.from_arrays([pa.concat_arrays(docs), pa.concat_arrays(keys), pa.array(np.concatenate(n))], names=["doc", "code", "n"])
                    docs, keys, n, held = [], [], [], 0
            if docs:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(docs), pa.concat_arrays(keys), pa.array(np.concatenate(n))], names=["doc", "code", "n"])

    return docs.select("doc", F.col("text").cast("string")).mapInArrow(run, f"doc {docs.schema['doc'].dataType.simpleString()}, code long, n long")


def trusted_ids(labels: DataFrame) -> DataFrame:
    """(doc_id): labelled good and not toxic. A label that is null isn't trusted."""
    return labels.where("quality = 1 AND toxic = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long")).distinct()


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame | None:
    """(doc, bits, n, rate, threshold, tail, tail_threshold, kept) of the documents, given as rows (doc, text); doc is a struct with doc_id and lang.

    bits: the sum of -log2 p of the n symbols; rate: bits a symbol, drawn to the language's mean; tail: bits beyond
    DEAR a symbol, drawn to none. None without any trusted text to train on, or none to hold out.
    """
    ready(docs.sparkSession)
    ids = cut(trusted_ids(labels))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0
    good = ids.where(~held).select("doc_id", F.lit(True).alias("good"))
    if ids.count() <= BROADCAST_IDS:
        good = F.broadcast(good)
    flagged = docs.select(F.col("doc.doc_id").alias("doc_id"), "text").join(good, "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    counts = cut(gram_counts(flagged))
    trained = counts.where("trained > 0").select("code", F.col("trained").alias("n"))
    if trained.isEmpty():
        return None
    table = cut(bits_of(counts.select("code", "n"), kneser_ney(trained)).withColumn("tail", F.greatest(F.col("bits") - DEAR, F.lit(0.0))))
    sums = weighed(document_grams(docs), "doc", "code", table, "bits", also=("tail",))
    scored = cut(sums.select("doc", F.col("total").alias("bits"), F.col("times").alias("n"), (F.col("tail") / (F.col("times") + PRIOR)).alias("tail")))
    lang = F.coalesce("doc.lang", F.lit(""))
    unseen = cut(scored.where("n > 0").select(F.col("doc.doc_id").alias("doc_id"), lang.alias("_lang"), "bits", "n", "tail").join(ids.where(held), "doc_id", "left_semi"))
    if unseen.isEmpty():
        return None
    names = ("mean", "threshold", "tail_threshold")
    found = ((F.sum("bits") / F.sum("n")).alias("mean"), F.percentile_approx(F.col("bits") / F.col("n"), QUANTILE, 10_000).alias("threshold"), F.percentile_approx("tail", QUANTILE, 10_000).alias("tail_threshold"))
    by_lang = cut(unseen.groupBy("_lang").agg(*found))
    if by_lang.count() <= BROADCAST_LANGS:
        by_lang = F.broadcast(by_lang)
    overall = unseen.agg(*found).first()
    joined = scored.withColumn("_lang", lang).join(by_lang, "_lang", "left")
    mean, threshold, most = (F.coalesce(F.col(c), F.lit(overall[c])) for c in names)
    rate = (F.col("bits") + PRIOR * mean) / (F.col("n") + PRIOR)
    return joined.select("doc", "bits", "n", rate.alias("rate"), threshold.alias("threshold"), "tail", most.alias("tail_threshold"), ((rate <= threshold) & (F.col("tail") <= most)).alias("kept"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, lang, n_symbols, perplexity, threshold (of the perplexity), tail, tail_threshold, kept.

    Null or empty text has no symbols and gets its language's mean and no tail, so it is kept. A null language is a language of
    its own; one without trusted documents has the threshold of all. Without any trusted text to train on, or none to
    hold out, every document is kept with null scores and thresholds. Repeated rows are judged each. Empty input: no rows.
    """
    rows = docs.select(F.struct(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "lang").alias("doc"), F.col("text").cast("string").alias("text"))
    found = judged(rows, labels)
    if found is None:
        none = F.lit(None).cast("double")
        return docs.select(F.col("doc_id").cast("long"), "lang", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_symbols"), none.alias("perplexity"), none.alias("threshold"), none.alias("tail"), none.alias("tail_threshold"), F.lit(True).alias("kept"))
    return found.select("doc.doc_id", "doc.lang", F.col("n").alias("n_symbols"), F.pow(F.lit(2.0), "rate").alias("perplexity"), F.pow(F.lit(2.0), "threshold").alias("threshold"), "tail", "tail_threshold", "kept")


def drop_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are kept, columns as they were. Rows alike in doc_id, language and text are judged as one.

    The rejected are named to the tasks up to BROADCAST_IDS; beyond, documents are shuffled to them.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    name = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").alias("lang"), F.md5(text).alias("md5"))
    found = judged(docs.select(name.alias("doc"), F.col("text").cast("string").alias("text")), labels)
    if found is None:
        return docs
    gone = cut(found.where("NOT kept").select(F.xxhash64("doc").alias("_key"), "doc.*").distinct()).toDF("_key", "_id", "_lang", "_md5")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    same = (F.col("_key") == F.xxhash64(name)) & F.col("_id").eqNullSafe(F.col("doc_id").cast("long")) & F.col("_lang").eqNullSafe(docs["lang"]) & (F.col("_md5") == F.md5(text))
    return docs.join(gone, same, "left_anti")
