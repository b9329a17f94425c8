import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from provenia.llm import alignment as module
from provenia.llm.alignment import Pieces, alignment, links

RANKS, MODEL = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("piece_bpe_32k.model")


def brute(texts):
    """By the libraries themselves, token by token and pair by pair."""
    one = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    one.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}
    two = sentencepiece.SentencePieceProcessor(model_file=MODEL)

    def piece_bytes(i):
        p = two.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode()

    found = []
    for t in texts:
        groups = []
        if t:
            a, b = one.encode(" " + t, add_special_tokens=False).ids, two.encode(t)
            bytes_a, bytes_b = [bytes(byte_of[c] for c in one.id_to_token(i)) for i in a], [piece_bytes(i) for i in b]
            if b"".join(bytes_a) == b"".join(bytes_b) == (" " + t).encode():
                ends_a, ends_b = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
                low = 0
                for cut in sorted(set(ends_a) & set(ends_b)):
                    groups.append(([i for i, e in zip(a, ends_a) if low < e <= cut], [i for i, e in zip(b, ends_b) if low < e <= cut]))
                    low = cut
        found.append(groups)
    linked = [Counter((x, y) for a, b in g for x in a for y in b) for g in found]
    count = Counter(p for c in linked for p in c)
    best = {}
    for (x, _), n in count.items():
        best[x] = max(best.get(x, 0), n)
    out = []
    for groups, pairs in zip(found, linked):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), sum(pairs.values()), sum(n for p, n in pairs.items() if count[p] == best[p[0]]), sum(n * count[p] for p, n in pairs.items()), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


def run(spark, texts):
    df = spark.createDataFrame([(i, t, "x", 1, "y") for i, t in enumerate(texts)], "doc_id long, text string, pair string, n int, row string").repartition(3)
    rows = sorted(alignment(df, RANKS, MODEL).collect())
    return [tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in rows]


def test_matches_the_libraries(spark, docs):
    texts = [r.text for r in docs.collect() if len(r.text or "") < 20_000]
    want = brute(texts)
    assert run(spark, texts) == want
    assert {0, 1} < {min(2, w[2]) for w in want}


def test_odd_characters(spark):
    rng = random.Random(11)
    texts = ["".join(rng.choices("ab the▁ \n\t\r.<s>é日😀 　\x00​ﬁ<|endoftext|>", k=rng.randint(0, 60))) for _ in range(400)]
    texts += [" ", "  ", "\n", "▁", "a" * 300, " " * 70, "<|endoftext|>", "<s>", "<0x41>", "étude naïve", "日本語" * 20, None]
    want = brute(texts)
    assert run(spark, texts) == want
    assert sum(w[0] == 0 for w in want) > 20 and sum(w[0] > 0 for w in want) > 100


def test_small_blocks_and_rare_pairs(spark, docs, monkeypatch):
    from provenia.llm import common

    texts = [r.text for r in docs.collect() if len(r.text or "") < 3000]
    want = brute(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(module, "BLOCK", 100)
    monkeypatch.setattr(module, "WIDE", 1)
    monkeypatch.setattr(module, "KEPT", 10)
    real = common.weighed
    monkeypatch.setattr(module, "weighed", lambda *a, **k: real(*a, most=20, **k))
    rows = sorted(alignment(df, RANKS, MODEL).collect())
    assert [tuple(r[c] for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in rows] == want


def test_ids_of_pieces_are_the_librarys():
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(5)
    texts = ["".join(rng.choices("ab the \n\t\r.<s>é日😀 　​", k=rng.randint(0, 40))) for _ in range(3000)]
    pieces = Pieces(MODEL)
    for t, ids in zip(texts, pieces(texts)):
        if ids is not None:
            assert ids.tolist() == model.encode(t)
        else:
            assert b"".join(pieces.bytes[i] for i in model.encode(t)) != b" " + t.encode()


def test_links_of_wide_groups():
    a, b = np.array([1, 2, 1]), np.array([3, 3, 4, 5])
    one = [x.tolist() for x in links(a, b, np.array([0, 0, 1]), np.array([0, 0, 0, 1]), np.array([2, 1]), np.array([3, 1]), np.array([0, 0]), 10)]
    assert one == [[0] * 5, [13, 14, 15, 23, 24], [2, 1, 1, 2, 1]]


def test_empty_repeated_and_null(spark, empty):
    assert alignment(empty, RANKS, MODEL).collect() == []
    df = spark.createDataFrame([(1, "one two"), (1, "one two"), (None, "one two"), (2, None)], "doc_id long, text string")
    rows = [tuple(r) for r in alignment(df, RANKS, MODEL).collect()]
    assert len(rows) == 4 and sorted(r[6] for r in rows) == [0, 6, 6, 6]
