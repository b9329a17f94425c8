import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from provenia.llm import packing
from provenia.llm.queries import SPECIAL

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ranks_give_the_librarys_ids(library, docs):
    encode = packing.byte_bpe(RANKS, SPECIAL)
    rng = random.Random(3)
    alphabet = "ab  \n\t.'sé日😀<|>_0123456789RE 　́"
    texts = [r.text or "" for r in docs.collect()] + ["".join(rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(3000)]
    texts += ["<|endoftext|>", "a<|endoftext|>b", "<|endoftext|><|endoftext|>", " <|endoftext|> x", "a" * 3000, " " * 3000, "\x00�"]
    for text in texts:
        assert encode(text) == library.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("text", [" " * 5_000_000, "\n" * 5_000_000, "x" + " " * 1_500_000 + "<|endoftext|>y", "\u3000" * 1_200_000 + "a", "b" * 2_000_000])
def test_very_long_runs(library, text):
    assert packing.byte_bpe(RANKS, SPECIAL)(text) == library.encode(text, add_special_tokens=False).ids
    plain = packing.byte_bpe(RANKS, {})
    assert plain.decode(plain(text)) == text


def best_fit(lengths, window):
    room, out = [], {}
    for i in np.argsort(-lengths, kind="stable").tolist():
        fits = [(r, -b) for b, r in enumerate(room) if r >= lengths[i]]
        if fits:
            b = -min(fits)[1]
        else:
            room.append(window)
            b = len(room) - 1
        out[i] = (b, room[b])
        room[b] -= int(lengths[i])
    return room, out


@pytest.mark.parametrize("window", [1, 7, 64, 1024])
def test_best_fit_leaves_the_same_rooms_as_brute_force(window):
    rng = np.random.default_rng(window)
    for n in (0, 1, 5, 300):
        lengths = rng.integers(1, window + 1, n)
        number, offset = packing.best_fit_decreasing(lengths, window)
        room, _ = best_fit(lengths, window)
        used = np.bincount(number, lengths, minlength=len(room)) if n else np.zeros(0)
        assert sorted(window - used) == sorted(room)
        for b in set(number.tolist()):
            spans = sorted(zip(offset[number == b], lengths[number == b]))
            assert [s for s, _ in spans] == [0, *np.cumsum([x for _, x in spans])[:-1]]


def test_every_id_lies_in_one_piece(docs, library, monkeypatch):
    rows = packing.pack_documents(docs, RANKS, SPECIAL, 64).collect()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(library.encode(r.text or "", add_special_tokens=False).ids + [0])
    pieces, windows = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert pieces.keys() == texts.keys()
    for doc_id, ids in texts.items():
        own = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in pieces[doc_id])
        cuts = [(s, min(64, len(x) - s), zlib.crc32(np.array(x[s : s + 64], "<u4").tobytes()), len(x)) for x in ids for s in range(0, len(x), 64)]
        assert own == sorted(cuts)
    for spans in windows.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(n for _, n in spans) <= 64


def test_sequences_read_back(spark, library):
    docs = spark.createDataFrame([(i, f"word {i} " * i) for i in range(40)], "doc_id long, text string")
    placed = packing.pack_documents(docs, RANKS, SPECIAL, 32)
    out = {r.sequence_id: np.frombuffer(bytes(r.ids), "<u4") for r in packing.sequences(docs, placed, RANKS, SPECIAL, 32).collect()}
    assert all(len(x) == 32 for x in out.values())
    for r in placed.collect():
        ids = [*library.encode(f"word {r.doc_id} " * r.doc_id, add_special_tokens=False).ids, 0]
        assert out[r.sequence_id][r.offset : r.offset + r.length].tolist() == ids[r.start : r.start + r.length]


def test_empty(empty):
    assert packing.pack_documents(empty, RANKS, SPECIAL).collect() == []
