import random
from collections import Counter

import public_tokenizers
import sentencepiece

from provenia.llm.token_counts import piece_table, pre_tokens, token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_matches_the_library(docs):
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    want = sorted((r.doc_id or -1, len((r.text or "").encode()), len(model.encode(r.text or ""))) for r in docs.collect())
    got = token_counts(docs, PATH).collect()
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(r.over_limit == (r.n_tokens > 4096) for r in got) and any(r.over_limit for r in got)


def test_blanks_and_odd_characters_at_any_place():
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rng = random.Random(5)
    texts = ["".join(rng.choices("ab the▁ \n\t\r.<s>é日😀 　\x00​", k=rng.randint(0, 40))) for _ in range(4000)]
    own = [sum(len(model.encode(p)) if p else 1 for p in pre_tokens(t)) for t in texts]
    assert own == [len(x) for x in model.encode(texts)]


def test_frequent_and_rare_pre_tokens(docs, monkeypatch):
    from provenia.llm import token_counts as module

    rows = docs.select("text")
    want = Counter(p for r in rows.collect() for p in pre_tokens(r.text or ""))
    counts = sorted((r.n_tokens for r in token_counts(docs, PATH).collect()))
    monkeypatch.setattr(module, "KEPT", 50)
    for frequent, most in ((1, 10**6), (8, 10**6), (1, 40), (10**9, 10**6)):
        monkeypatch.setattr(module, "FREQUENT", frequent)
        monkeypatch.setattr(module, "MOST", most)
        table, _ = piece_table(rows, PATH)
        n = table.count()
        assert n <= most and (n == sum(k >= frequent for k in want.values()) or most == 40)
        assert sorted(r.n_tokens for r in token_counts(docs, PATH).collect()) == counts


def test_empty(empty):
    assert token_counts(empty, PATH).collect() == []
