import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodestone.llm import wordpiece


def test_automaton_is_greedy():
    r = random.Random(1)
    for _ in range(3000):
        first = {"".join(r.choice("abc") for _ in range(r.randint(1, 4))) for _ in range(r.randint(0, 6))}
        later = {"".join(r.choice("abc") for _ in range(r.randint(1, 5))) for _ in range(r.randint(0, 8))}
        a = wordpiece.Automaton(first, later)
        for _ in range(4):
            w = "".join(r.choice("abcé") for _ in range(r.randint(0, 14)))
            assert a.count(w) == wordpiece.greedy_count(w, first, later), (first, later, w)


def test_long_words_take_linear_time():
    a = wordpiece.Automaton(["a"], ["a" * 50, "b"])
    assert a.count("a" * 200_000) > 0


@pytest.mark.parametrize("kept", [1 << 19, 0])
def test_counts_are_brute_force(documents, awkward, kept, monkeypatch):
    monkeypatch.setattr(wordpiece, "KEPT_WORDS", kept)
    first, later = wordpiece.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    f, g = set(first), set(later)
    texts = [*awkward, "The quick brown fox, naïve 日本語 x\u00a0y"]
    docs = documents(texts).withColumn("n_tokens", F.lit("x"))
    for r in wordpiece.token_counts(docs, first, later).collect():
        own = (texts[r.doc_id] or "").encode().split()
        assert r.n_words == len(own)
        assert r.n_tokens == sum(wordpiece.greedy_count(w.decode(), f, g) if len(w) < 1000 else wordpiece.Automaton(f, g).count(w.decode()) for w in own)


def test_empty_table(documents):
    assert wordpiece.token_counts(documents([]), ["a"], ["b"]).count() == 0
