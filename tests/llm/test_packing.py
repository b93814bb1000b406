import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(docs, capacity):
    tool = Tokenizer.from_file(PATH)
    rows = docs.collect()
    got = packing.pack(docs, PATH, capacity).collect()
    want = []
    for r in rows:
        ids = np.array(tool.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        for k, s in enumerate(range(0, len(ids), capacity)):
            want.append((r.doc_id, k, s, len(ids[s : s + capacity]), zlib.crc32(ids[s : s + capacity].tobytes())))
    key = repr
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences), sum(r.length for r in got)


@pytest.mark.parametrize("capacity", [7, 64, 4096])
def test_pieces_and_places(documents, awkward, capacity):
    texts = [*awkward, "<|endoftext|> a", "É e\u0301 Σ \u00a0 x\u2003y 's it's 12"] + [f"some words {'more ' * (i % 40)}" for i in range(120)]
    n, total = check(documents(texts).withColumn("offset", F.lit("x")).repartition(4), capacity)
    assert n <= 1.12 * total / capacity + 1


def test_empty_table(documents):
    assert packing.pack(documents([]), PATH).count() == 0


def test_knapsack_is_brute_force():
    from itertools import product

    r = np.random.default_rng(2)
    for _ in range(30):
        value, most, room = r.random(4), r.integers(0, 4, 4), 9
        best = max(sum(a[i] * value[i] for i in range(4)) for a in product(*[range(m + 1) for m in most]) if sum(a[i] * (i + 1) for i in range(4)) <= room)
        a = packing.best_configuration(value, most, room)
        assert (a <= most).all() and sum(a * np.arange(1, 5)) <= room and abs((a * value).sum() - best) < 1e-9


def test_plan_is_near_the_bound():
    r = np.random.default_rng(0)
    length = np.clip(np.exp(r.normal(6.4, 1, 20000)).astype(int), 1, 4096)
    counts = np.bincount(length, minlength=4097)
    chosen = packing.plan(counts)
    used = np.zeros(4097, int)
    for times, lengths in chosen:
        assert sum(lengths) <= 4096
        np.add.at(used, lengths, times)
    assert (used == counts).all()
    assert sum(t for t, _ in chosen) <= 1.005 * (-(-length.sum() // 4096)) + 1


def test_one_length_only():
    counts = np.zeros(4097, int)
    counts[1500] = 1001
    assert sum(t for t, _ in packing.plan(counts)) == 501


def test_ids_are_the_tokenizers():
    r = np.random.default_rng(5)
    parts = ["a", "B", "é", "É", "ñ", "İ", "ı", "ß", "ŉ", "Ǆ", "'", "'s", "'T", "'re", "!", ".", "<", "|", ">", "<|endoftext|>", "<|ENDOFTEXT|>", "1", "23", "́", "̱", "H̱", "̸", "=", "日", "😀", " ", " ", " ", "\n", "×", "÷", "Hello", "WORLD", "ſ", "K", "½", "²", "_", "\x00", "\x1c", "\x85"]
    texts = ["".join(r.choice(parts, r.integers(0, 14))) for _ in range(4000)]
    tool = packing.WordIds(PATH)
    assert tool.fine
    plain = Tokenizer.from_file(PATH)
    for lo in range(0, len(texts), 500):
        part = texts[lo : lo + 500]
        flat, first = tool.ids(*packing.text_buffers(packing.pa.array(part)))
        for t, a, z in zip(part, first[:-1], first[1:]):
            assert flat[a:z].tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_next_tasks_find_the_workers_words(spark, documents):
    docs = documents(["the words that a worker has met"])

    def kept(batches):
        import os

        for b in batches:
            yield packing.pa.RecordBatch.from_arrays([packing.pa.array([os.getpid()]), packing.pa.array([len(packing.tool_of(PATH))])], ["pid", "n"])

    seen = set()
    for _ in range(12):
        packing.pieces(docs.coalesce(1), PATH).collect()
        r = docs.coalesce(1).select("doc_id").mapInArrow(kept, "pid long, n long").first()
        if r.n >= 7:
            return
        seen.add(r.pid)
    raise AssertionError(f"no words kept in workers {seen}")


def test_the_bound_is_one():
    """The program's bound is below what any packing of the classes needs, and the plan near the tokens' own."""
    counts = np.zeros(4097, int)
    counts[[1500, 2100]] = 1000, 700
    got = packing.plan_report(counts)
    assert got["bound"] <= got["sequences"] + 1e-6 and got["least"] <= got["sequences"]
    assert packing.plan_report(np.zeros(4097, int))["sequences"] == 0
