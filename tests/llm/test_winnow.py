import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import winnow


def brute_select(h, w):
    w = min(w, len(h))
    out = set()
    for i in range(len(h) - w + 1):
        window = h[i : i + w]
        out.add(i + max(j for j in range(w) if window[j] == min(window)))
    return sorted(out)


def test_selection_is_brute_force():
    r = random.Random(1)
    for _ in range(300):
        h = [r.randint(0, 6) for _ in range(r.randint(1, 40))]
        w = r.randint(1, 12)
        assert winnow.select(np.array(h, np.uint64), w).tolist() == brute_select(h, w)


@pytest.mark.parametrize("k", [1, 2, 3, 7, 16])
def test_gram_hashes_depend_on_the_gram_alone(k):
    code = np.array([ord(c) for c in "abracadabra abracadabra xyz"], np.uint32)
    h = winnow.gram_hashes(code, k)
    seen = {}
    for i in range(len(h)):
        assert seen.setdefault(tuple(code[i : i + k].tolist()), h[i]) == h[i]
    assert len(set(seen.values())) == len(seen)


def test_shared_passage_is_always_found():
    r = random.Random(2)
    letters = "abcdefghij "
    for _ in range(50):
        shared = "".join(r.choice(letters) for _ in range(winnow.GRAM + winnow.WINDOW - 1))
        a, b = ("".join(r.choice(letters) for _ in range(200)) + shared + "".join(r.choice(letters) for _ in range(100)) for _ in range(2))
        assert set(winnow.fingerprint(a)[0].tolist()) & set(winnow.fingerprint(b)[0].tolist())


def expected(rows):
    out = []
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for i, (doc, text) in enumerate(rows):
        text, after = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        f, g, n = (winnow.fingerprint(t) for t in (text, new, after))
        out.append((doc, len(text), hashlib.sha256(new.encode()).hexdigest(), winnow.spell(f), winnow.spell(g), winnow.likeness(f, g), winnow.likeness(f, n)))
    return out


@pytest.mark.parametrize("buckets", [1, 3, 50])
def test_report_is_brute_force(spark, documents, awkward, buckets, monkeypatch):
    texts = awkward + [f"document number {i} with words {i * i}" * (i % 7) for i in range(60)]
    docs = documents(texts, ids=[None, *range(len(texts) - 2), 5]).withColumn("guest", F.lit("x")).repartition(5)
    dealt = winnow.with_next
    monkeypatch.setattr(winnow, "with_next", lambda d: dealt(d, buckets))
    got = [tuple(r) for r in winnow.edit_report(docs).collect()]
    key = repr
    assert sorted(got, key=key) == sorted(expected([(r.doc_id, r.text) for r in docs.collect()]), key=key)


@pytest.mark.parametrize("ids", [(None, 7), (None, None), (7, 9), (0, 59)])
def test_ids_that_many_rows_share_are_cut(spark, documents, ids, monkeypatch):
    r = random.Random(4)
    texts = [f"{'shared beginning ' * (i % 3)}{r.random()} text {i} " * 9 for i in range(400)] + ["same text " * 20] * 200 + [None, ""] * 20
    docs = documents(texts, ids=[ids[i % 2] if i % 3 else i % 60 for i in range(len(texts))]).repartition(5)
    dealt = winnow.with_next(docs, 12).groupBy("bucket").count().collect()
    assert max(x["count"] for x in dealt) < len(texts) / 4
    bucketed = winnow.with_next
    monkeypatch.setattr(winnow, "with_next", lambda d: bucketed(d, 12))
    got = [tuple(x) for x in winnow.edit_report(docs).collect()]
    assert sorted(got, key=repr) == sorted(expected([(x.doc_id, x.text) for x in docs.collect()]), key=repr)


def test_one_row_and_none(documents):
    r = winnow.edit_report(documents(["abcdef" * 20])).collect()
    assert len(r) == 1 and r[0].near_next == 1.0
    assert winnow.edit_report(documents([])).count() == 0


def test_equal_texts_have_equal_fingerprints(documents):
    a, b = winnow.fingerprints(documents(["same text " * 30] * 2)).collect()
    assert a.fingerprint == b.fingerprint != ""
