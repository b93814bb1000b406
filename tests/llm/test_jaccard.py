import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.llm import jaccard


def shingles(text, k):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def brute(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = {i: set() for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
                if sets[a] != sets[b]:
                    links[a].add(frozenset(sets[b]))
                    links[b].add(frozenset(sets[a]))
    return {i: (len(sets[i]), find(i), len(links[i])) for i in sets}


def corpus(seed, n=150, size=(9, 80)):
    """Originals and copies of copies with one to four words changed."""
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(n):
        if texts and r.random() < 0.7:
            w = r.choice(texts).split()
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = r.choice(vocabulary)
            texts.append(" ".join(w[: len(w) - r.randint(0, 1)]))
        else:
            texts.append(" ".join(r.choice(vocabulary) for _ in range(r.randint(*size))))
    return texts


def check(docs, k, percent):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in jaccard.jaccard_components(docs, k, percent).collect()}
    assert got == brute(rows, k, percent)
    return got


@pytest.mark.parametrize(("seed", "k", "percent"), [(1, 3, 90), (2, 5, 80), (3, 1, 60)])
def test_join_is_brute_force(documents, awkward, seed, k, percent):
    texts = awkward + corpus(seed)
    got = check(documents(texts).withColumn("component_id", F.lit("x")).repartition(3), k, percent)
    assert len({c for _, c, _ in got.values()}) < len(texts)


def test_one_large_group_in_blocks(documents, monkeypatch):
    r = random.Random(4)
    first = [f"w{i}" for i in range(120)]
    texts = []
    for _ in range(160):
        w = list(first)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(120)] = f"x{r.randrange(40)}"
        texts.append(" ".join(w))
    monkeypatch.setattr(jaccard, "LIST_BLOCK", 30)
    monkeypatch.setattr(jaccard, "GROUP_BLOCK", 4000)
    check(documents(texts), 3, 90)
    monkeypatch.setattr(jaccard, "GROUP_BLOCK", 4_000_000)
    monkeypatch.setattr(jaccard, "GROUP_SETS", 25)
    check(documents(texts), 3, 90)


def test_uncounted_long_lists_are_cut(documents, monkeypatch):
    r = random.Random(8)
    monkeypatch.setattr(jaccard, "counted_share", lambda percent: 0)
    monkeypatch.setattr(jaccard, "LIST_BLOCK", 20)
    check(documents(corpus(9, 40, (30, 40)) + [f"a b c d e f g h i j {r.randrange(3)} k l m n o p q r s t {r.randrange(30)}" for _ in range(120)]), 1, 80)


@pytest.mark.parametrize("short", [0, 1000])
@pytest.mark.parametrize("percent", [60, 80, 90])
def test_position_runs_are_the_position_test(percent, short, monkeypatch):
    import numpy as np

    monkeypatch.setattr(jaccard, "SHORT_LIST", short)
    r = np.random.default_rng(percent)
    n = np.sort(r.integers(1, 40, 300))
    pos = np.array([r.integers(0, x) for x in n])
    order = np.lexsort((pos, n))
    n, pos = n[order], pos[order]
    candidates = jaccard.position_runs(n, pos, percent)
    for i in range(1, len(n)):
        js = np.arange(i)
        want = js[(n[js] >= jaccard.need(int(n[i]), percent)) & jaccard.by_position(n[i], n[js], pos[i], pos[js], percent)]
        assert candidates(i).tolist() == want.tolist()


def test_ids_of_bytes(documents):
    texts = corpus(3, 40)
    docs = documents(texts)
    named = docs.withColumn("doc_id", F.encode(F.lpad(F.col("doc_id").cast("string"), 4, "0"), "UTF-8"))
    got = {int(r.doc_id): int(r.component_id) for r in jaccard.jaccard_components(named, 3, 80).collect()}
    assert got == {i: c for i, (_, c, _) in brute(list(enumerate(texts)), 3, 80).items()}


def test_long_sets_use_wider_sketches(documents):
    r = random.Random(5)
    w = [f"w{r.randrange(100000)}" for _ in range(6000)]
    near = list(w)
    for i in range(0, 6000, 100):
        near[i] = "changed"
    far = [f"w{r.randrange(100000)}" for _ in range(5000)] + w[:1000]
    got = check(documents([" ".join(x) for x in (w, near, far)]), 3, 90)
    assert got[1][1] == 0 and got[2][1] == 2


def test_null_ids_and_empty_table(spark, documents):
    docs = documents(["a b c d e f g h i j k l", "a b c d e f g h i j k l", None], ids=[None, 7, None])
    got = jaccard.jaccard_components(docs, 3, 90).collect()
    assert sorted((r.doc_id is None, r.component_id) for r in got if r.n_shingles) == [(False, 7), (True, 7)]
    assert jaccard.jaccard_components(documents([]), 3, 90).count() == 0


def test_derived_answers_are_the_direct_ones():
    import numpy as np

    sets = sorted((np.array(sorted(hash(x) & (2**63 - 1) for x in shingles(t, 2)), np.uint64) for t in corpus(6, 120)), key=len)
    degree, forest = jaccard.group_links(sets, None, 70)
    want = [sum(100 * len(set(a) & set(b)) >= 70 * len(set(a) | set(b)) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)]
    assert degree.tolist() == want and len(forest) <= len(sets)
