import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lodestone.llm import decontaminate

BENCHMARK = [("1", "Alpha beta gamma delta epsilon zeta eta theta iota kappa."), ("20", "one two three"), ("3", None), ("4", "--- !!"), ("5", "x1 X2 x3 x4 x5 x6 x7 x8 x9 été"), ("6", "x1 x2 x3 x4 x5 x6 x7 x8")]


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, benchmark, size):
    w, hit, items = words(text), set(), set()
    for name, item in benchmark:
        b = words(item)
        for i in range(max(1, len(b) - size + 1)) if b else ():
            window = b[i : i + size]
            for j in range(len(w) - len(window) + 1):
                if w[j : j + len(window)] == window:
                    items.add(name)
                    hit.update(range(j, j + len(window)))
    return len(w), len(hit), sorted(items)


@pytest.mark.parametrize("block_bytes", [8 << 20, 60])
def test_hits_are_brute_force(spark, documents, awkward, block_bytes, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block_bytes)
    texts = [*awkward, "so alpha, beta GAMMA delta epsilon zeta eta theta iota", "one two three one-two-three", "x1 x2 x3 x4 x5 x6 x7 x8 x9 ÉTÉ été one two", "beta gamma delta epsilon zeta eta theta", "eta theta iota", "one two", "three alpha beta", "one two three " * 2000]
    texts += ["x1 x2 x3 x4", "x5 x6 x7 x8"]  # neighbours that no phrase joins
    docs = documents(texts, ids=[0, *range(len(texts) - 1)]).withColumn("items", F.lit(1)).coalesce(2)
    benchmark = spark.createDataFrame(BENCHMARK, "item_id string, text string")
    got = decontaminate.contamination(docs, benchmark).collect()
    want = [(r.doc_id, *brute(r.text, BENCHMARK, 8)) for r in docs.collect()]
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got), key=repr) == sorted(want, key=repr)
    for r in got:
        assert sum(s.end - s.start for s in r.spans) >= r.n_hit


def test_short_items_can_be_left_out(spark, documents):
    benchmark = spark.createDataFrame(BENCHMARK, "item_id string, text string")
    got = decontaminate.contamination(documents(["one two three"]), benchmark, whole_only=True).first()
    assert got.n_items == 0 and got.n_words == 3


def test_proximity(documents):
    phrases = decontaminate.Phrases([("p", decontaminate.text_words(["red green blue"])[0])], 8)
    index = decontaminate.build_index(documents(["blue x green y red", "red a b c d e f green g h blue", "red green", "blue", "red green blue"]))
    phrases.rank(decontaminate.term_counts(index, phrases.known))
    got = {r.doc_id: list(r["items"]) for r in decontaminate.search(index, phrases, within=4).collect()}
    assert got == {0: ["p"], 1: [], 2: [], 3: [], 4: ["p"]}


def test_empty_tables(spark, documents):
    benchmark = spark.createDataFrame(BENCHMARK, "item_id string, text string")
    assert decontaminate.contamination(documents([]), benchmark).count() == 0
    r = decontaminate.contamination(documents(["a b"]), benchmark.limit(0)).first()
    assert (r.n_words, r.n_hit, r.n_items) == (2, 0, 0)


def test_query_of_the_tables(spark):
    sf = "/root/testdata/sf0.001"
    benchmark = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in decontaminate.op8_decontamination(spark, sf).collect():
        n, hit, items = brute(texts[r.doc_id], benchmark, 8)
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(items), len(items) >= 2)
        assert r.items_sha256 == hashlib.sha256(",".join(items).encode()).hexdigest()


def test_repeated_benchmark_rows_are_one_item(spark, documents):
    text = "one two three four five six seven eight nine"
    bench = spark.createDataFrame([("a", text), ("a", text), (None, "other words of a null item here and more"), (None, "other words of a null item here and more")], "item_id string, text string")
    got = decontaminate.contamination(documents([text, "other words of a null item here and more"]), bench).orderBy("doc_id").collect()
    assert [(r.n_items, r["items"]) for r in got] == [(1, ["a"]), (1, [""])]


def test_one_stored_index_serves_any_benchmark(spark, documents, tmp_path):
    """Exact and proximity matches of random phrases by a written index, against brute force."""
    import random

    r = random.Random(5)
    texts = [" ".join(r.choice("abcdefghij") for _ in range(r.randrange(0, 60))) for _ in range(40)] + [None, ""]
    path = f"file://{tmp_path}/index"
    decontaminate.build_index(documents(texts).coalesce(2)).write.parquet(path)
    index = spark.read.parquet(path)
    for size, within in ((2, None), (3, None), (3, 2), (4, 3)):
        items = [(f"p{i}", " ".join(r.choice("abcdefghijk") for _ in range(size))) for i in range(6)]
        phrases = decontaminate.Phrases(list(zip([n for n, _ in items], decontaminate.text_words([t for _, t in items]))), 8)
        counts = decontaminate.term_counts(index, phrases.known)
        phrases.rank(counts)
        got = {x.doc_id: list(x["items"]) for x in decontaminate.search(index, phrases, within=within).collect()}
        number = {w: sum((t or "").split().count(w) for t in texts) for w in "abcdefghijk"}
        for i, t in enumerate(texts):
            w, want, told = (t or "").split(), set(), set()
            for name, item in items:
                own = item.split()
                if within is None:
                    hit = any(w[j : j + size] == own for j in range(len(w)))
                else:
                    rarest = min(own, key=lambda x: number[x])
                    hit = any(w[j] == rarest and all(x in w[max(0, j - within) : j + within + 1] for x in own) for j in range(len(w)))
                    ties = [x for x in own if number[x] == number[rarest]]
                    if len(set(ties)) > 1:  # the tied term that comes first leads; equal counts leave the choice open
                        continue
                told.add(name)
                if hit:
                    want.add(name)
            assert want == told & set(got[i]), (i, want, got[i])
