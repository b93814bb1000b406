import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in pipeline.STAGES] == ["language ID", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "best-fit packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = pipeline.run(spark, SF).collect()
    assert 0 < len({r.doc_id for r in rows}) <= docs.count()
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).columns == docs.columns


def test_near_duplicates_leave_one(spark, documents):
    r = random.Random(1)
    first = [f"w{r.randrange(5000)}" for _ in range(200)]
    near = [*first[:100], "changed", *first[101:]]
    other = [f"v{r.randrange(5000)}" for _ in range(200)]
    texts = [" ".join(x) for x in (other, first, near, first)] + [None, None, ""]
    got = pipeline.near_duplicates(spark, documents(texts), SF).collect()
    assert sorted(x.doc_id for x in got) == [0, 1, 4, 5, 6]
    twice = documents(texts).union(documents(texts))
    assert sorted(x.doc_id for x in pipeline.near_duplicates(spark, twice, SF).collect()) == [0, 1, 4, 5, 6]


def test_leaks_go_and_clean_stay(spark, documents):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    texts = ["some clean words " * 10, "before " + item + " after", None, " ".join(item.split()[:7])]
    got = pipeline.leaks(spark, documents(texts, ids=[0, None, 2, 3]), SF).collect()
    assert sorted(x.doc_id for x in got) == [0, 2, 3]


def test_secrets_are_masked(spark, documents):
    got = pipeline.secret_spans(spark, documents(["x token = abcdefgh1234", "plain"]), SF).orderBy("doc_id").collect()
    assert [x.text for x in got] == ["x [REDACTED]", "plain"]


@pytest.mark.parametrize("name", ["language ID"])
def test_language_stage_drops_what_has_no_letters(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10**6, "12 34 !!", "en", "s", 8), (10**6 + 1, None, "en", "s", 0)], docs.schema)
    kept = {x.doc_id for x in pipeline.languages(spark, docs.union(extra), SF).collect()}
    assert 10**6 not in kept and 10**6 + 1 not in kept
    assert len(kept) >= 0.98 * docs.count()


def test_language_stage_without_labels_keeps_all(spark, documents):
    got = pipeline.languages(spark, documents(["some text", None, "12 !", "", "日"]), SF).collect()
    assert sorted(x.doc_id for x in got) == [0, 4]


def test_language_stage_rejects_by_posteriors(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    r = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [" ".join("".join(r.choice(x) for _ in range(r.randrange(2, 10))) for _ in range(80)) for x in (letters, letters.upper() + letters, "абвгдежзиклмнопрстуф")]
    by = {x.lang: x.text.split() for x in docs.where("n_chars > 1500").orderBy("doc_id").collect()}
    switched = " ".join(w for k in range(0, 60, 12) for lang in sorted(by) for w in by[lang][k : k + 12])
    extra = spark.createDataFrame([(10**6 + i, t, None, "s", len(t)) for i, t in enumerate([*texts, switched])], docs.schema)
    kept = {x.doc_id for x in pipeline.languages(spark, docs.union(extra), SF).collect()}
    assert kept & set(range(10**6, 10**6 + 4)) == {10**6 + 3}
    assert len(kept) >= 0.98 * docs.count()


def test_rows_with_one_id_null_ids_and_clashing_names(spark, documents):
    r = random.Random(3)
    a, b, c = (" ".join(f"{x}{r.randrange(5000)}" for _ in range(60)) for x in "abc")
    texts = [a, b, a, None, c, None, "", None]
    docs = documents(texts, ids=[7, 7, 7, None, 42, 42, None, None]).withColumn("_key", F.lit("mine")).withColumn("lang_sure", F.lit(0.5))
    got = pipeline.near_duplicates(spark, docs, SF).collect()
    want = [(7, a), (7, b), (None, None), (42, c), (42, None), (None, "")]
    assert sorted(((x.doc_id, x.text) for x in got), key=repr) == sorted(want, key=repr)
    assert {(x._key, x.lang_sure) for x in got} == {("mine", 0.5)} and got[0].__fields__ == docs.columns
    kept = pipeline.leaks(spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() == len(texts)
    assert {x._key for x in kept.collect()} == {"mine"}


def test_the_smallest_id_stays(spark, documents):
    text = "one text of more than five words here"
    assert [x.doc_id for x in pipeline.near_duplicates(spark, documents([text] * 4, ids=[None, 12, -3, 5]), SF).collect()] == [-3]


def test_language_stage_keeps_clashing_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("lang_pred", F.lit("mine"))
    got = pipeline.languages(spark, docs, SF)
    assert got.columns == docs.columns and got.where("lang_pred = 'mine'").count() == got.count() > 0
