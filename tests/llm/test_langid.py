import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from lodestone.llm import langid

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = langid.op1_crf_langid(spark, DATA).toPandas().merge(pq.read_table(f"{DATA}/documents.parquet", columns=["doc_id", "lang"]).to_pandas(), on="doc_id")
    held = got[got.held_out]
    assert len(got) == 1000 and len(held) > 250
    assert (held.lang == held.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all()


def brute_marginals(e, turn, begin):
    """Marginals by listing all label sequences."""
    from itertools import product

    n, k = e.shape
    out, total = np.zeros((n, k)), 0.0
    for y in product(range(k), repeat=n):
        w = np.exp(begin[y[0]] + sum(e[i, y[i]] for i in range(n)) + sum(turn[a, b] for a, b in zip(y, y[1:])))
        total += w
        for i in range(n):
            out[i, y[i]] += w
    return out / total


def test_forward_backward_is_exact():
    rng = np.random.default_rng(3)
    sizes = [1, 4, 2, 5]
    e = rng.normal(size=(sum(sizes), 3)).astype(np.float32)
    turn, begin = rng.normal(size=(3, 3)).astype(np.float32), rng.normal(size=3).astype(np.float32)
    chain = np.repeat(np.arange(4), sizes)
    place = np.concatenate([np.arange(s) for s in sizes])
    got = langid.forward_backward(e, chain, place, turn, begin)
    at = 0
    for s in sizes:
        assert np.allclose(got[at : at + s], brute_marginals(e[at : at + s], turn, begin), atol=1e-4)
        at += s


def test_messages_cross_the_borders_of_blocks(monkeypatch):
    """Blocks of two words give the marginals of whole documents."""
    monkeypatch.setattr(langid, "BLOCK", 2)
    rng = np.random.default_rng(4)
    sizes = [1, 7, 2, 5, 3, 8]
    row = np.repeat([0, 2, 3, 5, 6, 9], sizes)
    e = rng.normal(size=(len(row), 3)).astype(np.float32)
    turn, begin = rng.normal(size=(3, 3)).astype(np.float32), rng.normal(size=3).astype(np.float32)
    block, place, number = langid.blocks(row)
    got, at = langid.forward_backward(e, block, place, turn, begin, number=number), 0
    for s in sizes:
        assert np.allclose(got[at : at + s], brute_marginals(e[at : at + s], turn, begin), atol=1e-4)
        at += s


def sample_model():
    rows = pq.read_table(f"{DATA}/documents.parquet").to_pandas().head(300)
    return langid.train(rows.text.tolist(), rows.lang.tolist()), rows


def test_switched_text_is_labelled_by_word(documents):
    model, rows = sample_model()
    en, fr = (rows[(rows.lang == x) & (rows.n_chars > 1500)].text.iloc[0].split() for x in ("en", "fr"))
    text = " ".join(en[:60] + fr[:60])
    spans = langid.label_spans(documents([text]), model).first().spans
    border = len(" ".join(en[:60]).encode())
    first = sum(s.end - s.start for s in spans if s.lang == "en" and s.end <= border + 30)
    last = sum(s.end - s.start for s in spans if s.lang == "fr" and s.start >= border - 30)
    assert first > 0.8 * border and last > 0.8 * (len(text.encode()) - border)


def test_awkward_rows(documents, awkward):
    model, _ = sample_model()
    docs = documents([*awkward, "123 !!", "日本"]).withColumn("lang_score", F.lit("mine"))
    got = langid.identify(docs, model).orderBy("doc_id").collect()
    assert len(got) == len(awkward) + 2
    for r in got:
        has_letter = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not has_letter)
        assert 0 <= r.lang_score <= 1
    assert got[8].lang_pred == got[10].lang_pred


def test_empty_table_and_no_labels(documents):
    assert langid.identify(documents([])).count() == 0
    assert langid.identify(documents(["some text"])).first().lang_pred == "und"


def test_long_and_null_texts_do_not_cost_a_language(spark):
    rows = pq.read_table(f"{DATA}/documents.parquet").to_pandas()
    by = {x: " ".join(rows[rows.lang == x].text.head(60)) for x in ("en", "fr")}
    long = (by["fr"] + " ") * (1 + 20000 // len(by["fr"]))
    data = [(i, long, "fr") for i in range(30)] + [(100 + i, None, "en") for i in range(60)] + [(200 + i, by["en"][:3000], "en") for i in range(30)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = langid.fit(docs, 40)
    assert model.langs == ["en", "fr"]
    assert langid.predictions(model, pa.array([by["en"][3000:6000], by["fr"][6000:9000]]))[0] == ["en", "fr"]


def test_rows_beyond_the_starting_sample_are_learned(spark):
    """Words that only rows outside the sample hold are told apart, and are in the lexicon."""
    rng = np.random.default_rng(5)
    words = {(lang, part): ["".join(rng.choice(list(signs), 5)) for _ in range(12)] for (lang, part), signs in {("en", 0): "abcde", ("fr", 0): "vwxyz", ("en", 1): "klm", ("fr", 1): "opq"}.items()}
    ids = [r.id for r in spark.range(600).where(~langid.is_held_out(F.col("id"))).orderBy(F.xxhash64("id"), "id").collect()]
    data = [(x, " ".join(rng.choice(words[lang, int(i >= 40)], 30)), lang) for i, x in enumerate(ids) for lang in [("en", "fr")[i % 2]]]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = langid.fit(docs, 40)
    assert langid.predictions(model, pa.array([" ".join(words["en", 1]), " ".join(words["fr", 1]), " ".join(words["fr", 0])]))[0] == ["en", "fr", "fr"]
    keys = langid.featured(*langid.text_buffers(pa.array([" ".join(words["en", 1])]))).key
    assert (model.entry(keys) < len(model.lexicon)).all()


def test_sureness_is_measured_on_all_rows(spark):
    sure = np.random.default_rng(6).random(999)
    got = langid.median_sure(spark.createDataFrame([(float(x),) for x in [*sure, 0, 0]], "s double"))
    assert abs(got - np.median(sure)) < 1e-4
