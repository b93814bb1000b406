"""Small cases of what larger tables and a cluster showed."""

import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodestone.functions.vectors import Metric
from lodestone.operators import cluster, evaluate, index, quantize, search
from lodestone.operators.index import Part
from lodestone.sources import files


def random_rows(spark, n, d, seed=0):
    m = np.random.default_rng(seed).normal(size=(n, d)).astype(np.float32)
    return m, spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, vec array<float>")


def table_of(folder, vectors):
    """A folder with the table ``embeddings``."""
    n = len(vectors)
    columns = [pa.array(np.arange(n)), pa.array([v.tolist() for v in vectors], pa.list_(pa.float32())), pa.array((np.arange(n) % 10).astype(np.int32))]
    pq.write_table(pa.table(columns, ["vec_id", "embedding", "label"]), f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.mark.parametrize("kind", ["fvecs", "bin"])
def test_vector_file_in_a_new_folder(spark, tmp_path, kind):
    m, rows = random_rows(spark, 20, 3)
    path = f"{tmp_path}/new/folder/x.{kind}"
    files.write_vectors(rows, path, kind)
    assert files.probe(path) == (3, 20)
    got = {r.id: r.vec for r in files.read_vectors(spark, path).collect()}
    assert np.array_equal(np.array([got[i] for i in range(20)], np.float32), m)


@pytest.mark.parametrize("name", ["ivecs_round_trip", "bvecs_round_trip"])
def test_whole_numbers_of_single_precision(spark, tmp_path, name):
    """0.015 and 0.145 as floats lie beside the whole number that their single-precision product is."""
    steps = np.arange(64 * 60, dtype=np.float64).reshape(60, 64) / 1000
    sf = table_of(tmp_path, (steps % 1.0).astype(np.float32))
    assert compare(spark, connect(sf), sf, entry.queries()[name], entry.oracle_sql()[name]) == 60


def test_nearest_keeps_k_distances_and_no_more():
    rng, seen, all_ = np.random.default_rng(1), search.Nearest(3), []
    for _ in range(5):
        d = np.round(rng.random((4, 500)), 2)
        d[0, :490] = np.nan
        mark = seen(0, d)
        all_.append(d)
        last = np.sort(np.concatenate(all_, 1), 1)[:, 2:3]
        assert not mark[np.isnan(d)].any()
        assert (mark == (d <= last + 1e-9)).all()
    held = seen.best[0] if seen.best[0].base is None else seen.best[0].base
    assert held.size == 12


def peak(run) -> float:
    """MB that numpy held at most while a function ran, beyond what it held before."""
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_many_queries_of_a_task_are_bounded(spark, monkeypatch):
    """A task's memory doesn't grow with queries times rows."""
    m, rows = random_rows(spark, 4000, 4)
    ids, q = np.arange(6000), np.random.default_rng(2).normal(size=(6000, 4))
    taken = []
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, f, schema, *a: taken.append(f) or self.sparkSession.createDataFrame([], schema))
    for module in (search, quantize, cluster):
        monkeypatch.setattr(module, "query_blocks", lambda _: iter([(ids, q)]))
    book, offsets = [m[:16, :2].astype(float), m[:16, 2:].astype(float)], [0, 2, 4]
    pivots = rows.where("id < 2").select(F.col("id").alias("shard"), F.col("vec").cast("array<double>").alias("vec"))
    search.knn(rows, rows, 10)
    quantize.adc_knn(rows.select("id", F.array().cast("array<int>").alias("code")), rows, book, offsets, 10)
    quantize.spherical_knn(rows.select("id", F.array().cast("array<int>").alias("code"), F.lit(1.0).alias("norm"), F.lit(1.0).alias("scale")), rows, np.zeros(4), 4, 10)
    cluster.probe(rows.withColumn("shard", F.lit(0)), pivots, rows, 10, 2)
    vec = pa.array(m.tolist(), pa.list_(pa.float32()))
    code = pa.array(np.minimum(np.abs(m) * 4, 15).astype(np.int32).tolist(), pa.list_(pa.int32()))
    own, one, zero = pa.array(np.arange(4000)), pa.array(np.ones(4000)), pa.array(np.zeros(4000, np.int64))
    batches = [[own, vec, one, zero], [own, pa.array(np.minimum(np.abs(m[:, :2]) * 4, 15).astype(np.int32).tolist(), pa.list_(pa.int32()))], [own, code, one, one], [own, vec, zero]]
    assert len(taken) == 4
    for run, columns in zip(taken, batches):
        batch = pa.RecordBatch.from_arrays(columns, [str(i) for i in range(len(columns))])
        assert peak(lambda: [None for _ in run(iter([batch, batch]))]) < 100, run.__qualname__  # the whole matrix has 192 MB


def part_of(n, dim, **options):
    rng = np.random.default_rng(5)
    return Part(Metric.L2, 8, **options).insert(np.arange(n), rng.normal(size=(n, dim)).astype(np.float32).astype(float)), rng


@pytest.mark.parametrize("layered", [True, False])
@pytest.mark.parametrize("length, width, opens", [(60, 1, None), (60, 3, None), (60, 2, 7), (600, 1, None), (700, 1, None)])
def test_walk_by_ranks_is_the_walk(monkeypatch, layered, length, width, opens):
    p, rng = part_of(600, 6, layered=layered)
    q = rng.normal(size=(40, 6))
    seeds = np.array([3, 99])
    by_rank = p.walk(q, length, width, opens, seeds)
    traces = [[], []]
    p.walk(q, length, width, opens, seeds, trace=traces[0])
    monkeypatch.setattr(index, "MOST_SEEN", 0)
    merged = p.walk(q, length, width, opens, seeds)
    p.walk(q, length, width, opens, seeds, trace=traces[1])
    assert (by_rank[0] == merged[0]).all() and (by_rank[2] == merged[2]).all() and (by_rank[3] == merged[3]).all()
    assert np.allclose(by_rank[1], merged[1])
    assert sorted(t[:3] for t in traces[0]) == sorted(t[:3] for t in traces[1])


def test_walk_that_lists_every_row_of_a_torn_graph(monkeypatch):
    """Rows that others don't reach, or that don't reach others, are found from where they are reached only."""
    p, rng = part_of(200, 4, layered=False)
    p.links[0][:] = np.where(np.arange(200)[:, None] < 100, np.where(p.links[0] < 100, p.links[0], -1), p.links[0])
    p.links[0][7] = -1
    q, p.mutual = rng.normal(size=(9, 4)), None
    for seeds in (None, np.array([7]), np.array([150])):
        monkeypatch.setattr(index, "MOST_SEEN", 16)
        one = p.walk(q, 300, seeds=seeds)
        monkeypatch.setattr(index, "MOST_SEEN", 0)
        two = p.walk(q, 300, seeds=seeds)
        assert all((a == b).all() for a, b in zip((one[0], *one[2:]), (two[0], *two[2:])))


def test_walk_of_many_queries_that_lists_every_row_is_quick():
    """1,000 openings of 256 queries each with a merge took some 15 s."""
    p, rng = part_of(1000, 16)
    began = time.process_time()
    p.walk(rng.normal(size=(256, 16)), 2000)
    assert time.process_time() - began < 3


@pytest.mark.parametrize("method", ["one_hop", "two_hop", "visited"])
def test_deletes_of_a_part_are_bounded(method):
    """Two hops of each lost link had more than 1,000 vectors at once."""
    p = Part(Metric.L2, 16).insert(np.arange(1000), np.random.default_rng(3).normal(size=(1000, 64)))
    assert peak(lambda: p.delete(np.arange(0, 1000, 5), method)) < 250
    table = p.links[0][p.at[0][np.flatnonzero(~p.dead)]]
    assert not p.dead[table[table >= 0]].any() and (table >= 0).any(1).all()


def test_nearest_centroids_are_those_by_differences():
    rng = np.random.default_rng(6)
    rows = np.concatenate((rng.normal(size=(500, 3)), np.zeros((1, 3)), np.full((1, 3), 1e6), np.full((1, 3), np.nan)))
    c = np.concatenate((rng.normal(size=(20, 3)), -np.eye(3), np.eye(3)))
    c[9] = c[4] + 1e-9
    d = np.stack([((rows - x) ** 2).sum(1) for x in c], 1)
    assert (quantize.nearest_rows(rows, c) == np.round(d, 12).argmin(1)).all()


def test_small_parts_are_built_by_tasks_of_their_own(spark, tmp_path):
    m, rows = random_rows(spark, 400, 4)
    built = index.GraphIndex.build(rows, f"file://{tmp_path}/index", part_rows=20)
    files_ = built.nodes.select(F.input_file_name().alias("f"), "part").groupBy("f").count()
    assert files_.count() > 8 and files_.agg(F.max("count")).first()[0] < 8


def test_depth_of_reranking_grows_with_the_rows(spark):
    """Coarse codes: eighty rows by codes hold too few of the ten nearest; the depth that is found holds most."""
    m, rows = random_rows(spark, 3000, 8, seed=8)
    book, offsets = quantize.train_codebook(m[:400].astype(float), [0, 4, 8], 8), [0, 4, 8]
    codes = quantize.encode(rows, book, offsets)
    asked = rows.where("id < 60").select(F.col("id").alias("qid"), F.col("vec").alias("query"))
    truth = search.knn(rows, asked, 10)

    def recall(multiple):
        return evaluate.recall(quantize.reranked_knn(rows, codes, asked, book, offsets, 10, multiple), truth, 10).first()[0]

    depth = quantize.rerank_depth(rows, codes, asked, book, offsets, 10)
    assert recall(8) < 0.9 <= recall(-(-depth // 10)) and depth < 3000
