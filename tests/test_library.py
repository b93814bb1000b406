import json
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import vectors as V
from lodestone.operators import cluster, evaluate, filters, generate, graph, models, mutate, quantize, search
from lodestone.operators.index import GraphIndex
from lodestone.plans.store import Spec, VectorStore, run_jobs, strategy
from lodestone.sources import files, labels
from lodestone.streaming import ingest, runbook


def frame(spark, rows, schema="id long, vec array<float>"):
    return spark.createDataFrame(rows, schema)


def random_rows(spark, n, d, seed=0):
    m = np.random.default_rng(seed).normal(size=(n, d)).astype(np.float32)
    return m, frame(spark, [(i, [float(x) for x in v]) for i, v in enumerate(m)])


# --- metrics ---------------------------------------------------------------------


def test_metric_names():
    assert V.Metric.parse("InnerProduct") is V.Metric.INNER_PRODUCT
    with pytest.raises(ValueError):
        V.Metric.parse("manhattan")


@pytest.mark.parametrize("metric", ["l2", "full_l2", "innerproduct", "cosine", "cosinenormalized"])
def test_knn_is_brute_force(spark, metric):
    m, base = random_rows(spark, 300, 12)
    q = base.where("id < 5").select(F.col("id").alias("qid"), F.col("vec").alias("query"))
    got = search.knn(base, q, 7, metric).collect()
    x = m.astype(float)
    for i in range(5):
        g, n = x - x[i], np.linalg.norm(x, axis=1)
        d = {"l2": (g**2).sum(1), "full_l2": np.sqrt((g**2).sum(1)), "innerproduct": -x @ x[i], "cosine": 1 - x @ x[i] / (n * n[i]), "cosinenormalized": 1 - x @ x[i]}[metric]
        want = sorted((round(float(d[j]), 6), j) for j in range(300))[:7]
        assert [r.id for r in sorted((r for r in got if r.qid == i), key=lambda r: r["rank"])] == [j for _, j in want]


def test_cosine_of_zero_and_nan_rows(spark):
    base = frame(spark, [(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [float("nan"), 1.0]), (3, [-1.0, 0.0]), (4, None)])
    q = spark.createDataFrame([(9, [1.0, 0.0])], "qid long, query array<double>")
    assert {r.id: r.distance for r in search.knn(base, q, 10, "cosine").collect()} == {1: 0.0, 3: 2.0}


def test_query_blocks_give_the_same(spark, monkeypatch):
    _, base = random_rows(spark, 200, 8)
    q = base.where("id < 20").select(F.col("id").alias("qid"), F.col("vec").alias("query"))
    whole = sorted(map(tuple, search.knn(base, q, 5).collect()))
    monkeypatch.setattr(search, "QUERY_BYTES", 200)
    assert sorted(map(tuple, search.knn(base, q, 5).collect())) == whole


def test_ties_go_to_the_smaller_id(spark):
    base = frame(spark, [(i, [float(i % 3), 0.0]) for i in range(30)])
    q = spark.createDataFrame([(0, [0.0, 0.0])], "qid long, query array<double>")
    assert [r.id for r in search.knn(base, q, 4).orderBy("rank").collect()] == [0, 3, 6, 9]


def test_lattice_corner(spark):
    q = spark.createDataFrame([(0, [-1.0, -1.0, -1.0])], "qid long, query array<double>")
    got = search.knn(generate.lattice(spark, 3, 5), q, 10).orderBy("rank").collect()
    assert [r.distance for r in got] == [3, 6, 6, 6, 9, 9, 9, 11, 11, 11]


def test_range_rejects_bad_radii(spark):
    _, base = random_rows(spark, 10, 4)
    with pytest.raises(ValueError):
        search.range_search(base, base.select(F.col("id").alias("qid"), F.col("vec").alias("query")), 1.0, 2.0)


def test_no_queries(spark):
    _, base = random_rows(spark, 10, 4)
    assert search.knn(base, spark.createDataFrame([], "qid long, query array<double>"), 3).count() == 0


# --- filters ----------------------------------------------------------------------


@pytest.mark.parametrize("bad", ["{}", '{"$and": []}', '{"a": {"$in": [1]}}', '{"a": 3}', '{"$x": 1}', '{"a": {"$lt": "5"}}', '{"a": {"$lt": true}}', '{"$and": [{"$or": [{"$not": {"a": {"$eq": 1}}}]}]}'])
def test_filter_errors(bad):
    with pytest.raises(filters.FilterError):
        filters.parse_filter(bad)


def test_filter_types(spark):
    docs = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate([{"v": 1}, {"v": 1.0}, {"v": "1"}, {"v": True}, {"v": None}, {"v": [1]}, {}])], "doc_id long, j string")

    def ids(f):
        return sorted(r.doc_id for r in docs.where(filters.json_filter(f, F.parse_json("j"))).collect())

    assert ids({"v": {"$eq": 1}}) == [0]
    assert ids({"v": {"$eq": "1"}}) == [2]
    assert ids({"v": {"$eq": None}}) == [4]
    assert ids({"v": {"$eq": [1]}}) == [5]
    assert ids({"v": {"$ne": 1}}) == [1, 2, 3, 4, 5]
    assert ids({"v": {"$gte": 1}}) == [0, 1]
    assert ids({"$not": {"v": {"$gte": 1}}}) == [2, 3, 4, 5, 6]
    assert ids({"V": {"$eq": 1}}) == []
    assert [r.doc_id for r in docs.where(filters.json_filter({"V": {"$eq": 1}}, F.parse_json("j"), str.lower)).collect()] == [0]


def test_show_tree():
    assert filters.show(filters.parse_filter('{"a": {"$gt": 1}, "$not": {"b": {"$eq": "x"}}}')) == 'AND\n  a gt 1\n  NOT\n    b eq "x"'


def test_flatten_nested(spark):
    docs = spark.createDataFrame([(1, '{"a": {"b": [1, "x"]}, "c": null, "d": 2.5}')], "doc_id long, j string")
    got = {(r.path, r.kind, r.value) for r in filters.flatten_json(docs, "doc_id", F.parse_json("j"), "/").collect()}
    assert got == {("a/b/0", "int", "1"), ("a/b/1", "string", "x"), ("c", "null", None), ("d", "real", "2.5")}


# --- evaluation ---------------------------------------------------------------------


def test_recall_counts_duplicates_once(spark):
    truth = spark.createDataFrame([(0, i, i + 1, float(i)) for i in range(4)], "qid long, id long, rank int, distance double")
    found = spark.createDataFrame([(0, 0, 1, 0.0), (0, 0, 2, 0.0), (0, 1, 3, 1.0)], "qid long, id long, rank int, distance double")
    assert evaluate.recall(found, truth, 4).first().recall == 0.5
    assert evaluate.recall_by_query(found, truth, 4).first().recall == 1.0


@pytest.mark.parametrize("n", [1, 2, 3, 10, 101])
def test_percentile_rules(spark, n):
    values = sorted(float((i * 37) % 101) for i in range(n))
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    r = evaluate.latency_summary(rows, "x").first()
    assert (r.p50, r.p95, r.p99) == tuple(values[(n - 1) * p // 100] for p in (50, 95, 99))
    assert evaluate.percentile_stats(rows, "x", 0.9).first().value == values[min(int(0.9 * n), n - 1)]
    b = evaluate.benchmark_percentiles(rows, "x").first()
    assert (b.median, b.p90, b.p99, b.minimum) == ((values[(n - 1) // 2] + values[n // 2]) / 2, values[min(9 * n // 10, n - 1)], values[min(99 * n // 100, n - 1)], values[0])


def test_compare_runs_zero_before(spark):
    a, b = (spark.createDataFrame(r, "metric string, value double") for r in ([("x", 0.0), ("y", 2.0)], [("x", 1.0), ("y", 1.0)]))
    got = {r.metric: r for r in evaluate.compare_runs(a, b, {"x": 0.1, "y": 0.0}).collect()}
    assert math.isinf(got["x"].change) and not got["x"].passes and got["y"].change == -0.5 and got["y"].passes


# --- codes ----------------------------------------------------------------------------


def test_half_way_codes_round_away(spark):
    row = spark.createDataFrame([(0, [0.5, 1.5, 2.5])], "id long, vec array<double>")
    assert row.select(quantize.scalar_codes(F.col("vec"), [0.0] * 3, 1.0).alias("c")).first().c == [1, 2, 3]


def test_constant_vector_and_nan(spark):
    rows = spark.createDataFrame([(0, [2.0, 2.0]), (1, [float("nan"), 1.0])], "id long, vec array<double>")
    p = quantize.minmax_parameters(F.col("vec"), 8)
    got = rows.select("id", p.alias("p"), quantize.minmax_codes(F.col("vec"), 8, p).alias("c")).orderBy("id").collect()
    assert got[0].p.step == pytest.approx(1e-8 / 255) and got[0].c == [0, 0] and got[1].c is None


def test_zero_gives_bit_zero(spark):
    rows = spark.createDataFrame([(0, [0.0, -1.0, 1.0])], "id long, vec array<double>")
    assert rows.select(V.sign_words(F.col("vec"), 3).alias("w")).first().w == [4]


def test_chunk_offsets():
    assert quantize.chunk_offsets(8, 3) == [0, 3, 6, 8]


def test_product_codes_find_neighbours(spark):
    rng = np.random.default_rng(7)
    centres = rng.uniform(-1, 1, (40, 64))
    m = (centres[rng.integers(0, 40, 1500)] + rng.normal(0, 0.1, (1500, 64))).astype(np.float32)
    base = frame(spark, [(i, v.tolist()) for i, v in enumerate(m)])
    q = base.where("id < 20").select(F.col("id").alias("qid"), F.col("vec").alias("query"))
    offsets = quantize.chunk_offsets(64, 8)
    book = quantize.train_codebook(m.astype(float), offsets, 64, 8)
    codes = quantize.encode(base, book, offsets).cache()
    truth = search.knn(base, q, 10).cache()
    assert evaluate.recall(quantize.reranked_knn(base, codes, q, book, offsets, 10, 10), truth, 10).first().recall > 0.8


def test_rotations_keep_distances():
    m = np.random.default_rng(1).normal(size=(5, 12))
    for x in (m @ quantize.rotation(12).T, quantize.hadamard(m)):
        assert np.allclose((x**2).sum(1), (m**2).sum(1))


# --- graphs and partitions ---------------------------------------------------------------


def test_layered_graph_recall(spark, tmp_path):
    m = np.zeros((512, 32), np.float32)
    m[:, 0], m[:, 1] = 0.01 * np.arange(512), np.arange(512) % 7
    base = frame(spark, [(i, v.tolist()) for i, v in enumerate(m)])
    q = base.where("id < 50").select(F.col("id").alias("qid"), F.col("vec").alias("query"))
    index = GraphIndex.build(base, f"file://{tmp_path}/index", part_rows=256)
    got = GraphIndex.open(spark, index.path, 32).search(q, 10, 64)
    assert evaluate.recall(got, search.knn(base, q, 10), 10).first().recall >= 0.95
    nothing = q.limit(0)
    assert index.search(nothing, 10).count() == index.recorded(nothing).count() == index.costs(nothing).count() == 0
    with pytest.raises(ValueError, match="dimensions"):
        GraphIndex.open(spark, index.path, 31)
    with pytest.raises(ValueError, match="below k"):
        index.search(q, 10, 5)


def test_graph_of_awkward_rows(spark, tmp_path):
    """Repeated vectors, a zero vector, a null one, one row only, and no rows."""
    rows = [(i, [1.0, 2.0]) for i in range(40)] + [(50, [0.0, 0.0]), (51, None), (52, [5.0, 5.0])]
    q = spark.createDataFrame([(0, [1.0, 2.0]), (1, [4.0, 5.0]), (2, None), (3, [1.0])], "qid long, query array<double>")
    for metric in ("l2", "cosine", "innerproduct"):
        index = GraphIndex.build(frame(spark, rows), f"file://{tmp_path}/{metric}", metric)
        got = index.search(q, 1, 60).collect()
        want = search.knn(frame(spark, rows), q.where("qid < 2"), 1, metric).collect()
        assert sorted(r.qid for r in got) == sorted(r.qid for r in want) == [0, 1]
        assert [r.distance for r in sorted(got)] == pytest.approx([r.distance for r in sorted(want)], abs=1e-5)
    for n in (0, 1):
        index = GraphIndex.build(frame(spark, [(7, [1.0, 2.0])]).limit(n), f"file://{tmp_path}/n{n}")
        assert index.search(q, 5).count() == 2 * n


def test_graph_prune_is_the_one_row_rule():
    from lodestone.operators import index

    r = np.random.default_rng(3)
    v = r.normal(size=(60, 4))
    for _ in range(20):
        centre = int(r.integers(60))
        c = np.setdiff1d(r.choice(60, 25, replace=False), [centre])
        d = ((v[c] - v[centre]) ** 2).sum(1)
        order = np.lexsort((c, np.round(d, 9)))
        got = index.thinned(v, c[order][None], d[order][None], 6, 1.2)[0]
        assert got[got >= 0].tolist() == c[graph.prune_candidates(v[centre], c, v[c], 6, 1.2)].tolist()


def test_prune_drops_covered_candidates():
    v = np.array([[1.0, 0.0], [1.1, 0.0], [0.0, 1.0]])
    assert graph.prune_candidates(np.zeros(2), np.array([5, 6, 7]), v, 3, 1.2) == [0, 2]


def test_delete_leaves_no_trace(spark):
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 0)], "src long, dst long")
    gone = spark.createDataFrame([(1,)], "id long")
    assert sorted(map(tuple, graph.delete_and_repair(edges, gone).collect())) == [(0, 2), (2, 3), (3, 0)]
    assert [r.src for r in graph.touching_deleted(edges, gone).collect()] == [0]


def test_probe_with_all_shards_is_exact(spark):
    _, base = random_rows(spark, 400, 8)
    q = base.where("id < 8").select(F.col("id").alias("qid"), F.col("vec").alias("query"))
    pivots = cluster.kmeans(base, 5, 3)
    own = base.join(cluster.assign(base, pivots).select("id", "shard"), "id")
    assert sorted(map(tuple, cluster.probe(own, pivots, q, 6, 5).collect())) == sorted(map(tuple, search.knn(base, q, 6).collect()))


def test_shard_count():
    assert [cluster.shard_count(x, 10) for x in (1, 35, 45, 70)] == [3, 5, 5, 7]


def test_start_points(spark):
    base = frame(spark, [(i, [float(i)]) for i in range(5)])
    assert cluster.medoid(base).first().id == 2
    assert cluster.start_points(base, "first").first().id == 0
    assert cluster.start_points(base, "samples", 3).count() == 3


# --- files ---------------------------------------------------------------------------


@pytest.mark.parametrize("kind", ["fvecs", "bvecs", "ivecs"])
def test_vector_files_round_trip(spark, tmp_path, kind):
    rows = spark.range(50).select("id", F.array(*[(F.col("id") + d).cast("int") for d in range(4)]).cast(f"array<{files.KINDS[kind][1]}>").alias("vec"))
    path = f"{tmp_path}/x.{kind}"
    files.write_vectors(rows, path, kind)
    assert files.probe(path) == (4, 50) and files.detect_kind(path) == kind
    assert sorted(map(tuple, files.read_vectors(spark, path).collect())) == sorted(map(tuple, rows.collect()))
    assert files.read_vectors(spark, path, 7).count() == 7


def test_matrix_file_round_trip(spark, tmp_path):
    rows = spark.range(30).select("id", F.array(*[(F.col("id") * 0.5 + d).cast("float") for d in range(3)]).alias("vec"))
    path = f"{tmp_path}/x.bin"
    files.write_vectors(rows, path, "bin")
    assert files.probe(path) == (3, 30)
    assert sorted(map(tuple, files.read_vectors(spark, path).collect())) == sorted(map(tuple, rows.collect()))


def test_short_files_fail(spark, tmp_path):
    (tmp_path / "x.fvecs").write_bytes(struct.pack("<I2f", 2, 1, 2) + b"\0")
    with pytest.raises(ValueError):
        files.probe(f"{tmp_path}/x.fvecs")
    (tmp_path / "y").write_bytes(struct.pack("<I32B", 32, *range(32)))
    assert files.detect_kind(f"{tmp_path}/y") == "bvecs"


def test_truth_files(spark, tmp_path):
    (tmp_path / "t.bin").write_bytes(struct.pack("<II4I4f", 2, 2, 5, 6, 7, 8, 0.0, 1.0, 0.5, 2.0))
    assert [tuple(r) for r in files.read_truth(spark, f"{tmp_path}/t.bin").orderBy("qid", "rank").collect()] == [(0, 1, 5, 0.0), (0, 2, 6, 1.0), (1, 1, 7, 0.5), (1, 2, 8, 2.0)]
    (tmp_path / "r.bin").write_bytes(struct.pack("<II2I3I", 2, 3, 1, 2, 9, 4, 5))
    assert [tuple(r) for r in files.read_range_truth(spark, f"{tmp_path}/r.bin").orderBy("qid", "rank").collect()] == [(0, 1, 9), (1, 1, 4), (1, 2, 5)]
    (tmp_path / "m.bin").write_bytes(struct.pack("<III2f", 1, 1, 2, 1.0, 2.0))
    assert [tuple(r) for r in files.read_multivectors(spark, f"{tmp_path}/m.bin").collect()] == [(0, 0, [1.0, 2.0])]


def test_label_files(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"doc_id": 3, "a": 1}\n\n{"doc_id": 4, "a": "x"}\n')
    got = labels.read_labels(spark, f"{tmp_path}/l.jsonl")
    assert [r.doc_id for r in got.where(filters.json_filter({"a": {"$eq": "x"}}, F.col("document"))).collect()] == [4]
    (tmp_path / "q.jsonl").write_text('{"query_id": 1, "filter": {"a": {"$eq": 1}}}\n')
    assert labels.read_filters(spark, f"{tmp_path}/q.jsonl") == {1: ("cmp", "a", "$eq", 1)}
    lines = spark.createDataFrame([(0, "a=1,bad,c=x y")], "id long, line string")
    assert json.loads(labels.convert_labels(lines).first().value) == {"doc_id": 0, "a": 1, "c": "x y"}
    lines = spark.createDataFrame([(0, "a=1&c=x")], "id long, line string")
    assert json.loads(labels.convert_queries(lines).first().value) == {"query_id": 0, "filter": {"a": {"$eq": 1}, "c": {"$eq": "x"}}}


# --- changes and streams ------------------------------------------------------------------


@pytest.mark.parametrize("bad", ["t:\n  1:\n    operation: insert\n    start: 5\n    end: 5", "t:\n  0:\n    operation: fly", "t:\n  0:\n    operation: insert\n    start: 0\n    end: 3\n  2:\n    operation: search", "t:\n  0:\n    operation: delete\n    start: 0\n    end: 3", "u:\n  0:\n    operation: search"])
def test_runbook_errors(bad):
    with pytest.raises(runbook.RunbookError):
        runbook.load(bad, "t")


def test_consolidation_is_relative_to_active():
    assert not mutate.needs_consolidation(100, 20, 0.2) and mutate.needs_consolidation(100, 21, 0.2)


def test_store_sees_changes_at_once(spark, tmp_path):
    _, base = random_rows(spark, 40, 4)
    base.write.parquet(f"{tmp_path}/s")
    with VectorStore.open(spark, f"{tmp_path}/s") as s:
        s.insert(frame(spark, [(0, [9.0, 9.0, 9.0, 9.0]), (100, [1.0, 1.0, 1.0, 1.0])]))
        s.delete(spark.createDataFrame([(1,)], "id long"))
        q = spark.createDataFrame([(0, [9.0, 9.0, 9.0, 9.0])], "qid long, query array<double>")
        assert s.search(q, Spec(k=1)).first().id == 0
        assert s.card() == 40
        s.insert(frame(spark, [(1, [8.9, 9.0, 9.0, 9.0])]))
        assert [r.id for r in s.search(q, Spec(k=2)).orderBy("rank").collect()] == [0, 1]
        s.flush()
        assert s.card() == 41 and s.delta is None
    with pytest.raises(ValueError):
        Spec(k=20, length=10).checked()
    assert strategy(Spec()) == "exact" and strategy(Spec(radius=1.0)) == "exact" and strategy(Spec(mode="graph")) == "graph"
    for bad in (Spec(mode="graph", radius=1.0), Spec(mode="none")):
        with pytest.raises(ValueError):
            strategy(bad)
    with pytest.raises(ValueError, match="no stored graph"):
        s.search(q, Spec(mode="graph"))


def test_store_modes_honour_metric_and_page(spark, tmp_path):
    _, base = random_rows(spark, 60, 4)
    base.write.parquet(f"{tmp_path}/m")
    q = base.where("id < 3").select(F.col("id").alias("qid"), F.col("vec").alias("query"))
    s = VectorStore.open(spark, f"{tmp_path}/m")
    s.build_graph("cosine")
    s.build_partitions(4, metric="cosine")
    s.build_codes(4)
    want = sorted(map(tuple, s.search(q, Spec(k=5, metric="cosine", page=2)).collect()))
    assert len(want) == 15
    for mode, more in (("graph", {}), ("partitions", {"probes": 4}), ("codes", {"multiple": 12})):
        assert sorted(map(tuple, s.search(q, Spec(k=5, metric="cosine", page=2, mode=mode, **more)).collect())) == want
    with pytest.raises(ValueError, match="is for cosine"):
        s.search(q, Spec(mode="graph", metric="l2"))


def test_pending_bytes_flush(spark, tmp_path):
    _, base = random_rows(spark, 10, 4)
    base.write.parquet(f"{tmp_path}/b")
    s = VectorStore.open(spark, f"{tmp_path}/b")
    s.limit_bytes = 32
    s.insert(frame(spark, [(100, [1.0, 1.0, 1.0, 1.0])]))
    assert s.delta is not None
    s.insert(frame(spark, [(101, [1.0, 1.0, 1.0, 1.0])]))
    assert s.delta is None and s.card() == 12


def test_a_late_change_does_not_undo_a_newer_one(spark, tmp_path):
    log = "id long, seq long, op string, vec array<float>"
    live = ingest.LiveTable(spark, f"file://{tmp_path}/live")
    for n, row in enumerate([(1, 5, "insert", [1.0]), (2, 6, "insert", [2.0]), (1, 9, "delete", None), (1, 7, "insert", [7.0])]):
        live.apply(spark.createDataFrame([row], log), n)
    assert [tuple(r) for r in live.read().collect()] == [(2, [2.0])] and live.version() == 3


def test_deep_json_is_flattened(spark):
    deep = "1"
    for i in range(12):
        deep = f'{{"a{i}": {deep}}}'
    docs = spark.createDataFrame([(0, deep), (1, '[1, {"b": [{"c": [true, {"d": "x"}]}]}]'), (2, None), (3, "{}")], "doc_id long, j string")
    got = {(r.doc_id, r.path, r.kind, r.value) for r in filters.flatten_json(docs, "doc_id", F.parse_json("j")).where("value is not null").collect()}
    assert got == {(0, ".".join(f"a{i}" for i in range(11, -1, -1)), "int", "1"), (1, "0", "int", "1"), (1, "1.b.0.c.0", "bool", "true"), (1, "1.b.0.c.1.d", "string", "x")}


def test_keys_sort_as_values(spark):
    values = [("a", "int", str(x)) for x in (-(1 << 62), -5, 0, 3, 1 << 62)] + [("a", "real", str(x)) for x in (-1e300, -2.5, -1e-9, 0.0, 1e-9, 7.25, 1e300)] + [("a", "bool", "false"), ("a", "bool", "true"), ("b", "string", "x")]
    rows = spark.createDataFrame([(i, *v) for i, v in enumerate(values)], "i int, path string, kind string, value string")
    got = [(r.kind, r.i) for r in rows.withColumn("k", filters.sort_key(F.col("path"), F.col("kind"), F.col("value"))).orderBy("k").collect()]
    for kind in ("int", "real", "bool"):
        own = [i for k, i in got if k == kind]
        assert own == sorted(own)


def test_ids_are_used_again(spark):
    used = spark.createDataFrame([(0,), (2,), (5,)], "id long")
    new = spark.createDataFrame([(x,) for x in "abcde"], "name string")
    assert [r.id for r in mutate.allocate(new, used, ["name"]).orderBy("name").collect()] == [1, 3, 4, 6, 7]


def test_more_start_points(spark):
    base = frame(spark, [(i, [float(i), 2.0 * i]) for i in range(1, 9)])
    points = np.array([r.vec for r in cluster.start_points(base, "latin", 4).collect()])
    assert sorted(np.floor((points[:, 0] - 1) / 7 * 4).tolist()) == [0, 1, 2, 3]
    size = np.mean([np.hypot(i, 2 * i) for i in range(1, 9)])
    assert np.allclose([np.hypot(*r.vec) for r in cluster.start_points(base, "random", 3).collect()], size)


def test_prefetch_phases(spark):
    edges = spark.createDataFrame([(s, d, o, 0) for s in (1, 2) for o, d in enumerate((9, 3, 7, 5), 1)], "src long, dst long, ord int, layer int")
    got = models.prefetch_candidates(edges, 2, second_fan_out=3, switched=F.col("src") == 2).orderBy("src", "place").collect()
    assert [(r.src, r.dst) for r in got] == [(1, 3), (1, 9), (2, 3), (2, 7), (2, 9)]


def test_strata_hold_one_point_each(spark):
    points = np.array([r.vec for r in generate.hypercube_points(spark, 9, 2).collect()])
    assert all(sorted(np.floor(points[:, d] * 9 + 1e-6).tolist()) == list(range(9)) for d in range(2))


def test_jobs(spark, tmp_path):
    _, base = random_rows(spark, 20, 4)
    base.write.parquet(f"{tmp_path}/v")
    base.where("id < 2").select(F.col("id").alias("qid"), F.col("vec").alias("query")).write.parquet(f"{tmp_path}/q")
    out = run_jobs(spark, json.dumps({"jobs": [{"name": "a", "vectors": f"{tmp_path}/v", "queries": f"{tmp_path}/q", "spec": {"k": 3}}]}))
    assert out[0]["name"] == "a" and out[0]["qps"] > 0


def test_stream_applies_each_batch_once(spark, tmp_path):
    log = "id long, seq long, op string, vec array<float>"
    spark.createDataFrame([(1, 1, "insert", [1.0]), (2, 2, "insert", [2.0])], log).coalesce(1).write.parquet(f"{tmp_path}/in")
    table = ingest.LiveTable(spark, f"file://{tmp_path}/live")

    def drain():
        table.stream(spark.readStream.schema(log).parquet(f"{tmp_path}/in"), f"{tmp_path}/cp").awaitTermination()

    drain()
    spark.createDataFrame([(1, 3, "delete", None), (2, 4, "insert", [5.0])], log).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    drain()
    assert [tuple(r) for r in table.read().collect()] == [(2, [5.0])]
    v = table.version()
    table.apply(spark.createDataFrame([(2, 9, "delete", None)], log), v)
    assert table.read().count() == 1


def test_policy_merge():
    p = models.IoPolicy().merged('{"fan_out": 99, "cold_misses": 0, "theta": 2, "other": 1}')
    assert (p.fan_out, p.cold_misses, p.theta) == (32, 1, 1.0)
    assert json.loads(p.to_json())["fan_out"] == 32


def test_memory_budget(monkeypatch):
    assert models.ram_budget(5) == 5
    monkeypatch.setenv("LODESTONE_RAM_BYTES", "7")
    assert models.ram_budget() == 7


def test_generated_data(spark):
    assert generate.labels(spark, 20, 5, "one_per_point").where("labels between '1' and '5'").count() == 20
    assert generate.labels(spark, 20, 3).where("labels like '%1%'").count() == 20
    assert generate.payload_range(spark, 258, 259).first().payload == b"\x02\x01\x00\x00"
    assert all(abs(math.fsum(x * x for x in r.vec) - 4) < 1e-5 for r in generate.on_sphere(spark, 5, 6, 2.0).collect())
    assert len({r.vec[0] // 0.1 for r in generate.hypercube_points(spark, 10, 2).collect()}) == 10


def test_ladder_keeps_at_least_what_one_step_keeps():
    rng = np.random.default_rng(3)
    v = rng.normal(size=(40, 4))
    ids = np.arange(40)
    kept = graph.ladder_prune(np.zeros(4), ids, v, 8)
    assert kept[0] == int((v**2).sum(1).argmin()) and len(set(kept)) == len(kept) <= 8
    assert len(graph.ladder_prune(np.zeros(4), ids, v, 8, saturate=True)) == 8


def test_codebooks_are_saved_and_versioned(spark, tmp_path):
    m, base = random_rows(spark, 100, 8)
    offsets = quantize.chunk_offsets(8, 3)
    books = {v: quantize.train_codebook(m.astype(float), offsets, 16, 2, seed=v) for v in (0, 1)}
    for v, book in books.items():
        quantize.save_codebook(spark, book, f"{tmp_path}/b", v)
        assert all(np.allclose(x, y) for x, y in zip(book, quantize.load_codebook(spark, f"{tmp_path}/b", v, 8)))
    with pytest.raises(ValueError):
        quantize.load_codebook(spark, f"{tmp_path}/b", 0, 9)
    codes = [quantize.encode(base.where(F.col("id") % 2 == v), books[v], offsets).withColumn("version", F.lit(v)) for v in (0, 1)]
    q = base.where("id < 3").select(F.col("id").alias("qid"), F.col("vec").alias("query"))
    assert quantize.versioned_adc_knn(codes[0].unionByName(codes[1]), q, books, offsets, 5).count() == 15


def test_command_line(spark, tmp_path, capsys):
    from lodestone.__main__ import main

    main(["generate", f"{tmp_path}/v", "--rows", "60", "--dim", "5"])
    main(["export", f"{tmp_path}/v", f"{tmp_path}/v.fvecs"])
    main(["probe", f"{tmp_path}/v.fvecs"])
    main(["import", f"{tmp_path}/v.fvecs", f"{tmp_path}/w"])
    main(["truth", f"{tmp_path}/w", f"{tmp_path}/w", f"{tmp_path}/t", "--k", "3"])
    main(["build", f"{tmp_path}/w", f"{tmp_path}/w.graph", "--m", "8"])
    main(["evaluate", f"{tmp_path}/w", f"{tmp_path}/w", f"{tmp_path}/t", "--k", "3", "--spec", '{"mode": "graph"}'])
    lines = [json.loads(x) for x in capsys.readouterr().out.strip().splitlines()]
    assert lines[0] == {"kind": "fvecs", "dimensions": 5, "rows": 60} and lines[1]["rows"] == 60 and lines[2]["recall"] > 0.95
    spark.createDataFrame([(3, 1), (1, 2)], "src long, dst long").write.parquet(f"{tmp_path}/e")
    main(["reorder", f"{tmp_path}/e", f"{tmp_path}/r", "--start", "3"])
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/r").collect())) == [(0, 1), (1, 2)]


def test_reachable_walks_to_the_end(spark):
    chain = spark.range(120).selectExpr("id as src", "id + 1 as dst")
    got = graph.reachable(chain, spark.createDataFrame([(0,)], "id long")).collect()
    assert sorted((r.id, r.level) for r in got) == [(i, i) for i in range(121)]


def test_pruning_and_order_cover_the_whole_table(spark):
    from lodestone.plans import catalogue

    ids = {r.id for r in catalogue.base(spark, "/root/testdata/sf0.001").select("id").collect()}
    assert len(ids) > 200
    assert {r.src for r in catalogue.robust_prune(spark, "/root/testdata/sf0.001").collect()} == ids
    assert sorted(r.id for r in catalogue.gorder_reorder(spark, "/root/testdata/sf0.001").collect()) == sorted(ids)
