"""Centroids: medoid, k-means steps, inverted-file partitions and memory-bounded shards."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.vectors import Metric, exact, l2_norm, rough, squared_l2, unit_rows
from .search import DIGITS, TILE, Nearest, knn, marked, matrix, query_blocks, top


def mean_vector(base: DataFrame) -> np.ndarray:
    """The mean; as many rows as dimensions come to the driver."""
    rows = base.select(F.posexplode(F.col("vec").cast("array<double>")).alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("m")).collect()
    return np.array([r.m for r in sorted(rows, key=lambda r: r.dim)])


def nearest_to(base: DataFrame, point) -> DataFrame:
    """(id, distance): the row nearest to a point by squared L2, the smallest id of equal ones."""
    target = F.array(*[F.lit(float(x)) for x in point])
    d = F.round(squared_l2(F.col("vec"), target), DIGITS)
    return base.select("id", d.alias("distance")).agg(F.min_by("id", F.struct("distance", "id")).alias("id"), F.min("distance").alias("distance"))


def medoid(base: DataFrame, fraction: float | None = None, seed: int = 42) -> DataFrame:
    """The row nearest to the mean, of all rows or of a hash sample of them."""
    sample = base if fraction is None else sampled(base, fraction, seed)
    return nearest_to(base, mean_vector(sample))


def sampled(base: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """Rows whose hash of (id, seed) falls in the fraction: the same rows on every run."""
    return base.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_000)) < int(min(1.0, fraction) * 1_000_000))


#: Bytes of pivots that a task may hold.
PIVOT_BYTES = 256 << 20


def pivot_block(pivots: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Shards and vectors of all pivots, in order of shard; more than PIVOT_BYTES of them are an error."""
    size = pivots.agg(F.sum(F.size("vec") * 8).alias("n")).first().n or 0
    if size > PIVOT_BYTES:
        raise ValueError(f"{size} bytes of pivots are more than {PIVOT_BYTES}")
    rows = pivots.orderBy("shard").collect()
    return np.array([r.shard for r in rows], np.int64), np.array([r.vec for r in rows], np.float64)


def nearest_pivots(m: np.ndarray, pivots: np.ndarray, nearest: int, metric: Metric) -> tuple[np.ndarray, np.ndarray]:
    """Places and distances of each row's nearest pivots, the first of equal ones first."""
    if metric is Metric.L2:
        d = np.stack([((m - c) ** 2).sum(1) for c in pivots], 1)
    else:
        d = rough(metric, m, pivots)
    order = np.argsort(np.round(d, DIGITS), axis=1, kind="stable")[:, :nearest]
    return order, np.take_along_axis(d, order, 1)


def assign(base: DataFrame, pivots: DataFrame, nearest: int = 1, metric: str | Metric = Metric.L2) -> DataFrame:
    """(id, shard, rank, distance): each row's nearest pivots (shard, vec), by id on ties.

    Pivots are broadcast; ``pivot_block`` checks their size.
    """
    metric = Metric.parse(metric)
    sent = base.sparkSession.sparkContext.broadcast(pivot_block(pivots))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, p = sent.value
        for b in batches:
            m = matrix(b.column(1))
            if not len(m) or not len(p):
                continue
            order, d = nearest_pivots(m, p, nearest, metric)
            n = order.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), n)), pa.array(shard[order].ravel()), pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(m))), pa.array(d.ravel())], ["id", "shard", "rank", "distance"])

    return base.select(F.col("id").cast("long").alias("id"), "vec").where("vec is not null").mapInArrow(run, "id long, shard long, rank int, distance double").withColumn("distance", F.round("distance", DIGITS))


def lloyd_step(base: DataFrame, pivots: DataFrame) -> DataFrame:
    """(shard, dim, x, n): new centroids after one assignment, partial sums before the shuffle; empty shards stay away."""
    own = assign(base, pivots).select("id", "shard")
    return own.join(base.select("id", F.posexplode(F.col("vec").cast("array<double>")).alias("dim", "x")), "id").groupBy("shard", "dim").agg(F.avg("x").alias("x"), F.count("*").alias("n"))


def kmeans(base: DataFrame, k: int, rounds: int = 10, seed: int = 42) -> DataFrame:
    """Pivots (shard, vec) by MLlib's k-means (parallel k-means++ start)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    model = KMeans(k=k, maxIter=rounds, seed=seed, featuresCol="f").fit(base.select(array_to_vector(F.col("vec").cast("array<double>")).alias("f")))
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    return base.sparkSession.createDataFrame(rows, "shard long, vec array<double>")


def shard_count(estimated_bytes: float, budget_bytes: float) -> int:
    """Parts for a memory budget: at least 3, odd, and enough."""
    n = max(3, math.ceil(estimated_bytes / budget_bytes))
    return n if n % 2 else n + 1


def partition_for_budget(base: DataFrame, budget_bytes: float, copies: int = 2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(pivots, assignment): shards whose largest fits the budget; two more until it does."""
    stats = base.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("d")).first()
    size = (stats.n or 0) * (stats.d or 0) * 4.0
    n = shard_count(size * copies, budget_bytes)
    while True:
        pivots = kmeans(base, n, seed=seed)
        own = assign(base, pivots, copies)
        largest = own.groupBy("shard").count().agg(F.max("count").alias("m")).first().m or 0
        if largest * (stats.d or 0) * 4.0 <= budget_bytes or n > (stats.n or 0):
            return pivots, own
        n += 2


def write_partitions(base: DataFrame, pivots: DataFrame, path: str, metric: str | Metric = Metric.L2) -> None:
    """Inverted file: vectors by shard in ``path``/shards, so a probe reads only its shards, and ``path``/pivots.

    A row's shard is found where the row is; only the write deals the rows, a shard over several tasks.
    """
    pivots.write.mode("overwrite").parquet(f"{path}/pivots")
    rows = sharded(base, pivots, metric)
    rows.repartition("shard", F.pmod(F.xxhash64("id"), F.lit(16))).write.mode("overwrite").partitionBy("shard").parquet(f"{path}/shards")


def sharded(base: DataFrame, pivots: DataFrame, metric: str | Metric = Metric.L2) -> DataFrame:
    """base (id, vec, ...) with ``shard``, that of the nearest pivot; rows without a vector are left out."""
    metric = Metric.parse(metric)
    rows = base.drop("shard").where("vec is not null")
    sent, at = base.sparkSession.sparkContext.broadcast(pivot_block(pivots)), rows.columns.index("vec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, p = sent.value
        for b in batches:
            if b.num_rows:
                order, _ = nearest_pivots(matrix(b.column(at)), p, 1, metric)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shard[order[:, 0]])], [*b.schema.names, "shard"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("shard", LongType())]))


def probe(partitions: DataFrame, pivots: DataFrame, queries: DataFrame, k: int = 10, probes: int = 3, metric: str | Metric = Metric.L2, page: int = 1) -> DataFrame:
    """Approximate nearest: only the shards of each query's nearest pivots are searched.

    Queries are broadcast in bounded blocks; in a block the queries of a shard are held together
    with it, so a row is scored for its shard's queries alone, and shards that no query of the block
    wants aren't read (``shard`` is a folder of stored partitions). Empty queries have no results.
    """
    spark, metric = partitions.sparkSession, Metric.parse(metric)
    shards, centers = pivot_block(pivots)
    most = k * page
    out = spark.createDataFrame([], "qid long, id long, distance double")
    for qids, vectors in query_blocks(queries):
        order, _ = nearest_pivots(vectors, centers, probes, metric)
        wanted = {int(shards[s]): np.flatnonzero((order == s).any(1)) for s in np.unique(order)}
        sent = spark.sparkContext.broadcast((qids, vectors, wanted))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            qids, vectors, wanted = sent.value
            keep = Nearest(most)
            for b in batches:
                own, m, shard = b.column(0).to_numpy(), matrix(b.column(1)), b.column(2).to_numpy()
                for s in np.unique(shard).tolist():
                    at = np.flatnonzero(shard == s)
                    for lo in range(0, len(wanted[s]), TILE):
                        q = wanted[s][lo : lo + TILE]
                        i, j = marked(keep((s, lo), rough(metric, vectors[q], m[at])))
                        yield pa.RecordBatch.from_arrays([pa.array(qids[q][i]), pa.array(own[at][j]), pa.array(exact(metric, vectors[q][i], m[at][j]))], ["qid", "id", "distance"])

        hit = partitions.where(F.col("shard").isin(list(wanted))).select(F.col("id").cast("long").alias("id"), "vec", F.col("shard").cast("long").alias("shard"))
        out = out.unionByName(hit.mapInArrow(run, "qid long, id long, distance double").where(~F.isnan("distance")))
    pairs = out.withColumn("distance", F.round("distance", DIGITS) + F.lit(0.0)).distinct()
    return top(pairs, most).where(F.col("rank") > k * (page - 1)).select("qid", "id", "rank", "distance")


def start_points(base: DataFrame, strategy: str = "medoid", n: int = 1, seed: int = 42) -> DataFrame:
    """Rows to start walks from: medoid, first, or seeded samples (id); or points (id, vec) that aren't rows:
    ``random`` ones of the rows' mean norm, or a ``latin`` hypercube over the rows' ranges, one point in each of n
    slices of every dimension."""
    if strategy in ("random", "latin"):
        rng = np.random.default_rng(seed)
        dims = base.select(F.posexplode(F.col("vec").cast("array<double>")).alias("dim", "x")).groupBy("dim").agg(F.min("x").alias("low"), F.max("x").alias("high")).orderBy("dim").collect()
        low, high = (np.array([r[c] for r in dims], float) for c in ("low", "high"))
        if strategy == "latin":
            cell = np.stack([rng.permutation(n) for _ in dims], 1) if dims else np.zeros((n, 0))
            points = low + (high - low) * (cell + rng.random(cell.shape)) / n
        else:
            size = base.agg(F.avg(l2_norm(F.col("vec"))).alias("n")).first().n or 0.0
            points = unit_rows(rng.normal(size=(n, len(dims)))) * size
        return base.sparkSession.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id long, vec array<double>")
    if strategy == "medoid":
        return medoid(base).select("id")
    if strategy == "first":
        return base.agg(F.min("id").alias("id"))
    if strategy == "samples":
        return base.select("id").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(n)
    raise ValueError(f"unknown strategy: {strategy!r}")


def relative_contrast(base: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """One row: mean over queries of (mean squared distance to all) / (mean to the k nearest, the query itself left out).

    The mean to all needs no pairs: it is |q - m|^2 plus the total variance.
    """
    m = mean_vector(base)
    spread = base.select(F.posexplode(F.col("vec").cast("array<double>")).alias("dim", "x")).groupBy("dim").agg(F.var_pop("x").alias("v")).agg(F.sum("v").alias("v")).first().v
    target = F.array(*[F.lit(float(x)) for x in m])
    near = knn(base, queries, k, exclude_self=True).groupBy("qid").agg(F.avg("distance").alias("near"))
    far = queries.select("qid", (squared_l2(F.col("query"), target) + F.lit(spread)).alias("far"))
    return far.join(near, "qid").agg(F.avg(F.col("far") / F.col("near")).alias("contrast"))
