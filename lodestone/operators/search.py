"""Exact searches of a query set against all vectors.

Queries are held in blocks of a fixed size and broadcast block by block; every Arrow batch
of vectors is scored by one matrix product, keeps what can be in a result, and only
that is shuffled. A final window by query merges the parts. Vectors are never shuffled,
and no pairs are made as rows.

Results are ordered by (distance rounded to DIGITS, id), so they don't depend on the order of sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import Metric, exact, rough

DIGITS = 6
#: Bytes of query vectors that are broadcast at once.
QUERY_BYTES = 32 << 20
#: Queries whose distances to a batch of rows are held at once.
TILE = 256
#: How far apart the matrix product and the exact distance may be, relative to the vectors' scale.
SLACK = 1e-6


def matrix(col: pa.Array) -> np.ndarray:
    """A list column of one dimension as a double matrix."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if not len(col):
        return np.zeros((0, 0))
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1)


def marked(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of what is true; by flat places, which is much faster than ``np.nonzero`` where little is."""
    return np.divmod(np.flatnonzero(mask), max(1, mask.shape[1]))


def query_blocks(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) in blocks of about QUERY_BYTES; a block is on the driver until it is broadcast."""
    queries = queries.select(F.col("qid").cast("long").alias("qid"), F.col("query").cast("array<double>").alias("query")).where("query is not null")
    size = queries.agg(F.sum(F.size("query") * 8).alias("n")).first().n or 0
    blocks = 1 + size // QUERY_BYTES
    for b in range(blocks):
        got = queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).collect()
        if got:
            yield np.array([r.qid for r in got], np.int64), np.array([r.query for r in got], np.float64)


def scored(base: DataFrame, queries: DataFrame, metric: str | Metric, marker, factor: Column | None = None, group: Column | None = None, exclude_self: bool = False) -> DataFrame:
    """(qid, id, distance, grp) of all pairs that are marked in each batch.

    ``marker()`` makes a task's own function (query block, distances, groups) -> marks.

    base: (id, vec); queries: (qid, query). ``factor`` multiplies a row's distances.
    NaN distances are in no result. Null vectors and vectors of another dimension are skipped.
    """
    metric = Metric.parse(metric)
    spark = base.sparkSession
    rows = base.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<float>").alias("vec") if dict(base.dtypes)["vec"] == "array<float>" else F.col("vec").cast("array<double>").alias("vec"), (factor if factor is not None else F.lit(1.0)).cast("double").alias("factor"), (group if group is not None else F.lit(0)).cast("long").alias("grp")).where("vec is not null")
    out = None
    for ids, vectors in query_blocks(queries):
        sent = spark.sparkContext.broadcast((ids, vectors))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            qids, q = sent.value
            keep = marker()
            for b in batches:
                b = b.filter(pa.compute.equal(pa.compute.list_value_length(b.column(1)), q.shape[1])) if b.num_rows else b
                if not b.num_rows:
                    continue
                own, m = b.column(0).to_numpy(), matrix(b.column(1))
                f, g = b.column(2).to_numpy(), b.column(3).to_numpy(zero_copy_only=False)
                for lo in range(0, len(q), TILE):
                    d = rough(metric, q[lo : lo + TILE], m) * f
                    if exclude_self:
                        same = np.flatnonzero(np.isin(own, qids[lo : lo + TILE]))
                        i, j = np.nonzero(qids[lo : lo + TILE, None] == own[same])
                        d[i, same[j]] = np.nan
                    i, j = marked(keep(lo, d, g))
                    real = ~np.isnan(d[i, j])
                    i, j = i[real], j[real]
                    if len(i):
                        real = exact(metric, q[lo + i], m[j]) * f[j]
                        yield pa.RecordBatch.from_arrays([pa.array(qids[lo + i]), pa.array(own[j]), pa.array(real), pa.array(g[j].astype(np.int64))], ["qid", "id", "distance", "grp"])

        part = rows.mapInArrow(run, "qid long, id long, distance double, grp long")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "qid long, id long, distance double, grp long")
    return out.withColumn("distance", F.round("distance", DIGITS) + F.lit(0.0))


class Nearest:
    """Marks what may be among each query's k nearest, given all that a task has seen so far.

    Holds k distances for each query (and group), and nothing else of what it has seen, so a task
    sends about k (1 + ln of its batches) rows for a query, not k for each batch. All that may tie
    with the last are marked; NaN never is.
    """

    def __init__(self, k: int):
        self.k, self.best = k, {}

    def __call__(self, key, d: np.ndarray) -> np.ndarray:
        """d: queries x rows; key: of the queries (and group) that the rows of d are for."""
        if key not in self.best:
            self.best[key] = np.full((len(d), self.k), np.inf)
            self._add(key, np.where(np.isnan(d), np.inf, d))
            i, j = marked(d <= self._limit(key)[:, None])
        else:
            i, j = marked(d <= self._limit(key)[:, None])
            if len(i):
                number = np.bincount(i, minlength=len(d))
                some = np.full((len(d), number.max()), np.inf)
                some[i, np.arange(len(i)) - (np.cumsum(number) - number)[i]] = d[i, j]
                self._add(key, some)
        near = d[i, j] <= self._limit(key)[i]
        mark = np.zeros(d.shape, bool)
        mark[i[near], j[near]] = True
        return mark

    def _add(self, key, d: np.ndarray) -> None:
        both = np.concatenate((self.best[key], d), 1)
        # A slice alone would keep the whole array alive.
        self.best[key] = np.partition(both, self.k - 1, axis=1)[:, : self.k].copy()

    def _limit(self, key) -> np.ndarray:
        last = self.best[key].max(1)
        return last + 2 * 10.0**-DIGITS + SLACK * np.abs(last)


def top(pairs: DataFrame, k: int, by: str = "qid") -> DataFrame:
    """rank 1 to k by (distance, id); Spark drops the rest before the shuffle too."""
    order = Window.partitionBy(by).orderBy("distance", "id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def nearest(k: int):
    """A marker of each query's k nearest."""

    def marker():
        seen = Nearest(k)
        return lambda lo, d, _: seen(lo, d)

    return marker


def knn(base: DataFrame, queries: DataFrame, k: int = 10, metric: str | Metric = Metric.L2, factor: Column | None = None, exclude_self: bool = False, page: int = 1) -> DataFrame:
    """(qid, id, rank, distance): each query's k nearest; ``page`` p gives ranks (p-1)k+1 to pk, numbered from the first."""
    found = top(scored(base, queries, metric, nearest(k * page), factor, exclude_self=exclude_self), k * page)
    return found.where(F.col("rank") > k * (page - 1)).select("qid", "id", "rank", "distance")


def filtered_knn(base: DataFrame, queries: DataFrame, predicate: Column, k: int = 10, metric: str | Metric = Metric.L2) -> DataFrame:
    """Nearest of the rows that satisfy the predicate; the filter reaches the scan."""
    return knn(base.where(predicate), queries, k, metric)


def beta_knn(base: DataFrame, queries: DataFrame, predicate: Column, k: int = 10, beta: float = 0.5, metric: str | Metric = Metric.L2, final_filter: bool = False, length: int | None = None) -> DataFrame:
    """Rows that match have their distance multiplied by beta; all stay eligible.

    With ``final_filter`` the best ``length`` (at least k) are taken first and those that
    don't match dropped; distances stay the multiplied ones. Under the inner product,
    distances are negative, so a beta below 1 puts matches behind.
    """
    match = F.coalesce(predicate, F.lit(False))
    if not final_filter:
        return knn(base, queries, k, metric, F.when(match, F.lit(beta)).otherwise(F.lit(1.0)))
    size = max(k, length or k)
    pairs = scored(base, queries, metric, nearest(size), F.when(match, F.lit(beta)).otherwise(F.lit(1.0)), match.cast("int"))
    return top(top(pairs, size).where("grp = 1").drop("rank"), k).select("qid", "id", "rank", "distance")


def range_search(base: DataFrame, queries: DataFrame, radius: float, inner: float | None = None, metric: str | Metric = Metric.L2, max_returned: int | None = None) -> DataFrame:
    """(qid, id, rank, distance) with inner < distance <= radius, nearest first."""
    if inner is not None and inner > radius:
        raise ValueError("the inner radius is beyond the radius")
    pad = 2 * 10.0**-DIGITS + SLACK * abs(radius)
    pairs = scored(base, queries, metric, lambda: lambda _, d, __: d <= radius + pad)
    pairs = pairs.where(F.col("distance") <= radius)
    if inner is not None:
        pairs = pairs.where(F.col("distance") > inner)
    order = Window.partitionBy("qid").orderBy("distance", "id")
    out = pairs.withColumn("rank", F.row_number().over(order)).select("qid", "id", "rank", "distance")
    return out if max_returned is None else out.where(F.col("rank") <= max_returned)


def diverse_knn(base: DataFrame, queries: DataFrame, attribute: Column, k: int = 10, per_value: int = 2, metric: str | Metric = Metric.L2) -> DataFrame:
    """At most per_value hits of each (integer) attribute value; rows without the attribute are left out."""

    def marker():
        seen = Nearest(per_value)

        def keep(lo: int, d: np.ndarray, g: np.ndarray) -> np.ndarray:
            out = np.zeros(d.shape, bool)
            for value in np.unique(g):
                cols = np.flatnonzero(g == value)
                out[:, cols] = seen((lo, int(value)), d[:, cols])
            return out

        return keep

    pairs = scored(base.where(attribute.isNotNull()), queries, metric, marker, group=attribute)
    inside = Window.partitionBy("qid", "grp").orderBy("distance", "id")
    some = pairs.withColumn("place", F.row_number().over(inside)).where(F.col("place") <= per_value)
    return top(some, k).select("qid", "id", F.col("grp").alias("attribute"), "rank", "distance")


def knn_by_element(base: DataFrame, ids: list[int], k: int = 10, metric: str | Metric = Metric.L2) -> DataFrame:
    """Neighbours of stored rows, themselves left out."""
    queries = base.where(F.col("id").isin(ids)).select(F.col("id").alias("qid"), F.col("vec").alias("query"))
    return knn(base, queries, k, metric, exclude_self=True)


def merge_hits(parts: list[DataFrame], k: int) -> DataFrame:
    """Several result lists as one: an id that is in more than one counts once, at its smallest distance."""
    both = parts[0].select("qid", "id", "distance")
    for p in parts[1:]:
        both = both.unionByName(p.select("qid", "id", "distance"))
    return top(both.groupBy("qid", "id").agg(F.min("distance").alias("distance")), k).select("qid", "id", "rank", "distance")


def bitmap_knn(base: DataFrame, queries: DataFrame, allowed: DataFrame, covered: int, k: int = 10, metric: str | Metric = Metric.L2) -> DataFrame:
    """Nearest among ids of ``allowed`` and all ids from ``covered`` on, which a short bitmap doesn't speak of."""
    ok = base.join(allowed.select("id").distinct().withColumn("_ok", F.lit(True)), "id", "left")
    return knn(ok.where(F.col("_ok") | (F.col("id") >= covered)).drop("_ok"), queries, k, metric)


def post_process(hits: DataFrame, *steps) -> DataFrame:
    """Steps on a result, one after the other; each takes and returns a DataFrame."""
    for step in steps:
        hits = hits.transform(step)
    return hits


def without_start_points(start_ids: list[int]):
    """A step that drops start points and numbers the ranks anew."""

    def step(hits: DataFrame) -> DataFrame:
        kept = hits.where(~F.col("id").isin(start_ids)).drop("rank")
        return kept.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("distance", "id")))

    return step


def bits_of(vec: Column) -> Column:
    """A vector's sign bits as 0.0 and 1.0, 1 where a value is above zero: squared L2 of these is the Hamming
    distance, and the inner product the number of ones in both."""
    return F.transform(vec, lambda x: F.when(x > 0, 1.0).otherwise(0.0).cast("float"))


def bit_knn(base: DataFrame, queries: DataFrame, k: int = 10, metric: str | Metric = Metric.L2) -> DataFrame:
    """Nearest by sign bits: ``l2`` is the Hamming distance, ``innerproduct`` minus the ones in both."""
    return knn(base.select("id", bits_of(F.col("vec")).alias("vec")), queries.select("qid", bits_of(F.col("query")).alias("query")), k, metric)


# --- several vectors for one document -----------------------------------------


def multivector(base: DataFrame, queries: DataFrame, how: str = "chamfer", k: int | None = None) -> DataFrame:
    """(qid, doc, distance[, rank]) of documents that are sets of vectors against queries that are.

    base: (doc, pos, vec); queries: (qid, pos, query). how: ``chamfer`` sums over the query's
    vectors the smallest minus-inner-product to the document's; ``max_sim`` keeps them by query
    vector; ``average_pairwise`` and ``min_pairwise`` are squared L2 over all pairs; ``avg_of_mins``
    averages the smallest squared L2. A batch sends one number per (query vector, document). Vectors
    of another dimension are skipped.
    """
    metric = Metric.INNER_PRODUCT if how in ("chamfer", "max_sim") else Metric.L2
    spark = base.sparkSession
    flat = queries.select(F.col("qid").cast("long").alias("owner"), F.col("pos").cast("long").alias("pos"), F.col("query"))
    rows = base.select(F.col("doc").cast("long").alias("doc"), F.col("vec").cast("array<float>").alias("vec")).where("vec is not null")
    size = flat.agg(F.sum(F.size("query") * 8).alias("n")).first().n or 0
    blocks, parts = 1 + size // QUERY_BYTES, None
    for x in range(blocks):
        got = flat.where(F.pmod(F.xxhash64("owner"), F.lit(blocks)) == x).collect()
        if not got:
            continue
        sent = spark.sparkContext.broadcast(([r.owner for r in got], [r.pos for r in got], np.array([r["query"] for r in got], np.float64)))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            owner, pos, q = sent.value
            for b in batches:
                b = b.filter(pa.compute.equal(pa.compute.list_value_length(b.column(1)), q.shape[1])) if b.num_rows else b
                if not b.num_rows:
                    continue
                doc, m = b.column(0).to_numpy(), matrix(b.column(1))
                order = np.argsort(doc, kind="stable")
                doc, m = doc[order], m[order]
                new = np.flatnonzero(np.diff(doc, prepend=doc[0] - 1))
                n = np.diff(np.append(new, len(doc)))
                for lo in range(0, len(q), TILE):
                    d = rough(metric, q[lo : lo + TILE], m)
                    low, total = np.minimum.reduceat(d, new, axis=1), np.add.reduceat(d, new, axis=1)
                    shape = low.shape
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(owner[lo : lo + TILE], shape[1]).astype(np.int64)), pa.array(np.repeat(pos[lo : lo + TILE], shape[1]).astype(np.int64)), pa.array(np.tile(doc[new], shape[0])), pa.array(low.ravel()), pa.array(total.ravel()), pa.array(np.tile(n, shape[0]).astype(np.int64))], ["qid", "qpos", "doc", "low", "total", "n"])

        part = rows.mapInArrow(run, "qid long, qpos long, doc long, low double, total double, n long")
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        parts = spark.createDataFrame([], "qid long, qpos long, doc long, low double, total double, n long")
    by_vector = parts.groupBy("qid", "qpos", "doc").agg(F.min("low").alias("low"), F.sum("total").alias("total"), F.sum("n").alias("n"))
    if how == "max_sim":
        return by_vector.select("qid", "qpos", "doc", (F.round("low", DIGITS) + F.lit(0.0)).alias("distance"))
    value = {"chamfer": F.sum("low"), "average_pairwise": F.sum("total") / F.sum("n"), "min_pairwise": F.min("low"), "avg_of_mins": F.avg("low")}[how]
    out = by_vector.groupBy("qid", "doc").agg((F.round(value, DIGITS) + F.lit(0.0)).alias("distance"))
    if k is None:
        return out
    order = Window.partitionBy("qid").orderBy("distance", "doc")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
