"""Quantizers: scalar, min-max, binary, product and spherical codes, and searches over codes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import Metric, doubles, unit_rows
from .search import DIGITS, TILE, Nearest, marked, matrix, query_blocks, top


def dimension_stats(base: DataFrame) -> DataFrame:
    """(dim, mean, variance): population figures of every dimension."""
    return base.select(F.posexplode(doubles(F.col("vec"))).alias("dim", "x")).groupBy("dim").agg(F.avg("x").alias("mean"), F.var_pop("x").alias("variance"))


def half_away(x: Column) -> Column:
    """Whole numbers, halves away from zero."""
    return F.round(x, 0)


def scalar_parameters(base: DataFrame, bits: int = 8, deviations: float = 2.0) -> tuple[list[float], float]:
    """(shift of each dimension, scale): mean - p and 2p / (2^bits - 1), p = deviations * the largest standard deviation.

    As many rows as dimensions come to the driver.
    """
    rows = sorted(dimension_stats(base).collect(), key=lambda r: r.dim)
    p = deviations * max((r.variance for r in rows), default=0.0) ** 0.5
    return [r["mean"] - p for r in rows], 2 * p / (2**bits - 1)


def scalar_codes(vec: Column, shift: list[float], scale: float, bits: int = 8) -> Column:
    """Codes of a vector: clamped to the code range, then rounded; null if a value is NaN."""
    top_ = float(2**bits - 1)
    low = F.array(*[F.lit(float(s)) for s in shift])
    codes = F.zip_with(doubles(vec), low, lambda x, s: half_away(F.greatest(F.lit(0.0), F.least(F.lit(top_), (x - s) / (scale or 1.0)))).cast("int"))
    return F.when(~F.exists(doubles(vec), F.isnan), codes)


def minmax_parameters(vec: Column, bits: int, grid: float = 1.0) -> Column:
    """struct(low, step) of a vector's own range.

    The range is the middle of least and greatest value, plus and minus half their distance
    times grid. One bit takes the mean of the values below the mean and of the others instead of
    least and greatest.
    """
    v = doubles(vec)
    if bits == 1:
        mean = F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)

        def average(part: Column) -> Column:
            return F.when(F.size(part) > 0, F.aggregate(part, F.lit(0.0), lambda s, x: s + x) / F.size(part)).otherwise(mean)

        least, most = average(F.filter(v, lambda x: x < mean)), average(F.filter(v, lambda x: x >= mean))
    else:
        least, most = F.array_min(v), F.array_max(v)
    half = (most - least) / 2
    low, high = least + half - half * grid, least + half + half * grid
    return F.struct(low.alias("low"), (F.greatest(high - low, F.lit(1e-8)) / (2**bits - 1)).alias("step"))


def minmax_codes(vec: Column, bits: int, parameters: Column) -> Column:
    """Codes of a vector; null if a value is NaN."""
    top_ = float(2**bits - 1)
    codes = F.transform(doubles(vec), lambda x: half_away(F.greatest(F.lit(0.0), F.least(F.lit(top_), (x - parameters["low"]) / parameters["step"]))).cast("int"))
    return F.when(~F.exists(doubles(vec), F.isnan), codes)


def minmax_decode(codes: Column, parameters: Column) -> Column:
    return F.transform(codes, lambda c: parameters["low"] + c * parameters["step"])


def minmax_recode(codes: Column, parameters: Column, bits: int, fewer: int) -> tuple[Column, Column]:
    """Codes of fewer bits for the same range, and their parameters."""
    ratio = (2**fewer - 1) / (2**bits - 1)
    step = parameters["step"] / F.lit(ratio)
    return F.transform(codes, lambda c: half_away(c * F.lit(ratio)).cast("int")), F.struct(parameters["low"].alias("low"), step.alias("step"))


def compensated_dot(a: Column, pa_: Column, b: Column, pb: Column) -> Column:
    """Inner product of two decoded vectors from their codes: the code product and sums, without decoding."""
    n = F.size(a)
    both = F.aggregate(F.zip_with(a, b, lambda x, y: (x * y).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    sum_a, sum_b = (F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x) for c in (a, b))
    return pa_["step"] * pb["step"] * both + pa_["low"] * pb["step"] * sum_b + pb["low"] * pa_["step"] * sum_a + n * pa_["low"] * pb["low"]


def code_sums(codes: Column) -> Column:
    """struct(total, squares) of a code, to store beside it."""
    zero = F.lit(0).cast("long")
    return F.struct(F.aggregate(codes, zero, lambda s, x: s + x).alias("total"), F.aggregate(codes, zero, lambda s, x: s + x.cast("long") * x).alias("squares"))


def compensated_norm(codes: Column, p: Column) -> Column:
    """Squared norm of a decoded vector, from its code's sums."""
    sums = code_sums(codes)
    return p["step"] * p["step"] * sums["squares"] + 2 * p["low"] * p["step"] * sums["total"] + F.size(codes) * p["low"] * p["low"]


def compensated_distance(metric: str, a: Column, pa_: Column, b: Column, pb: Column) -> Column:
    """A metric between two decoded vectors from their codes, without decoding; null for the cosine of a zero vector."""
    metric, dot = Metric.parse(metric), compensated_dot(a, pa_, b, pb)
    if metric is Metric.INNER_PRODUCT:
        return -dot
    if metric is Metric.COSINE_NORMALIZED:
        return 1 - dot
    na, nb = compensated_norm(a, pa_), compensated_norm(b, pb)
    if metric is Metric.COSINE:
        return F.when((na > 0) & (nb > 0), 1 - dot / F.sqrt(na * nb))
    squared = F.greatest(na + nb - 2 * dot, F.lit(0.0))
    return F.sqrt(squared) if metric is Metric.FULL_L2 else squared


# --- product quantization -------------------------------------------------------


def chunk_offsets(dim: int, chunks: int) -> list[int]:
    """Borders of the chunks; the first ones take what doesn't divide."""
    small, more = divmod(dim, chunks)
    return [i * small + min(i, more) for i in range(chunks + 1)]


def train_codebook(sample: np.ndarray, offsets: list[int], centroids: int = 256, rounds: int = 12, seed: int = 42, pinned: bool = False) -> list[np.ndarray]:
    """Centroids of each chunk by Lloyd's rounds over a bounded sample (rows x dimensions).

    ``pinned`` starts at the first rows instead of random ones; without rounds they are the codebook.
    An empty cluster keeps its centroid.
    """
    rng = np.random.default_rng(seed)
    out = []
    for a, z in zip(offsets[:-1], offsets[1:]):
        part = sample[:, a:z]
        k = min(centroids, len(part))
        c = part[:k].copy() if pinned else part[rng.choice(len(part), k, replace=False)].copy()
        for _ in range(rounds):
            near = nearest_rows(part, c)
            n = np.bincount(near, minlength=k)
            total = np.stack([np.bincount(near, part[:, j], minlength=k) for j in range(z - a)], 1)
            c[n > 0] = total[n > 0] / n[n > 0, None]
        out.append(c)
    return out


def nearest_rows(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row by differences, the first of equal ones.

    One product chooses; rows that it leaves open, as two centroids are about as near, are decided by differences.
    """
    size = (centroids**2).sum(1)
    d = size - 2 * (rows @ centroids.T)
    out = d.argmin(1)
    least = d[np.arange(len(d)), out]
    pad = 1e-9 * (1 + (rows**2).sum(1) + size.max(initial=0))
    open_ = np.flatnonzero(np.count_nonzero(d <= (least + pad)[:, None], axis=1) != 1)
    if len(open_):
        some = rows[open_]
        out[open_] = np.round(np.stack([np.einsum("ij,ij->i", some - c, some - c) for c in centroids], 1), 12).argmin(1)
    return out


def encode(base: DataFrame, codebook: list[np.ndarray], offsets: list[int]) -> DataFrame:
    """(id, code): the nearest centroid of every chunk. The codebook's size doesn't depend on the data."""
    sent = base.sparkSession.sparkContext.broadcast(codebook)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = matrix(b.column(1))
            codes = np.stack([nearest_rows(m[:, a:z], c) for a, z, c in zip(offsets[:-1], offsets[1:], sent.value)], 1) if len(m) else np.zeros((0, 1), int)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(codes.astype(np.int32).tolist(), pa.list_(pa.int32()))], ["id", "code"])

    return base.select(F.col("id").cast("long").alias("id"), "vec").where("vec is not null").mapInArrow(run, "id long, code array<int>")


def encode_in_batches(base: DataFrame, codebook: list[np.ndarray], offsets: list[int], path: str, batches: int = 16) -> DataFrame:
    """Codes of all rows, written batch by batch (by a hash of the id) below ``path``; a batch that is whole already is
    not made again, so a run that was ended goes on where it was."""
    spark = base.sparkSession
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for b in range(batches):
        target = f"{path}/batch={b}"
        if not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{target}/_SUCCESS")):
            encode(base.where(F.pmod(F.xxhash64("id"), F.lit(batches)) == b), codebook, offsets).write.mode("overwrite").parquet(target)
    return spark.read.parquet(path).drop("batch")


def halves(base: DataFrame) -> DataFrame:
    """(id, half): vectors as little-endian 16-bit floats, a quarter of the doubles' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.array(v, "<f2").tobytes() for v in b.column(1).to_pylist()], pa.binary())], ["id", "half"])

    return base.select(F.col("id").cast("long").alias("id"), "vec").where("vec is not null").mapInArrow(run, "id long, half binary")


def from_halves(rows: DataFrame) -> DataFrame:
    """(id, vec) of ``halves``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.frombuffer(v, "<f2").astype(np.float32) for v in b.column(1).to_pylist()], pa.list_(pa.float32()))], ["id", "vec"])

    return rows.select("id", "half").mapInArrow(run, "id long, vec array<float>")


def decode(codes: DataFrame, codebook: list[np.ndarray]) -> DataFrame:
    """(id, vec): the centroids that a code names, joined."""
    sent = codes.sparkSession.sparkContext.broadcast(codebook)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = matrix(b.column(1)).astype(int)
            vec = np.concatenate([c[m[:, i]] for i, c in enumerate(sent.value)], 1) if len(m) else np.zeros((0, 1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(vec.tolist(), pa.list_(pa.float64()))], ["id", "vec"])

    return codes.select("id", "code").mapInArrow(run, "id long, vec array<double>")


def adc_knn(codes: DataFrame, queries: DataFrame, codebook: list[np.ndarray], offsets: list[int], k: int = 10, metric: str = "l2") -> DataFrame:
    """Nearest by table lookups: a query's term with every centroid, summed over each code.

    Tables are made in the tasks, for a tile of queries at a time; only the queries are broadcast.

    The distance is the metric's between the query and the decoded vector. Products need one table;
    cosine also the centroids' squared norms; a zero vector's cosine is in no result.
    """
    spark, metric = codes.sparkSession, Metric.parse(metric)
    out = spark.createDataFrame([], "qid long, id long, distance double")
    norms = [(c**2).sum(1) for c in codebook]
    for block in query_blocks(queries):
        sent = spark.sparkContext.broadcast((*block, codebook))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            qids, vectors, book = sent.value
            keep = Nearest(k)
            for b in batches:
                if not b.num_rows:
                    continue
                own, m = b.column(0).to_numpy(), matrix(b.column(1)).astype(int)
                length = np.sqrt(sum(x[m[:, i]] for i, x in enumerate(norms)))
                for lo in range(0, len(qids), TILE):
                    q = vectors[lo : lo + TILE]
                    d = np.zeros((len(q), len(m)))
                    for x, (a, z, c) in enumerate(zip(offsets[:-1], offsets[1:], book)):
                        table = ((q[:, None, a:z] - c) ** 2).sum(2) if metric in (Metric.L2, Metric.FULL_L2) else q[:, a:z] @ c.T
                        d += table[:, m[:, x]]
                    if metric is Metric.FULL_L2:
                        d = np.sqrt(d)
                    elif metric is Metric.INNER_PRODUCT:
                        d = -d
                    elif metric is Metric.COSINE_NORMALIZED:
                        d = 1 - d
                    elif metric is Metric.COSINE:
                        both = np.sqrt((q**2).sum(1))[:, None] * length
                        d = 1 - d / np.where(both > 0, both, np.nan)
                    i, j = marked(keep(lo, d))
                    yield pa.RecordBatch.from_arrays([pa.array(qids[lo + i]), pa.array(own[j]), pa.array(d[i, j])], ["qid", "id", "distance"])

        part = codes.select("id", "code").mapInArrow(run, "qid long, id long, distance double").withColumn("distance", F.round("distance", DIGITS) + F.lit(0.0))
        out = out.unionByName(part)
    return top(out, k).select("qid", "id", "rank", "distance")


def code_distances(pairs: DataFrame, codebook: list[np.ndarray], metric: str = "l2") -> DataFrame:
    """(a, b, distance) of pairs (a, code_a, b, code_b): between the decoded vectors, by tables of centroid pairs."""
    metric = Metric.parse(metric)
    apart = [((c[:, None, :] - c[None, :, :]) ** 2).sum(2) if metric in (Metric.L2, Metric.FULL_L2) else c @ c.T for c in codebook]
    norms = [(c**2).sum(1) for c in codebook]
    sent = pairs.sparkSession.sparkContext.broadcast((apart, norms))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart, norms = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (matrix(b.column(i)).astype(int) for i in (1, 3))
            d = sum(t[x[:, i], y[:, i]] for i, t in enumerate(apart))
            if metric is Metric.FULL_L2:
                d = np.sqrt(d)
            elif metric is Metric.INNER_PRODUCT:
                d = -d
            elif metric is Metric.COSINE_NORMALIZED:
                d = 1 - d
            elif metric is Metric.COSINE:
                both = np.sqrt(sum(n[x[:, i]] for i, n in enumerate(norms)) * sum(n[y[:, i]] for i, n in enumerate(norms)))
                d = 1 - d / np.where(both > 0, both, np.nan)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(np.round(d, DIGITS) + 0.0)], ["a", "b", "distance"])

    return pairs.select(F.col("a").cast("long").alias("a"), "code_a", F.col("b").cast("long").alias("b"), "code_b").mapInArrow(run, "a long, b long, distance double")


def reranked_knn(base: DataFrame, codes: DataFrame, queries: DataFrame, codebook: list[np.ndarray], offsets: list[int], k: int = 10, multiple: int = 8, metric: str = "l2") -> DataFrame:
    """The best k * multiple by codes, ordered anew by the exact metric.

    Candidates are found by L2 tables for all metrics but the inner product, and re-ranked by the
    metric asked for. Only the candidates are joined with their vectors, by id.
    """
    from ..functions.vectors import distance

    walk = "innerproduct" if Metric.parse(metric) is Metric.INNER_PRODUCT else "l2"
    near = adc_knn(codes, queries, codebook, offsets, max(k, k * max(1, multiple)), walk).select("qid", "id")
    full = near.join(base.select(F.col("id").cast("long").alias("id"), "vec"), "id").join(queries.select(F.col("qid").cast("long").alias("qid"), "query"), "qid")
    pairs = full.select("qid", "id", (F.round(distance(metric, F.col("vec"), F.col("query")), DIGITS) + F.lit(0.0)).alias("distance"))
    return top(pairs.where("distance is not null"), k).select("qid", "id", "rank", "distance")


def rerank_depth(base: DataFrame, codes: DataFrame, queries: DataFrame, codebook: list[np.ndarray], offsets: list[int], k: int = 10, share: float = 0.95, probes: int = 64) -> int:
    """How many rows by codes (squared L2) hold ``share`` of the exact k nearest: seen on ``probes`` of the queries, drawn by
    a hash, against all rows. A fixed depth finds ever less as rows are added, this one grows with them.

    Two passes over the table; a task sends a count for each probe and neighbour.
    """
    spark = codes.sparkSession
    some = queries.select(F.col("qid").cast("long").alias("qid"), F.col("query").cast("array<double>").alias("query")).where("query is not null").orderBy(F.xxhash64("qid"), "qid").limit(probes).collect()
    if not some:
        return k
    from .search import knn

    asked = spark.createDataFrame([(r.qid, r["query"]) for r in some], "qid long, query array<double>")
    at = {r.qid: i for i, r in enumerate(some)}
    q = np.array([r["query"] for r in some])
    near = codes.join(F.broadcast(knn(base, asked, k).select("qid", "id")), "id").select("qid", "code").collect()  # k rows for each probe
    own = np.array([at[r.qid] for r in near], np.int64)
    back = np.concatenate([c[np.array([r.code[i] for r in near], np.int64)] for i, c in enumerate(codebook)], 1)
    gap = ((q[own] - back) ** 2).sum(1) + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(own), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            m, d = matrix(b.column(0)).astype(int), 0
            for x, (a, z, c) in enumerate(zip(offsets[:-1], offsets[1:], codebook)):
                d = d + ((q[:, None, a:z] - c) ** 2).sum(2)[:, m[:, x]]
            d.sort(1)
            n += [np.searchsorted(d[i], g, "right") for i, g in zip(own, gap)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n))), pa.array(n)], ["pair", "n"])

    counts = codes.select("code").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    return max(k, int(np.quantile([r.n for r in counts], share, method="higher"))) if counts else k


def save_codebook(spark: SparkSession, codebook: list[np.ndarray], path: str, version: int = 0) -> None:
    """A codebook as a table (version, chunk, code, centroid); versions are folders of one table."""
    rows = [(chunk, code, [float(x) for x in c]) for chunk, book in enumerate(codebook) for code, c in enumerate(book)]
    spark.createDataFrame(rows, "chunk int, code int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")


def load_codebook(spark: SparkSession, path: str, version: int = 0, dim: int | None = None) -> list[np.ndarray]:
    """A saved codebook; with ``dim`` its chunks must add up to it."""
    rows = spark.read.parquet(f"{path}/version={version}").orderBy("chunk", "code").collect()
    out = [np.array([r.centroid for r in rows if r.chunk == c]) for c in sorted({r.chunk for r in rows})]
    if dim is not None and sum(b.shape[1] for b in out) != dim:
        raise ValueError("the codebook is for other dimensions")
    return out


def versioned_adc_knn(codes: DataFrame, queries: DataFrame, codebooks: dict[int, list[np.ndarray]], offsets: list[int], k: int = 10) -> DataFrame:
    """Lookups over codes (version, id, code) of several codebooks, each by its own, as one result."""
    from .search import merge_hits

    return merge_hits([adc_knn(codes.where(F.col("version") == v), queries, book, offsets, k) for v, book in sorted(codebooks.items())], k)


def decoded_knn(codes: DataFrame, queries: DataFrame, k: int = 10, metric: str = "l2") -> DataFrame:
    """Exhaustive search over min-max codes (id, code, p): distances to the decoded vectors."""
    from .search import knn

    return knn(codes.select("id", minmax_decode(F.col("code"), F.col("p")).alias("vec")), queries, k, metric)


def singular_values(base: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(values, directions as rows) of the table as a matrix, from its Gram matrix.

    A task sends one dimensions x dimensions sum, whatever its rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            m = matrix(b.column(0))
            if len(m):
                total = m.T @ m if total is None else total + m.T @ m
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "row"])

    parts = base.select("vec").where("vec is not null").mapInArrow(run, "i int, row array<double>")
    sums = parts.select("i", F.posexplode("row").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    d = 1 + max((r.i for r in sums), default=-1)
    gram = np.zeros((d, d))
    for r in sums:
        gram[r.i, r.j] = r.x
    values, vectors = np.linalg.eigh(gram)
    return np.sqrt(np.maximum(values[::-1], 0)), vectors[:, ::-1].T


# --- transforms and spherical codes ---------------------------------------------


def rotation(dim: int, seed: int = 42) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def hadamard(m: np.ndarray, seed: int = 42) -> np.ndarray:
    """Rows padded to a power of two, signs flipped at random, and the orthonormal Hadamard transform of them."""
    n = 1 << (m.shape[1] - 1).bit_length()
    out = np.zeros((len(m), n))
    out[:, : m.shape[1]] = m
    out *= np.random.default_rng(seed).choice([-1.0, 1.0], n)
    h = 1
    while h < n:
        x = out.reshape(len(m), n // (2 * h), 2, h)
        out = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), 2).reshape(len(m), n)
        h *= 2
    return out / np.sqrt(n)


def transformed(base: DataFrame, kind: str = "rotation", seed: int = 42) -> DataFrame:
    """(id, vec) after a distance-preserving transform: null, rotation, hadamard or double_hadamard."""
    if kind not in ("null", "rotation", "hadamard", "double_hadamard"):
        raise ValueError(f"unknown transform: {kind!r}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = matrix(b.column(1))
            if len(m) and kind == "rotation":
                m = m @ rotation(m.shape[1], seed).T
            elif len(m) and kind != "null":
                m = hadamard(m, seed)
                m = hadamard(m, seed + 1) if kind == "double_hadamard" else m
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(m.tolist(), pa.list_(pa.float64()))], ["id", "vec"])

    return base.select(F.col("id").cast("long").alias("id"), "vec").where("vec is not null").mapInArrow(run, "id long, vec array<double>")


def spherical_codes(base: DataFrame, bits: int = 1, metric: str = "l2", seed: int = 42) -> DataFrame:
    """(id, code, norm, scale): the rotated, centred direction in 2^bits levels.

    The centre is the mean of the vectors (of unit vectors for cosine). ``scale`` makes the
    code's inner product with its own direction right.
    """
    mean = spherical_model(base, metric)
    if Metric.parse(metric) is Metric.COSINE:
        from ..functions.vectors import normalized

        base = base.select("id", normalized(F.col("vec")).alias("vec")).where("vec is not null")
    levels = 2**bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = matrix(b.column(1))
            if not len(m):
                continue
            x = (m - mean) @ rotation(m.shape[1], seed).T
            norm = np.sqrt((x**2).sum(1))
            unit = np.nan_to_num(unit_rows(x))
            span = np.abs(unit).max(1, keepdims=True) if bits > 1 else np.full((len(m), 1), 1 / np.sqrt(m.shape[1]))
            code = (unit > 0).astype(int) if bits == 1 else np.clip(np.floor((unit / np.where(span > 0, span, 1) + 1) / 2 * levels), 0, levels - 1).astype(int)
            point = (2 * code + 1 - levels) / levels
            inner = (point * unit).sum(1)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(code.tolist(), pa.list_(pa.int32())), pa.array(norm), pa.array(np.divide(1, inner, out=np.zeros(len(m)), where=inner > 0))], ["id", "code", "norm", "scale"])

    return base.select(F.col("id").cast("long").alias("id"), "vec").where("vec is not null").mapInArrow(run, "id long, code array<int>, norm double, scale double")


def spherical_model(base: DataFrame, metric: str = "l2") -> np.ndarray:
    """The centre of spherical codes: the mean of the vectors, of unit vectors for cosine. It must be finite."""
    if Metric.parse(metric) is Metric.COSINE:
        from ..functions.vectors import normalized

        base = base.select("id", normalized(F.col("vec")).alias("vec")).where("vec is not null")
    mean = np.array([r["mean"] for r in sorted(dimension_stats(base).collect(), key=lambda r: r.dim)])
    if not len(mean) or not np.isfinite(mean).all():
        raise ValueError("the mean isn't finite")
    return mean


def spherical_knn(codes: DataFrame, queries: DataFrame, mean: np.ndarray, bits: int = 1, k: int = 10, metric: str = "l2", seed: int = 42) -> DataFrame:
    """Exhaustive search over spherical codes (id, code, norm, scale) made with the same mean, bits and seed.

    A row's inner product with the rotated, centred query is estimated by norm * scale times its
    code's; squared L2, inner product and cosine follow from it, the query's and the row's figures.
    """
    spark, metric, levels = codes.sparkSession, Metric.parse(metric), 2**bits
    out = spark.createDataFrame([], "qid long, id long, distance double")
    for ids, vectors in query_blocks(queries):
        own = np.nan_to_num(unit_rows(vectors)) if metric is Metric.COSINE else vectors
        sent = spark.sparkContext.broadcast((ids, own, (own - mean) @ rotation(len(mean), seed).T))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            qids, own, turned = sent.value
            keep, spin = Nearest(k), rotation(len(mean), seed) @ mean
            for b in batches:
                if not b.num_rows:
                    continue
                ids, point = b.column(0).to_numpy(), (2 * matrix(b.column(1)) + 1 - levels) / levels
                norm, scale = b.column(2).to_numpy(), b.column(3).to_numpy()
                length = norm * scale
                for lo in range(0, len(qids), TILE):
                    some = turned[lo : lo + TILE]
                    cross = (some @ point.T) * length  # of centred query and centred row
                    if metric in (Metric.L2, Metric.FULL_L2):
                        d = np.maximum((some**2).sum(1)[:, None] + norm**2 - 2 * cross, 0)
                        d = np.sqrt(d) if metric is Metric.FULL_L2 else d
                    else:
                        # <q, x> = <q - m, x - m> + <q, m> + <m, x> - <m, m>
                        product = cross + (own[lo : lo + TILE] @ mean)[:, None] + (point @ spin) * length
                        d = -product if metric is Metric.INNER_PRODUCT else 1 - product
                    i, j = marked(keep(lo, d))
                    yield pa.RecordBatch.from_arrays([pa.array(qids[lo + i]), pa.array(ids[j]), pa.array(d[i, j])], ["qid", "id", "distance"])

        part = codes.select("id", F.col("code").cast("array<double>").alias("code"), "norm", "scale").mapInArrow(run, "qid long, id long, distance double")
        out = out.unionByName(part.withColumn("distance", F.round("distance", DIGITS) + F.lit(0.0)))
    return top(out, k).select("qid", "id", "rank", "distance")
