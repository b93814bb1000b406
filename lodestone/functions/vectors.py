"""Vector functions as Columns, and the same metrics for matrices of an Arrow batch."""

from __future__ import annotations

from enum import Enum

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class Metric(Enum):
    """Distances; smaller is closer."""

    L2 = "l2"  # squared
    FULL_L2 = "full_l2"
    INNER_PRODUCT = "innerproduct"  # minus the inner product
    COSINE = "cosine"  # 1 - cosine
    COSINE_NORMALIZED = "cosinenormalized"  # 1 - inner product of unit vectors

    @classmethod
    def parse(cls, name: str | Metric) -> Metric:
        """By name in any case."""
        if isinstance(name, cls):
            return name
        try:
            return cls(name.strip().lower())
        except ValueError:
            raise ValueError(f"unknown metric: {name!r}") from None


def doubles(v: Column) -> Column:
    """Any numeric array as array<double>."""
    return v.cast("array<double>")


def _sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def squared_l2(a: Column, b: Column) -> Column:
    """Null where the dimensions differ."""
    return F.when(F.size(a) == F.size(b), _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y))))


def l2_norm(v: Column) -> Column:
    return F.sqrt(squared_norm(v))


def squared_norm(v: Column) -> Column:
    return _sum(F.transform(doubles(v), lambda x: x * x))


def l1_norm(v: Column) -> Column:
    return _sum(F.transform(doubles(v), lambda x: F.abs(x)))


def max_norm(v: Column) -> Column:
    return F.array_max(F.transform(doubles(v), lambda x: F.abs(x)))


def normalized(v: Column) -> Column:
    """The unit vector; null for the zero vector."""
    n = l2_norm(v)
    return F.when(n > 0, F.transform(doubles(v), lambda x: x / n))


def distance(metric: str | Metric, a: Column, b: Column) -> Column:
    metric = Metric.parse(metric)
    if metric is Metric.L2:
        return squared_l2(a, b)
    if metric is Metric.FULL_L2:
        return F.sqrt(squared_l2(a, b))
    if metric is Metric.INNER_PRODUCT:
        return -dot(a, b)
    if metric is Metric.COSINE_NORMALIZED:
        return 1 - dot(a, b)
    norm = l2_norm(a) * l2_norm(b)
    return F.when(norm > 0, 1 - dot(a, b) / norm)


def sign_words(v: Column, dims: int) -> Column:
    """One bit per value, 1 where it is above zero, as array<bigint> of 32 bits each, first value lowest."""
    words = []
    for lo in range(0, dims, 32):
        total = F.lit(0).cast("bigint")
        for i in range(lo, min(dims, lo + 32)):
            total = total + F.when(F.get(v, F.lit(i)) > 0, F.lit(1 << (i - lo)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
        words.append(total)
    return F.array(*words)


def hamming(a: Column, b: Column) -> Column:
    """Number of differing bits of two arrays of words."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


# --- matrices ---------------------------------------------------------------


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows at length 1; zero rows become NaN, so they are in no result."""
    n = np.sqrt(np.einsum("ij,ij->i", m, m))
    return m / np.where(n > 0, n, np.nan)[:, None]


def rough(metric: Metric, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """All distances (queries x rows) by one matrix product; for choosing candidates."""
    if metric is Metric.COSINE:
        queries, rows = unit_rows(queries), unit_rows(rows)
    product = queries @ rows.T
    if metric is Metric.INNER_PRODUCT:
        return -product
    if metric in (Metric.COSINE, Metric.COSINE_NORMALIZED):
        return 1 - product
    d = np.maximum(np.einsum("ij,ij->i", queries, queries)[:, None] + np.einsum("ij,ij->i", rows, rows) - 2 * product, 0)
    return np.sqrt(d) if metric is Metric.FULL_L2 else d


def exact(metric: Metric, queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Distances of paired rows, from differences where the metric has them."""
    if metric in (Metric.L2, Metric.FULL_L2):
        gap = queries - rows
        d = np.einsum("ij,ij->i", gap, gap)
        return np.sqrt(d) if metric is Metric.FULL_L2 else d
    if metric is Metric.COSINE:
        queries, rows = unit_rows(queries), unit_rows(rows)
    product = np.einsum("ij,ij->i", queries, rows)
    return -product if metric is Metric.INNER_PRODUCT else 1 - product
