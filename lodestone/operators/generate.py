"""Generated data: lattices, points on spheres, labels, payload ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .numbering import numbered


def lattice(spark: SparkSession, dims: int, size: int) -> DataFrame:
    """(id, vec): all points of {0..size-1}^dims, the last dimension running fastest."""
    points = spark.range(size**dims)
    return points.select("id", F.array(*[(F.floor(F.col("id") / size ** (dims - 1 - d)) % size).cast("float") for d in range(dims)]).alias("vec"))


def lattice_edges(spark: SparkSession, dims: int, size: int) -> DataFrame:
    """(src, dst): neighbours at distance one."""
    points = spark.range(size**dims)
    out = []
    for d in range(dims):
        step = size ** (dims - 1 - d)
        place = F.floor(F.col("id") / step) % size
        out += [F.when(place > 0, F.col("id") - step), F.when(place < size - 1, F.col("id") + step)]
    return points.select(F.col("id").alias("src"), F.explode(F.array_compact(F.array(*out))).alias("dst"))


def circle(spark: SparkSession, n: int, radius: float = 1.0) -> DataFrame:
    """(id, vec): points evenly on a circle."""
    angle = F.col("id") * (2 * 3.141592653589793 / n)
    return spark.range(n).select("id", F.array((F.cos(angle) * radius).cast("float"), (F.sin(angle) * radius).cast("float")).alias("vec"))


def on_sphere(spark: SparkSession, n: int, dim: int, radius: float = 1.0, seed: int = 42) -> DataFrame:
    """(id, vec): random directions of one length, the same on every run with the same partitioning."""
    raw = spark.range(n).select("id", F.array(*[F.randn(seed + d) for d in range(dim)]).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return raw.select("id", F.transform("v", lambda x: (x / norm * radius).cast("float")).alias("vec"))


def hypercube_points(spark: SparkSession, n: int, dim: int, seed: int = 42) -> DataFrame:
    """(id, vec): Latin hypercube: in every dimension each of n strata holds one point."""
    rows = spark.range(n)
    for d in range(dim):
        drawn = numbered(rows.select("id", F.xxhash64("id", F.lit(seed + d)).alias("_h")), ["_h", "id"], f"_s{d}")
        rows = rows.join(drawn.select("id", f"_s{d}"), "id")
    return rows.select("id", F.array(*[((F.col(f"_s{d}") + F.pmod(F.xxhash64("id", F.lit(seed - d - 1)), F.lit(1000)) / 1000) / n).cast("float") for d in range(dim)]).alias("vec"))


def labels(spark: SparkSession, n: int, kinds: int, how: str = "zipf", seed: int = 42) -> DataFrame:
    """(id, labels): a comma list for each id; ``0`` when none. zipf: label i with chance 1/i; random: a half; one_per_point."""
    u = [F.pmod(F.xxhash64("id", F.lit(seed + i)), F.lit(1_000_000)) / 1_000_000 for i in range(1, kinds + 1)]
    if how == "one_per_point":
        return spark.range(n).select("id", (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(kinds)) + 1).cast("string").alias("labels"))
    if how not in ("zipf", "random"):
        raise ValueError(f"unknown distribution: {how!r}")
    picked = F.array_compact(F.array(*[F.when(x < (1 / i if how == "zipf" else 0.5), F.lit(str(i))) for i, x in enumerate(u, 1)]))
    return spark.range(n).select("id", F.when(F.size(picked) > 0, F.array_join(picked, ",")).otherwise("0").alias("labels"))


def payload_range(spark: SparkSession, low: int, high: int, width: int = 4) -> DataFrame:
    """(id, payload): ids of a range as little-endian bytes."""
    digits = F.lpad(F.hex("id"), 2 * width, "0")
    pairs = [F.substring(digits, 2 * b + 1, 2) for b in reversed(range(width))]
    return spark.range(low, high).select("id", F.unhex(F.concat(*pairs)).alias("payload"))
