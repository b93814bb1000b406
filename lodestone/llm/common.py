"""Shared parts: written tables, Arrow text buffers, connected components.

Everything that cuts lineage is a Parquet table below ``spark.checkpoint.dir``,
so a lost executor costs only the tasks it ran.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a vectorised step handles at once.
CHUNK_BYTES = 1 << 20

#: Rows of an Arrow batch; documents are kilobytes, so 10,000 would be too many.
BATCH_ROWS = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a new one of this machine only where it is unset and all tasks run here."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        path = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small in rows; Spark's own maxBytesPerBatch (64 MB by default) keeps them small in bytes."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


class Tables:
    """Written intermediate tables of one operator call."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def write(self, df: DataFrame) -> DataFrame:
        """Write df once and read it back."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.lodestone_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that no later step reads."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(df.lodestone_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_tables(spark: SparkSession) -> None:
    """Delete all intermediate tables below the checkpoint folder; results that weren't written read them still."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/lodestone")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


# --- text as Arrow buffers -------------------------------------------------


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offsets, data = col.buffers()
    if len(col) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    off = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(data: np.ndarray, off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows; a longer row is a run of its own."""
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; all other bytes stay."""
    return _LOWER[data]


#: Any byte but white space \x09-\x0D and \x20.
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
#: 0-9, a-z and every byte of a code point beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _powers[k] = np.cumprod(step)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit words."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_bounds(data: np.ndarray, off: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs of bytes in kind; runs end with their row."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = kind[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[off] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | cut[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(off, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes, the same on every machine."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _power(len(data))
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_TABLE[data] * power[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_SHINGLE = [0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63]


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its k-word shingles.

    Words are runs without white space, A-Z lower-cased. A row with fewer words
    is one shingle; a row without words has none.
    """
    data = lower_ascii(data)
    starts, ends, _ = word_bounds(data, off, SPACED)
    h = word_hashes(data, starts, ends)
    first = np.searchsorted(starts, off)
    mult = [np.uint64((_SHINGLE[j % 5] * (2 * (j // 5) + 1)) % (1 << 64)) for j in range(k)]
    whole = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for j in range(k):
        whole += h[j : j + len(whole)] * mult[j]
    whole = mix(whole)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            s = np.sort(whole[a : b - k + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            s = np.full(1, b - a, np.uint64)
            for j in range(b - a):
                s = s + h[a + j : a + j + 1] * mult[j]
            out.append(mix(s ^ np.uint64(0x5851F42D4C957F2D)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


# --- connected components --------------------------------------------------


def components(edges: DataFrame, tables: Tables, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the undirected edges (a, b).

    A component's name is its smallest node. Alternates the two star steps: each
    node links its larger neighbours, then itself and its smaller ones, to the
    smallest of its neighbourhood. Minima are aggregated before the shuffle and
    the joins are plain equi-joins, so a hub is split by AQE. Null ends and loops
    are ignored; no edges give no rows.
    """
    now = tables.write(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(0 if now.isEmpty() else max_rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b"), F.col("a")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("b"), F.col("m").alias("a")).union(small.select(F.col("u"), F.col("m"))).where("a <> b").distinct().select("a", "b")
        new = tables.write(small)
        tables.drop(now)
        now = new
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if (mark.n, mark.s) == seen:
            break
        seen = (mark.n, mark.s)
    else:
        if seen:
            raise RuntimeError(f"components aren't final after {max_rounds} rounds")
    roots = now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(roots)
