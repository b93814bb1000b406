"""Vector files as Spark data sources: fvecs, bvecs, ivecs and dense .bin matrices.

``register(spark)`` makes ``spark.read.format("vecs")`` and ``.format("vecbin")`` (and their
writers) known. A file is split into ranges of records, so one big file is read by many tasks.
Files are opened through pyarrow's file systems, by URI or local path.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

# Fixed values of the formats: element type and Spark type by kind.
KINDS = {"fvecs": ("<f4", "float"), "bvecs": ("u1", "short"), "ivecs": ("<i4", "int")}
BIN_TYPES = {"f32": ("<f4", "float"), "u8": ("u1", "short"), "i8": ("i1", "short"), "u32": ("<u4", "long"), "i32": ("<i4", "int")}
#: Bytes of a read partition.
SPLIT_BYTES = 64 << 20


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), os.path.abspath(path))


def file_to_write(path: str) -> tuple[pafs.FileSystem, str]:
    """As ``file_system``, with the folder of a local file made: a task may be the first to write there."""
    fs, p = file_system(path)
    if isinstance(fs, pafs.LocalFileSystem):
        fs.create_dir(os.path.dirname(p), recursive=True)
    return fs, p


def file_size(path: str) -> int:
    fs, p = file_system(path)
    return fs.get_file_info(p).size


def read_at(path: str, start: int, n: int) -> bytes:
    fs, p = file_system(path)
    with fs.open_input_file(p) as f:
        return f.read_at(n, start)


def detect_kind(path: str) -> str:
    """By extension; else by content: whole records, bytes first if there are 32 dimensions or more."""
    ext = path.rsplit(".", 1)[-1].lower()
    if ext in KINDS:
        return ext
    if ext in ("bin", "fbin", "u8bin", "i8bin"):
        return "bin"
    size = file_size(path)
    dim = struct.unpack("<I", read_at(path, 0, 4))[0] if size >= 4 else 0
    if dim:
        order = ("bvecs", "fvecs") if dim >= 32 else ("fvecs", "bvecs")
        for kind in order:
            if size % (4 + dim * np.dtype(KINDS[kind][0]).itemsize) == 0:
                return kind
    raise ValueError(f"{path}: no known vector file")


def probe(path: str, kind: str | None = None) -> tuple[int, int]:
    """(dimensions, rows) from the header and the size."""
    kind = kind or detect_kind(path)
    size = file_size(path)
    if kind == "bin":
        rows, dim = struct.unpack("<II", read_at(path, 0, 8))
        return dim, rows
    if size < 4:
        return 0, 0
    dim = struct.unpack("<I", read_at(path, 0, 4))[0]
    record = 4 + dim * np.dtype(KINDS[kind][0]).itemsize
    if size % record:
        raise ValueError(f"{path}: the last record is short")
    return dim, size // record


@dataclass
class Split(InputPartition):
    path: str
    start: int
    rows: int
    first: int

    def __init__(self, path: str, start: int, rows: int, first: int):
        super().__init__((path, start))
        self.path, self.start, self.rows, self.first = path, start, rows, first


def _splits(path: str, head: int, record: int, rows: int) -> list[Split]:
    each = max(1, SPLIT_BYTES // max(1, record))
    return [Split(path, head + lo * record, min(each, rows - lo), lo) for lo in range(0, rows, each)]


class _Reader(DataSourceReader):
    def __init__(self, path: str, kind: str, element: str, limit: int | None):
        self.path, self.kind, self.element = path, kind, element
        self.dim, rows = probe(path, kind)
        self.rows = rows if limit is None else min(rows, limit)
        self.item = np.dtype(element).itemsize
        self.head = 8 if kind == "bin" else 0
        self.record = self.dim * self.item + (0 if kind == "bin" else 4)
        if kind == "bin" and file_size(path) < 8 + rows * self.record:
            raise ValueError(f"{path}: shorter than its header says")

    def partitions(self) -> list[Split]:
        return _splits(self.path, self.head, self.record, self.rows) or [Split(self.path, self.head, 0, 0)]

    def read(self, partition: Split) -> Iterator[pa.RecordBatch]:
        step = 65_536
        for lo in range(0, partition.rows, step):
            n = min(step, partition.rows - lo)
            raw = np.frombuffer(read_at(self.path, partition.start + lo * self.record, n * self.record), np.uint8).reshape(n, self.record)
            if self.kind != "bin":
                if (raw[:, :4].copy().view("<u4") != self.dim).any():
                    raise ValueError(f"{self.path}: dimensions differ")
                raw = raw[:, 4:]
            values = np.ascontiguousarray(raw).view(self.element).ravel()
            wide = {"u1": "<i2", "i1": "<i2", "<u4": "<i8"}.get(self.element, self.element)
            flat = pa.array(values.astype(wide))
            offsets = pa.array(np.arange(0, n * self.dim + 1, max(1, self.dim), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(partition.first + lo, partition.first + lo + n)), pa.ListArray.from_arrays(offsets, flat)], ["id", "vec"])


@dataclass
class _Done(WriterCommitMessage):
    path: str
    rows: int


class _Writer(DataSourceWriter):
    """Each task writes one part of rows in its order; commit joins them to one file.

    Parts are named by task, so a repeated task overwrites its own.
    """

    def __init__(self, path: str, kind: str, element: str):
        self.path, self.kind, self.element = path, kind, element

    def write(self, rows) -> _Done:
        from pyspark import TaskContext

        part = f"{self.path}.part-{TaskContext.get().partitionId():06d}"
        fs, p = file_to_write(part)
        n = 0
        with fs.open_output_stream(p) as f:
            for row in rows:
                vec = np.asarray(row.vec, self.element)
                if self.kind != "bin":
                    f.write(struct.pack("<I", len(vec)))
                elif not n:
                    f.write(struct.pack("<I", len(vec)))
                f.write(vec.tobytes())
                n += 1
        return _Done(part, n)

    def commit(self, messages: list[_Done]) -> None:
        fs, p = file_to_write(self.path)
        parts = sorted((m.path, m.rows) for m in messages if m and m.rows)
        with fs.open_output_stream(p) as out:
            dim = None
            for i, (path, _) in enumerate(parts):
                _, own = file_system(path)
                with fs.open_input_stream(own) as f:
                    if self.kind == "bin":
                        head = f.read(4)
                        if dim is None:
                            dim = head
                            out.write(struct.pack("<I", sum(n for _, n in parts)) + head)
                        elif head != dim:
                            raise ValueError("dimensions differ")
                    while block := f.read(1 << 20):
                        out.write(block)
            if self.kind == "bin" and dim is None:
                out.write(struct.pack("<II", 0, 0))
        self.abort(messages)

    def abort(self, messages: list[_Done]) -> None:
        for m in messages:
            if m:
                fs, p = file_system(m.path)
                if fs.get_file_info(p).type == pafs.FileType.File:
                    fs.delete_file(p)


class VecsSource(DataSource):
    """fvecs, bvecs, ivecs; options path, kind (else detected), limit."""

    @classmethod
    def name(cls) -> str:
        return "vecs"

    def _kind(self) -> str:
        return self.options.get("kind") or detect_kind(self.options["path"])

    def schema(self) -> str:
        return f"id long, vec array<{KINDS[self._kind()][1]}>"

    def reader(self, schema) -> DataSourceReader:
        kind = self._kind()
        return _Reader(self.options["path"], kind, KINDS[kind][0], int(self.options["limit"]) if "limit" in self.options else None)

    def writer(self, schema, overwrite) -> DataSourceWriter:
        kind = self.options.get("kind") or self.options["path"].rsplit(".", 1)[-1]
        return _Writer(self.options["path"], kind, KINDS[kind][0])


class BinSource(DataSource):
    """Dense matrices: rows and dimensions as u32, then the rows; options path, element (f32, u8, i8, u32, i32), limit."""

    @classmethod
    def name(cls) -> str:
        return "vecbin"

    def schema(self) -> str:
        return f"id long, vec array<{BIN_TYPES[self.options.get('element', 'f32')][1]}>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], "bin", BIN_TYPES[self.options.get("element", "f32")][0], int(self.options["limit"]) if "limit" in self.options else None)

    def writer(self, schema, overwrite) -> DataSourceWriter:
        return _Writer(self.options["path"], "bin", BIN_TYPES[self.options.get("element", "f32")][0])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(VecsSource)
    spark.dataSource.register(BinSource)


def read_vectors(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(id, vec) of a vector file of any kind."""
    register(spark)
    kind = detect_kind(path)
    reader = spark.read.format("vecbin" if kind == "bin" else "vecs").option("path", path)
    if kind != "bin":
        reader = reader.option("kind", kind)
    elif path.endswith(("u8bin", "i8bin")):
        reader = reader.option("element", path[-5:-3])
    return (reader.option("limit", str(limit)) if limit is not None else reader).load()


def write_vectors(rows: DataFrame, path: str, kind: str, element: str = "f32") -> None:
    """Write (id, vec) in id order as one file."""
    register(rows.sparkSession)
    ordered = rows.select("id", "vec").repartitionByRange("id").sortWithinPartitions("id").select("vec")
    out = ordered.write.format("vecbin" if kind == "bin" else "vecs").option("path", path).mode("append")
    (out.option("element", element) if kind == "bin" else out.option("kind", kind)).save()


def chosen_rows(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Only the rows of the listed ids."""
    return rows.join(ids.select("id"), "id", "left_semi")


def id_range(rows: DataFrame, begin: int, count: int) -> DataFrame:
    return rows.where((rows["id"] >= begin) & (rows["id"] < begin + count))


def load_ids(spark: SparkSession, path: str) -> DataFrame:
    """(id) from a text file of one id a line, or a u32 .bin list."""
    if path.endswith(".bin"):
        register(spark)
        return spark.read.format("vecbin").option("path", path).option("element", "u32").load().selectExpr("explode(vec) as id")
    return spark.read.text(path).where("trim(value) <> ''").selectExpr("cast(trim(value) as long) as id")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(qid, rank, id, distance) of a truth file: rows and k as u32, all ids (u32), then all distances (f32)."""
    rows, k = struct.unpack("<II", read_at(path, 0, 8))
    if file_size(path) < 8 + rows * k * 8:
        raise ValueError(f"{path}: shorter than its header says")
    parts = [(lo, min(rows, lo + 4096)) for lo in range(0, rows, 4096)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                n = (hi - lo) * k
                ids = np.frombuffer(read_at(path, 8 + lo * k * 4, n * 4), "<u4").astype(np.int64)
                d = np.frombuffer(read_at(path, 8 + rows * k * 4 + lo * k * 4, n * 4), "<f4").astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(lo, hi), k)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), hi - lo)), pa.array(ids), pa.array(d)], ["qid", "rank", "id", "distance"])

    return spark.createDataFrame(parts or [(0, 0)], "lo long, hi long").mapInArrow(run, "qid long, rank int, id long, distance double")


def read_range_truth(spark: SparkSession, path: str) -> DataFrame:
    """(qid, rank, id) of a ragged truth file: queries and total as u32, a count for each query, then all ids."""
    queries, total = struct.unpack("<II", read_at(path, 0, 8))
    counts = np.frombuffer(read_at(path, 8, 4 * queries), "<u4").astype(int)
    starts = np.concatenate(([0], np.cumsum(counts)))
    if starts[-1] != total:
        raise ValueError(f"{path}: counts don't sum up")
    rows = [(q, int(starts[q]), int(counts[q])) for q in range(queries)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for q, start, n in zip(*(b.column(i).to_pylist() for i in range(3))):
                ids = np.frombuffer(read_at(path, 8 + 4 * queries + 4 * start, 4 * n), "<u4").astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, q)), pa.array(np.arange(1, n + 1, dtype=np.int32)), pa.array(ids)], ["qid", "rank", "id"])

    return spark.createDataFrame(rows, "q long, start long, n long").mapInArrow(run, "qid long, rank int, id long")


def read_multivectors(spark: SparkSession, path: str) -> DataFrame:
    """(doc, pos, vec) of a file: documents as u32, then for each its rows and dimensions as u32 and the f32 values."""
    n = struct.unpack("<I", read_at(path, 0, 4))[0]
    at, rows = 4, []
    for doc in range(n):
        m, dim = struct.unpack("<II", read_at(path, at, 8))
        rows.append((doc, at + 8, m, dim))
        at += 8 + 4 * m * dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc, start, m, dim in zip(*(b.column(i).to_pylist() for i in range(4))):
                v = np.frombuffer(read_at(path, start, 4 * m * dim), "<f4").reshape(m, dim)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, doc)), pa.array(np.arange(m)), pa.array(v.tolist(), pa.list_(pa.float32()))], ["doc", "pos", "vec"])

    return spark.createDataFrame(rows or [(0, 0, 0, 0)], "doc long, start long, m long, dim long").mapInArrow(run, "doc long, pos long, vec array<float>")
