"""Sharding along a Hilbert curve over quantised metadata."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Tables

#: Bits of each quantised dimension.
BITS = 6
#: Groups of equal texts with more than this part of all rows are looked up by broadcast; there are fewer than HOT.
HOT = 1000


def hilbert_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Curve index of integer cells (rows x dimensions), each below 2**bits.

    Transposed form first: undo the excess work of each level from the top bit
    down, then Gray-encode; at last the bits are interleaved, dimension 0 highest.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(high, low, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= turn
    out = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | x[i] >> bit & 1
    return out


def numbered_parts(rows: DataFrame, keys: list[str], tables: Tables) -> DataFrame:
    """rows in the order of keys, written once as sorted range partitions, with ``_part`` and ``_at``, the place in it."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = tables.write(rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    return placed.withColumn("_part", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))


def starts(parts: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], int]:
    """(part, rows before it) from (part, rows), and the total; as many as partitions, whatever the rows."""
    out, total = [], 0
    for p, n in sorted(parts):
        out.append((p, total))
        total += n
    return out, total


def quantile_cuts(rows: DataFrame, col: str, cells: int, tables: Tables) -> list:
    """Values that begin the cells of col: exact quantiles by rank over all rows, so ``cells`` - 1 at most.

    Distinct values are counted (partial counts first) and sorted by range; a value begins a cell
    if a border of equal shares falls on one of its rows. Works for strings and numbers alike.
    """
    counts = numbered_parts(rows.where(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n")), [col], tables)
    before, total = starts([(r._part, r.n) for r in counts.groupBy("_part").agg(F.sum("n").alias("n")).collect()])
    if not total:
        return []
    low = rows.sparkSession.createDataFrame(before, "_part long, _start long")
    in_part = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    last = F.col("_start") + F.sum("n").over(in_part)
    summed = counts.join(F.broadcast(low), "_part").withColumn("_last", last)
    first = F.expr(f"(_last - n) * {cells} div {total}")
    of_last = F.expr(f"(_last - 1) * {cells} div {total}")
    border = (of_last > first) | ((F.col("_last") > F.col("n")) & (F.expr(f"(_last - n - 1) * {cells} div {total}") < first))
    return sorted(r[0] for r in summed.where(border).select(col).collect())


def cell_of(col: pa.Array, cuts: list, side: int) -> np.ndarray:
    """Cells of values by cuts, spread over the side of the cube; null is cell 0 as is what lies before the first cut."""
    if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
        known = [c.encode() for c in cuts]
        few = col.fill_null("").dictionary_encode() if not pa.types.is_dictionary(col.type) else col
        of = np.array([bisect.bisect_right(known, v.encode()) for v in few.dictionary.to_pylist()], np.int64)
        cell = of[few.indices.to_numpy(zero_copy_only=False)] if len(of) else np.zeros(len(col), np.int64)
    else:
        cell = np.searchsorted(np.array(cuts, np.float64), col.cast(pa.float64()).fill_null(-np.inf).to_numpy(zero_copy_only=False), "right")
    cell[col.is_null().to_numpy(zero_copy_only=False)] = 0
    return cell * (side - 1) // max(1, len(cuts))


def curve_order(rows: DataFrame, dims: list[str], tables: Tables, bits: int = BITS) -> DataFrame:
    """rows with ``curve`` in place of the dims: their Hilbert index.

    Each dimension, string or number, is cut at its own 2**bits - 1 quantiles by rank over all
    rows. Null comes before every value. A dimension of few values is spread over its whole
    side of the cube, so it tells as much as others.
    """
    cuts = [quantile_cuts(rows, c, 1 << bits, tables) for c in dims]
    names = [f.name for f in rows.schema.fields if f.name not in dims]
    fields = [rows.schema[n] for n in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = [cell_of(b.column(b.schema.get_field_index(c)), cut, 1 << bits) for c, cut in zip(dims, cuts)]
            index = hilbert_index(np.stack(cells, 1), bits) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(n)) for n in names] + [pa.array(index, pa.int64())], [*names, "curve"])

    return rows.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["curve long"]))


def with_places(rows: DataFrame, total: int) -> DataFrame:
    """rows (curve, text_key) with ``place``: the least curve index of the rows of the same text.

    Only texts that repeat are looked up. Fewer than HOT groups can hold more than a HOT-th of
    all rows; these are broadcast, so no such group meets in one task.
    """
    groups = rows.groupBy("text_key").agg(F.min("curve").alias("place"), F.count("*").alias("n")).where("n > 1")
    hot = F.col("n") * HOT > total
    large = groups.where(hot).select("text_key", F.col("place").alias("large"))
    small = groups.where(~hot).select("text_key", F.col("place").alias("small"))
    named = rows.join(F.broadcast(large), "text_key", "left")
    # Rows of large groups get keys of their own for the shuffle.
    key = F.when(F.col("large").isNull(), F.col("text_key")).otherwise(F.xxhash64("doc_id", "curve"))
    out = named.withColumn("_key", key).join(small.withColumnRenamed("text_key", "_key"), "_key", "left")
    return out.withColumn("place", F.when(F.col("large").isNotNull(), F.col("large")).otherwise(F.coalesce("small", "curve"))).drop("large", "small", "_key")


def best_borders(total: int, n_shards: int, whole: set[int]) -> list[int]:
    """First ranks of the shards and the end: sizes differ by one at most, and as many borders as can be are in ``whole``.

    Which shards are larger by one is free; a shortest path over the borders chooses it.
    """
    wide, more = divmod(total, n_shards)
    best: dict[int, tuple[int, list[int]]] = {0: (0, [])}  # larger shards so far: borders that tear, the choice
    for k in range(1, n_shards + 1):
        new: dict[int, tuple[int, list[int]]] = {}
        for used, (torn, path) in best.items():
            for add in (0, 1):
                u = used + add
                if u > more or more - u > n_shards - k:
                    continue
                at = k * wide + u
                cost = torn + (at not in whole and at < total)
                if u not in new or cost < new[u][0]:
                    new[u] = (cost, [*path, at])
        best = new
    return [0, *best[more][1]]


def shards(docs: DataFrame, n_shards: int = 24, bits: int = BITS) -> DataFrame:
    """Cut documents into runs of the Hilbert order of (lang, source, length).

    The law is ``rows``: shard sizes differ by one row at most, however rows repeat. Equal
    texts are a group that stands together, at the place of its first row on the curve; which
    shards are the larger ones is chosen so that as few borders as can be tear a group (a group
    larger than a shard, or on a border that can't move, is torn). Groups of one place follow by a
    hash of the text, rows of a group by (doc_id, size). Null metadata sorts first, null text has
    no bytes and is one group with the empty text. Rows that repeat whole each get a slot. Empty
    tables give no rows; very long texts are only measured; other columns are ignored.
    """
    spark, tables = docs.sparkSession, Tables(docs.sparkSession, "hilbert")
    text = F.coalesce("text", F.lit(""))
    picked = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("text_key"),
        F.col("lang").cast("string").alias("d_lang"), F.col("source").cast("string").alias("d_source"), F.length(text).cast("double").alias("d_length"),
    )
    picked = tables.write(picked)
    curved = tables.write(curve_order(picked, ["d_lang", "d_source", "d_length"], tables, bits))
    total = picked.count()
    rows = numbered_parts(with_places(curved, total), ["place", "text_key", "doc_id", "size"], tables)
    before, _ = starts([(r._part, r.n) for r in rows.groupBy("_part").agg(F.count("*").alias("n")).collect()])
    rows = rows.join(F.broadcast(spark.createDataFrame(before, "_part long, _start long")), "_part").withColumn("rank", F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")
    wide = total // n_shards
    if not wide:  # fewer rows than shards: one each
        shard, slot = F.col("rank"), F.lit(0).cast("long")
    else:
        # Ranks that may be a border, and the ones before: some hundreds, whatever the rows.
        near = F.broadcast(spark.createDataFrame([(r,) for r in sorted({k * wide + u - d for k in range(1, n_shards) for u in range(total % n_shards + 1) for d in (0, 1)})], "rank long"))
        key = {r.rank: (r.place, r.text_key) for r in rows.join(near, "rank").select("rank", "place", "text_key").collect()}
        borders = best_borders(total, n_shards, {r for r in key if key.get(r - 1) != key[r]})
        shard, first = F.lit(0), F.lit(0)
        for k, at in enumerate(borders[1:-1], 1):
            shard, first = F.when(F.col("rank") >= at, k).otherwise(shard), F.when(F.col("rank") >= at, at).otherwise(first)
        slot = F.col("rank") - first
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("curve").alias("curve_index"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 24) -> DataFrame:
    """Write documents as one sorted file group per shard and return what pruning needs:
    rows, bytes and the range of each dimension by shard."""
    placed = shards(docs, n_shards).select("doc_id", "text_crc32", "shard", "slot").dropDuplicates(["doc_id", "text_crc32"])
    crc = F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.encode(F.lit(""), "UTF-8")))
    rows = docs.withColumn("text_crc32", crc).join(placed, ["doc_id", "text_crc32"])
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").drop("text_crc32").write.partitionBy("shard").parquet(path)
    back = docs.sparkSession.read.parquet(path)
    size = F.coalesce(F.length("text"), F.lit(0))
    return back.groupBy("shard").agg(F.count("*").alias("rows"), F.min("lang").alias("lang_low"), F.max("lang").alias("lang_high"), F.min("source").alias("source_low"), F.max("source").alias("source_high"), F.min(size).alias("length_low"), F.max(size).alias("length_high"))


def op9_hilbert_sharding(spark, sf_dir: str) -> DataFrame:
    """The place of every row of ``documents`` in 24 shards; see ``shards`` for nulls, repeats and ties."""
    return shards(spark.read.parquet(f"{sf_dir}/documents.parquet"))
