"""Changes to a vector table: upserts, tombstones, compaction and maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .numbering import numbered


def last_writes(log: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    """Each key's row with the greatest sequence number.

    max_by merges before the shuffle, so a hot key is one row of each task.
    """
    value = F.struct(*[F.col(c) for c in log.columns])
    return log.groupBy(key).agg(F.max_by(value, seq).alias("_r")).select("_r.*")


def upsert(base: DataFrame, delta: DataFrame, key: str = "id") -> DataFrame:
    """base with the rows of delta put in place of those with their keys."""
    return base.join(delta.select(key), key, "left_anti").select(*base.columns).unionByName(delta.select(*base.columns))


def without(base: DataFrame, deleted: DataFrame, key: str = "id") -> DataFrame:
    """base without deleted keys (tombstones)."""
    return base.join(deleted.select(key).distinct(), key, "left_anti").select(*base.columns)


def status(ids: DataFrame, base: DataFrame, deleted: DataFrame, key: str = "id") -> DataFrame:
    """(id, status): valid, deleted or unknown."""
    a = base.select(key).distinct().withColumn("_b", F.lit(True))
    d = deleted.select(key).distinct().withColumn("_d", F.lit(True))
    return ids.join(a, key, "left").join(d, key, "left").select(key, F.when(F.col("_d"), "deleted").when(F.col("_b"), "valid").otherwise("unknown").alias("status"))


def compact(base: DataFrame, delta: DataFrame, deleted: DataFrame, key: str = "id", buckets: int = 16) -> tuple[DataFrame, DataFrame]:
    """(rows, changed buckets): the merged table with ``bucket`` by key hash, and the buckets that must be rewritten."""
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    merged = without(upsert(base, delta, key), deleted, key).withColumn("bucket", bucket)
    changed = delta.select(key).union(deleted.select(key)).select(bucket.alias("bucket")).distinct()
    return merged, changed


def write_compacted(merged: DataFrame, changed: DataFrame, path: str) -> None:
    """Rewrite only the changed buckets of a table partitioned by bucket."""
    rows = merged.join(F.broadcast(changed), "bucket", "left_semi")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def live_set(log: DataFrame, stage: int | None = None) -> DataFrame:
    """Rows alive after a stage of an ordered log (stage, seq, op, id, vec): the last op of each id, if it isn't a delete."""
    seen = log if stage is None else log.where(F.col("stage") <= stage)
    last = seen.groupBy("id").agg(F.max_by(F.struct("op", "vec"), F.struct("stage", "seq")).alias("r"))
    return last.where("r.op <> 'delete'").select("id", "r.vec")


def needs_consolidation(active: int, deleted: int, threshold: float) -> bool:
    """Whether more rows are deleted than the threshold allows, relative to the active ones."""
    return deleted > int(active * threshold)


def replace_range(log: DataFrame, tags: tuple[int, int], ids: tuple[int, int], source: DataFrame, stage: int) -> DataFrame:
    """The log with tags [a, b) given the vectors of ids [c, d) in a stage."""
    if tags[1] - tags[0] != ids[1] - ids[0]:
        raise ValueError("the ranges differ in length")
    new = source.where(F.col("id").between(ids[0], ids[1] - 1)).select(F.lit(stage).cast("int").alias("stage"), F.col("id").cast("long").alias("seq"), F.lit("replace").alias("op"), (F.col("id") - ids[0] + tags[0]).alias("id"), "vec")
    return log.unionByName(new)


def slots(rows: DataFrame, capacity: int) -> DataFrame:
    """(slot): the free slots below the capacity, given rows (slot)."""
    return rows.sparkSession.range(capacity).select(F.col("id").alias("slot")).join(rows.select("slot"), "slot", "left_anti")


def latest(df: DataFrame, key: str, order: str) -> DataFrame:
    """Each key's newest row by a window; for several order columns."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_k = 1").drop("_k")


def allocate(new: DataFrame, used: DataFrame, keys: list[str]) -> DataFrame:
    """new with ``id``: free ids below the greatest used one first, in order, then ids beyond it; rows in the order of keys.

    Both sides are numbered in sorted range partitions and joined by number.
    """
    high = used.agg(F.max("id").alias("m")).first().m
    high = -1 if high is None else high
    free = slots(used.select(F.col("id").alias("slot")), high + 1)
    free = numbered(free, ["slot"], "_n")
    count = free.agg(F.count("*").alias("n")).first().n
    placed = numbered(new, keys, "_n").join(free, "_n", "left")
    return placed.withColumn("id", F.coalesce("slot", F.lit(high + 1) + F.col("_n") - F.lit(count))).drop("_n", "slot")
