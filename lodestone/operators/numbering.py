"""Dense row numbers in a global order without a single-task window, and cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def work_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a folder of this machine only where that is unset and all tasks run here."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        own = tempfile.mkdtemp(prefix="lodestone-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        path = f"file://{own}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df from a reliable checkpoint in ``work_dir``."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(work_dir(spark))
    return df.checkpoint()


def numbered(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """df with ``name``: 0, 1, ... in the order of keys.

    Range partitions are sorted and checkpointed, so their borders are drawn once; a row's
    number is its place in its partition plus the rows of the partitions before it.
    """
    ordered = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = ordered.groupBy(part.alias("_p")).agg(F.count("*").alias("_n"))  # a row for each partition
    before = sizes.withColumn("_start", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = ordered.withColumn("_p", part).join(F.broadcast(before.select("_p", "_start")), "_p")
    return out.withColumn(name, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_p", "_start", "_at")


def cumulative(df: DataFrame, keys: list[str], weight: str, name: str) -> DataFrame:
    """df with ``name``: the sum of ``weight`` up to and with each row in the order of keys; as ``numbered``, no task holds all rows."""
    ordered = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    placed = ordered.withColumn("_p", F.shiftright("_at", 33))
    total, low = 0, []
    for r in placed.groupBy("_p").agg(F.sum(weight).alias("n")).orderBy("_p").collect():  # a row for each partition
        low.append((r["_p"], total))
        total += r.n
    start = df.sparkSession.createDataFrame(low, "_p long, _s long")
    inside = Window.partitionBy("_p").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    return placed.join(F.broadcast(start), "_p").withColumn(name, F.col("_s") + F.sum(weight).over(inside)).drop("_p", "_s", "_at")
