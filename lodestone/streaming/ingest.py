"""Streaming ingest of vector changes into a versioned Parquet table."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.mutate import last_writes


#: Buckets of a live table by a hash of the id.
BUCKETS = 16


class LiveTable:
    """Rows (id, vec) in buckets by id; a version names, for every bucket, the batch that wrote it last.

    A batch is applied by its number: one that was applied before changes nothing, so a
    restarted stream repeats safely. ``log`` rows are (id, seq, op, vec). Only the buckets that a
    batch touches are written anew. Sequence numbers stay with the rows, deleted ones too, so a
    change that comes late doesn't undo a newer one.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def version(self) -> int:
        """Number of the last batch that was applied, -1 before the first."""
        fs, p = self._fs("versions")
        if not fs.exists(p):
            return -1
        return max((int(s.getPath().getName()) for s in fs.listStatus(p) if s.getPath().getName().isdigit()), default=-1)

    def _writers(self) -> dict[int, int]:
        """The batch that wrote each bucket last."""
        v = self.version()
        if v < 0:
            return {}
        return {int(k): n for k, n in json.loads(self.spark.read.text(f"{self.path}/versions/{v}").first().value).items()}

    def _states(self, writers: dict[int, int]) -> DataFrame:
        """(id, seq, vec) of some buckets; deleted ids have no vec."""
        kinds = "id long, seq long, vec array<float>"
        if not writers:
            return self.spark.createDataFrame([], kinds)
        return self.spark.read.schema(kinds).parquet(*[f"{self.path}/batch-{n}/bucket={b}" for b, n in sorted(writers.items())])

    def read(self) -> DataFrame:
        return self._states(self._writers()).where("vec is not null").select("id", "vec")

    def apply(self, log: DataFrame, batch: int) -> None:
        """Upserts and deletes of one batch, the last of each id; then the version's mark, put in place at once."""
        if batch <= self.version():
            return
        vec = F.when(F.col("op") != "delete", F.col("vec").cast("array<float>"))
        new = last_writes(log.select("id", F.col("seq").cast("long").alias("seq"), vec.alias("vec")))
        bucket = F.pmod(F.xxhash64("id"), F.lit(BUCKETS)).cast("int")
        touched = [r.b for r in new.select(bucket.alias("b")).distinct().collect()]
        writers = self._writers()
        old = self._states({b: n for b, n in writers.items() if b in touched})
        merged = last_writes(old.unionByName(new)).withColumn("bucket", bucket)
        merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/batch-{batch}")
        now = writers | dict.fromkeys(touched, batch)
        fs, part = self._fs(f"versions/.{batch}")
        out = fs.create(part, True)
        out.write(json.dumps(now).encode())
        out.close()
        fs.rename(part, self._fs(f"versions/{batch}")[1])
        for n in set(writers.values()) - set(now.values()):  # no bucket reads these any more
            fs, gone = self._fs(f"batch-{n}")
            fs.delete(gone, True)

    def stream(self, log: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
        """Apply a streaming log; batches are bounded by the source's maxFilesPerTrigger."""
        writer = log.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: self.apply(df, n))
        return (writer.trigger(availableNow=True) if once else writer).start()


class LiveState(StatefulProcessor):
    """Per-id state of a change log: emits (id, live, changes) whenever an id changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("live", "seq long, live boolean, changes long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seq, live, changes = self.state.get() if self.state.exists() else (-1, False, 0)
        for frame in rows:
            for s, op in frame.sort_values("seq")[["seq", "op"]].itertuples(index=False):
                if s > seq:
                    seq, live, changes = int(s), op != "delete", changes + 1
        self.state.update((seq, live, changes))
        yield pd.DataFrame({"id": [key[0]], "live": [live], "changes": [changes]})

    def close(self) -> None:
        pass


def live_states(log: DataFrame) -> DataFrame:
    """The stream of id states; needs the RocksDB state store."""
    return log.groupBy("id").transformWithStateInPandas(LiveState(), "id long, live boolean, changes long", "Update", "None")


def event_counts(events: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Tumbling counts by type with a watermark, for an events stream (ts, event_type)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")
