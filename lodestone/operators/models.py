"""Analytic models of cache, prefetch, placement and policy, as expressions over trace tables."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, fields

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values of the eviction score and of the placement profiles.
PREFETCH_BONUS, SMALL_GROUP, LARGE_GROUP, SMALL_BONUS, LARGE_PENALTY, AGE_SHIFT = 64, 64, 512, -16, 24, 16


def eviction_score(age: Column, from_prefetch: Column, group_bytes: Column) -> Column:
    """age / 16, plus 64 for prefetched entries, less 16 for groups up to 64 bytes, plus 24 from 512 bytes on; the greatest goes first."""
    size = F.when(group_bytes <= SMALL_GROUP, SMALL_BONUS).when(group_bytes >= LARGE_GROUP, LARGE_PENALTY).otherwise(0)
    return F.floor(age / AGE_SHIFT) + F.when(from_prefetch, PREFETCH_BONUS).otherwise(0) + size


def admitted(trace: DataFrame, misses: int = 2) -> DataFrame:
    """The accesses (id, at) from each id's n-th cold miss on."""
    nth = F.row_number().over(Window.partitionBy("id").orderBy("at"))
    return trace.withColumn("nth", nth).where(F.col("nth") >= misses)


def prefetch_candidates(edges: DataFrame, fan_out: int = 8, depth: int = 1, layer_aware: bool = True, second_fan_out: int | None = None, switched: Column | None = None) -> DataFrame:
    """(src, dst, repeat, place): the first neighbours by place, upper layers first if ``layer_aware``, each repeated
    ``depth`` times; ``place`` is the order of their offsets (ids), in which they are asked for.

    Nodes for which ``switched`` holds are in the second phase and take ``second_fan_out``.
    """
    order = Window.partitionBy("src").orderBy(*([F.desc("layer")] if layer_aware else []), "ord", "dst")
    most = F.lit(fan_out) if second_fan_out is None or switched is None else F.when(switched, second_fan_out).otherwise(fan_out)
    first = edges.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most).select("src", "dst").distinct()
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy("src").orderBy("dst")))
    return placed.select("src", "dst", F.explode(F.sequence(F.lit(1), F.lit(depth))).alias("repeat"), "place")


def random_walks(edges: DataFrame, starts: DataFrame, steps: int = 16, seed: int = 42) -> DataFrame:
    """(trace, step, node, fanout, sequential, layer): walks from the start rows (id) along edges (src, dst, ord[, layer]).

    The next node is drawn by a hash of (trace, step, seed) among a node's edges in the order of (layer, ord,
    dst); a node without edges ends its walk. Each step is a join on the present nodes. ``sequential``: the step
    goes to a neighbouring id.
    """
    layer = F.col("layer") if "layer" in edges.columns else F.lit(0)
    own = Window.partitionBy("src")
    ranked = edges.select("src", "dst", layer.cast("int").alias("layer"), "ord").withColumn("nth", F.row_number().over(own.orderBy("layer", "ord", "dst")) - 1).withColumn("fanout", F.count("*").over(own))
    degree = ranked.select("src", "fanout").distinct()
    now = starts.select(F.col("id").alias("trace"), F.col("id").alias("src"))
    out = None
    for step in range(steps):
        draw = F.pmod(F.xxhash64("trace", F.lit(step), F.lit(seed)), F.col("fanout"))
        moved = now.join(degree, "src").withColumn("nth", draw.cast("int")).drop("fanout").join(ranked, ["src", "nth"])
        row = moved.select("trace", F.lit(step).alias("step"), F.col("src").alias("node"), F.col("fanout").cast("double").alias("fanout"), (F.abs(F.col("dst") - F.col("src")) == 1).alias("sequential"), "layer")
        out = row if out is None else out.unionByName(row)
        now = moved.select("trace", F.col("dst").alias("src"))
    return out


def phase_switched(visited: Column, theta: float, length: int) -> Column:
    """Whether a walk has come to its second phase."""
    return visited >= int(theta * length)


def ram_budget(given: int | None = None, variable: str = "LODESTONE_RAM_BYTES") -> int:
    """The given bytes, else the environment's, else four fifths of the machine's memory."""
    if given:
        return given
    if os.environ.get(variable):
        return int(os.environ[variable])
    return int(0.8 * os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES"))


GB = 1 << 30

# For each profile (M0 resident, M1 hybrid, M2 paged, M3 tiered_bytes, M4 huge_bytes) the phase share, beam hint, prefetch depth and batch of a streamed build.
PROFILES = {
    "resident": (0.0, 128, 1, 0),
    "hybrid": (0.30, 160, 1, 1_000_000),
    "paged": (0.35, 192, 2, 500_000),
    "tiered_bytes": (0.35, 192, 2, 500_000),
    "huge_bytes": (0.35, 224, 2, 500_000),
}


def placement(kind: Column, size: Column, ram: Column) -> Column:
    """Profile of a vector file by element kind (``u8`` or ``f32``), bytes and memory.

    Byte vectors: huge from 400 GB on 80 to 128 GB of memory, tiered from 100 GB or three times
    memory. Float vectors: resident up to half of memory, hybrid up to twice. Else paged.
    """
    byte = F.when((size >= 400 * GB) & ram.between(80 * GB, 128 * GB), "huge_bytes").when((size >= 100 * GB) | (size / ram >= 3.0), "tiered_bytes").otherwise("paged")
    real = F.when(size <= ram / 2, "resident").when(size <= ram * 2, "hybrid").otherwise("paged")
    return F.when(kind == "u8", byte).when(kind == "f32", real).otherwise("paged")


def pools(profile: Column, ram: Column) -> Column:
    """struct(write, static, dynamic) of memory in bytes."""
    write = F.floor(ram * 0.10)
    static = F.when(profile == "resident", F.floor(ram * 0.15)).otherwise(F.floor(ram * 0.20))
    return F.struct(write.alias("write"), static.alias("static"), (ram - write - static).alias("dynamic"))


@dataclass
class IoPolicy:
    """Knobs of the prefetch model; out-of-range values are clamped."""

    fan_out: int = 8
    cold_misses: int = 2
    theta: float = 0.5
    depth: int = 1
    second_fan_out: int = 16
    layer_aware: bool = True
    sort_offsets: bool = True
    batch: int = 32

    def merged(self, text: str) -> IoPolicy:
        """This policy with the known keys of a JSON object put over it."""
        names = {f.name for f in fields(self)}
        new = IoPolicy(**(asdict(self) | {k: v for k, v in json.loads(text).items() if k in names}))
        new.fan_out, new.second_fan_out = (min(32, max(0, int(x))) for x in (new.fan_out, new.second_fan_out))
        new.cold_misses, new.theta = min(64, max(1, int(new.cold_misses))), min(1.0, max(0.0, float(new.theta)))
        return new

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)


def trace_features(traces: DataFrame) -> DataFrame:
    """(trace, mean_fanout, std_fanout, seq_locality, high_layer_share) of step rows (trace, fanout, sequential, layer)."""
    return traces.groupBy("trace").agg(F.avg("fanout").alias("mean_fanout"), F.stddev_pop("fanout").alias("std_fanout"), F.avg(F.col("sequential").cast("int")).alias("seq_locality"), F.avg((F.col("layer") >= 1).cast("int")).alias("high_layer_share"))


def policy_score(mean_fanout: Column, seq_locality: Column, high_layer_share: Column) -> Column:
    """Fan-out / 32 - 0.55 * sequential share + 0.35 * upper-layer share."""
    return mean_fanout / 32 - 0.55 * seq_locality + 0.35 * high_layer_share


def policy_cluster(score: Column) -> Column:
    return F.when(score < 0.42, 0).otherwise(1)
