"""Similarity graphs: edges (src, dst, ord), statistics, pruning, reordering, repair, and walks.

Everything here is joins and aggregates over the edge table; graphs that are built to be
walked are in ``index``.
"""

from __future__ import annotations

import heapq
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .numbering import cut, numbered
from .search import knn, matrix

#: Candidates that a prune looks at unless it is told another number; None looks at all.
MOST_CANDIDATES = 750


def knn_edges(base: DataFrame, k: int = 8) -> DataFrame:
    """(src, dst, ord, distance): every row's exact k nearest others.

    The edges are found once and stored below the checkpoint folder, as what is built on them reads them many times.
    """
    queries = base.select(F.col("id").alias("qid"), F.col("vec").alias("query"))
    found = knn(base, queries, k, exclude_self=True)
    return cut(found.select(F.col("qid").alias("src"), F.col("id").alias("dst"), F.col("rank").alias("ord"), "distance"))


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) both ways."""
    return edges.select("src", "dst").union(edges.select("dst", "src")).distinct()


def degree_stats(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: largest, mean and smallest out-degree, and nodes with fewer than two edges."""
    degree = nodes.select(F.col("id").alias("src")).join(edges.groupBy("src").agg(F.count("*").alias("n")), "src", "left").na.fill(0, ["n"])
    return degree.agg(F.max("n").alias("max_degree"), F.avg("n").alias("avg_degree"), F.min("n").alias("min_degree"), F.sum((F.col("n") < 2).cast("long")).alias("under_two"))


def reachable(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(id, level): nodes that edges reach from the start rows (id), by breadth-first levels until one adds none.

    Each level is written below the checkpoint folder, and all of them together now and then, so plans stay short.
    """
    spark = edges.sparkSession
    seen = starts.select(F.col("id").cast("long").alias("id")).distinct().withColumn("level", F.lit(0)).transform(cut)
    front = seen
    for level in itertools.count(1):
        new = front.join(edges, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        front = new.withColumn("level", F.lit(level)).transform(cut)
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if level % 32 == 0:
            seen = cut(seen.coalesce(edges.sparkSession.sparkContext.defaultParallelism))
    return spark.createDataFrame([], seen.schema).unionByName(seen)


def bfs_order(edges: DataFrame, nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """(id, new_id): breadth-first numbering, levels in id order; what isn't reached follows in id order."""
    found = reachable(edges, starts)
    all_ = nodes.select("id").join(found, "id", "left").withColumn("level", F.coalesce("level", F.lit(1 << 30)))
    return numbered(all_, ["level", "id"], "new_id").select("id", "new_id")


def renumbered(edges: DataFrame, order: DataFrame) -> DataFrame:
    """Edges by new ids."""
    a = order.select(F.col("id").alias("src"), F.col("new_id").alias("_s"))
    b = order.select(F.col("id").alias("dst"), F.col("new_id").alias("_d"))
    return edges.join(a, "src").join(b, "dst").select(F.col("_s").alias("src"), F.col("_d").alias("dst"))


def locality(edges: DataFrame) -> DataFrame:
    """One row: mean distance of the ids that edges join."""
    return edges.agg(F.avg(F.abs(F.col("src") - F.col("dst"))).alias("locality"))


def greedy_order(edges: DataFrame, nodes: DataFrame, window: int = 64) -> DataFrame:
    """(part, id, new_id): within each part, next comes the node with most neighbours shared with the last ``window`` placed.

    Greedy and sequential; nodes carry a ``part`` (a shard) that bounds what one task orders.
    """
    inside = edges.join(nodes.select(F.col("id").alias("src"), "part"), "src").select("part", "src", "dst")
    rows = nodes.select("part", F.col("id").alias("src"), F.lit(None).cast("long").alias("dst")).unionByName(inside)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        src, dst = table["src"].to_pylist(), table["dst"].to_pylist()
        own = sorted(set(src))
        near: dict[int, set[int]] = {x: set() for x in own}
        for s, d in zip(src, dst):
            if d in near:
                near[s].add(d)
                near[d].add(s)
        score, placed, left = dict.fromkeys(own, 0), [], set(own)

        def change(x: int, by: int) -> None:
            for y in near[x]:
                score[y] += by
                for z in near[y]:
                    score[z] += by
            for y in near[x]:
                heapq.heappush(heap, (-score[y], y))
                for z in near[y]:
                    heapq.heappush(heap, (-score[z], z))

        heap = [(0, x) for x in own]
        while left:
            s, x = heapq.heappop(heap)
            if x not in left:
                continue
            if -s != score[x]:
                heapq.heappush(heap, (-score[x], x))
                continue
            left.discard(x)
            placed.append(x)
            change(x, 1)
            if len(placed) > window:
                change(placed[-window - 1], -1)
        return pa.table({"part": pa.array([key[0].as_py()] * len(placed), pa.int64()), "id": pa.array(placed, pa.int64()), "new_id": pa.array(range(len(placed)), pa.int64())})

    return rows.select(F.col("part").cast("long").alias("part"), F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).groupBy("part").applyInArrow(run, "part long, id long, new_id long")


def prune_candidates(center: np.ndarray, ids: np.ndarray, vectors: np.ndarray, most: int, alpha: float, candidates: int | None = MOST_CANDIDATES) -> list[int]:
    """Places of the kept candidates: in order of (distance, id), one goes if a kept one is nearer to it, times alpha, than the centre."""
    d = ((vectors - center) ** 2).sum(1)
    kept: list[int] = []
    for i in np.lexsort((ids, np.round(d, 9)))[:candidates].tolist():
        if all(alpha * ((vectors[i] - vectors[j]) ** 2).sum() > d[i] for j in kept):
            kept.append(i)
            if len(kept) == most:
                break
    return kept


def ladder_prune(center: np.ndarray, ids: np.ndarray, vectors: np.ndarray, most: int, alpha: float = 1.2, saturate: bool = False, candidates: int | None = MOST_CANDIDATES) -> list[int]:
    """Places of the kept candidates when alpha rises from 1 in steps of min(alpha, 1.2) until enough are kept.

    A candidate's occlusion is the greatest ratio of its distance to the centre over that to a kept one;
    it waits while that is beyond the current alpha. ``saturate`` fills up with the nearest left.
    """
    d = ((vectors - center) ** 2).sum(1)
    order = np.lexsort((ids, np.round(d, 9)))[:candidates].tolist()
    occlusion, kept, now = dict.fromkeys(order, 0.0), [], 1.0
    while True:
        for i in order:
            if len(kept) == most:
                break
            if i in kept or occlusion[i] > now:
                continue
            kept.append(i)
            for j in order:
                if j not in kept and occlusion[j] <= alpha:
                    gap = ((vectors[i] - vectors[j]) ** 2).sum()
                    occlusion[j] = max(occlusion[j], d[j] / gap if gap > 0 else np.inf)
        if len(kept) == most or now >= alpha:
            break
        now = min(alpha, now * min(alpha, 1.2))
    if saturate:
        kept += [i for i in order if i not in kept][: most - len(kept)]
    return kept


def robust_prune(candidates: DataFrame, base: DataFrame, most: int = 32, alpha: float = 1.2, looked: int | None = MOST_CANDIDATES) -> DataFrame:
    """(src, dst, ord): each node's candidates (src, dst) thinned.

    The two joins bring vectors by id; a group is one node's candidates, the ``looked`` nearest of
    them (None: all), chosen before grouping.
    """
    from ..functions.vectors import squared_l2

    vec = base.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    pairs = candidates.select("src", "dst").where("src <> dst").distinct()
    full = pairs.join(vec.withColumnRenamed("id", "dst").withColumnRenamed("vec", "there"), "dst").join(vec.withColumnRenamed("id", "src").withColumnRenamed("vec", "here"), "src")
    near = Window.partitionBy("src").orderBy("d", "dst")
    full = full.withColumn("d", F.round(squared_l2(F.col("here"), F.col("there")), 9))
    if looked is not None:
        full = full.withColumn("k", F.row_number().over(near)).where(F.col("k") <= looked)

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids = table["dst"].to_numpy()
        kept = prune_candidates(matrix(table["here"].slice(0, 1))[0], ids, matrix(table["there"]), most, alpha, looked)
        return pa.table({"src": pa.array([key[0].as_py()] * len(kept), pa.int64()), "dst": pa.array(ids[kept], pa.int64()), "ord": pa.array(range(1, len(kept) + 1), pa.int32())})

    return full.select("src", "dst", "here", "there").groupBy("src").applyInArrow(run, "src long, dst long, ord int")


def prune_range(edges: DataFrame, base: DataFrame, low: int, high: int, most: int = 32, alpha: float = 1.2) -> DataFrame:
    """Edges with the nodes of an id range pruned anew."""
    own = F.col("src").between(low, high)
    return edges.where(~own).select("src", "dst", "ord").unionByName(robust_prune(edges.where(own), base, most, alpha))


def add_edges(edges: DataFrame, new: DataFrame, base: DataFrame, most: int = 32, alpha: float = 1.2) -> DataFrame:
    """Edges and the new ones in both directions; only nodes that grow beyond ``most`` are pruned."""
    both = edges.select("src", "dst").union(undirected(new)).distinct()
    full = both.groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") > most).select("src")
    pruned = robust_prune(both.join(full, "src", "left_semi"), base, most, alpha)
    rest = both.join(full, "src", "left_anti").withColumn("ord", F.row_number().over(Window.partitionBy("src").orderBy("dst")).cast("int"))
    return rest.unionByName(pruned)


def drop_deleted(edges: DataFrame, deleted: DataFrame) -> DataFrame:
    """Edges without those to or from deleted nodes (id)."""
    gone = deleted.select("id").distinct()
    return edges.join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti").join(gone.withColumnRenamed("id", "src"), "src", "left_anti").select(*edges.columns)


def touching_deleted(edges: DataFrame, deleted: DataFrame) -> DataFrame:
    """(src): live nodes that have an edge to a deleted one."""
    gone = deleted.select("id").distinct()
    return edges.join(gone.withColumnRenamed("id", "dst"), "dst", "left_semi").join(gone.withColumnRenamed("id", "src"), "src", "left_anti").select("src").distinct()


def delete_and_repair(edges: DataFrame, deleted: DataFrame, base: DataFrame | None = None, most: int = 32, alpha: float = 1.2, hops: int = 1) -> DataFrame:
    """(src, dst): deleted nodes go; each node that pointed to one gets its (live) out-neighbours instead.

    ``hops`` 2 offers their neighbours too. With ``base`` the changed nodes are pruned.
    """
    plain = edges.select("src", "dst")
    gone = deleted.select(F.col("id").alias("g")).distinct()
    lost = plain.join(gone, F.col("dst") == F.col("g"), "left_semi")
    offer = lost.alias("a").join(plain.alias("b"), F.col("a.dst") == F.col("b.src")).select(F.col("a.src").alias("src"), F.col("b.dst").alias("dst"))
    if hops > 1:
        offer = offer.union(offer.alias("a").join(plain.alias("b"), F.col("a.dst") == F.col("b.src")).select(F.col("a.src").alias("src"), F.col("b.dst").alias("dst")))
    live = drop_deleted(plain.union(offer).where("src <> dst").distinct(), deleted)
    if base is None:
        return live
    changed = touching_deleted(edges, deleted)
    return live.join(changed, "src", "left_anti").union(robust_prune(live.join(changed, "src", "left_semi"), base, most, alpha).select("src", "dst"))


def navigation_nodes(edges: DataFrame, starts: DataFrame, budget_bytes: int, node_bytes: int = 2048) -> DataFrame:
    """(id, level): the first nodes in breadth-first order that fit the budget; to broadcast or keep in memory."""
    return reachable(edges, starts).orderBy("level", "id").limit(budget_bytes // node_bytes)
