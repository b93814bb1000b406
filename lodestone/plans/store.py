"""A vector store over tables: open, insert, search, delete, flush; and search specifications."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import Metric, normalized
from ..operators import cluster, filters, index, mutate, quantize, search


@dataclass
class Spec:
    """One search: what to return and how to get it."""

    k: int = 10
    length: int = 100
    metric: str = "l2"
    mode: str = "auto"  # exact, partitions, graph, codes
    filter: str | None = None
    beta: float | None = None
    radius: float | None = None
    inner: float | None = None
    attribute: str | None = None
    per_value: int = 2
    page: int = 1
    probes: int = 3
    multiple: int = 8
    width: int = 1

    def checked(self) -> Spec:
        Metric.parse(self.metric)
        if self.k < 1:
            raise ValueError("k must be positive")
        if self.length < self.k:
            raise ValueError(f"length {self.length} is below k {self.k}")
        return self

    @classmethod
    def from_json(cls, text: str) -> Spec:
        return cls(**json.loads(text)).checked()


MODES = ("auto", "exact", "partitions", "graph", "codes")


def strategy(spec: Spec) -> str:
    """``auto`` is exact: approximation is the caller's choice. Searches that only exact search answers refuse other modes."""
    special = spec.filter or spec.radius is not None or spec.attribute or spec.beta is not None
    if spec.mode not in MODES:
        raise ValueError(f"unknown mode: {spec.mode!r}")
    if special and spec.mode not in ("auto", "exact"):
        raise ValueError(f"mode {spec.mode} has no filter, radius, attribute or beta")
    return "exact" if spec.mode == "auto" else spec.mode


@dataclass
class VectorStore:
    """Rows (id, vec, and a ``document`` of JSON attributes if there is one) with pending changes.

    Changes are visible at once: reads see the base without changed or deleted ids, and the
    last change of each. ``flush`` writes the merged table as a new version. Indexes are built
    once (``build_graph``, ``build_partitions``, ``build_codes``), stored beside the table and found again
    by ``open``; searches by them leave out changed ids and add pending rows, searched exactly.
    """

    spark: SparkSession
    base: DataFrame
    path: str | None = None
    delta: DataFrame | None = None
    deleted: DataFrame | None = None
    metrics: dict[str, int] = field(default_factory=lambda: {"searches": 0, "inserts": 0, "deletes": 0})
    #: Bytes of pending vectors at which an insert flushes; None: never.
    limit_bytes: int | None = None
    _seq: int = 0

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> VectorStore:
        return cls(spark, spark.read.parquet(path), path)

    def _beside(self, kind: str) -> str:
        if not self.path:
            raise ValueError("a store without a path has no indexes")
        return f"{self.path.rstrip('/')}.{kind}"

    def _has(self, kind: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._beside(kind))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def build_graph(self, metric: str = "l2", **options) -> index.GraphIndex:
        """Build and store the graph of the flushed rows."""
        self._drop("graph")
        return index.GraphIndex.build(self.base, self._beside("graph"), metric, **options)

    def build_partitions(self, shards: int = 16, rounds: int = 4, metric: str = "l2") -> None:
        """Store the flushed rows by the nearest of so many k-means pivots."""
        rows = self.base
        if Metric.parse(metric) is Metric.COSINE:
            rows = rows.withColumn("vec", normalized(F.col("vec"))).where("vec is not null")
        cluster.write_partitions(self.base, cluster.kmeans(rows.where("vec is not null"), shards, rounds), self._beside("partitions"), metric)

    def build_codes(self, chunks: int = 8, sample_rows: int = 20_000) -> None:
        """Store product codes of the flushed rows, their codebook learned from a hash sample of about that many rows."""
        n = self.base.count()
        share = min(1.0, sample_rows / max(1, n))
        got = cluster.sampled(self.base, share).select("vec").where("vec is not null").limit(2 * sample_rows).collect()
        data = np.array([r.vec for r in got], float)
        offsets = quantize.chunk_offsets(data.shape[1], min(chunks, data.shape[1]))
        book = quantize.train_codebook(data, offsets)
        quantize.save_codebook(self.spark, book, self._beside("codebook"))
        quantize.encode(self.base, book, offsets).write.mode("overwrite").parquet(self._beside("codes"))

    def _drop(self, kind: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._beside(kind))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _changed_ids(self) -> DataFrame | None:
        """Ids that the stored indexes don't know the present state of."""
        out = None
        for part in (self.delta, self.deleted):
            if part is not None:
                out = part.select("id") if out is None else out.union(part.select("id"))
        return out.distinct() if out is not None else None

    def _indexed_search(self, queries: DataFrame, spec: Spec, how: str) -> DataFrame:
        """A search by a stored index, merged with an exact one of the pending rows."""
        kind = {"graph": "graph", "partitions": "partitions", "codes": "codes"}[how]
        if not self._has(kind):
            raise ValueError(f"no stored {kind}: build_{kind} first")
        most = spec.k * spec.page
        wide = max(spec.length, most)
        changed = self._changed_ids()
        # With changes more hits are asked for, so that enough are left.
        k = most if changed is None else wide
        if how == "graph":
            found = index.GraphIndex.open(self.spark, self._beside("graph"))
            if Metric.parse(found.header["metric"]) is not Metric.parse(spec.metric):
                raise ValueError(f"the stored graph is for {found.header['metric']}, not {spec.metric}")
            hits = found.search(queries, k, wide, spec.width)
        elif how == "partitions":
            path = self._beside("partitions")
            hits = cluster.probe(self.spark.read.parquet(f"{path}/shards"), self.spark.read.parquet(f"{path}/pivots"), queries, k, spec.probes, spec.metric)
        else:
            book = quantize.load_codebook(self.spark, self._beside("codebook"))
            offsets = [0, *np.cumsum([b.shape[1] for b in book]).tolist()]
            hits = quantize.reranked_knn(self.base, self.spark.read.parquet(self._beside("codes")), queries, book, offsets, k, spec.multiple, spec.metric)
        parts = [hits]
        if changed is not None:
            parts = [hits.join(changed, "id", "left_anti")]
            pending = self.rows().join(changed, "id", "left_semi")
            parts.append(search.knn(pending, queries, most, spec.metric))
        merged = search.merge_hits(parts, most)
        return merged.where(F.col("rank") > spec.k * (spec.page - 1))

    def __enter__(self) -> VectorStore:
        return self

    def __exit__(self, *_) -> None:
        if self.path and (self.delta is not None or self.deleted is not None):
            self.flush()

    def insert(self, rows: DataFrame) -> None:
        """Upsert; the caller's ids stay."""
        self._seq += 1
        new = rows.select(*self.base.columns).withColumn("_seq", F.lit(self._seq))
        self.delta = new if self.delta is None else self.delta.unionByName(new)
        self.metrics["inserts"] += 1
        if self.limit_bytes is not None and (self.delta.agg(F.sum(F.size("vec") * 4).alias("n")).first().n or 0) >= self.limit_bytes:
            self.flush()

    def delete(self, ids: DataFrame) -> None:
        self._seq += 1
        gone = ids.select("id").withColumn("_seq", F.lit(self._seq))
        self.deleted = gone if self.deleted is None else self.deleted.unionByName(gone)
        self.metrics["deletes"] += 1

    def undelete(self, ids: DataFrame) -> None:
        if self.deleted is not None:
            self.deleted = self.deleted.join(ids.select("id"), "id", "left_anti")

    def rows(self) -> DataFrame:
        """All rows that are alive, pending ones too."""
        out = self.base
        delta = self.delta
        if self.deleted is not None:
            last = self.deleted.groupBy("id").agg(F.max("_seq").alias("_gone"))
            out = out.join(last, "id", "left_anti")
            if delta is not None:
                delta = delta.join(last, "id", "left").where("_gone is null or _seq > _gone").drop("_gone")
        if delta is not None:
            newest = mutate.last_writes(delta, "id", "_seq").drop("_seq")
            out = mutate.upsert(out, newest)
        return out

    def card(self) -> int:
        return self.rows().count()

    def get(self, ids: list[int]) -> DataFrame:
        return self.rows().where(F.col("id").isin(ids))

    def set_attributes(self, documents: DataFrame) -> None:
        """Give ids new attribute documents (id, document)."""
        self.insert(self.rows().drop("document").join(documents, "id"))

    def flush(self) -> None:
        """Write the merged rows and read them back; pending changes are then part of the base."""
        merged = self.rows()
        if self.path:
            self.path = f"{self.path.rstrip('/')}.{self._seq}"
            merged.write.mode("overwrite").parquet(self.path)
            merged = self.spark.read.parquet(self.path)
        self.base, self.delta, self.deleted = merged, None, None

    def search(self, queries: DataFrame, spec: Spec | None = None, with_columns: list[str] | None = None) -> DataFrame:
        """Results of a specification; ``with_columns`` joins columns of the rows to the hits."""
        spec = (spec or Spec()).checked()
        self.metrics["searches"] += 1
        rows, how = self.rows(), strategy(spec)
        hits = run_search(rows, queries, spec) if how == "exact" else self._indexed_search(queries, spec, how)
        return hits if not with_columns else hits.join(rows.select("id", *with_columns), "id")


def run_search(rows: DataFrame, queries: DataFrame, spec: Spec) -> DataFrame:
    """Plan and build one exact search."""
    if strategy(spec) != "exact":
        raise ValueError(f"mode {spec.mode} needs a store with that index")
    predicate = filters.json_filter(spec.filter, F.parse_json("document")) if spec.filter else None
    if spec.radius is not None:
        return search.range_search(rows if predicate is None else rows.where(predicate), queries, spec.radius, spec.inner, spec.metric)
    if spec.beta is not None and predicate is not None:
        return search.beta_knn(rows, queries, predicate, spec.k, spec.beta, spec.metric)
    if predicate is not None:
        rows = rows.where(predicate)
    if spec.attribute:
        return search.diverse_knn(rows, queries, F.col(spec.attribute), spec.k, spec.per_value, spec.metric)
    return search.knn(rows, queries, spec.k, spec.metric, page=spec.page)


def run_jobs(spark: SparkSession, text: str) -> list[dict]:
    """Declarative benchmarks: {"jobs": [{"name", "vectors", "queries", "spec", "reps"}]}; each with seconds and rate.

    ``vectors`` is a store's path; its indexes serve specs whose mode asks for them."""
    import time

    out = []
    for job in json.loads(text)["jobs"]:
        store, queries = VectorStore.open(spark, job["vectors"]), spark.read.parquet(job["queries"])
        spec, seconds = Spec(**job.get("spec", {})).checked(), []
        n = queries.count()
        for _ in range(job.get("reps", 1)):
            start = time.perf_counter()
            store.search(queries, spec).write.format("noop").mode("overwrite").save()
            seconds.append(time.perf_counter() - start)
        out.append({"name": job["name"], "seconds": min(seconds), "qps": n / min(seconds)})
    return out
