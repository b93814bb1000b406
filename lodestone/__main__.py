"""Command line: probe, import and export of vector files, ground truth, search evaluation, generation.

python -m lodestone probe FILE
python -m lodestone import FILE TABLE | export TABLE FILE
python -m lodestone build TABLE INDEX --metric l2 --m 16 --chunks 8 | reorder EDGES OUT
python -m lodestone truth TABLE QUERIES OUT --k 10 --metric l2
python -m lodestone evaluate TABLE QUERIES TRUTH --spec '{"mode": "graph"}'
python -m lodestone generate TABLE --rows 1000 --dim 64
python -m lodestone contrast TABLE QUERIES
python -m lodestone jobs FILE
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import cluster, evaluate, generate, graph, index, search
from .plans.store import Spec, VectorStore, run_jobs
from .sources import files


def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="lodestone", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = top.add_subparsers(dest="what", required=True)
    for name, places in {"probe": ["file"], "import": ["file", "table"], "export": ["table", "file"], "truth": ["table", "queries", "out"], "evaluate": ["table", "queries", "truth"], "generate": ["table"], "build": ["table", "index"], "reorder": ["edges", "out"], "contrast": ["table", "queries"], "jobs": ["file"]}.items():
        p = sub.add_parser(name)
        for place in places:
            p.add_argument(place)
        p.add_argument("--k", type=int, default=10)
        p.add_argument("--metric", default="l2")
        p.add_argument("--spec", default="{}")
        p.add_argument("--rows", type=int, default=1000)
        p.add_argument("--dim", type=int, default=64)
        p.add_argument("--m", type=int, default=16)
        p.add_argument("--chunks", type=int, default=0)
        p.add_argument("--start", type=int, default=0)
    a = top.parse_args(argv)
    if a.what == "probe":
        dim, rows = files.probe(a.file)
        print(json.dumps({"kind": files.detect_kind(a.file), "dimensions": dim, "rows": rows}))
        return
    spark = SparkSession.builder.getOrCreate()
    if a.what == "import":
        files.read_vectors(spark, a.file).write.mode("overwrite").parquet(a.table)
    elif a.what == "export":
        files.write_vectors(spark.read.parquet(a.table), a.file, files.KINDS.keys() & {a.file.rsplit(".", 1)[-1]} and a.file.rsplit(".", 1)[-1] or "bin")
    elif a.what == "generate":
        generate.on_sphere(spark, a.rows, a.dim).write.mode("overwrite").parquet(a.table)
    elif a.what == "build":
        print(json.dumps(index.GraphIndex.build(spark.read.parquet(a.table), a.index, a.metric, a.m, chunks=a.chunks).header))
    elif a.what == "reorder":
        edges = spark.read.parquet(a.edges)
        nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
        order = graph.bfs_order(edges, nodes, nodes.where(F.col("id") == a.start))
        graph.renumbered(edges, order).write.mode("overwrite").parquet(a.out)
    elif a.what == "jobs":
        with open(a.file) as f:
            print(json.dumps(run_jobs(spark, f.read())))
    else:
        base = spark.read.parquet(a.table)
        queries = spark.read.parquet(a.queries).select(F.col("id").alias("qid"), F.col("vec").alias("query"))
        if a.what == "truth":
            search.knn(base, queries, a.k, a.metric).write.mode("overwrite").parquet(a.out)
        elif a.what == "contrast":
            print(json.dumps({"contrast": cluster.relative_contrast(base, queries, a.k).first().contrast}))
        else:
            spec = Spec(**({"k": a.k, "metric": a.metric} | json.loads(a.spec))).checked()
            print(json.dumps({"recall": evaluate.recall(VectorStore.open(spark, a.table).search(queries, spec), spark.read.parquet(a.truth), spec.k).first().recall}))


if __name__ == "__main__":
    main()
