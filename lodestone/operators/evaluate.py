"""Recall, percentiles and comparisons of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .numbering import cumulative


def _distinct_hits(results: DataFrame, truth: DataFrame) -> DataFrame:
    """(qid, hits): distinct result ids that are in the truth."""
    return results.select("qid", "id").distinct().join(truth.select("qid", "id").distinct(), ["qid", "id"], "left_semi").groupBy("qid").agg(F.count("*").alias("hits"))


def _sized(results: DataFrame, truth: DataFrame) -> DataFrame:
    """(qid, n_truth, n_results, hits) for every query of the truth."""
    n_truth = truth.groupBy("qid").agg(F.countDistinct("id").alias("n_truth"))
    n_results = results.groupBy("qid").agg(F.countDistinct("id").alias("n_results"))
    out = n_truth.join(n_results, "qid", "left").join(_distinct_hits(results, truth), "qid", "left")
    return out.na.fill(0, ["n_results", "hits"])


def first_k(hits: DataFrame, k: int) -> DataFrame:
    return hits.where(F.col("rank") <= k)


def recall(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """One row: hits over (queries * k)."""
    found = _sized(first_k(results, k), first_k(truth, k))
    return found.agg((F.sum("hits") / (F.count("*") * k)).alias("recall"))


def recall_by_query(results: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """qid, recall: hits over min(k, results, truth)."""
    found = _sized(first_k(results, k), first_k(truth, k))
    least = F.least(F.lit(k).cast("long"), "n_results", "n_truth")
    return found.select("qid", F.when(least > 0, F.col("hits") / least).otherwise(0.0).alias("recall"))


def recall_with_ties(results: DataFrame, truth: DataFrame, k: int, n: int) -> DataFrame:
    """k-recall-at-n: truth rows as near as the k-th count too, k hits at most; average, least and most."""
    limit = truth.where(F.col("rank") <= k).groupBy("qid").agg(F.max("distance").alias("limit"))
    wide = truth.join(limit, "qid").where(F.col("distance") <= F.col("limit"))
    found = _sized(first_k(results, n), wide).withColumn("r", F.least("hits", F.lit(k)) / F.lit(k))
    return found.agg(F.avg("r").alias("average"), F.min("r").alias("least"), F.max("r").alias("most"))


def filtered_recall(results: DataFrame, truth: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """qid, recall in percent: 100 * hits / max(min(k, truth), results); 100 where the truth is empty."""
    n_truth = truth.groupBy("qid").agg(F.countDistinct("id").alias("n_truth"))
    n_results = results.groupBy("qid").agg(F.countDistinct("id").alias("n_results"))
    out = queries.select("qid").join(n_truth, "qid", "left").join(n_results, "qid", "left").join(_distinct_hits(results, truth), "qid", "left").na.fill(0)
    below = F.greatest(F.least(F.lit(k).cast("long"), "n_truth"), "n_results")
    return out.select("qid", F.when(F.col("n_truth") == 0, 100.0).otherwise(100 * F.col("hits") / below).alias("recall"))


def pooled_recall(results: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: all hits over all truth rows, for range results."""
    found = _sized(results, truth)
    return found.agg((F.sum("hits") / F.sum("n_truth")).alias("recall"))


def _at(values: Column, index: Column) -> Column:
    return F.element_at(values, (index + 1).cast("int"))


def latency_summary(rows: DataFrame, value: str, by: list[str] | None = None, places: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """n, avg and percentiles: the sorted value at floor((n - 1) * p / 100).

    Ranks come from counts of distinct values in sorted range partitions, so equal values are one
    row and no group's values meet in one task.
    """
    by = by or []
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    summed = cumulative(counts, [*by, "_v"], "_c", "_all")
    own = counts.groupBy(*by).agg(F.sum("_c").alias("_n"), F.min("_v").alias("_low"))
    # A group's own sums are the running ones less what lies before its first value.
    first = summed.join(own, by) if by else summed.join(F.broadcast(own))
    first = first.where(F.col("_v") == F.col("_low")).select(*by, (F.col("_all") - F.col("_c")).alias("_start"))
    own = own.join(first, by) if by else own.join(F.broadcast(first))
    placed = (summed.join(own, by) if by else summed.join(F.broadcast(own))).withColumn("_hi", F.col("_all") - F.col("_start"))
    cols = [F.first("_n").alias("n"), (F.sum(F.col("_v") * F.col("_c")) / F.first("_n")).alias("avg")]
    cols += [F.min(F.when(F.col("_hi") > F.floor((F.col("_n") - 1) * p / 100), F.col("_v"))).alias(f"p{p}") for p in places]
    return placed.groupBy(*by).agg(*cols)


def percentile_stats(rows: DataFrame, value: str, p: float) -> DataFrame:
    """n, sum, mean and the sorted value at min(floor(p * n), n - 1)."""
    return _ranked(rows, value, {"value": lambda n: F.least(F.floor(n * p), n - 1)}, [F.sum(F.col("_v") * F.col("_c")).alias("total")])


def benchmark_percentiles(rows: DataFrame, value: str) -> DataFrame:
    """n, mean, median (mean of the two middle values when n is even), p90, p99 and minimum of a benchmark."""
    out = _ranked(rows, value, {"low": lambda n: F.floor((n - 1) / 2), "high": lambda n: F.floor(n / 2), "p90": lambda n: F.least(F.floor(n * 9 / 10), n - 1), "p99": lambda n: F.least(F.floor(n * 99 / 100), n - 1)}, [F.min("_v").alias("minimum")])
    return out.select("n", "mean", ((F.col("low") + F.col("high")) / 2).alias("median"), "p90", "p99", "minimum")


def _ranked(rows: DataFrame, value: str, places: dict, more: list[Column]) -> DataFrame:
    counts = rows.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    total = counts.agg(F.sum("_c").alias("_n"))  # one row
    placed = cumulative(counts, ["_v"], "_c", "_hi").join(F.broadcast(total))
    return placed.agg(F.first("_n").alias("n"), (F.sum(F.col("_v") * F.col("_c")) / F.first("_n")).alias("mean"), *more, *[F.min(F.when(F.col("_hi") > at(F.col("_n")), F.col("_v"))).alias(name) for name, at in places.items()])


def qps(n: Column, total_ms: Column) -> Column:
    return F.try_divide(n * 1000.0, total_ms)


def share(part: Column, rest: Column) -> Column:
    """part / (part + rest), 0 when both are 0: hit rate, prefetch use."""
    return F.coalesce(F.try_divide(part.cast("double"), (part + rest).cast("double")), F.lit(0.0))


def compare_runs(before: DataFrame, after: DataFrame, tolerances: dict[str, float] | None = None) -> DataFrame:
    """(metric, before, after, change[, passes]): relative change of each metric, and whether it is within its tolerance.

    A metric that was 0 changes by 0 if it still is, else infinitely.
    """
    both = before.select("metric", F.col("value").alias("before")).join(after.select("metric", F.col("value").alias("after")), "metric")
    gap = F.col("after") - F.col("before")
    out = both.withColumn("change", F.when(F.col("before") != 0, gap / F.col("before")).when(gap == 0, 0.0).otherwise(F.lit(float("inf"))))
    if tolerances:
        limit = F.create_map(*[F.lit(x) for pair in tolerances.items() for x in pair])
        out = out.withColumn("passes", F.coalesce(F.col("change") <= limit[F.col("metric")], F.lit(True)))
    return out


def per_query_report(rows: DataFrame, path: str) -> None:
    """Per-query metrics as CSV with a header."""
    rows.write.mode("overwrite").csv(path, header=True)


def recall_percent(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """The recall of ``recall_with_ties`` as a percentage."""
    return recall_with_ties(found, truth, k, k).select((F.col("average") * 100).alias("recall_percent"))


def run_summary(rows: DataFrame, path: str) -> None:
    """One row of figures as key=value lines, in the order of its columns."""
    pairs = F.array(*[F.concat(F.lit(c + "="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in rows.columns])
    rows.limit(1).select(F.explode(pairs).alias("value")).coalesce(1).write.mode("overwrite").text(path)
