"""JSON-lines labels, filter queries and filtered ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.filters import parse_filter


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, document): one JSON object a line, the whole as VARIANT."""
    v = F.parse_json("value")
    return spark.read.text(path).where("trim(value) <> ''").select(F.variant_get(v, "$.doc_id", "long").alias("doc_id"), v.alias("document"))


def read_filters(spark: SparkSession, path: str) -> dict[int, tuple]:
    """Filter trees by query_id; a list of queries is small and comes to the driver."""
    rows = spark.read.text(path).where("trim(value) <> ''").select(F.get_json_object("value", "$.query_id").cast("long").alias("q"), F.get_json_object("value", "$.filter").alias("f")).collect()
    return {r.q: parse_filter(r.f) for r in rows}


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(qid, rank, id, distance) of lines {query_id, count, ids, distances}."""
    rows = spark.read.schema("query_id long, count long, ids array<long>, distances array<double>").json(path)
    pairs = rows.select(F.col("query_id").alias("qid"), F.posexplode(F.arrays_zip("ids", "distances")).alias("p", "x"))
    return pairs.select("qid", (F.col("p") + 1).cast("int").alias("rank"), F.col("x.ids").alias("id"), F.col("x.distances").alias("distance"))


def _typed(value):
    """A number, if the text is one, else the text, as JSON."""
    number = F.regexp_extract(value, r"^-?\d+(\.\d+)?$", 0)
    return F.when(number != "", value).otherwise(F.concat(F.lit('"'), F.regexp_replace(value, r'(["\\])', r"\\$1"), F.lit('"')))


def _members(pairs, operator: str | None = None):
    """Comma-joined JSON members of k=v texts; those without one ``=`` are skipped."""
    good = F.filter(pairs, lambda p: F.size(F.split(p, "=")) == 2)

    def member(p):
        key, value = F.trim(F.split(p, "=")[0]), _typed(F.trim(F.split(p, "=")[1]))
        value = value if operator is None else F.concat(F.lit('{"' + operator + '":'), value, F.lit("}"))
        return F.concat(F.lit('"'), key, F.lit('":'), value)

    return F.array_join(F.transform(good, member), ",")


def convert_labels(lines: DataFrame) -> DataFrame:
    """(id, line) with ``k=v,k=v`` as JSON lines with a doc_id."""
    doc_id = F.concat(F.lit('"doc_id":'), F.col("id").cast("string"))
    members = _members(F.split("line", ","))
    return lines.select(F.concat(F.lit("{"), F.concat_ws(",", doc_id, F.when(members != "", members)), F.lit("}")).alias("value"))


def convert_queries(lines: DataFrame) -> DataFrame:
    """(id, line) with ``k=v&k=v`` as JSON lines {query_id, filter} of equalities."""
    return lines.select(F.concat(F.lit('{"query_id":'), F.col("id").cast("string"), F.lit(',"filter":{'), _members(F.split("line", "&"), "$eq"), F.lit("}}")).alias("value"))


def with_payload(vectors: DataFrame, payload: DataFrame) -> DataFrame:
    """Vectors and their associated data, paired by id."""
    return vectors.join(payload, "id")
