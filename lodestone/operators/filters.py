"""Attribute filters: a JSON language, label expressions, attribute dictionaries and posting lists."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .numbering import numbered

# Fixed values of the filter language.
COMPARISONS = ("$eq", "$ne", "$lt", "$lte", "$gt", "$gte")
MOST_DEPTH = 2


class FilterError(ValueError):
    """A filter that isn't of the language."""


def parse_filter(source: str | dict, normalize: Callable[[str], str] = lambda name: name) -> tuple:
    """The filter as a tree: ("and"|"or", parts), ("not", part), ("cmp", path, op, value)."""
    tree = json.loads(source) if isinstance(source, str) else source
    return _parse(tree, 0, normalize)


def _parse(node, depth: int, normalize) -> tuple:
    if not isinstance(node, dict) or not node:
        raise FilterError("a filter is an object with at least one key")
    if depth > MOST_DEPTH:
        raise FilterError(f"filters nest {MOST_DEPTH} deep at most")
    parts = []
    for key, value in node.items():
        if key in ("$and", "$or"):
            if not isinstance(value, list) or not value:
                raise FilterError(f"{key} needs an array with at least one filter")
            parts.append((key[1:], [_parse(v, depth + 1, normalize) for v in value]))
        elif key == "$not":
            parts.append(("not", _parse(value, depth + 1, normalize)))
        elif key.startswith("$"):
            raise FilterError(f"unknown operator {key}")
        else:
            if not isinstance(value, dict) or not value:
                raise FilterError(f"{key} needs an object of comparisons")
            for op, operand in value.items():
                if op not in COMPARISONS:
                    raise FilterError(f"unknown comparison {op}")
                if op not in ("$eq", "$ne") and (isinstance(operand, bool) or not isinstance(operand, int | float)):
                    raise FilterError(f"{op} needs a number")
                parts.append(("cmp", normalize(key), op, operand))
    return parts[0] if len(parts) == 1 else ("and", parts)


def _kind(v: Column) -> Column:
    """Type class of a variant: int, real, or what Spark calls it."""
    s = F.schema_of_variant(v)
    return F.when(s == "BIGINT", "int").when(s.startswith("DECIMAL") | s.isin("DOUBLE", "FLOAT"), "real").otherwise(s)


def to_column(tree: tuple, document: Column) -> Column:
    """The tree as a Boolean Column over a VARIANT document; never null.

    A missing field makes every comparison false, $ne too; a JSON null is a value. Equality
    needs the same JSON type (1 is not 1.0); ranges compare any numbers.
    """
    if tree[0] in ("and", "or"):
        parts = [to_column(t, document) for t in tree[1]]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if tree[0] == "and" else out | p
        return out
    if tree[0] == "not":
        return ~to_column(tree[1], document)
    _, path, op, value = tree
    place = "$" + "".join(f"['{p}']" for p in path.split("."))
    field = F.try_variant_get(document, place, "variant")
    if op in ("$eq", "$ne"):
        other = F.parse_json(F.lit(json.dumps(value)))
        # The real number 1.0 is written 1.0 in JSON, which Spark reads as a decimal.
        same = (_kind(field) == _kind(other)) & (F.to_json(field) == F.to_json(other))
        return F.coalesce(same if op == "$eq" else ~same, F.lit(False)) & field.isNotNull()
    number = F.when(_kind(field).isin("int", "real"), F.try_variant_get(document, place, "double"))
    limit = F.lit(float(value))
    return F.coalesce({"$lt": number < limit, "$lte": number <= limit, "$gt": number > limit, "$gte": number >= limit}[op], F.lit(False))


def json_filter(source: str | dict, document: Column, normalize: Callable[[str], str] = lambda name: name) -> Column:
    """A filter over a column of JSON text (or VARIANT)."""
    return to_column(parse_filter(source, normalize), document)


def show(tree: tuple, indent: int = 0) -> str:
    """A tree as indented text."""
    pad = "  " * indent
    if tree[0] in ("and", "or"):
        return f"{pad}{tree[0].upper()}\n" + "\n".join(show(t, indent + 1) for t in tree[1])
    if tree[0] == "not":
        return f"{pad}NOT\n{show(tree[1], indent + 1)}"
    return f"{pad}{tree[1]} {tree[2][1:]} {json.dumps(tree[3])}"


def matches(docs: DataFrame, document: Column, filters: dict[int, str]) -> DataFrame:
    """(query_id, doc_id) of every match, all filters in one scan."""
    tests = F.array(*[F.when(json_filter(f, document), F.lit(q)) for q, f in filters.items()])
    return docs.select("doc_id", F.explode(F.array_compact(tests)).alias("query_id")).select(F.col("query_id").cast("long").alias("query_id"), "doc_id")


def label_match(query: str, labels: Column) -> Column:
    """Comma-separated labels against "a|b & c": every & part needs one of its | tokens among the labels."""
    base = F.transform(F.split(labels, ","), lambda x: F.trim(x))
    out = F.lit(True)
    for part in query.split("&"):
        out = out & F.arrays_overlap(base, F.array(*[F.lit(t.strip()) for t in part.split("|")]))
    return F.coalesce(out, F.lit(False))


# --- flattened attributes, dictionary, postings -------------------------------


def nesting(document: Column) -> Column:
    """How deep a variant's objects and arrays are nested, at least; 0 for a plain value."""
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    signs = F.split(F.regexp_replace(F.schema_of_variant(document), "[^<>]", ""), "")

    def step(a: Column, c: Column) -> Column:
        now = a["now"] + F.when(c == "<", 1).when(c == ">", -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(a["most"], now).alias("most"))

    return F.aggregate(signs, start, step, lambda a: a["most"])


def flatten_json(docs: DataFrame, id_col: str, document: Column, separator: str = ".", levels: int | None = None) -> DataFrame:
    """(doc_id, path, kind, value): every leaf of a JSON document; array places are part of the path.

    One explode for each level; the deepest document's levels are measured in a pass of their own
    unless ``levels`` is given. Elements of one array that differ in kind count as one level of it.
    """
    level = docs.select(F.col(id_col).alias("doc_id"), F.lit("").alias("path"), document.alias("v"))
    out, spark = None, docs.sparkSession
    while True:
        # Arrays of mixed kinds hide what is below, so the next levels are measured when they are reached.
        ahead = level.agg(F.max(nesting(F.col("v")))).first()[0] if levels is None else levels - 1
        if ahead is None:
            break
        for _ in range(ahead + 1):
            opened = level.withColumn("s", F.schema_of_variant("v"))
            nested = F.col("s").startswith("OBJECT<") | F.col("s").startswith("ARRAY<")
            leaf = opened.where(~nested).select("doc_id", "path", F.when(F.col("s") == "BIGINT", "int").when(F.col("s").startswith("DECIMAL") | (F.col("s") == "DOUBLE"), "real").when(F.col("s") == "BOOLEAN", "bool").when(F.col("s") == "VOID", "null").otherwise("string").alias("kind"), F.try_variant_get("v", "$", "string").alias("value"))
            out = leaf if out is None else out.unionByName(leaf)
            view = f"nested_{uuid.uuid4().hex}"
            opened.where(nested).createOrReplaceTempView(view)
            step = F.when(F.col("path") == "", F.col("name")).otherwise(F.concat("path", F.lit(separator), F.col("name")))
            level = spark.sql(f"select doc_id, path, coalesce(key, cast(pos as string)) as name, value as v from {view}, lateral variant_explode(v)").select("doc_id", step.alias("path"), "v")
            spark.catalog.dropTempView(view)
        if levels is not None:
            break
    return out if out is not None else spark.createDataFrame([], level.select("doc_id").schema.add("path", "string").add("kind", "string").add("value", "string"))


def sort_key(path: Column, kind: Column, value: Column) -> Column:
    """A string that sorts as (path, kind, value) does: whole numbers as 16 hexadecimal digits from the least
    number up, real ones by their bits in the order of their values, texts and booleans as they are."""
    number = F.expr("try_cast(value as bigint)") if value is None else value.try_cast("bigint")
    whole = F.lpad(F.hex(number.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))), 16, "0")
    real = ordered_bits(value.try_cast("double"))
    letter = F.when(kind == "int", "I").when(kind == "real", "F").when(kind == "bool", "B").otherwise("S")
    spelled = F.when(kind == "int", whole).when(kind == "real", real).otherwise(F.coalesce(value, F.lit("")))
    return F.concat_ws("\x1f", path, letter, spelled)


@F.pandas_udf(StringType())
def ordered_bits(x: pd.Series) -> pd.Series:
    """A double's bits as 16 hexadecimal digits that sort as the values do; null for null."""
    bits = x.to_numpy(np.float64, na_value=np.nan).view(np.uint64)
    bits = np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))
    return pd.Series([f"{b:016x}" for b in bits.tolist()], index=x.index).where(x.notna(), None)


def attribute_dictionary(attributes: DataFrame) -> DataFrame:
    """(path, kind, value, attr_id): dense numbers from 0 in the order of (path, kind, value)."""
    keys = ["path", "kind", "value"]
    return numbered(attributes.select(*keys).distinct(), keys, "attr_id").select(*keys, "attr_id")


def postings(attributes: DataFrame) -> DataFrame:
    """(path, kind, value, doc_id), one row for each posting; lists are never gathered in one row."""
    return attributes.select("path", "kind", "value", "doc_id").distinct()


def lookup(index: DataFrame, path: str, op: str, value) -> DataFrame:
    """Doc ids of one comparison on a posting table; ranges look at whole and real numbers alike."""
    own = index.where(F.col("path") == path)
    if op in ("$eq", "$ne"):
        kind = "bool" if isinstance(value, bool) else "int" if isinstance(value, int) else "real" if isinstance(value, float) else "null" if value is None else "string"
        spelled = json.dumps(value) if kind in ("bool", "int", "real") else value
        same = (F.col("kind") == kind) & F.col("value").eqNullSafe(F.lit(spelled))
        return own.where(same if op == "$eq" else ~same).select("doc_id").distinct()
    number = F.expr("try_cast(value as double)")
    test = {"$lt": number < value, "$lte": number <= value, "$gt": number > value, "$gte": number >= value}[op]
    return own.where(F.col("kind").isin("int", "real") & test).select("doc_id").distinct()


def query_index(index: DataFrame, everything: DataFrame, tree: tuple) -> DataFrame:
    """Doc ids of a filter tree by set operations on posting lists; $not by anti-join with all documents."""
    if tree[0] == "cmp":
        return lookup(index, *tree[1:])
    if tree[0] == "not":
        return everything.select("doc_id").distinct().join(query_index(index, everything, tree[1]), "doc_id", "left_anti")
    parts = [query_index(index, everything, t) for t in tree[1]]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "doc_id", "left_semi") if tree[0] == "and" else out.union(p).distinct()
    return out


def remove_document(index: DataFrame, doc_ids: list[int]) -> DataFrame:
    """The posting table without some documents."""
    return index.where(~F.col("doc_id").isin(doc_ids))


def update_document(index: DataFrame, new: DataFrame) -> DataFrame:
    """The posting table with the documents of ``new`` (flattened attributes) replaced."""
    return index.join(new.select("doc_id").distinct(), "doc_id", "left_anti").select(*index.columns).unionByName(postings(new))
