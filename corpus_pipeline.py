"""Five stages that turn ``documents`` into packed training sequences.

Each function takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as
Parquet and reads again as the next one's docs. All but the last return the columns of docs.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, jaccard, langid, packing, secrets
from lodestone.llm.common import Tables

#: Words of a shingle and percent of similarity that make near duplicates.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def row_key() -> Column:
    """What tells documents apart: doc_id and the text's digest, as bytes in the order of doc_id.

    A null id comes after all ids; a null text isn't the empty one.
    """
    least = F.lit(-(1 << 63)).cast("long")
    id_ = F.coalesce(F.concat(F.lit("0"), F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(least)), 16, "0")), F.lit("1"))
    text = F.coalesce(F.concat(F.lit("1"), F.substring(F.sha2(F.encode("text", "UTF-8"), 256), 1, 31)), F.lit("0"))
    return F.concat(id_, text).cast("binary")


def unused(docs: DataFrame, name: str) -> str:
    """name, or a longer one that no column of docs begins with."""
    while any(c.lower().startswith(name) for c in docs.columns):
        name += "_"
    return name


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one or several of the languages that are learned from all labelled ones of docs itself.

    A document goes if its text is null or has no letter, or if the field is too unsure of its
    words one by one (junk, text of other languages), compared with all labelled ones. Without labelled documents nothing is
    learned: then only texts without a letter go. Repeated rows fare alike; an empty table
    gives no rows; columns of any name stay as they are.
    """
    model = langid.fit(docs)
    if not model.langs:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    name = unused(docs, "lang_")
    known = Tables(spark, "languages").write(langid.identify(docs, model, name))
    model.usual = langid.median_sure(known.where(F.col("lang").isNotNull()).select(name + "sure"))
    return known.where((F.col(name + "pred") != "und") & (F.col(name + "sure") >= F.lit(model.least_sure()))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, the one with the smallest doc_id (null last).

    Rows of one doc_id and one text are one document and stay once; different texts under one
    doc_id are different documents. Documents without words are nobody's duplicates. An empty
    table gives no rows; very long texts are compared whole; columns of any name stay as they are.
    """
    key = unused(docs, "_key")
    keyed = docs.withColumn(key, row_key())
    found = jaccard.jaccard_components(keyed, NEAR_WORDS, NEAR_PERCENT, key)
    stay = found.where(F.col("component_id") == F.col(key)).select(key)
    return keyed.join(stay, key, "left_semi").dropDuplicates([key]).select(*docs.columns)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a run of eight consecutive words of a benchmark item.

    Items of fewer words say too little to condemn a document. Null and empty texts hold no
    item; repeated rows fare alike; an empty benchmark condemns none; an empty table gives
    no rows; columns of any name stay as they are.
    """
    key = unused(docs, "_key")
    keyed = docs.withColumn(key, row_key())
    found = decontaminate.contamination(keyed.select(F.col(key).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), whole_only=True)
    bad = found.where("n_items > 0").select(F.col("doc_id").alias(key))
    return keyed.join(bad, key, "left_anti").select(*docs.columns)


def secret_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark.

    Null and empty texts stay; repeated rows are each redacted; an empty table gives no rows."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 4096 tokens.

    Null and empty texts are one token; repeated rows are each packed; an empty table gives no rows."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language ID", languages), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", leaks), ("secret scans", secret_spans), ("best-fit packing", packed)]

#: No stage but the secret patterns can be said in SQL; tests hold each against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over ``documents``."""
    tables = Tables(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = tables.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
