"""The corpus pipeline: quality rules, near-duplicate removal, substring dedup, packing.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir), where docs is the table that the stage
before it kept, and returns a DataFrame.  All but the last return the columns of docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textmill.llm import ngram_join, packing, quality_rules, shared, substring_dedup
from textmill.llm.queries import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail no rule of policy v1."""
    book = quality_rules.ledger(docs.select(F.struct(*(F.col(c) for c in docs.columns)).alias("row"), F.col("text").alias("words_of")), "words_of")
    return book.where(quality_rules.passes(quality_rules.POLICIES["v1"])).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of five-word shingle sets with a similarity of 0.8 or more: the least id.

    Rows that share an id are one document, of which the first text in order stays; rows without id all stay.
    """
    found = ngram_join.jaccard_components(docs, shingle=5, num=4, den=5)
    copies = shared.written(found.where("doc_id != component_id").select("doc_id").distinct(), "pipeline-copies")
    kept = docs.join(shared.if_small(copies), "doc_id", "left_anti").select(*docs.columns)
    repeated = shared.written(docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id"), "pipeline-ids")
    if repeated.isEmpty():
        return kept
    (place,) = shared.fresh(docs, "_place")
    several = kept.join(shared.if_small(repeated), "doc_id", "left_semi").select(*docs.columns)
    first = several.withColumn(place, F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where(F.col(place) == 1).drop(place)
    return kept.join(shared.if_small(repeated), "doc_id", "left_anti").select(*docs.columns).union(first)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the words of 13-word windows that a document of smaller id has."""
    return substring_dedup.without_repeats(docs, window=13)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, each a piece of one document."""
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("quality_rules", quality), ("ngram_jaccard_join", near_duplicates), ("substring_dedup", repeated_passages), ("packing", pack)]

#: Byte-level BPE can't be expressed in SQL; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each written and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
