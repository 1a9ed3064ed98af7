"""Readers, and the views of the driver's tables on which the operators' queries run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def assert_schema(df: DataFrame, required: list[str], optional: list[str] = ()) -> list[str]:
    """Raises if a required column is missing; returns the optional ones that are."""
    have = {c.lower() for c in df.columns}
    missing = [c for c in required if c.lower() not in have]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return [c for c in optional if c.lower() not in have]


BOOK = [
    "doc_id",
    "concat('B', doc_id) AS barcode",
    "CASE lang WHEN 'en' THEN 'eng' ELSE lang END AS language",
    "CASE WHEN doc_id % 11 = 0 THEN '18uu' WHEN doc_id % 13 = 0 THEN '9999' ELSE CAST(1850 + doc_id % 100 AS STRING) END AS date1",
    "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST(1900 + doc_id % 40 AS STRING) END AS date2",
    "substr('sstcqmsrd', CAST(1 + doc_id % 9 AS INT), 1) AS date_type",
    "CASE WHEN doc_id % 29 = 0 THEN NULL ELSE 84 + doc_id % 17 END AS ocr_src",
    "84 + (doc_id * 7) % 17 AS ocr_gen",
    "CASE WHEN doc_id % 31 = 0 THEN NULL ELSE named_struct('language', array('xxx', 'eng'), 'proportion', array((doc_id % 25) / 100.0D, 1.0D - (doc_id % 25) / 100.0D)) END AS distribution",
    "92 + (doc_id * 3) % 9 AS tokenizability",
    "CAST(floor(n_chars / 4) AS BIGINT) AS tokens",
    "n_chars AS chars",
    "CAST(1 + floor(n_chars / 500) AS BIGINT) AS pages",
    "length(text) - length(replace(text, '.', '')) AS sentences",
    "source AS topic",
    "text",
]


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as rows of book metadata."""
    return table(spark, sf_dir, "documents").selectExpr(*BOOK)


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as one row each: conv_id, messages (role, content) in turn order."""
    rows = table(spark, sf_dir, "conversations")
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return rows.groupBy("conv_id").agg(F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content"))).alias("messages"))
