"""The ways beyond the bounds of broadcasts give the same results."""

import pytest
from pyspark.sql import functions as F

from textmill.llm import fingerprints, ngram_join, substring_dedup

OPERATORS = {
    "ngram_join": (ngram_join, lambda d: ngram_join.jaccard_components(d)),
    "fingerprints": (fingerprints, lambda d: fingerprints.fingerprints(d)),
    "substring_dedup": (substring_dedup, lambda d: substring_dedup.repeated_spans(d).drop("spans")),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_without_broadcast(spark, sf_dir, monkeypatch, name):
    module, run = OPERATORS[name]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(docs.where("doc_id % 3 = 0").select((F.col("doc_id") + 1_000_000).alias("doc_id"), F.concat("text", F.lit(" more")).alias("text")))
    rows = lambda: sorted(map(str, run(docs).collect()))
    wanted = rows()
    monkeypatch.setattr(module, "if_small", lambda table, rows=0: table)
    assert rows() == wanted
