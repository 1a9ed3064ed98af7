"""Claim dedup: scanning in order, a row whose key is already claimed is dropped; any other row claims its own key and
the keys of its duplicate list.  Dropped rows claim nothing, and lists need not be symmetric.

Distributed as rounds over (earlier owner, later target) edges: a row with no undecided and no kept earlier owner is
kept; what a kept row claims is dropped.  Each round is written, which cuts lineage; the number of rounds is the length
of the longest chain of undecided rows, small in practice; every round decides a row at least, so they end.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.sources.scratch import folder


def claim_dedup(rows: DataFrame, *, order: str, key: str, duplicates: str) -> DataFrame:
    """rows with is_duplicate.  order must be unique; rows without key claim only their lists."""
    spark, base = rows.sparkSession, folder(rows.sparkSession, "claims")

    def keep(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{base}/{name}")
        return spark.read.schema(df.schema).parquet(f"{base}/{name}")

    claims = rows.select(F.col(order).alias("owner"), F.explode(F.array_distinct(F.concat(F.array(F.col(key)), F.coalesce(F.col(duplicates), F.array().cast("array<string>"))))).alias("claimed")).where("claimed IS NOT NULL")
    edges = claims.join(rows.select(F.col(order).alias("target"), F.col(key).alias("claimed")), "claimed").where("owner < target").select("owner", "target").distinct()
    edges = keep(edges, "edges")
    state = keep(edges.select(F.col("target").alias("row")).union(edges.select(F.col("owner").alias("row"))).distinct().withColumn("kept", F.lit(None).cast("boolean")), "state0")
    for i in count(1):
        owners = edges.join(state.withColumnRenamed("row", "owner"), "owner")
        seen = owners.groupBy(F.col("target").alias("row")).agg(F.bool_or(F.coalesce("kept", F.lit(False))).alias("hit"), F.bool_or(F.col("kept").isNull()).alias("open"))
        after = state.join(seen, "row", "left").select("row", F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("hit"), False).when(~F.coalesce("open", F.lit(False)), True).alias("kept"))
        state = keep(after, f"state{i}")
        if state.where("kept IS NULL").isEmpty():
            break
    gone = state.where("NOT kept").select(F.col("row").alias(order))
    return rows.join(gone.withColumn("_gone", F.lit(True)), order, "left").withColumn("is_duplicate", F.coalesce("_gone", F.lit(False))).drop("_gone")


def not_committed(rows: DataFrame, committed: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't committed; to be applied after claim_dedup, as committed rows claim too."""
    return rows.join(committed.select(key).distinct(), key, "left_anti")
