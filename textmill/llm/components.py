"""Connected components of a graph given by its edges, as joins.

Two steps alternate until the edges no longer change: every node tells its larger neighbours the least node it knows
(large star), then its smaller ones (small star).  Each keeps the components and shortens paths, so the number of
rounds is logarithmic; each round is written to the scratch folder, which cuts lineage.  Nothing is collected but two
sums a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from textmill.llm.shared import drop_folder, new_folder


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 100) -> DataFrame:
    """(node, component) of every node that an edge has; component is the least node reachable."""
    spark = edges.sparkSession
    pairs = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u != v")
    kept: list[str] = []

    def keep(df: DataFrame) -> tuple[DataFrame, tuple]:
        path, seen = new_folder(spark, "components"), Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).write.parquet(path)
        kept.append(path)
        return spark.read.schema("u long, v long").parquet(path), (seen.get["n"], seen.get["h"])

    now, state = keep(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if not state[0]:
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u")
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        after, seen = keep(small)
        if len(kept) > 2:
            drop_folder(spark, kept.pop(0))
        if seen == state:
            roots = after.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return after.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
        now, state = after, seen
    raise RuntimeError("components did not settle")
