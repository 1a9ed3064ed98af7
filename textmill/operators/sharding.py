"""Global order, running sums and shards.

A running sum over a whole table would put all rows in one task.  Here rows are range-partitioned once by the order;
one small row per partition (its sum) gives every partition its offset, and each partition then sums on its own.  The
partitioned rows are written first: bounds come from a sample, and both uses must see the same ones, also when a lost
task runs again.  Callers pass keys and lengths, not texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textmill.sources.scratch import written


def _ranged(df: DataFrame, order: list[str]) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")


def running_total(df: DataFrame, order: str | list[str], amount: str, out: str = "running") -> DataFrame:
    """df with the running sum of amount in order, this row included."""
    order = [order] if isinstance(order, str) else order
    rows = _ranged(df, order)
    sums = rows.groupBy("_part").agg(F.sum(amount).alias("_sum"))
    before = sums.select(F.col("_part"), F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    local = F.sum(amount).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_local", local).join(F.broadcast(before), "_part").withColumn(out, F.col("_local") + F.col("_before")).drop("_part", "_local", "_before")


def numbered(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """df with a dense number from 0 in order."""
    return running_total(df.withColumn("_one", F.lit(1).cast("long")), order, "_one", out).withColumn(out, F.col(out) - 1).drop("_one")


def ranked(df: DataFrame, by: list[str], order: list[str], out: str) -> DataFrame:
    """df with its rank from 1 in order among the rows of its group: the place in the order of all, less where the group
    begins, so a group of any size is spread over the tasks."""
    placed = numbered(df, [*by, *order], "_place")
    first = placed.groupBy(*by).agg(F.min("_place").alias("_first"))
    return placed.join(first, by).withColumn(out, F.col("_place") - F.col("_first") + 1).drop("_place", "_first")


def budget_cut(df: DataFrame, order: str, amount: str, budget: int, *, inclusive: bool = False) -> DataFrame:
    """Rows in order until their amounts reach the budget (inclusive: exceed it); the crossing row stays."""
    rows = running_total(df, order, amount)
    before = F.col("running") - F.col(amount)
    return rows.where(before <= budget if inclusive else before < budget)


def greedy_shards(df: DataFrame, key: str, amount: str, budget: int, *, multiple: int = 1, drop_tail: bool = False) -> DataFrame:
    """(key, amount, shard): a shard closes with the row that brings it to the budget (and, with multiple, only when
    its row count is divisible by it).  drop_tail leaves out the last shard if it isn't closed.

    Closing depends on every row before, so the numbers alone (never texts) pass one task in order, streamed.
    """
    schema = pa.schema([(key, pa.int64()), (amount, pa.int64()), ("shard", pa.int64()), ("closed", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, filled, rows = 0, 0, 0
        for batch in batches:
            sizes, shards, closed = batch.column(1).to_pylist(), [], []
            for n in sizes:
                shards.append(shard)
                filled, rows = filled + (n or 0), rows + 1
                if filled >= budget and rows % multiple == 0:
                    shard, filled, rows = shard + 1, 0, 0
                closed.append(shard)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shards, pa.int64()), pa.array(closed, pa.int64())], schema=schema)

    rows = df.select(F.col(key).cast("long"), F.col(amount).cast("long")).repartitionByRange(1, key).sortWithinPartitions(key)
    out = rows.mapInArrow(scan, f"`{key}` long, `{amount}` long, shard long, closed long")
    if drop_tail:
        complete = out.agg(F.max("closed").alias("_complete"))
        out = out.crossJoin(F.broadcast(complete)).where("shard < _complete").drop("_complete")
    return out.drop("closed")


def token_files(df: DataFrame, key: str, tokens: str, per_file: int) -> DataFrame:
    """Which tokens of each document lie in which file of a fixed number of tokens: key, file, first_token, n_tokens."""
    rows = running_total(df, key, tokens, "_end").withColumn("_start", F.col("_end") - F.col(tokens)).where(F.col(tokens) > 0)
    rows = rows.withColumn("file", F.explode(F.sequence(F.floor(F.col("_start") / per_file), F.floor((F.col("_end") - 1) / per_file))))
    first = F.greatest("_start", F.col("file") * per_file)
    return rows.select(key, "file", (first - F.col("_start")).alias("first_token"), (F.least(F.col("_end"), (F.col("file") + 1) * per_file) - first).alias("n_tokens"))
