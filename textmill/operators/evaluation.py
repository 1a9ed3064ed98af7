"""Evaluation analytics: bits per byte, ranks and percentiles, accuracy, pass@k, instruction following, fits."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bits_per_byte(nats: Column, n_bytes: Column) -> Column:
    """Aggregate: nats of counted tokens over ln 2 times their bytes; tokens without bytes don't count; no bytes: infinite."""
    counted = F.sum(F.when(n_bytes > 0, nats))
    total = F.sum(F.when(n_bytes > 0, n_bytes).otherwise(0))
    return F.when(total > 0, counted / (F.lit(math.log(2)) * total)).otherwise(F.lit(float("inf")))


def auc(rows: DataFrame, score: str, positive: str) -> DataFrame:
    """P(positive > negative), ties one half, by average ranks of the distinct scores: one row a score, not a pair."""
    per = rows.where(F.col(score).isNotNull()).groupBy(score).agg(F.sum(F.col(positive).cast("long")).alias("p"), F.sum(1 - F.col(positive).cast("long")).alias("q"))
    from textmill.operators.sharding import running_total

    run = running_total(per, score, "q", "_q")
    won = F.sum(F.col("p") * (F.col("_q") - F.col("q")) + F.col("p") * F.col("q") / 2.0)
    return run.agg(F.sum("p").alias("n_positive"), F.sum("q").alias("n_negative"), (won / F.nullif(F.sum("p") * F.sum("q"), F.lit(0))).alias("auc"))


def grouped_auc(rows: DataFrame, by: str, score: str, positive: str) -> DataFrame:
    """auc of each of many groups, from the distinct scores of each; null without positives or without negatives."""
    hit = F.col(positive).cast("long")
    per = rows.where(F.col(score).isNotNull()).groupBy(by, score).agg(F.sum(hit).alias("p"), F.sum(1 - hit).alias("q"))
    below = F.coalesce(F.sum("q").over(Window.partitionBy(by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = F.sum(F.col("p") * F.col("_below") + F.col("p") * F.col("q") / 2.0)
    return per.withColumn("_below", below).groupBy(by).agg((won / F.nullif(F.sum("p") * F.sum("q"), F.lit(0))).alias("auc"))


def nearest_rank(rows: DataFrame, value: str, q: float) -> DataFrame:
    """The value at index round_half_even(q * (n - 1)) in order."""
    from textmill.operators.sharding import numbered

    have = rows.where(F.col(value).isNotNull()).select(value)
    at = have.agg(F.bround(q * (F.count("*") - 1)).cast("long").alias("_at"))
    return numbered(have, [value], "_n").crossJoin(F.broadcast(at)).where("_n = _at").select(F.col(value).alias("percentile"))


def centered(accuracy: Column, baseline: Column) -> Column:
    return (accuracy - baseline) / (1 - baseline)


def top_mean(values: Column, k: int) -> Column:
    """Mean of the k largest; of all if there are fewer; null if none."""
    top = F.slice(F.sort_array(values, False), 1, k)
    return F.when(F.size(top) > 0, F.aggregate(top, F.lit(0.0), lambda a, x: a + x) / F.size(top))


def pass_at(samples: DataFrame, problem: str, order: str, correct: str, most: int) -> DataFrame:
    """k, pass_at_k for k = 1..most: the share of problems with a correct one among their first k samples."""
    first = samples.groupBy(problem).agg(F.min(F.when(F.col(correct), F.col(order))).alias("hit"))
    ks = first.sparkSession.range(1, most + 1).withColumnRenamed("id", "k")
    return first.crossJoin(F.broadcast(ks)).groupBy("k").agg(F.avg(F.coalesce((F.col("hit") <= F.col("k")).cast("double"), F.lit(0.0))).alias("pass_at_k"))


def advantage(rows: DataFrame, group: str, reward: str) -> DataFrame:
    return rows.withColumn("advantage", F.col(reward) - F.avg(reward).over(Window.partitionBy(group)))


def line_fit(rows: DataFrame, x: str, y: str, by: list[str] = ()) -> DataFrame:
    return rows.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def parabola(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Least squares y = a x^2 + b x + c per group from sums of powers (x shifted to its mean), and the vertex;
    where the fit opens downwards, the x of the least y."""
    mean = rows.groupBy(*by).agg(F.avg(x).alias("_m"))
    r = rows.join(F.broadcast(mean), by).withColumn("_x", F.col(x) - F.col("_m"))
    s = lambda i, j=0: F.sum(F.pow("_x", F.lit(float(i))) * (F.col(y) if j else 1.0))
    sums = r.groupBy(*by).agg(F.first("_m").alias("_m"), *(s(i).alias(f"s{i}") for i in range(5)), *(s(i, 1).alias(f"t{i}") for i in range(3)), F.min_by(x, F.struct(y, x)).alias("_raw"))
    det = lambda a, b, c, d, e, f, g, h, i: a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    c = {k: F.col(k) for k in ("s0", "s1", "s2", "s3", "s4", "t0", "t1", "t2")}
    whole = det(c["s4"], c["s3"], c["s2"], c["s3"], c["s2"], c["s1"], c["s2"], c["s1"], c["s0"])
    a = det(c["t2"], c["s3"], c["s2"], c["t1"], c["s2"], c["s1"], c["t0"], c["s1"], c["s0"]) / whole
    b = det(c["s4"], c["t2"], c["s2"], c["s3"], c["t1"], c["s1"], c["s2"], c["t0"], c["s0"]) / whole
    return sums.select(*by, a.alias("a"), b.alias("b"), F.col("_m"), F.col("_raw")).select(*by, "a", F.when(F.col("a") > 0, F.col("_m") - F.col("b") / (2 * F.col("a"))).otherwise(F.col("_raw")).alias("vertex"))


def debiased_average(rows: DataFrame, step: str, loss: str, beta: float) -> DataFrame:
    """(step, loss, smooth): exponential moving average in step order, divided by 1 - beta^n; streamed by one task, as
    every value needs the one before."""
    schema = pa.schema([(step, pa.int64()), (loss, pa.float64()), ("smooth", pa.float64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, left = 0.0, 1.0
        for batch in batches:
            out = []
            for x in batch.column(1).to_pylist():
                mean, left = beta * mean + (1 - beta) * x, left * beta
                out.append(mean / (1 - left))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], schema=schema)

    ordered = rows.where(F.col(loss).isNotNull()).select(F.col(step).cast("long"), F.col(loss).cast("double")).repartitionByRange(1, step).sortWithinPartitions(step)
    return ordered.mapInArrow(scan, f"`{step}` long, `{loss}` double, smooth double")
