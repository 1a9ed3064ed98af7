"""Splits, hold-outs, hash-ordered samples, balancing and epochs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.functions.ordering import half_even, hash_order
from textmill.operators.sharding import numbered, ranked


def stride(df: DataFrame, index: str, *, group: int, start: int, step: int) -> DataFrame:
    """Rows of every step-th group of consecutive indexes, from start."""
    place = F.floor(F.col(index) / group)
    return df.withColumn("row_group", place).where(place % step == start)


def last_is_validation(df: DataFrame, shard: str) -> DataFrame:
    """is_val marks the rows of the last shard in order; with one shard all rows are validation."""
    last = df.agg(F.max(shard).alias("_last"))
    return df.crossJoin(F.broadcast(last)).withColumn("is_val", F.col(shard) == F.col("_last")).drop("_last")


def shuffled(df: DataFrame, key: str, *, seed: int, scope: str) -> DataFrame:
    """df with position: its place in hash order, dense from 0."""
    return numbered(df.withColumn("_h", hash_order(seed, scope, key)), ["_h", key], "position").drop("_h")


def holdouts(rows: DataFrame, *, seed: int, group: str = "route", key: str = "conv_id", score: str = "score", least_score: int = 80, share: float = 0.015, floor: int = 16, cap: int = 512) -> DataFrame:
    """Per group, the first min(cap, max(floor, round(share * n))) well-scored keys in hash order."""
    good = rows.where(F.col(score) >= least_score)
    placed = ranked(good.withColumn("_h", hash_order(seed, F.col(group).cast("string"), key)), [group], ["_h", key], "_p")
    n = good.groupBy(group).agg(F.least(F.lit(cap), F.greatest(F.lit(floor), half_even(F.count("*") * share))).alias("_n"))
    return placed.join(n, group).where("_p <= _n").select(group, key)


def pool(rows: DataFrame, held: DataFrame, *, threshold: int, group: str = "route", key: str = "conv_id", score: str = "score") -> DataFrame:
    """Rows at or above threshold whose key isn't held out, whatever threshold held it out."""
    return rows.where(F.col(score) >= threshold).join(held, [group, key], "left_anti")


def first_per_group(rows: DataFrame, group: str, key: str, count: int | None, *, seed: int) -> DataFrame:
    out = ranked(rows.withColumn("_h", hash_order(seed, F.col(group).cast("string"), key)), [group], ["_h", key], "place").drop("_h")
    return out if count is None else out.where(F.col("place") <= count)


def round_robin(rows: DataFrame, domain: str, key: str, *, seed: int) -> DataFrame:
    """position interleaves domains: any prefix is balanced; domains in the order of their first key in hash order."""
    return numbered(_turns(rows, [domain], key, seed), ["_k", "_g"], "position").drop("_h", "_k", "_g")


def round_robin_places(rows: DataFrame, by: list[str], domain: str, key: str, *, seed: int) -> DataFrame:
    """place (from 1) interleaves the domains of each group."""
    return ranked(_turns(rows, [*by, domain], key, seed), by, ["_k", "_g"], "place").drop("_h", "_k", "_g")


def _turns(rows: DataFrame, by: list[str], key: str, seed: int) -> DataFrame:
    """rows with _k, the place of a row in its domain, and _g, the domain's first hash."""
    h = rows.withColumn("_h", hash_order(seed, "balance", key))
    return ranked(h, by, ["_h", key], "_k").join(h.groupBy(*by).agg(F.min("_h").alias("_g")), by)


def epochs(rows: DataFrame, key: str, times: float, *, seed: int) -> DataFrame:
    """Whole copies, then one sample of max(1, round(n * rest)) rows in hash order; column epoch."""
    whole, rest = math.floor(times), times - math.floor(times)
    copies = rows.withColumn("epoch", F.explode(F.array(*map(F.lit, range(whole))))) if whole else rows.limit(0).withColumn("epoch", F.lit(0))
    if rest <= 0:
        return copies
    placed = shuffled(rows, key, seed=seed, scope="epochs")
    n = rows.agg(F.greatest(F.lit(1), half_even(F.count("*") * rest)).alias("_n"))
    extra = placed.crossJoin(F.broadcast(n)).where("position < _n").select(*rows.columns, F.lit(whole).alias("epoch"))
    return copies.unionByName(extra)


def share_of(rows: DataFrame, key: str, share: float, *, seed: int) -> DataFrame:
    """The first max(1, round(n * share)) rows in hash order."""
    n = rows.agg(F.greatest(F.lit(1), half_even(F.count("*") * share)).alias("_n"))
    return shuffled(rows, key, seed=seed, scope="share").crossJoin(F.broadcast(n)).where("position < _n").drop("_n", "position")


def train_val(rows: DataFrame, key: str, *, seed: int, most: int = 256) -> DataFrame:
    """is_val marks the first min(most, n div 2) rows in hash order."""
    n = rows.agg(F.least(F.lit(most), F.floor(F.count("*") / 2)).alias("_n"))
    return shuffled(rows, key, seed=seed, scope="split").crossJoin(F.broadcast(n)).withColumn("is_val", F.col("position") < F.col("_n")).drop("_n")
