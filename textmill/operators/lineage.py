"""Checkpoints, inventories and configurations as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def step_of(path: Column) -> Column:
    return F.regexp_extract(path, "_([0-9]+)", 1).try_cast("long")


def complete_steps(files: DataFrame, ranks: list[int] | None = None, path: str = "path") -> DataFrame:
    """Steps with a model and a meta file, and an optimizer file of every required rank."""
    p = F.col(path)
    rank = F.regexp_extract(p, "rank([0-9]+)", 1).try_cast("int")
    rows = files.select(step_of(p).alias("step"), p.startswith("model").alias("model"), p.startswith("meta").alias("meta"), rank.alias("rank")).where("step IS NOT NULL")
    needed = ranks or []
    per = rows.groupBy("step").agg(F.bool_or("model").alias("model"), F.bool_or("meta").alias("meta"), F.count_distinct(F.when(F.col("rank").isin(needed), F.col("rank"))).alias("ranks"))
    return per.where(F.col("model") & F.col("meta") & (F.col("ranks") == len(set(needed)))).select("step")


def prunable(uploaded: DataFrame, keep: int) -> DataFrame:
    """Uploaded steps beyond the newest keep; none if keep is negative."""
    if keep < 0:
        return uploaded.limit(0)
    return uploaded.withColumn("_n", F.row_number().over(Window.orderBy(F.desc("step")))).where(F.col("_n") > keep).drop("_n")


def verify(source: DataFrame, target: DataFrame) -> DataFrame:
    """source (path, size, oid) with verdict: missing, size differs, content differs or ok."""
    t = target.select("path", F.col("size").alias("_size"), F.col("oid").alias("_oid"), F.lit(True).alias("_there"))
    verdict = F.when(F.col("_there").isNull(), "missing").when(~F.col("size").eqNullSafe(F.col("_size")), "size differs").when(~F.col("oid").eqNullSafe(F.col("_oid")), "content differs").otherwise("ok")
    return source.join(t, "path", "left").withColumn("verdict", verdict).drop("_size", "_oid", "_there")


def diff(parent: DataFrame, child: DataFrame) -> DataFrame:
    """Fields (field, value) whose values differ: field, parent, child."""
    a = parent.select("field", F.col("value").alias("parent"))
    b = child.select("field", F.col("value").alias("child"))
    return a.join(b, "field", "full").where(~F.col("parent").eqNullSafe(F.col("child")))


def promote(state: DataFrame, files: DataFrame) -> DataFrame:
    """Reconciles committed shard numbers with those found: action is ok, delete orphan or missing."""
    s, f = state.select("index", F.lit(True).alias("_s")), files.select("index", F.lit(True).alias("_f"))
    return s.join(f, "index", "full").select("index", F.when(F.col("_s").isNull(), "delete orphan").when(F.col("_f").isNull(), "missing").otherwise("ok").alias("action"))


def inherited(runs: DataFrame) -> DataFrame:
    """(run, inherited): the parent's cumulative compute, else that of its stage, else 0."""
    p = runs.select(F.col("run").alias("parent"), F.col("cumulative").alias("_c"), F.col("stage").alias("_s"))
    return runs.select("run", "parent").join(p, "parent", "left").select("run", F.coalesce("_c", "_s", F.lit(0.0)).alias("inherited"))


def moved(paths: DataFrame, old: str, new: str) -> DataFrame:
    """Paths under a prefix with target, the path under the new prefix."""
    return paths.where(F.startswith(F.col("path"), F.lit(old))).withColumn("target", F.concat(F.lit(new), F.substr(F.col("path"), F.lit(len(old) + 1))))


def run_tag(state: Column, flops: Column) -> Column:
    return F.when(state.isin("crashed", "killed"), "interrupted").when((state == "finished") & flops.isNull(), "legacy")
