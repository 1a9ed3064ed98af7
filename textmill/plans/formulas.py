"""Queries of the formulas of training plans, over orders and parts as runs and steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from textmill.catalog import register
from textmill.functions import formulas
from textmill.sources.tables import table


@register("h31_model_shapes", """
SELECT p_partkey, CAST((p_size * 64 + 127) // 128 * 128 AS BIGINT) AS model_dim,
       CAST((p_size * 64 + 127) // 128 AS BIGINT) AS heads
FROM part
""")
def model_shapes(spark, sf_dir):
    dim = formulas.model_dim(F.col("p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", dim.alias("model_dim"), F.floor(dim / 128).alias("heads"))


@register("h44_compute", """
SELECT o_orderkey, CAST(o_orderkey * 524288 AS DOUBLE) * CAST(o_custkey AS DOUBLE) AS stage_flops,
       CAST(o_orderkey AS DOUBLE) * (CAST(o_custkey AS DOUBLE) / 3.0) AS rollout_flops,
       CAST(o_orderkey * 524288 AS DOUBLE) * CAST(o_custkey AS DOUBLE) + CAST(o_totalprice AS DOUBLE) AS cumulative_flops
FROM orders
""")
def compute(spark, sf_dir):
    stage = formulas.training_flops(F.col("o_orderkey") * 524_288, F.col("o_custkey"))
    rollout = formulas.rollout_flops(F.col("o_orderkey"), F.col("o_custkey"))
    total = stage + F.col("o_totalprice").cast("double")
    return table(spark, sf_dir, "orders").select("o_orderkey", stage.alias("stage_flops"), rollout.alias("rollout_flops"), total.alias("cumulative_flops"))


@register("h45_learning_rate", """
WITH s AS (SELECT o_orderkey, o_orderkey % 1000 AS it FROM orders)
SELECT o_orderkey, round(CASE WHEN it < 40 THEN (it + 1) / 40.0 WHEN it <= 350 THEN 1.0
  ELSE (1000 - it) / 650.0 + (1 - (1000 - it) / 650.0) * 0.05 END, 9) AS rate
FROM s
""")
def learning_rate(spark, sf_dir):
    rate = formulas.learning_rate(F.col("o_orderkey") % 1000, steps=1000, warmup=40, warmdown=0.65, least=0.05)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(rate, 9).alias("rate"))


@register("h46_batch_law", """
WITH r AS (SELECT o_orderkey, CAST(o_totalprice AS DOUBLE) * 1e5 AS tokens FROM orders),
b AS (SELECT *, pow(2, round_even(log2(524288 * pow(tokens / 1.2e10, 0.383)), 0)) AS batch FROM r)
SELECT o_orderkey, CAST(batch AS BIGINT) AS batch, round(sqrt(batch / 524288), 9) AS rate_scale,
       round(sqrt(batch / 524288) * (1.2e10 / tokens), 6) AS decay_scale
FROM b
""")
def batch_law(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice").cast("double") * 1e5).alias("tokens"))
    law = {"reference_batch": 524_288, "reference_tokens": 1.2e10}
    rows = rows.withColumn("batch", formulas.batch_size(F.col("tokens"), **law))
    decay = formulas.decay_scale(F.col("batch"), F.col("tokens"), **law)
    return rows.select("o_orderkey", "batch", F.round(formulas.rate_scale(F.col("batch"), 524_288), 9).alias("rate_scale"), F.round(decay, 6).alias("decay_scale"))


@register("h47_hourly_cost", """
WITH d AS (SELECT p_partkey, p_size, CASE p_size % 4 WHEN 0 THEN 'NVIDIA H100 80GB' WHEN 1 THEN 'NVIDIA A100-SXM4'
  WHEN 2 THEN 'Tesla V100' ELSE p_type END AS device FROM part)
SELECT p_partkey, round(p_size * CAST(CASE WHEN contains(device, 'H100') THEN 3.0 WHEN contains(device, 'A100') THEN 1.79
  WHEN contains(device, 'V100') THEN 0.55 ELSE 2.0 END AS DOUBLE), 6) AS hourly
FROM d
""")
def hourly_cost(spark, sf_dir):
    kind = F.col("p_size") % 4
    device = F.when(kind == 0, "NVIDIA H100 80GB").when(kind == 1, "NVIDIA A100-SXM4").when(kind == 2, "Tesla V100").otherwise(F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(formulas.hourly_cost(device, F.col("p_size")), 6).alias("hourly"))


@register("h51_momentum_and_decay", """
WITH s AS (SELECT o_orderkey, o_orderkey % 1000 AS it FROM orders)
SELECT o_orderkey, round(CASE WHEN it < 400 THEN (1 - it / 400.0) * 0.85 + it / 400.0 * 0.97
  WHEN it >= 350 THEN 0.97 * (1 - (it - 350) / 650.0) + 0.90 * ((it - 350) / 650.0) ELSE 0.97 END, 9) AS momentum,
  round(0.2 * 0.5 * (1 + cos(pi() * it / 1000)), 9) AS weight_decay
FROM s
""")
def momentum_and_decay(spark, sf_dir):
    at = F.col("o_orderkey") % 1000
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.round(formulas.momentum(at, steps=1000, warmdown=0.65), 9).alias("momentum"),
        F.round(formulas.weight_decay(at, steps=1000, start=0.2), 9).alias("weight_decay"),
    )


@register("h52_compute_fields", """
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey WHEN o_orderkey % 3 = 1 THEN o_custkey ELSE 7 END AS step,
       CASE WHEN o_orderkey % 5 = 0 THEN 0.0 ELSE o_orderkey * 1.5 END AS stage_flops,
       CASE WHEN o_orderkey % 7 = 0 THEN o_custkey * 2.0 ELSE 0.0 END AS inherited_flops,
       CASE WHEN o_orderkey % 4 = 0 THEN 123.0
         ELSE CASE WHEN o_orderkey % 5 = 0 THEN 0.0 ELSE o_orderkey * 1.5 END
            + CASE WHEN o_orderkey % 7 = 0 THEN o_custkey * 2.0 ELSE 0.0 END END AS cumulative_flops
FROM orders
""")
def compute_fields(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    loop = F.struct(
        F.when(k % 3 == 1, c).alias("step"),
        F.when(k % 5 != 0, k * 1.5).alias("stage_training_flops"),
        F.when(k % 7 == 0, c * 2.0).alias("inherited_parent_flops"),
        F.when(k % 4 == 0, 123.0).alias("cumulative_pipeline_training_flops"),
    )
    meta = F.to_json(F.struct(F.when(k % 3 == 0, k).alias("step"), loop.alias("loop_state")))
    return table(spark, sf_dir, "orders").select("o_orderkey", formulas.compute_fields(meta, 7).alias("f")).select("o_orderkey", "f.*")


@register("f20_cache_tokens", "SELECT o_orderkey, CAST(ceil(o_custkey * 1.05) AS BIGINT) AS tokens FROM orders")
def cache_tokens(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", formulas.cache_tokens(F.col("o_custkey"), 1.05).alias("tokens"))


@register("f21_iterations", """
SELECT o_orderkey, CAST(CASE o_orderkey % 4 WHEN 0 THEN greatest(1, o_orderkey * 100 // 4096) WHEN 1 THEN o_custkey
  WHEN 2 THEN greatest(1, o_custkey * 50 // 4096) ELSE greatest(1, ceil(1.5 * o_custkey / 4096)) END AS BIGINT) AS steps
FROM orders
""")
def iterations(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    given = lambda n, value: F.when(k % 4 == n, value)
    steps = formulas.iterations(given(0, k * 100), given(1, c), given(2, c * 50), given(3, F.lit(1.5)), c, F.lit(4096))
    return table(spark, sf_dir, "orders").select("o_orderkey", steps.cast("long").alias("steps"))


@register("c23_sampling_errors", """
SELECT p_partkey, CASE WHEN p_size / 20.0 > 2.0 THEN 'temperature' WHEN p_partkey % 210 > 200 THEN 'top_k'
  WHEN p_partkey % 50 = 0 THEN 'max_tokens' WHEN p_size % 7 = 0 AND p_size / 5.0 NOT BETWEEN 1.0 AND 2.0 THEN 'repetition_penalty' END AS error
FROM part
""")
def sampling_errors(spark, sf_dir):
    k, n = F.col("p_partkey"), F.col("p_size")
    error = formulas.sampling_error(n / 20.0, k % 210, k % 50, F.when(n % 7 == 0, n / 5.0))
    return table(spark, sf_dir, "part").select("p_partkey", error.alias("error"))


@register("m6_mixture_entries", """
SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 3 = 0 AND o_custkey % 2 = 0 THEN o_custkey * 2048 ELSE 0 END AS BIGINT) AS entry
FROM orders
""")
def mixture_entries(spark, sf_dir):
    mode = F.when(F.col("o_orderkey") % 3 == 0, "continue").otherwise("restart")
    step = F.when(F.col("o_custkey") % 2 == 0, F.col("o_custkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey", formulas.mixture_entry(mode, step, F.lit(2048)).alias("entry"))


@register("m16_run_paths", """
SELECT p_partkey, 'experiments/' || p_brand || CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN '/sft/' || p_type
  ELSE '/sft/' || p_type || '/posttrain/' || p_name END AS path
FROM part
""")
def run_paths(spark, sf_dir):
    stage = F.element_at(F.array(*map(F.lit, ("base", "sft", "posttrain"))), (F.col("p_size") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", formulas.run_path(stage, F.col("p_brand"), F.col("p_type"), F.col("p_name")).alias("path"))
