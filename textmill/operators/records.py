"""Records of evaluations and runs: merging shards, prefixes, milestones, examples, horizons, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions.ordering import hash_pick
from textmill.operators.sharding import numbered, running_total


def merge_violations(inputs: DataFrame, answers: DataFrame) -> DataFrame:
    """What keeps answers (key, prompt) of several shards from being inputs (key, prompt) answered once each: missing,
    extra, duplicate or another prompt."""
    per = answers.groupBy("key").agg(F.count("*").alias("n"), F.min("prompt").alias("p"), F.max("prompt").alias("q"))
    rows = inputs.select("key", F.col("prompt").alias("asked"), F.lit(True).alias("there")).join(per, "key", "full")
    violation = F.when(F.col("there").isNull(), "extra").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate").when(~F.col("asked").eqNullSafe(F.col("p")), "another prompt")
    return rows.select("key", violation.alias("violation")).where("violation IS NOT NULL")


def key_differences(a: DataFrame, b: DataFrame, key: str, a_name: str, b_name: str) -> DataFrame:
    """(side, n): how many keys only a has, only b has, and both have."""
    rows = a.select(key).distinct().withColumn("_a", F.lit(True)).join(b.select(key).distinct().withColumn("_b", F.lit(True)), key, "full")
    sides = {"both": F.col("_a") & F.col("_b"), f"only {a_name}": F.col("_b").isNull(), f"only {b_name}": F.col("_a").isNull()}
    counts = rows.agg(*(F.count(F.when(c, 1)).alias(f"n{i}") for i, c in enumerate(sides.values())))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(side).alias("side"), F.col(f"n{i}").alias("n")) for i, side in enumerate(sides)))).alias("s")).select("s.*")


def completed_prefix(inputs: DataFrame, answers: DataFrame, order: str) -> DataFrame:
    """Inputs in order up to the first without an answer."""
    done = answers.select("key").distinct().withColumn("_done", F.lit(True))
    rows = inputs.join(done, "key", "left").withColumn("_gap", F.when(F.col("_done"), 0).otherwise(1).cast("long"))
    return running_total(rows, order, "_gap", "_gaps").where("_gaps = 0").select(*inputs.columns)


def milestones(prefix: DataFrame, inputs: DataFrame, *, every: int, published: int = 0) -> DataFrame:
    """Multiples of every (and the whole) that the prefix has newly reached."""
    n, total = prefix.agg(F.count("*").alias("n")), inputs.agg(F.count("*").alias("total"))
    marks = total.select(F.explode(F.array_distinct(F.concat(F.when(F.col("total") >= every, F.sequence(F.lit(every).cast("long"), F.col("total"), F.lit(every).cast("long"))).otherwise(F.array().cast("array<bigint>")), F.array("total")))).alias("milestone"))
    return marks.crossJoin(F.broadcast(n)).where((F.col("milestone") > published) & (F.col("milestone") <= F.col("n"))).select("milestone")


def few_shot(items: DataFrame, key: str, k: int, *, seed: int) -> DataFrame:
    """(key, other, place): k other items for each, drawn without replacement from the hash of the item's own seed.

    Items are numbered once; each draws k different numbers below n - 1 (Floyd's way, one number a step), steps over
    its own, and looks the others up.
    """
    placed = numbered(items.select(key), [key], "_at")
    n = placed.agg((F.count("*") - 1).alias("_n"))

    def draw(kept: Column, i: Column) -> Column:
        last = F.col("_n") - F.col("_k") + i
        pick = hash_pick(F.md5(F.concat_ws(":", F.lit(seed) + F.col(key), F.lit("shots"), i)), last + 1)
        return F.concat(kept, F.array(F.when(F.array_contains(kept, pick), last).otherwise(pick)))

    drawn = placed.crossJoin(F.broadcast(n)).withColumn("_k", F.least(F.lit(k).cast("long"), F.col("_n"))).where("_k > 0")
    drawn = drawn.withColumn("_drawn", F.aggregate(F.sequence(F.lit(0).cast("long"), F.col("_k") - 1), F.array().cast("array<bigint>"), draw))
    drawn = drawn.select(key, "_at", F.posexplode("_drawn").alias("_i", "_x"))
    looked = placed.select(F.col(key).alias("other"), F.col("_at").alias("_x"))
    drawn = drawn.withColumn("_x", F.when(F.col("_x") >= F.col("_at"), F.col("_x") + 1).otherwise(F.col("_x")))
    return drawn.join(looked, "_x").select(key, "other", (F.col("_i") + 1).alias("place"))


def horizon(runs: DataFrame, *, batch: int, ratio: float) -> DataFrame:
    """Steps of each run: as given, else from its tokens, else ratio tokens a parameter; whole batches."""
    steps = F.coalesce(F.col("steps"), F.floor(F.col("tokens") / batch), F.floor(ratio * F.col("parameters") / batch))
    return runs.select("run", steps.cast("long").alias("steps"))


def shifted(ids: Column, mask: Column | None = None) -> Column:
    """(inputs, targets): all but the last, and all but the first; a target whose place in mask is 0 is -1."""
    n = F.greatest(F.size(ids) - 1, F.lit(0))
    targets = F.slice(ids, F.lit(2), n)
    if mask is not None:
        targets = F.zip_with(targets, F.slice(mask, F.lit(2), n), lambda x, m: F.when(m == 0, -1).otherwise(x))
    return F.struct(F.slice(ids, F.lit(1), n).alias("inputs"), targets.alias("targets"))


def prompt(shots: Column, question: Column) -> Column:
    """Example blocks and the question, parted by blank lines."""
    return F.array_join(F.concat(shots, F.array(question)), "\n\n")
