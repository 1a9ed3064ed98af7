"""Formulas of training plans: shapes, compute, batch sizes, schedules, costs and horizons, as expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hourly rates by the name of the device, and for any other.
HOURLY = {"H100": 3.00, "A100": 1.79, "V100": 0.55}
OTHER_HOURLY = 2.0


def model_dim(depth: Column, aspect: int = 64, head: int = 128) -> Column:
    """depth * aspect, rounded up to whole heads."""
    return (F.ceil(depth * aspect / head) * head).cast("long")


def training_flops(tokens: Column, per_token: Column) -> Column:
    return tokens.cast("double") * per_token.cast("double")


def rollout_flops(tokens: Column, per_token: Column) -> Column:
    """Generation is a forward pass only, a third of training."""
    return tokens.cast("double") * (per_token.cast("double") / 3.0)


def learning_rate(step: Column, *, steps: int, warmup: int, warmdown: float, least: float, first: int = 0) -> Column:
    """Multiplier: a linear warm-up, 1, and a linear way down to least over the last share of the steps."""
    at, down = step - first, round(warmdown * steps)
    left = (steps - at) / down if down else F.lit(0.0)
    flat = F.when(at <= steps - down, 1.0).otherwise(left + (1 - left) * least)
    return F.when(at < warmup, (at + 1) / warmup).otherwise(flat) if warmup else flat


def momentum(step: Column, *, steps: int, warmdown: float, first: int = 0, ramp: int = 400, low: float = 0.85, high: float = 0.97, end: float = 0.90) -> Column:
    """A linear ramp from low to high, high, and a linear way to end over the last share of the steps."""
    at, down = step - first, round(warmdown * steps)
    rise, fall = at / ramp, (at - (steps - down)) / max(down, 1)
    return F.when(at < ramp, (1 - rise) * low + rise * high).when(at >= steps - down, high * (1 - fall) + end * fall).otherwise(high)


def weight_decay(step: Column, *, steps: int, start: float, first: int = 0) -> Column:
    """Half a cosine from start to 0."""
    return start * 0.5 * (1 + F.cos(math.pi * (step - first) / steps))


def batch_size(tokens: Column, *, reference_batch: int, reference_tokens: float, power: float = 0.383) -> Column:
    """The power of two nearest (half to even) to a batch that grows as a power of the training tokens."""
    wanted = reference_batch * F.pow(tokens / reference_tokens, F.lit(power))
    return F.pow(F.lit(2.0), F.bround(F.log2(wanted))).cast("long")


def rate_scale(batch: Column, reference_batch: int) -> Column:
    return F.sqrt(batch / reference_batch)


def decay_scale(batch: Column, tokens: Column, *, reference_batch: int, reference_tokens: float) -> Column:
    return F.sqrt(batch / reference_batch) * (F.lit(reference_tokens) / tokens)


def hourly_cost(device: Column, count: Column) -> Column:
    """Rate of the first known name that the device's name holds, times the number of devices."""
    rate = None
    for name, hourly in HOURLY.items():
        rate = F.when(F.contains(device, F.lit(name)), hourly) if rate is None else rate.when(F.contains(device, F.lit(name)), hourly)
    return rate.otherwise(OTHER_HOURLY) * count


def compute_fields(meta: Column, fallback_step: int = 0) -> Column:
    """step and compute of a checkpoint's JSON: the step at the top, else in the loop state, else the fallback; the
    recorded cumulative compute, else the stage's plus the inherited."""
    of = lambda path: F.get_json_object(meta, path)
    stage = F.coalesce(of("$.loop_state.stage_training_flops").cast("double"), F.lit(0.0))
    inherited = F.coalesce(of("$.loop_state.inherited_parent_flops").cast("double"), F.lit(0.0))
    return F.struct(
        F.coalesce(of("$.step").cast("long"), of("$.loop_state.step").cast("long"), F.lit(fallback_step).cast("long")).alias("step"),
        stage.alias("stage_flops"),
        inherited.alias("inherited_flops"),
        F.coalesce(of("$.loop_state.cumulative_pipeline_training_flops").cast("double"), stage + inherited).alias("cumulative_flops"),
    )


def cache_tokens(planned: Column, slack: float) -> Column:
    return F.ceil(planned * slack).cast("long")


def iterations(mixture: Column, steps: Column, tokens: Column, epochs: Column, unique: Column, batch: Column) -> Column:
    """Steps of a run: of its mixture's tokens, as given, from its own tokens, or from its epochs; one at least, but as
    given."""
    by = lambda given, n: F.when(given.isNotNull(), F.greatest(F.lit(1).cast("long"), n.cast("long")))
    return F.coalesce(by(mixture, F.floor(mixture / batch)), steps, by(tokens, F.floor(tokens / batch)), by(epochs, F.ceil(epochs * unique / batch)))


def sampling_error(temperature: Column, top_k: Column, most_tokens: Column, penalty: Column) -> Column:
    """The first knob out of its (inclusive) range; null passes."""
    bad = lambda c, low, high: c.isNotNull() & ~c.between(low, high)
    return F.coalesce(
        F.when(bad(temperature, 0.0, 2.0), "temperature"),
        F.when(bad(top_k, 0, 200), "top_k"),
        F.when(bad(most_tokens, 1, 4096), "max_tokens"),
        F.when(bad(penalty, 1.0, 2.0), "repetition_penalty"),
    )


def mixture_entry(mode: Column, parent_step: Column, batch: Column) -> Column:
    """The token at which a run enters its mixture: a continuation where its parent stopped, others at 0."""
    return F.when((mode == "continue") & parent_step.isNotNull(), parent_step * batch).otherwise(F.lit(0).cast("long"))


def run_path(stage: Column, base: Column, sft: Column, post: Column) -> Column:
    """Folder of a run: stages are nested below the run that they start from."""
    at = F.concat(F.lit("experiments/"), base)
    below = F.concat(at, F.lit("/sft/"), sft)
    return F.when(stage == "base", at).when(stage == "sft", below).otherwise(F.concat(below, F.lit("/posttrain/"), post))
