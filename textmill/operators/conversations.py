"""Conversations: validation, repair, merging, windows of context, mixtures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textmill.functions.ordering import hash_order
from textmill.operators.sharding import numbered


def has_system(messages: Column) -> Column:
    return F.coalesce(F.get(messages, F.lit(0))["role"] == "system", F.lit(False))


def alternates(messages: Column, least: int = 2) -> Column:
    """After an optional system message: at least so many messages, user and assistant in turn, user first."""
    lead = has_system(messages).cast("int")
    rest = F.slice(messages, lead + 1, F.greatest(F.size(messages) - lead, F.lit(0)))
    turn = F.transform(rest, lambda m, i: m["role"].eqNullSafe(F.when(i % 2 == 0, "user").otherwise("assistant")))
    return (F.size(rest) >= least) & F.forall(turn, lambda x: x)


def first_error(messages: Column, *, most_messages: int = 500, most_chars: int = 8000, most_total: int = 32000) -> Column:
    """The first rule that a request breaks, null if none."""
    text = lambda m: F.coalesce(m["content"], F.lit(""))
    total = F.aggregate(messages, F.lit(0).cast("long"), lambda n, m: n + F.length(text(m)))
    return F.coalesce(
        F.when(F.size(messages) <= 0, "no messages"),
        F.when(F.size(messages) > most_messages, "too many messages"),
        F.when(F.exists(messages, lambda m: text(m) == ""), "empty message"),
        F.when(F.exists(messages, lambda m: F.length(text(m)) > most_chars), "message too long"),
        F.when(total > most_total, "conversation too long"),
        F.when(F.exists(messages, lambda m: ~F.coalesce(m["role"], F.lit("")).isin("system", "user", "assistant")), "unknown role"),
        F.when(F.exists(F.slice(messages, 2, F.greatest(F.size(messages) - 1, F.lit(0))), lambda m: m["role"] == "system"), "system not first"),
    )


def merge_system(messages: Column) -> Column:
    """A leading system message joined to the first user message by a blank line."""
    first = F.get(messages, F.lit(1))
    joined = F.struct(first["role"].alias("role"), F.concat(F.get(messages, F.lit(0))["content"], F.lit("\n\n"), first["content"]).alias("content"))
    tail = F.slice(messages, 3, F.greatest(F.size(messages) - 2, F.lit(0)))
    return F.when(has_system(messages) & (F.size(messages) > 1), F.concat(F.array(joined), tail)).otherwise(messages)


def instruct_last_user(turns: DataFrame, instruction: str) -> DataFrame:
    """turns (conv_id, turn, role, text) with the instruction behind the last user text of each conversation."""
    last = F.max(F.when(F.col("role") == "user", F.col("turn"))).over(Window.partitionBy("conv_id"))
    return turns.withColumn("text", F.when(F.col("turn") == last, F.concat("text", F.lit(instruction))).otherwise(F.col("text")))


def rounds(messages: Column) -> Column:
    return F.floor((F.size(messages) - has_system(messages).cast("int")) / 2).cast("long")


def context_suffix(turns: DataFrame, budget: int, tokens: str = "tokens") -> DataFrame:
    """The latest turns of each conversation whose tokens fit the budget together; the last turn always stays."""
    newest = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    used = F.sum(tokens).over(newest.rowsBetween(Window.unboundedPreceding, 0))
    return turns.withColumn("used", used).withColumn("_n", F.row_number().over(newest)).where((F.col("used") <= budget) | (F.col("_n") == 1)).drop("_n")


def fitted(turns: DataFrame, budget: int, *, reply: int = 0, tokens: str = "tokens") -> DataFrame:
    """The turns of each conversation that fit a budget less what the reply needs: leading system turns always, and of the
    rest the latest exchanges (a user turn and what follows it), whole ones only; where not even the last exchange fits, it
    stays alone, cut from the left (column kept, the tokens that are left of a turn)."""
    at = Window.partitionBy("conv_id").orderBy("turn")
    asked = F.sum((F.col("role") == "user").cast("long")).over(at.rowsBetween(Window.unboundedPreceding, 0))
    rows = turns.withColumn("_exchange", F.coalesce(asked, F.lit(0)))
    lead = rows.groupBy("conv_id").agg(F.coalesce(F.sum(F.when(F.col("_exchange") == 0, F.col(tokens))), F.lit(0)).alias("_lead"))
    sizes = rows.where("_exchange > 0").groupBy("conv_id", "_exchange").agg(F.sum(tokens).alias("_size")).join(lead, "conv_id")
    newest = Window.partitionBy("conv_id").orderBy(F.desc("_exchange"))
    sizes = sizes.withColumns({"_used": F.sum("_size").over(newest.rowsBetween(Window.unboundedPreceding, 0)), "_k": F.row_number().over(newest)})
    room = F.lit(budget - reply) - F.col("_lead")
    kept = sizes.where((F.col("_used") <= room) | (F.col("_k") == 1)).select("conv_id", "_exchange", F.greatest(F.col("_size") - room, F.lit(0)).alias("_over"))
    before = F.coalesce(F.sum(tokens).over(Window.partitionBy("conv_id", "_exchange").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    body = rows.withColumn("_before", before).join(kept, ["conv_id", "_exchange"])
    left = F.least(F.col(tokens), F.greatest(F.col("_before") + F.col(tokens) - F.col("_over"), F.lit(0)))
    head = rows.where("_exchange = 0").withColumn("kept", F.col(tokens)).drop("_exchange")
    return head.unionByName(body.withColumn("kept", left).drop("_exchange", "_before", "_over").where("kept > 0"))


def priming(spec: str | None, named: dict[str, list[dict]]) -> list[dict]:
    """Messages that a conversation is primed with: none, a named block, or JSON (a list, or an object with messages).

    They must be exchanges: an even number of texts that aren't blank, user and assistant in turn.
    """
    import json

    if spec is None or not spec.strip():
        return []
    if spec.strip() in named:
        turns = named[spec.strip()]
    else:
        found = json.loads(spec)
        turns = found["messages"] if isinstance(found, dict) else found
    if len(turns) % 2 or any(m.get("role") != ("user", "assistant")[i % 2] or not str(m.get("content", "")).strip() for i, m in enumerate(turns)):
        raise ValueError("priming turns must be exchanges of user and assistant")
    return [{"role": m["role"], "content": m["content"]} for m in turns]


def mixture(tasks: dict[str, DataFrame], key: str, *, seed: int = 42) -> DataFrame:
    """UNION ALL of tasks (a task listed twice counts twice) in one hash order: task, key, position."""
    rows = None
    for i, (name, df) in enumerate(tasks.items()):
        part = df.select(F.lit(i).alias("task_index"), F.lit(name).alias("task"), F.col(key).cast("long").alias("local"))
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.withColumn("_h", hash_order(seed, F.col("task_index").cast("string"), "local"))
    return numbered(rows, ["_h", "task_index", "local"], "position").drop("_h")


def sequence(tasks: dict[str, DataFrame], key: str) -> DataFrame:
    """Tasks one after another, each in the order of its key."""
    rows = None
    for i, (name, df) in enumerate(tasks.items()):
        part = df.select(F.lit(i).alias("task_index"), F.lit(name).alias("task"), F.col(key).cast("long").alias("local"))
        rows = part if rows is None else rows.unionByName(part)
    return numbered(rows, ["task_index", "local"], "position")


def view(df: DataFrame, index: str, start: int = 0, stop: int | None = None, step: int = 1) -> DataFrame:
    """A logical slice; stop isn't clamped."""
    at = F.col(index)
    return df.where((at >= start) & ((at - start) % step == 0) & (F.lit(True) if stop is None else at < stop))


def staged(rows: DataFrame, stages: DataFrame) -> DataFrame:
    """Cumulative stages: stage k has every route added in stages up to k (stages: stage, route added there)."""
    numbers = stages.select("stage").distinct().withColumnRenamed("stage", "at")
    have = numbers.crossJoin(F.broadcast(stages)).where("stage <= at").select(F.col("at").alias("stage"), "route")
    return rows.join(F.broadcast(have), "route")
