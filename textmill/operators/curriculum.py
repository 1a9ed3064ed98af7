"""Curricula: specifications of routes turned into the rows that a run presents, in passes and stages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.functions.ordering import hash_order, hash_pick
from textmill.operators.sampling import round_robin_places
from textmill.operators.sharding import ranked


@dataclass(frozen=True)
class Route:
    """Rows of one route: those of at least a score, the first count of them, in so many passes.

    kind is graded or calibration (rows held out for validation stay away), or robustness or authentic (all rows).
    """

    name: str
    threshold: int = 0
    count: int | None = None
    passes: int = 1
    kind: str = "graded"
    stage: int = 1


def specification(spark: SparkSession, routes: list[Route]) -> DataFrame:
    rows = [(r.name, r.threshold, r.count, r.passes, r.kind, r.stage) for r in routes]
    return spark.createDataFrame(rows, "route string, threshold int, most long, passes int, kind string, stage int")


def held_rows(rows: DataFrame, held: DataFrame, *, group: str = "route", key: str = "conv_id") -> DataFrame:
    """All rows whose key is held out, whatever their score."""
    return rows.join(held.select(group, key), [group, key], "left_semi")


def selected(rows: DataFrame, held: DataFrame, routes: list[Route], *, seed: int, key: str = "conv_id", score: str = "score", domain: str | None = None) -> DataFrame:
    """rows (route, key, score) that a specification takes, with place (from 1) in the hash order of their route; with
    domain, places take turns among the domains of a route, so that any count of them is balanced."""
    spec = F.broadcast(specification(rows.sparkSession, routes))
    taken = rows.join(spec, "route").where((F.col("kind").isin("robustness", "authentic")) | (F.col(score) >= F.col("threshold")))
    open_ = F.col("kind").isin("graded", "calibration")
    free = taken.where(open_).join(held.select("route", key), ["route", key], "left_anti").unionByName(taken.where(~open_))
    if domain:
        placed = round_robin_places(free, ["route"], domain, key, seed=seed)
    else:
        placed = ranked(free.withColumn("_h", hash_order(seed, F.col("route"), key)), ["route"], ["_h", key], "place").drop("_h")
    return placed.where(F.col("most").isNull() | (F.col("place") <= F.col("most")))


def flat(rows: DataFrame, held: DataFrame, routes: list[Route], *, seed: int, key: str = "conv_id", score: str = "score", domain: str | None = None) -> DataFrame:
    """(route, key, pass): the selected rows, once for each pass of their route."""
    chosen = selected(rows, held, routes, seed=seed, key=key, score=score, domain=domain)
    return chosen.withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("passes")))).select("route", key, "pass")


def summary(rows: DataFrame, held: DataFrame, routes: list[Route], *, seed: int, key: str = "conv_id", score: str = "score") -> DataFrame:
    """Per route: stage, threshold, passes, rows, presentations, and the presentations of all stages up to its own."""
    chosen = selected(rows, held, routes, seed=seed, key=key, score=score).groupBy("route").agg(F.count("*").alias("rows"))
    per = specification(rows.sparkSession, routes).join(chosen, "route", "left").withColumn("rows", F.coalesce("rows", F.lit(0).cast("long")))
    per = per.withColumn("presentations", F.col("rows") * F.col("passes"))
    stages = per.groupBy(F.col("stage").alias("at")).agg(F.sum("presentations").alias("n"))
    upto = per.select("stage").distinct().join(F.broadcast(stages), F.col("at") <= F.col("stage")).groupBy("stage").agg(F.sum("n").alias("cumulative"))
    return per.join(upto, "stage").select("route", "stage", "threshold", "passes", "rows", "presentations", "cumulative")


def capped(mixture: DataFrame, most: int) -> DataFrame:
    """The first rows of a mixture (task_index, task, local, position); refused if there are fewer."""
    if mixture.limit(most).count() < most:
        raise ValueError(f"the mixture has fewer than {most} rows")
    return mixture.where(F.col("position") < most)


def selection_digest(chosen: DataFrame) -> str:
    """SHA-256 of the lines "task_index:task:local" in the order of position: what a capped run has seen.

    A digest needs the lines in order, so they stream to the driver, which holds one partition of them at a time.
    """
    from hashlib import sha256

    digest = sha256()
    lines = chosen.orderBy("position").select(F.concat_ws(":", "task_index", "task", "local").alias("line"))
    for row in lines.toLocalIterator():
        digest.update(f"{row['line']}\n".encode())
    return digest.hexdigest()


def choice(key: Column, seed: int, scope: str, options: list[str]) -> Column:
    """One of the options, by hash of the key."""
    return F.get(F.array(*map(F.lit, options)), hash_pick(hash_order(seed, scope, key), len(options)).cast("int"))


def choices(key: Column, seed: int, scope: str, options: list[str], n: int) -> Column:
    """n different options, in hash order."""
    order = F.array_sort(F.array(*(F.struct(hash_order(seed, F.lit(f"{scope}-{x}"), key).alias("h"), F.lit(x).alias("x")) for x in options)))
    return F.transform(F.slice(order, 1, n), lambda s: s["x"])


#: Fixed value: what parts the seeds of generated test rows from those of training rows.
TEST_OFFSET = 10_000_000
TEMPLATES = (
    "How many {letter} are in the word {word}",
    "Count the {letter} in {word}",
    "{word}: how often does {letter} occur",
    "Tell me the number of {letter} in {word}",
)


def letter_task(place: Column, words: list[str], *, seed: int, test: bool = False) -> Column:
    """A generated task of counting letters: question, word, letter, count and the answer spelled out.

    Nine tasks in ten ask for a letter of the word; three in ten are lower-cased; half quote word and letter and half
    end in a question mark.
    """
    at = place + (TEST_OFFSET if test else 0)
    pick = lambda scope, n: hash_pick(hash_order(seed, scope, at), n)
    word = F.get(F.array(*map(F.lit, words)), pick("word", len(words)).cast("int"))
    own = F.substr(word, (pick("own", F.length(word)) + 1).cast("int"), F.lit(1))
    other = F.substr(F.lit("abcdefghijklmnopqrstuvwxyz"), (pick("other", 26) + 1).cast("int"), F.lit(1))
    letter = F.when(pick("from", 10) < 9, own).otherwise(other)
    quote = F.when(pick("quote", 2) == 0, "'").otherwise("")
    text = F.get(F.array(*map(F.lit, TEMPLATES)), pick("template", len(TEMPLATES)).cast("int"))
    text = F.replace(F.replace(text, F.lit("{letter}"), F.concat(quote, letter, quote)), F.lit("{word}"), F.concat(quote, word, quote))
    text = F.concat(F.when(pick("case", 10) < 3, F.lower(text)).otherwise(text), F.when(pick("mark", 2) == 0, "?").otherwise(""))
    count = F.length(word) - F.length(F.replace(word, letter, F.lit("")))
    return F.struct(text.alias("question"), word.alias("word"), letter.alias("letter"), count.cast("long").alias("count"), F.array_join(F.split(word, ""), ",").alias("spelled"))


def letter_tasks(spark: SparkSession, n: int, words: list[str], *, seed: int, test: bool = False) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("place"), letter_task(F.col("id"), words, seed=seed, test=test).alias("t")).select("place", "t.*")
