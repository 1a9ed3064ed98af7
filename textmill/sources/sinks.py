"""Writers: text shards, JSON lines, manifests, cards, result tables.

Files are committed by renaming: what a failed write leaves is never read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textmill.operators.sharding import greedy_shards, numbered
from textmill.sources.files import _fs

SHARD_OPTIONS = {
    "compression": "zstd",
    "parquet.compression.codec.zstd.level": "3",
    "parquet.enable.dictionary": "false",
    "parquet.column.statistics.enabled": "false",
}


def write_text_shards(df: DataFrame, path: str, *, text: str = "text", by: list[str] = (), rows_per_group: int = 64) -> None:
    """Parquet files with the single column text, without dictionary and statistics, in row groups of so many rows; a
    folder for each value of by."""
    writer = df.select(F.col(text).alias("text"), *by).write.options(**SHARD_OPTIONS, **{"parquet.block.row.count.limit": str(rows_per_group)})
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_atomic(df: DataFrame, path: str, kind: str = "json") -> None:
    """A folder that is there whole or not at all: written beside its place and renamed; it must not exist."""
    spark = df.sparkSession
    fs, to = _fs(spark, path)
    if fs.exists(to):
        raise FileExistsError(path)
    aside = f"{path}.tmp-{uuid.uuid4().hex}"
    getattr(df.write, kind)(aside)
    if not fs.rename(_fs(spark, aside)[1], to):
        raise OSError(f"{aside} can't be renamed to {path}")


def append_lines(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, added to a folder."""
    df.write.mode("append").json(path)


def write_string(spark: SparkSession, text: str, path: str) -> None:
    """A small file, in place whole or not at all."""
    fs, to = _fs(spark, path)
    aside = _fs(spark, f"{path}.tmp-{uuid.uuid4().hex}")[1]
    out = fs.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    fs.delete(to, False)
    if not fs.rename(aside, to):
        raise OSError(f"{path} can't be written")


def resharded(df: DataFrame, key: str, amount: str, *, validation: int, budget: int, has_validation: bool = False) -> DataFrame:
    """(key, shard name) of a re-sharded stream: the first rows are validation where the source has no split of its own
    (the shard numbered 99999), the rest goes to shards that close when their characters reach the budget."""
    rows = numbered(df.select(key, amount), [key], "_n")
    held = rows.where(F.col("_n") < (0 if has_validation else validation))
    rest = greedy_shards(rows.join(held.select(key), key, "left_anti"), key, amount, budget)
    name = lambda n: F.format_string("shard_%05d", n)
    return held.select(F.col(key).cast("long").alias(key), F.lit("shard_99999").alias("shard")).unionByName(rest.select(key, name(F.col("shard")).alias("shard")))


def manifest(shards: DataFrame, *, shard: str = "shard", chars: str = "n_chars") -> DataFrame:
    """Per shard: documents and characters, and their share of all."""
    per = shards.groupBy(shard).agg(F.count("*").alias("documents"), F.sum(chars).cast("long").alias("chars"))
    total = per.agg(F.sum("documents").alias("_d"), F.sum("chars").alias("_c"))
    return per.crossJoin(F.broadcast(total)).select(shard, "documents", "chars", (F.col("documents") / F.col("_d")).alias("share"), (F.col("chars") / F.col("_c")).alias("chars_share"))


def manifest_json(shards: DataFrame, filters: dict, *, shard: str = "shard", chars: str = "n_chars") -> str:
    """The manifest as JSON: filters, one record a shard, and totals.  There are few shards, one row each."""
    import json

    records = [r.asDict() for r in manifest(shards, shard=shard, chars=chars).select(shard, "documents", "chars").orderBy(shard).toLocalIterator()]
    totals = {k: sum(r[k] for r in records) for k in ("documents", "chars")}
    return json.dumps({"filters": filters, "shards": records, "totals": totals}, sort_keys=True)


def card_table(counts: DataFrame, name: str, n: str = "n") -> DataFrame:
    """(place, line) of a markdown table: names by falling count with their share; equal counts by name."""
    total = counts.agg(F.sum(n).alias("_t"))
    rows = counts.crossJoin(F.broadcast(total)).select(
        F.struct((-F.col(n)).alias("n"), F.col(name).alias("name")).alias("place"),
        F.format_string("| %s | %d | %.2f%% |", F.col(name).cast("string"), F.col(n), 100.0 * F.col(n) / F.col("_t")).alias("line"),
    )
    return rows


def card(title: str, seen: int, passed: int, rejections: DataFrame, topics: DataFrame) -> str:
    """A dataset card from two small tables of counts (reason, n) and (topic, n)."""
    part = lambda df, name: [r["line"] for r in card_table(df, name).orderBy("place").collect()]
    rate = 100.0 * passed / seen if seen else 0.0
    head = [f"# {title}", "", f"{passed:,} of {seen:,} rows passed ({rate:.2f} %).", ""]
    return "\n".join([*head, "| reason | rows | share |", "|-|-|-|", *part(rejections, "reason"), "", "| topic | rows | share |", "|-|-|-|", *part(topics, "topic"), ""])


def result_lines(results: DataFrame) -> DataFrame:
    """(place, line) of a result file: a header, a line a task in order of name, and the mean of the centered results."""
    line = lambda a, b, c: F.format_string("%-35s, %-10s, %-10s", a, b, c)
    number = lambda c: F.format_string("%.6f", c)
    head = results.sparkSession.createDataFrame([(0, "", "Task", "Accuracy", "Centered")], "part int, task string, a string, b string, c string")
    tasks = results.select(F.lit(1).alias("part"), "task", F.col("task").alias("a"), number("accuracy").alias("b"), number("centered").alias("c"))
    core = results.agg(F.avg("centered").alias("m")).select(F.lit(2).alias("part"), F.lit("").alias("task"), F.lit("CORE").alias("a"), F.lit("").alias("b"), number("m").alias("c"))
    return head.unionByName(tasks).unionByName(core).select(F.struct("part", "task").alias("place"), line("a", "b", "c").alias("line"))


def metric_table(values: DataFrame, stages: list[str]) -> DataFrame:
    """(metric, a column a stage) of rows (stage, metric, value), with place: CORE first, ChatCORE last, others by name."""
    wide = values.groupBy("metric").pivot("stage", stages).agg(F.first("value"))
    return wide.withColumn("place", F.struct((F.col("metric") != "CORE").alias("a"), (F.col("metric") == "ChatCORE").alias("b"), "metric"))


def report(sections: list[tuple[str, str]], values: DataFrame, stages: list[str]) -> str:
    """Markdown: sections one after another, and the table of final metrics by stage."""
    rows = metric_table(values, stages).orderBy("place").collect()
    table = [f"| metric | {' | '.join(stages)} |", f"|-|{'-|' * len(stages)}", *(f"| {r['metric']} | {' | '.join(str(r[s]) if r[s] is not None else '-' for s in stages)} |" for r in rows)]
    return "\n\n".join([*(f"## {name}\n\n{body}" for name, body in sections), "## Summary\n\n" + "\n".join(table)]) + "\n"


def publishable(before: DataFrame, now: DataFrame, required: list[str], *, valid: str = "valid") -> DataFrame:
    """(step) of checkpoints whose required kinds of files (step, kind, path, size) are all there, valid, and have had the
    same size in two listings."""
    same = now.join(before.select("path", F.col("size").alias("_before")), "path", "left")
    fine = F.col("size").eqNullSafe(F.col("_before")) & F.coalesce(F.col(valid), F.lit(False))
    per = same.groupBy("step").agg(F.bool_and(fine).alias("fine"), F.count_distinct(F.when(F.col("kind").isin(required), F.col("kind"))).alias("n"))
    return per.where(F.col("fine") & (F.col("n") == len(set(required)))).select("step")
