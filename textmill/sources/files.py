"""Readers of files that runs and evaluations leave: JSONL, CSV, logs, reports, token files, listings."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

T = TypeVar("T")
MESSAGES = "array<struct<role: string, content: string>>"
TOKENS_PER_ROW = 65_536


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def parquet_files(spark: SparkSession, folder: str) -> list[str]:
    """Names of the parquet files of a folder in order; unfinished ones (.tmp) are no parquet files."""
    fs, at = _fs(spark, folder)
    return sorted(n for s in (fs.listStatus(at) if fs.exists(at) else []) if (n := s.getPath().getName()).endswith(".parquet"))


def jsonl_conversations(spark: SparkSession, path: str) -> DataFrame:
    """(messages) of a file with one JSON array of messages a line; blank lines are skipped, a missing file is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"messages {MESSAGES}")
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", MESSAGES).alias("messages"))


def jsonl_parts(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Rows of part-*.jsonl of a folder; none at all is an error."""
    return spark.read.schema(schema).json(f"{folder}/part-*.jsonl")


SOURCES: dict[str, Callable[..., DataFrame]] = {
    "parquet_shards": lambda spark, path, subfolder="": spark.read.parquet("/".join(p for p in (path.rstrip("/"), subfolder) if p)),
    "jsonl": lambda spark, path, schema="text string", subfolder="": spark.read.schema(schema).json("/".join(p for p in (path.rstrip("/"), subfolder) if p)),
    "conversations": lambda spark, path: jsonl_conversations(spark, path),
}


def load(spark: SparkSession, kind: str, path: str, **options) -> DataFrame:
    """A source by the name of its adapter."""
    if kind not in SOURCES:
        raise ValueError(f"unknown source {kind!r}; choose from {', '.join(sorted(SOURCES))}")
    return SOURCES[kind](spark, path, **options)


def strict_violations(rows: DataFrame, expected: int, unique: list[str]) -> DataFrame:
    """(violation, n): another number of rows than expected, and per column the values that occur more than once."""
    counts = rows.agg(F.count("*").alias("n")).where(F.col("n") != expected).select(F.lit("rows").alias("violation"), "n")
    for c in unique:
        again = rows.groupBy(c).count().where("count > 1").agg(F.count("*").alias("n")).where("n > 0")
        counts = counts.unionByName(again.select(F.lit(f"duplicate {c}").alias("violation"), "n"))
    return counts


def strict(rows: DataFrame, expected: int, unique: list[str]) -> DataFrame:
    """rows, or an error naming what is wrong with them."""
    if found := strict_violations(rows, expected, unique).collect():
        raise ValueError("; ".join(f"{r['violation']}: {r['n']}" for r in found))
    return rows


def completed(rows: DataFrame, model: str, *, key: str = "key", model_col: str = "model_id") -> DataFrame:
    """Results of one model; a row of another model or a key that occurs twice is an error."""
    bad = rows.agg(F.count_if(~F.col(model_col).eqNullSafe(model)).alias("foreign"), (F.count(key) - F.count_distinct(key)).alias("again")).first()
    if bad["foreign"] or bad["again"]:
        raise ValueError(f"{bad['foreign']} rows of other models, {bad['again']} repeated keys")
    return rows


def csv_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV file with a header."""
    reader = spark.read.option("header", True)
    return (reader.schema(schema) if schema else reader).csv(path)


def ragged_results(spark: SparkSession, path: str) -> DataFrame:
    """(task, accuracy, centered) of result lines with three fields or more, trimmed; empty numbers are null, lines with
    other text in their place are left out."""
    f = F.transform(F.split("value", ","), lambda x: F.trim(x))
    rows = spark.read.text(path).select(f.alias("f")).where((F.size("f") >= 3) & (F.get("f", F.lit(0)) != "Task"))
    number = lambda i: F.get("f", F.lit(i)).try_cast("double")
    fine = lambda i: (F.get("f", F.lit(i)) == "") | number(i).isNotNull()
    return rows.where(fine(1) & fine(2)).select(F.get("f", F.lit(0)).alias("task"), number(1).alias("accuracy"), number(2).alias("centered"))


def log_values(lines: DataFrame, patterns: dict[str, str], *, by: str = "run", order: str = "line", text: str = "value") -> DataFrame:
    """Per log, the number (thousands separators gone) that each pattern's group caught last."""
    caught = {k: F.replace(F.nullif(F.regexp_extract(text, p, 1), F.lit("")), F.lit(","), F.lit("")) for k, p in patterns.items()}
    return lines.groupBy(by).agg(*(F.max_by(c, F.when(c.isNotNull(), F.col(order))).try_cast("double").alias(k) for k, c in caught.items()))


def section_values(section: Column, keys: list[str]) -> Column:
    """key -> what follows the first colon (up to the next) of the last line that holds the key."""
    lines = F.split(section, "\n")

    def value(key: str) -> Column:
        line = F.try_element_at(F.filter(lines, lambda x: F.contains(x, F.lit(key))), F.lit(-1))
        return F.trim(F.get(F.split(line, ":"), F.lit(1)))

    pairs = F.array(*(F.struct(F.lit(k).alias("key"), value(k).alias("value")) for k in keys))
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))


def section_time(section: Column, prefix: str) -> Column:
    """The time (yyyy-MM-dd HH:mm:ss) of the first line with the prefix that has one."""
    lines = F.filter(F.split(section, "\n"), lambda x: F.startswith(x, F.lit(prefix)))
    times = F.transform(lines, lambda x: F.try_to_timestamp(F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)), F.lit("yyyy-MM-dd HH:mm:ss")))
    return F.get(F.filter(times, lambda t: t.isNotNull()), F.lit(0))


def token_file(spark: SparkSession, path: str) -> DataFrame:
    """(file, first, tokens): files of little-endian unsigned 16-bit ids, in rows of 65,536; an empty file is an error."""
    schema = pa.schema([("file", pa.string()), ("first", pa.int64()), ("tokens", pa.list_(pa.int32()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = np.frombuffer(content.as_buffer(), "<u2").astype(np.int32)
                if not len(tokens):
                    raise ValueError(f"{file} is empty")
                for at in range(0, len(tokens), TOKENS_PER_ROW):
                    yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([at], pa.int64()), pa.array([tokens[at : at + TOKENS_PER_ROW]], pa.list_(pa.int32()))], schema=schema)

    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1), "content")
    return files.mapInArrow(scan, "file string, first long, tokens array<int>")


def inventory(spark: SparkSession, path: str, *, digests: bool = False) -> DataFrame:
    """(path, size) of all files below a folder, with oid, the SHA-256 of their content, where asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    columns = ["path", F.col("length").alias("size")]
    return files.select(*columns, F.sha2("content", 256).alias("oid")) if digests else files.select(*columns)


def drawn_table(lines: DataFrame, *, by: str = "table", order: str = "line", text: str = "value") -> DataFrame:
    """(by, order, row: map) of tables drawn with rules: the first row of fields names them (in lower case, spaces as
    underscores), rows with another number of fields are skipped."""
    fields = F.transform(F.split(text, r"[|│┃]"), lambda x: F.trim(x))
    rows = lines.where(F.regexp_like(text, F.lit(r"[|│┃]"))).select(by, order, F.filter(fields, lambda x: x != "").alias("f")).where(F.size("f") > 0)
    rows = rows.withColumn("head", F.min_by("f", order).over(Window.partitionBy(by))).withColumn("first", F.min(order).over(Window.partitionBy(by)))
    names = F.transform("head", lambda x: F.replace(F.lower(x), F.lit(" "), F.lit("_")))
    return rows.where((F.col(order) > F.col("first")) & (F.size("f") == F.size("head"))).select(by, order, F.map_from_arrays(names, "f").alias("row"))


def after(rows: DataFrame, file: int, group: int, *, epochs: int = 1, file_col: str = "file", group_col: str = "row_group") -> DataFrame:
    """rows with epoch (from 1): in the first one only those beyond a position, in later ones all."""
    beyond = (F.col(file_col) > file) | ((F.col(file_col) == file) & (F.col(group_col) > group))
    return rows.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs)))).where((F.col("epoch") > 1) | beyond)


def retried(call: Callable[[], T], *, attempts: int = 6, first: float = 1.0, most: float = 60.0, wait: Callable[[Exception], float | None] = lambda e: None, sleep: Callable[[float], None] = time.sleep) -> T:
    """The result of call, tried again after 1, 2, 4, ... seconds, or after what wait says for its error."""
    for n in range(attempts):
        try:
            return call()
        except Exception as e:
            if n == attempts - 1:
                raise
            given = wait(e)
            sleep(min(most, first * 2**n) if given is None else given)
    raise AssertionError
