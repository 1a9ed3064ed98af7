"""Analytics of token losses: bits spread over words, summaries by text, comparison of two models."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.operators.evaluation import bits_per_byte, top_mean
from textmill.operators.sharding import running_total

#: Words of raw UTF-8: parted by ASCII white space.
WORD = re.compile(rb"[^ \t\n\x0b\x0c\r]+")


def word_spans(text: bytes) -> np.ndarray:
    """(start, end) of each word, in bytes."""
    return np.array([m.span() for m in WORD.finditer(text)], np.int64).reshape(-1, 2)


def word_bits(rows: DataFrame, *, key: str = "key", text: str = "text", nats: str = "nats", n_bytes: str = "n_bytes") -> DataFrame:
    """(key, place, start, n_bytes, bits): bits that a model spent on each word of a text.

    nats and n_bytes are arrays with an entry for each token; a token's bits are spread evenly over its bytes, and
    tokens without bytes count for nothing.  The bits up to a byte are a broken line over the ends of the tokens, so a
    word has the difference at its two ends.  Words that begin beyond the last scored byte are left out, and the last
    one may be cut there.
    """
    schema = pa.schema([("key", pa.int64()), ("place", pa.int64()), ("start", pa.int64()), ("n_bytes", pa.int64()), ("bits", pa.float64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, content, loss, size in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                content, loss, size = content or b"", np.array(loss or [], float), np.array(size or [], np.int64)
                ends = np.concatenate([[0], np.cumsum(size[size > 0])])
                sums = np.concatenate([[0.0], np.cumsum(loss[size > 0] / math.log(2))])
                scored = min(int(ends[-1]), len(content))
                spans = word_spans(content)
                spans = spans[spans[:, 0] < scored]
                last = np.minimum(spans[:, 1], scored)
                bits = np.interp(last, ends, sums) - np.interp(spans[:, 0], ends, sums)
                n = len(spans)
                yield pa.RecordBatch.from_arrays([pa.array([k] * n, pa.int64()), pa.array(np.arange(n)), pa.array(spans[:, 0]), pa.array(last - spans[:, 0]), pa.array(bits)], schema=schema)

    return rows.select(F.col(key).cast("long"), text, F.col(nats).cast("array<double>"), F.col(n_bytes).cast("array<bigint>")).mapInArrow(scan, "key long, place long, start long, n_bytes long, bits double")


def text_bits(words: DataFrame, k: int) -> DataFrame:
    """(key, mean, peak): bits a byte of each text, and the mean of its k highest words; texts without bytes are left out."""
    per = F.collect_list(F.when(F.col("n_bytes") > 0, F.col("bits") / F.col("n_bytes")))
    return words.groupBy("key").agg(F.sum("bits").alias("b"), F.sum("n_bytes").alias("n"), per.alias("each")).where("n > 0").select("key", (F.col("b") / F.col("n")).alias("mean"), top_mean(F.col("each"), k).alias("peak"))


def bits_delta(ours: DataFrame, theirs: DataFrame, k: int) -> DataFrame:
    """(key, mean, peak) of our bits a byte less theirs, word by word: words are joined by place, which ends both at the
    shorter side; the mean is over all bytes that we scored."""
    total = ours.groupBy("key").agg(F.sum("n_bytes").alias("total"))
    b = theirs.select("key", "place", F.col("n_bytes").alias("_n"), F.col("bits").alias("_b"))
    both = ours.join(b, ["key", "place"])
    each = F.when((F.col("n_bytes") > 0) & (F.col("_n") > 0), F.col("bits") / F.col("n_bytes") - F.col("_b") / F.col("_n"))
    per = both.groupBy("key").agg(F.sum(F.col("bits") - F.col("_b")).alias("d"), F.collect_list(each).alias("each")).where(F.size("each") > 0)
    return per.join(total.where("total > 0"), "key").select("key", (F.col("d") / F.col("total")).alias("mean"), top_mean(F.col("each"), k).alias("peak"))


def loss_summary(losses: Column, k: int = 3) -> Column:
    """mean, peak (mean of the k highest) and n_tokens of an array of losses; null scores and no tokens if it is empty."""
    n = F.size(losses)
    mean = F.when(n > 0, F.aggregate(losses, F.lit(0.0), lambda a, x: a + x) / n)
    return F.struct(mean.alias("mean"), top_mean(losses, k).alias("peak"), F.greatest(n, F.lit(0)).cast("long").alias("n_tokens"))


def verdict(auc: Column) -> Column:
    """Whether a score tells positives from negatives."""
    return F.when(auc >= 0.8, "SIGNAL").when(auc >= 0.65, "WEAK").otherwise("NO SIGNAL")


def grouped_bits(rows: DataFrame, by: list[str], nats: str, n_bytes: str) -> DataFrame:
    return rows.groupBy(*by).agg(bits_per_byte(F.col(nats), F.col(n_bytes)).alias("bits_per_byte"))


def token_bytes(tokens: DataFrame, vocabulary: DataFrame, token: str = "token") -> DataFrame:
    """tokens with n_bytes, the length of their token in vocabulary (token, n_bytes); unknown ones have none."""
    return tokens.join(vocabulary.select(F.col("token").alias(token), "n_bytes"), token, "left").withColumn("n_bytes", F.coalesce("n_bytes", F.lit(0)))


def throughput(log: DataFrame, *, batch: int, per_token: float, peak: float, steps: int, skip: int = 10) -> DataFrame:
    """Per step of log (step, seconds): tokens and compute a second, use of the peak, share done, and the time to go at
    the mean pace of the steps after the first skip."""
    paced = log.withColumn("_s", F.when(F.col("step") > skip, F.col("seconds")).otherwise(0.0)).withColumn("_n", (F.col("step") > skip).cast("long"))
    run = running_total(running_total(paced, "step", "_s", "_spent"), "step", "_n", "_paced")
    rate = batch / F.col("seconds")
    return run.select(
        "step",
        rate.alias("tokens_per_second"),
        (per_token * rate).alias("flops_per_second"),
        (100 * per_token * rate / peak).alias("percent_of_peak"),
        (100 * F.col("step") / steps).alias("percent_done"),
        F.when(F.col("_paced") > 0, (steps - F.col("step")) * F.col("_spent") / F.col("_paced")).alias("seconds_left"),
    )
