"""Queries of token losses, over benchmark items (their tokens being runs of three bytes) and other tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from textmill.catalog import register
from textmill.operators import evaluation, losses
from textmill.sources.tables import table


def _scored(spark, sf_dir, factor):
    """benchmark items with made-up losses: (item_id * factor + 7 k) % 11 / 4 nats for the k-th run of three bytes."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), "text", F.octet_length("text").alias("n"))
    tokens = F.when(F.col("n") > 0, F.sequence(F.lit(0), F.floor((F.col("n") - 1) / 3).cast("int"))).otherwise(F.array().cast("array<int>"))
    nats = F.transform(tokens, lambda k: (F.col("key") * factor + 7 * k) % 11 / 4)
    size = F.transform(tokens, lambda k: F.least(F.lit(3), F.col("n") - 3 * k))
    return losses.word_bits(items.select("key", "text", nats.alias("nats"), size.alias("n_bytes")))


WORDS = r"""
g AS (SELECT item_id AS key, unnest(regexp_extract_all(text, '[ \t\n\x0b\x0c\r]*[^ \t\n\x0b\x0c\r]+')) AS seg,
  generate_subscripts(regexp_extract_all(text, '[ \t\n\x0b\x0c\r]*[^ \t\n\x0b\x0c\r]+'), 1) - 1 AS place FROM benchmark),
s AS (SELECT key, place, strlen(regexp_replace(seg, '^[ \t\n\x0b\x0c\r]+', '')) AS n_bytes,
  sum(strlen(seg)) OVER (PARTITION BY key ORDER BY place) AS stop FROM g),
w AS (SELECT key, place, CAST(stop - n_bytes AS BIGINT) AS start, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(stop AS BIGINT) AS stop FROM s)"""


def _bits(name: str, factor: int) -> str:
    return f"""
{name}_t AS (SELECT item_id AS key, k * 3 AS a, least(k * 3 + 3, strlen(text)) AS b, ((item_id * {factor} + 7 * k) % 11) / 4.0 / ln(2) AS bits
  FROM benchmark, LATERAL (SELECT unnest(range((strlen(text) + 2) // 3)) AS k)),
{name} AS (SELECT w.key, w.place, w.start, w.n_bytes, sum(t.bits * (least(t.b, w.stop) - greatest(t.a, w.start)) / (t.b - t.a)) AS bits
  FROM w JOIN {name}_t t ON t.key = w.key AND t.a < w.stop AND t.b > w.start GROUP BY ALL)"""


@register("h36_word_bits", f"WITH {WORDS}, {_bits('v', 3)} SELECT key, place, start, n_bytes, round(bits, 6) AS bits FROM v")
def word_bits(spark, sf_dir):
    return _scored(spark, sf_dir, 3).select("key", "place", "start", "n_bytes", F.round("bits", 6).alias("bits"))


@register("h19_byte_words", r"""
SELECT doc_id, CAST(len(regexp_extract_all(text, '[^ \t\n\x0b\x0c\r]+')) AS BIGINT) AS words,
       CAST(strlen(regexp_replace(text, '[ \t\n\x0b\x0c\r]+', '', 'g')) AS BIGINT) AS word_bytes
FROM documents WHERE text IS NOT NULL
""")
def byte_words(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    words = F.size(F.regexp_extract_all("text", F.lit(r"[^ \t\n\x0b\x0c\r]+"), F.lit(0)))
    return docs.select("doc_id", words.cast("long").alias("words"), F.octet_length(F.regexp_replace("text", r"[ \t\n\x0b\x0c\r]+", "")).cast("long").alias("word_bytes"))


@register("i10_text_bits", f"""
WITH {WORDS}, {_bits('v', 3)}, r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY bits / n_bytes DESC) AS r FROM v)
SELECT key, round(sum(bits) / sum(n_bytes), 6) AS mean, round(avg(bits / n_bytes) FILTER (r <= 3), 6) AS peak FROM r GROUP BY key
""")
def text_bits(spark, sf_dir):
    return losses.text_bits(_scored(spark, sf_dir, 3), 3).select("key", F.round("mean", 6).alias("mean"), F.round("peak", 6).alias("peak"))


@register("e7_word_deltas", f"""
WITH {WORDS}, {_bits('v', 3)}, {_bits('m', 5)},
d AS (SELECT v.key, v.n_bytes, v.bits - m.bits AS d, (v.bits - m.bits) / v.n_bytes AS per FROM v JOIN m USING (key, place)),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY per DESC) AS r FROM d)
SELECT key, round(sum(d) / sum(n_bytes), 6) AS mean, round(avg(per) FILTER (r <= 3), 6) AS peak FROM r GROUP BY key
""")
def word_deltas(spark, sf_dir):
    return losses.bits_delta(_scored(spark, sf_dir, 3), _scored(spark, sf_dir, 5), 3).select("key", F.round("mean", 6).alias("mean"), F.round("peak", 6).alias("peak"))


@register("i11_loss_summaries", """
WITH l AS (SELECT conv_id, (conv_id * 7 + turn * 13) % 17 / 4.0 AS x FROM conversations),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY x DESC) AS r FROM l)
SELECT conv_id, round(avg(x), 6) AS mean, round(avg(x) FILTER (r <= 3), 6) AS peak, count(*) AS n_tokens FROM r GROUP BY conv_id
""")
def loss_summaries(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").withColumn("x", (F.col("conv_id") * 7 + F.col("turn") * 13) % 17 / 4)
    found = rows.groupBy("conv_id").agg(losses.loss_summary(F.collect_list("x")).alias("s"))
    return found.select("conv_id", F.round("s.mean", 6).alias("mean"), F.round("s.peak", 6).alias("peak"), "s.n_tokens")


@register("i9_verdicts", """
WITH p AS (SELECT p_brand, avg(CASE WHEN a.y > b.y THEN 1.0 WHEN a.y = b.y THEN 0.5 ELSE 0.0 END) AS auc
  FROM (SELECT p_brand, p_size % 20 + CASE WHEN p_partkey % 3 = 0 THEN length(p_brand) ELSE 0 END AS y FROM part WHERE p_partkey % 2 = 0) a
  JOIN (SELECT p_brand, p_size % 20 AS y FROM part WHERE p_partkey % 2 = 1) b USING (p_brand) GROUP BY p_brand)
SELECT p_brand, CASE WHEN auc >= 0.8 THEN 'SIGNAL' WHEN auc >= 0.65 THEN 'WEAK' ELSE 'NO SIGNAL' END AS verdict FROM p
""")
def verdicts(spark, sf_dir):
    part, odd = table(spark, sf_dir, "part"), F.col("p_partkey") % 2 == 1
    score = F.col("p_size") % 20 + F.when(~odd & (F.col("p_partkey") % 3 == 0), F.length("p_brand")).otherwise(0)
    return evaluation.grouped_auc(part.select("p_brand", score.alias("y"), (~odd).alias("positive")), "p_brand", "y", "positive").select("p_brand", losses.verdict(F.col("auc")).alias("verdict"))


@register("i26_bits_by_source", """
SELECT source, lang, round(sum(n_chars * ((doc_id % 7) + 1)) / (ln(2) * sum(strlen(text))), 6) AS bits_per_byte
FROM documents WHERE strlen(text) > 0 GROUP BY source, lang
""")
def bits_by_source(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("source", "lang", (F.col("n_chars") * (F.col("doc_id") % 7 + 1)).alias("nats"), F.octet_length("text").alias("n_bytes")).where("n_bytes > 0")
    return losses.grouped_bits(rows, ["source", "lang"], "nats", "n_bytes").withColumn("bits_per_byte", F.round("bits_per_byte", 6))


@register("e6_token_bytes", """
SELECT l_orderkey, CAST(sum(coalesce(length(p_name), 0)) AS BIGINT) AS n_bytes
FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_size > 5 GROUP BY l_orderkey
""")
def token_bytes(spark, sf_dir):
    vocabulary = table(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").alias("token"), F.octet_length("p_name").alias("n_bytes"))
    tokens = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("token"))
    return losses.token_bytes(tokens, vocabulary).groupBy("l_orderkey").agg(F.sum("n_bytes").cast("long").alias("n_bytes"))


@register("i39_throughput", """
WITH s AS (SELECT o_orderkey AS step, 0.5 + o_custkey % 9 / 4.0 AS seconds FROM orders), t AS (SELECT max(step) AS steps FROM s),
r AS (SELECT *, sum(CASE WHEN step > 10 THEN seconds END) OVER (ORDER BY step) AS spent, count(CASE WHEN step > 10 THEN 1 END) OVER (ORDER BY step) AS n FROM s, t)
SELECT step, round(4096 / seconds, 6) AS tokens_per_second, round(6e9 * 4096 / seconds, 0) AS flops_per_second, round(100 * 6e9 * (4096 / seconds) / 1e15, 6) AS percent_of_peak,
       round(100.0 * step / steps, 6) AS percent_done, round(CASE WHEN n > 0 THEN (steps - step) * spent / n END, 4) AS seconds_left FROM r
""")
def throughput(spark, sf_dir):
    log = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("step"), (0.5 + F.col("o_custkey") % 9 / 4).alias("seconds"))
    steps = log.agg(F.max("step")).first()[0] or 1
    out = losses.throughput(log, batch=4096, per_token=6e9, peak=1e15, steps=steps)
    digits = {"tokens_per_second": 6, "flops_per_second": 0, "percent_of_peak": 6, "percent_done": 6, "seconds_left": 4}
    return out.select("step", *(F.round(c, n).alias(c) for c, n in digits.items()))
