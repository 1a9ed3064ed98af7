"""Queries of merges, prefixes, roll-ups, fits and plans over records of runs and evaluations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textmill.catalog import register
from textmill.functions import ordering, text
from textmill.operators import evaluation, lineage, records
from textmill.sources.tables import table


def _shards(spark, sf_dir):
    """benchmark items answered by three shards: some twice, some never."""
    items = table(spark, sf_dir, "benchmark")
    k = F.col("item_id")
    one = lambda n, keep: items.where(keep).select(F.lit(n).alias("shard"), k.alias("key"), F.md5("text").alias("prompt"), (k * n % 7).alias("answer"))
    return one(1, k % 3 == 0).unionByName(one(2, (k % 3 == 1) & (k % 13 != 0))).unionByName(one(3, (k % 3 == 2) | (k % 10 == 0)))


SHARDS = "s AS (SELECT 1 AS shard, item_id AS key, (item_id * 1) % 7 AS answer FROM benchmark WHERE item_id % 3 = 0 UNION ALL SELECT 2, item_id, item_id * 2 % 7 FROM benchmark WHERE item_id % 3 = 1 AND item_id % 13 <> 0 UNION ALL SELECT 3, item_id, item_id * 3 % 7 FROM benchmark WHERE item_id % 3 = 2 OR item_id % 10 = 0)"


@register("e2_merge_violations", f"WITH {SHARDS}, c AS (SELECT key, count(*) AS n FROM s GROUP BY key) SELECT i.item_id AS key, CASE WHEN c.n IS NULL THEN 'missing' ELSE 'duplicate' END AS violation FROM benchmark i LEFT JOIN c ON c.key = i.item_id WHERE c.n IS NULL OR c.n > 1")
def merge_violations(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), F.md5("text").alias("prompt"))
    return records.merge_violations(items, _shards(spark, sf_dir))


@register("e3_completed_prefix", f"WITH {SHARDS}, i AS (SELECT item_id AS key, EXISTS (SELECT 1 FROM s WHERE s.key = item_id) AS done FROM benchmark) SELECT key FROM (SELECT key, sum(CASE WHEN done THEN 0 ELSE 1 END) OVER (ORDER BY key) AS gaps FROM i) WHERE gaps = 0")
def completed_prefix(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"))
    return records.completed_prefix(items, _shards(spark, sf_dir), "key")


@register("i40_milestones", f"WITH {SHARDS}, i AS (SELECT item_id AS key, EXISTS (SELECT 1 FROM s WHERE s.key = item_id) AS done FROM benchmark), n AS (SELECT count(*) AS n FROM (SELECT key, sum(CASE WHEN done THEN 0 ELSE 1 END) OVER (ORDER BY key) AS gaps FROM i) WHERE gaps = 0) SELECT m AS milestone FROM n, range(5, (SELECT count(*) FROM benchmark) + 1, 5) AS r(m) WHERE m > 5 AND m <= n")
def milestones(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"))
    prefix = records.completed_prefix(items, _shards(spark, sf_dir), "key")
    return records.milestones(prefix, items, every=5, published=5)


@register("d13_few_shot_examples", """
WITH i AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS pos, count(*) OVER () - 1 AS m FROM benchmark),
h AS (SELECT *, [CAST('0x' || substr(md5((1234 + item_id) || ':shots:' || k), 1, 8) AS BIGINT) FOR k IN [0, 1, 2]] AS h FROM i),
a AS (SELECT *, h[1] % (m - 2) AS x0, h[2] % (m - 1) AS x1, h[3] % m AS x2 FROM h),
b AS (SELECT *, CASE WHEN x1 = x0 THEN m - 2 ELSE x1 END AS y1 FROM a),
c AS (SELECT *, CASE WHEN x2 IN (x0, y1) THEN m - 1 ELSE x2 END AS y2 FROM b),
d AS (SELECT item_id, pos, unnest([x0, y1, y2]) AS x, unnest([1, 2, 3]) AS place FROM c)
SELECT d.item_id, i.item_id AS other, place FROM d JOIN i ON i.pos = CASE WHEN d.x >= d.pos THEN d.x + 1 ELSE d.x END
""")
def few_shot_examples(spark, sf_dir):
    return records.few_shot(table(spark, sf_dir, "benchmark"), "item_id", 3, seed=1234)


@register("d14_hash_head", "SELECT doc_id FROM documents ORDER BY md5('1337:head:' || doc_id), doc_id LIMIT 50")
def hash_head(spark, sf_dir):
    return table(spark, sf_dir, "documents").orderBy(ordering.hash_order(1337, "head", "doc_id"), "doc_id").limit(50).select("doc_id")


@register("e5_centered_by_task", "WITH t AS (SELECT p_brand AS task, avg(CASE WHEN p_size % 3 = 0 THEN 1.0 ELSE 0.0 END) AS acc FROM part GROUP BY p_brand), b AS (SELECT DISTINCT p_brand AS task, length(p_brand) / 40.0 AS base FROM part) SELECT task, round((acc - base) / (1 - base), 6) AS centered FROM t JOIN b USING (task)")
def centered_by_task(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    acc = part.groupBy(F.col("p_brand").alias("task")).agg(F.avg((F.col("p_size") % 3 == 0).cast("double")).alias("acc"))
    base = part.select(F.col("p_brand").alias("task"), (F.length("p_brand") / 40.0).alias("base")).distinct()
    return acc.join(base, "task").select("task", F.round(evaluation.centered(F.col("acc"), F.col("base")), 6).alias("centered"))


@register("i14_core", "WITH t AS (SELECT p_brand, avg(CASE WHEN p_size % 3 = 0 THEN 1.0 ELSE 0.0 END) AS acc FROM part GROUP BY p_brand) SELECT round(avg((acc - 0.25) / 0.75), 6) AS core, count(*) AS tasks FROM t")
def core(spark, sf_dir):
    acc = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.avg((F.col("p_size") % 3 == 0).cast("double")).alias("acc"))
    return acc.agg(F.round(F.avg(evaluation.centered(F.col("acc"), F.lit(0.25))), 6).alias("core"), F.count("*").alias("tasks"))


@register("i15_guarded_mean", "WITH t AS (SELECT c_nationkey % 5 AS suite, c_mktsegment AS task, avg(c_acctbal) AS score FROM customer GROUP BY ALL) SELECT suite, CASE WHEN count(*) = 5 THEN round(avg(score), 4) END AS mean FROM t GROUP BY suite")
def guarded_mean(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").groupBy((F.col("c_nationkey") % 5).alias("suite"), F.col("c_mktsegment").alias("task")).agg(F.avg("c_acctbal").alias("score"))
    return rows.groupBy("suite").agg(F.when(F.count("*") == 5, F.round(F.avg("score"), 4)).alias("mean"))


@register("i17_letter_argmax", "WITH c AS (SELECT item_id, k, (item_id * 13 + k * 29) % 31 AS logit FROM benchmark, range(4) AS r(k)) SELECT item_id, substr('ABCD', CAST(arg_max(k, logit * 10 - k) + 1 AS BIGINT), 1) AS letter FROM c GROUP BY item_id")
def letter_argmax(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    best = rows.groupBy("item_id").agg(F.max_by("k", F.struct(((F.col("item_id") * 13 + F.col("k") * 29) % 31).alias("logit"), -F.col("k"))).alias("k"))
    return best.select("item_id", F.substr(F.lit("ABCD"), F.col("k") + 1, F.lit(1)).alias("letter"))


@register("i20_mean_reward", "SELECT event_type, round(avg(value), 4) AS reward, round(avg(length(props)), 4) AS size FROM events GROUP BY event_type")
def mean_reward(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.avg("value"), 4).alias("reward"), F.round(F.avg(F.length("props")), 4).alias("size"))


@register("i27_piece_bytes", r"WITH p AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[^ \t\n\x0b\f\r]+')) AS w FROM documents) SELECT min(strlen(w)) AS least, max(strlen(w)) AS most, round(avg(strlen(w)), 6) AS mean, round(stddev_samp(strlen(w)), 6) AS std FROM p")
def piece_bytes(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all("text", F.lit(r"[^ \t\n\x0b\f\r]+"), F.lit(0))).alias("w")).distinct()
    n = F.octet_length("w").cast("long")
    return words.agg(F.min(n).alias("least"), F.max(n).alias("most"), F.round(F.avg(n), 6).alias("mean"), F.round(F.stddev_samp(n), 6).alias("std"))


@register("i28_reply_lengths", "SELECT turn, role, round(avg(length(text)), 4) AS mean FROM conversations GROUP BY turn, role")
def reply_lengths(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("turn", "role").agg(F.round(F.avg(F.length("text")), 4).alias("mean"))


@register("i29_source_ledger", "SELECT o_orderkey, CAST(sum(o_custkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS BIGINT) AS drawn FROM orders")
def source_ledger(spark, sf_dir):
    w = Window.partitionBy("o_orderstatus").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.sum("o_custkey").over(w).alias("drawn"))


@register("i32_cross_matrix", "SELECT l_returnflag AS model, round(avg(CASE WHEN l_linestatus = 'F' THEN l_discount END), 6) AS f, round(avg(CASE WHEN l_linestatus = 'O' THEN l_discount END), 6) AS o FROM lineitem GROUP BY l_returnflag")
def cross_matrix(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("model"), F.lower("l_linestatus").alias("set"), "l_discount")
    out = rows.groupBy("model").pivot("set", ["f", "o"]).agg(F.avg("l_discount"))
    return out.select("model", F.round("f", 6).alias("f"), F.round("o", 6).alias("o"))


@register("i33_parabola_vertices", """
WITH r AS (SELECT l_returnflag, CAST(l_quantity AS DOUBLE) - avg(l_quantity) OVER g AS x, avg(l_quantity) OVER g AS m,
  pow(CAST(l_quantity AS DOUBLE) - 20, 2) / 2 + CAST(l_extendedprice AS DOUBLE) / 1000 AS y FROM lineitem WINDOW g AS (PARTITION BY l_returnflag)),
s AS (SELECT l_returnflag, any_value(m) AS m, CAST(count(*) AS DOUBLE) AS s0, sum(x) AS s1, sum(x * x) AS s2, sum(x ** 3) AS s3, sum(x ** 4) AS s4,
  sum(y) AS t0, sum(x * y) AS t1, sum(x * x * y) AS t2 FROM r GROUP BY l_returnflag),
d AS (SELECT *, s4 * (s2 * s0 - s1 * s1) - s3 * (s3 * s0 - s1 * s2) + s2 * (s3 * s1 - s2 * s2) AS d,
  t2 * (s2 * s0 - s1 * s1) - s3 * (t1 * s0 - s1 * t0) + s2 * (t1 * s1 - s2 * t0) AS a,
  s4 * (t1 * s0 - s1 * t0) - t2 * (s3 * s0 - s1 * s2) + s2 * (s3 * t0 - t1 * s2) AS b FROM s)
SELECT l_returnflag, round(a / d, 6) AS a, round(m - b / (2 * a), 4) AS vertex FROM d
""")
def parabola_vertices(spark, sf_dir):
    q = F.col("l_quantity").cast("double")
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", q.alias("x"), (F.pow(q - 20, F.lit(2)) / 2 + F.col("l_extendedprice").cast("double") / 1000).alias("y"))
    return evaluation.parabola(rows, "x", "y", ["l_returnflag"]).select("l_returnflag", F.round("a", 6).alias("a"), F.round("vertex", 4).alias("vertex"))


@register("i37_first_of_group", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1")
def first_of_group(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(F.struct("o_orderdate", "o_orderkey")).alias("m")).select("o_custkey", F.col("m.o_orderkey").alias("o_orderkey"))


@register("i41_suite_progress", "SELECT event_type AS model, count(*) AS total, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS completed, bool_and(value > 50) AS complete FROM events GROUP BY ROLLUP (event_type)")
def suite_progress(spark, sf_dir):
    done = F.col("value") > 50
    return table(spark, sf_dir, "events").rollup(F.col("event_type").alias("model")).agg(F.count("*").alias("total"), F.sum(done.cast("long")).alias("completed"), F.bool_and(done).alias("complete"))


@register("i42_parent_flops", "SELECT c.c_custkey AS run, coalesce(p.c_acctbal, CAST(p.c_nationkey AS DOUBLE), 0) AS inherited FROM customer c LEFT JOIN (SELECT c_custkey, c_nationkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer) p ON p.c_custkey = CAST(floor(c.c_custkey / 2) AS BIGINT)")
def parent_flops(spark, sf_dir):
    runs = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run"), F.floor(F.col("c_custkey") / 2).alias("parent"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal")).alias("cumulative"), F.col("c_nationkey").cast("double").alias("stage"))
    return lineage.inherited(runs)


@register("f19_horizon", "SELECT s_suppkey AS run, CAST(coalesce(CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey END, CASE WHEN s_suppkey % 3 = 1 THEN floor(s_suppkey * 100000 / 2048) END, floor(12.5 * s_nationkey * 1000 / 2048)) AS BIGINT) AS steps FROM supplier")
def horizon(spark, sf_dir):
    k = F.col("s_suppkey")
    runs = table(spark, sf_dir, "supplier").select(k.alias("run"), F.when(k % 3 == 0, k).alias("steps"), F.when(k % 3 == 1, k * 100_000).alias("tokens"), (F.col("s_nationkey") * 1000).alias("parameters"))
    return records.horizon(runs, batch=2048, ratio=12.5)


@register("f10_shifted_targets", "SELECT doc_id, CAST(n - 1 AS BIGINT) AS n, CAST(CASE WHEN n > 1 THEN n * (n - 1) / 2 END AS BIGINT) AS targets FROM (SELECT doc_id, least(n_chars, 300) AS n FROM documents)")
def shifted_targets(spark, sf_dir):
    ids = F.sequence(F.lit(0).cast("long"), F.least(F.col("n_chars"), F.lit(300)) - 1)
    rows = table(spark, sf_dir, "documents").select("doc_id", records.shifted(ids).alias("pair"))
    total = F.aggregate("pair.targets", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("doc_id", F.size("pair.inputs").cast("long").alias("n"), F.when(F.size("pair.targets") > 0, total).alias("targets"))


@register("f10_masked_targets", "SELECT doc_id, greatest(n_chars - 1, 0)::BIGINT AS n, CAST(coalesce(list_sum(list_transform(range(1, n_chars::BIGINT), lambda x: CASE WHEN x % 3 = 0 THEN -1 ELSE x END)), 0) AS BIGINT) AS targets FROM documents")
def masked_targets(spark, sf_dir):
    """The whole sequence of each document, every third place masked."""
    ids = F.when(F.col("n_chars") > 0, F.sequence(F.lit(0).cast("long"), F.col("n_chars").cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))
    rows = table(spark, sf_dir, "documents").select("doc_id", records.shifted(ids, F.transform(ids, lambda x: x % 3)).alias("pair"))
    total = F.aggregate("pair.targets", F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.select("doc_id", F.size("pair.inputs").cast("long").alias("n"), total.alias("targets"))


@register("h27_prompt_blocks", "WITH s AS (SELECT item_id, md5(text) AS q FROM benchmark) SELECT a.item_id, md5(string_agg(b.q || ' = ' || (b.item_id % 4), chr(10) || chr(10) ORDER BY b.item_id) || chr(10) || chr(10) || any_value(a.q)) AS digest FROM s a JOIN s b ON b.item_id < 3 GROUP BY a.item_id")
def prompt_blocks(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select("item_id", F.md5("text").alias("q"))
    shots = items.where("item_id < 3").agg(F.array_sort(F.collect_list(F.struct("item_id", F.concat("q", F.lit(" = "), (F.col("item_id") % 4).cast("string")).alias("b")))).alias("shots"))
    return items.crossJoin(F.broadcast(shots)).select("item_id", F.md5(records.prompt(F.col("shots.b"), F.col("q"))).alias("digest"))


@register("m7_prefix_moves", "SELECT p_partkey, 'new/' || substr('old/' || p_name, 5) AS target FROM part")
def prefix_moves(spark, sf_dir):
    paths = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("old/"), "p_name").alias("path"))
    return lineage.moved(paths, "old/", "new/").select("p_partkey", "target")


@register("m8_run_tags", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'interrupted' WHEN o_orderkey % 4 = 0 THEN 'legacy' END AS tag FROM orders")
def run_tags(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "crashed").otherwise("finished").alias("state"), F.when(F.col("o_orderkey") % 4 != 0, 1.0).alias("flops"))
    return rows.select("o_orderkey", lineage.run_tag(F.col("state"), F.col("flops")).alias("tag"))


@register("h24_families", "SELECT split_part(p_type, ' ', 1) AS family, count(*) AS n FROM part GROUP BY 1")
def families(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.split_part("p_type", F.lit(" "), F.lit(1)).alias("family")).agg(F.count("*").alias("n"))


@register("h33_padded", "SELECT conv_id, CAST(max(n) OVER () - n AS INT) AS padding FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)")
def padded(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_list(F.lit(1)).alias("a"))
    most = turns.agg(F.max(F.size("a")).alias("n"))
    rows = turns.crossJoin(F.broadcast(most)).select("conv_id", text.pad_right(F.col("a"), F.col("n"), 0).alias("a"))
    return rows.select("conv_id", F.size(F.filter("a", lambda x: x == 0)).alias("padding"))
