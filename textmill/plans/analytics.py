"""Queries of conversations, schedules, packing, evaluation and lineage."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textmill.catalog import register
from textmill.functions import text
from textmill.operators import conversations as conv
from textmill.operators import dedup, evaluation, lineage, schedule
from textmill.sources.tables import books, conversations, table

# --- claims -----------------------------------------------------------------------------------------------------


@register("d1_claim_dedup")
def claim_dedup(spark, sf_dir):
    """Books claim the barcodes of books with the same text, and every 17th that of the book three further on."""
    rows = books(spark, sf_dir).select("doc_id", "barcode", F.sha2("text", 256).alias("digest"))
    first = rows.groupBy("digest").agg(F.min("barcode").alias("first"))
    lists = F.array_compact(F.array(F.when(F.col("first") != F.col("barcode"), F.col("first")), F.when(F.col("doc_id") % 17 == 0, F.concat(F.lit("B"), (F.col("doc_id") + 3).cast("string")))))
    rows = rows.join(first, "digest").select("doc_id", "barcode", lists.alias("duplicates"))
    return dedup.claim_dedup(rows, order="doc_id", key="barcode", duplicates="duplicates").select("doc_id", "is_duplicate")


# --- conversations ----------------------------------------------------------------------------------------------

TALKS = "t AS (SELECT conv_id, list(role ORDER BY turn) AS roles, list(text ORDER BY turn) AS texts FROM conversations GROUP BY conv_id), r AS (SELECT *, CASE WHEN roles[1] = 'system' THEN 1 ELSE 0 END AS lead FROM t)"


@register("c24_role_alternation", f"WITH {TALKS} SELECT conv_id, len(roles) - lead >= 2 AND len(list_filter(range(1, len(roles) - lead + 1), lambda i: roles[i + lead] IS DISTINCT FROM CASE WHEN i % 2 = 1 THEN 'user' ELSE 'assistant' END)) = 0 AS valid FROM r")
def role_alternation(spark, sf_dir):
    return conversations(spark, sf_dir).select("conv_id", conv.alternates(F.col("messages")).alias("valid"))


@register("c22_first_errors", f"WITH {TALKS}, s AS (SELECT *, list_transform(texts, lambda x: length(x)) AS ls FROM r) SELECT conv_id, CASE WHEN len(roles) > 6 THEN 'too many messages' WHEN list_contains(texts, '') THEN 'empty message' WHEN list_max(ls) > 600 THEN 'message too long' WHEN list_sum(ls) > 1500 THEN 'conversation too long' WHEN len(list_filter(roles, lambda x: x NOT IN ('system', 'user', 'assistant'))) > 0 THEN 'unknown role' WHEN list_contains(roles[2:], 'system') THEN 'system not first' END AS error FROM s")
def first_errors(spark, sf_dir):
    return conversations(spark, sf_dir).select("conv_id", conv.first_error(F.col("messages"), most_messages=6, most_chars=600, most_total=1500).alias("error"))


@register("h30_merged_system", f"WITH {TALKS} SELECT conv_id, CAST(CASE WHEN lead = 1 AND len(roles) > 1 THEN len(roles) - 1 ELSE len(roles) END AS INT) AS n, md5(CASE WHEN lead = 1 AND len(roles) > 1 THEN texts[1] || chr(10) || chr(10) || texts[2] ELSE texts[1] END) AS first FROM r")
def merged_system(spark, sf_dir):
    rows = conversations(spark, sf_dir).select("conv_id", conv.merge_system(F.col("messages")).alias("m"))
    return rows.select("conv_id", F.size("m").alias("n"), F.md5(F.get("m", F.lit(0))["content"]).alias("first"))


@register("h28_instructed_turns", "SELECT conv_id, turn, md5(text || CASE WHEN turn = max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id) THEN ' Answer with a letter.' ELSE '' END) AS digest FROM conversations")
def instructed_turns(spark, sf_dir):
    return conv.instruct_last_user(table(spark, sf_dir, "conversations"), " Answer with a letter.").select("conv_id", "turn", F.md5("text").alias("digest"))


@register("g8_multi_turn", f"WITH {TALKS} SELECT conv_id, CAST(floor((len(roles) - lead) / 2) AS BIGINT) AS rounds FROM r WHERE floor((len(roles) - lead) / 2) > 1")
def multi_turn(spark, sf_dir):
    return conversations(spark, sf_dir).select("conv_id", conv.rounds(F.col("messages")).alias("rounds")).where("rounds > 1")


@register("h39_context_suffix", "SELECT conv_id, turn, CAST(used AS BIGINT) AS used FROM (SELECT conv_id, turn, sum(length(text)) OVER w AS used, row_number() OVER w AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)) WHERE used <= 800 OR n = 1")
def context_suffix(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn("tokens", F.length("text").cast("long"))
    return conv.context_suffix(turns, 800).select("conv_id", "turn", "used")


@register("g1_mixture", """
WITH a AS (SELECT 0 AS i, 'items' AS task, item_id AS local FROM benchmark UNION ALL SELECT 1, 'talks', conv_id FROM (SELECT DISTINCT conv_id FROM conversations) UNION ALL SELECT 2, 'again', item_id FROM benchmark)
SELECT task, local, row_number() OVER (ORDER BY md5('42:' || i || ':' || local), i, local) - 1 AS position FROM a
""")
def mixture(spark, sf_dir):
    items, talks = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "conversations").select("conv_id").distinct()
    tasks = {"items": items.select(F.col("item_id").alias("k")), "talks": talks.select(F.col("conv_id").alias("k")), "again": items.select(F.col("item_id").alias("k"))}
    return conv.mixture(tasks, "k").select("task", "local", "position")


@register("g2_sequence", "WITH a AS (SELECT 0 AS i, 'items' AS task, item_id AS local FROM benchmark UNION ALL SELECT 1, 'docs', doc_id FROM documents) SELECT task, local, row_number() OVER (ORDER BY i, local) - 1 AS position FROM a")
def sequence(spark, sf_dir):
    return conv.sequence({"items": table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("k")), "docs": table(spark, sf_dir, "documents").select(F.col("doc_id").alias("k"))}, "k").select("task", "local", "position")


@register("g3_slice_view", "SELECT doc_id FROM documents WHERE doc_id >= 10 AND (doc_id - 10) % 7 = 0")
def slice_view(spark, sf_dir):
    return conv.view(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 10, None, 7)


@register("g6_cumulative_stages", "WITH s(stage, route) AS (VALUES (1, 0), (1, 1), (2, 2), (3, 5)), c AS (SELECT DISTINCT conv_id, conv_id % 10 AS route FROM conversations) SELECT b.stage, count(*) AS n FROM (SELECT DISTINCT stage FROM s) b JOIN s ON s.stage <= b.stage JOIN c ON c.route = s.route GROUP BY b.stage")
def cumulative_stages(spark, sf_dir):
    stages = spark.createDataFrame([(1, 0), (1, 1), (2, 2), (3, 5)], "stage int, route long")
    rows = table(spark, sf_dir, "conversations").select("conv_id").distinct().withColumn("route", F.col("conv_id") % 10)
    return conv.staged(rows, stages).groupBy("stage").agg(F.count("*").alias("n"))


@register("g9_domains_with_eight", "SELECT source, count(*) AS n FROM documents GROUP BY source HAVING count(*) >= 8")
def domains_with_eight(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")).where("n >= 8")


@register("g12_mixture_manifest", "SELECT source, count(*) AS presentations, count(DISTINCT md5(text)) AS distinct_rows, CAST(sum(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS selected FROM documents GROUP BY source")
def mixture_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("source").agg(F.count("*").alias("presentations"), F.countDistinct(F.md5("text")).alias("distinct_rows"), F.sum((F.col("doc_id") % 3 == 0).cast("long")).alias("selected"))


# --- schedules, cursors, packing --------------------------------------------------------------------------------

PLAN = [("first", "a", 0), ("second", "b", 140_000), ("third", "a", 181_000)]
STAGES = """plan(i, name, source, st) AS (VALUES (0, 'first', 'a', 0), (1, 'second', 'b', 140000), (2, 'third', 'a', 181000)),
s AS (SELECT *, CAST(max(round_even(st / 2000, 0) - i) OVER (ORDER BY i) + i AS BIGINT) AS sp FROM plan),
g AS (SELECT *, lead(st, 1, 201000) OVER (ORDER BY st) AS et, lead(sp, 1, CAST(ceil(201000 / 2000) AS BIGINT)) OVER (ORDER BY st) AS ep FROM s)"""


def _schedule(spark):
    return schedule.stages(spark, PLAN, 201_000, 2_000)


@register("f12_snapped_stages", f"WITH {STAGES} SELECT name, source, CAST(sp AS BIGINT) AS start_step, CAST(ep AS BIGINT) AS end_step FROM g")
def snapped_stages(spark, sf_dir):
    return _schedule(spark).select("name", "source", "start_step", "end_step")


@register("f14_stage_of_order", f"WITH {STAGES} SELECT g.name, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS keys FROM orders JOIN g ON o_orderkey * 13 >= g.st AND o_orderkey * 13 < g.et GROUP BY g.name")
def stage_of_order(spark, sf_dir):
    points = table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 13).alias("at"), "o_custkey")
    return schedule.stage_at(points, _schedule(spark), "at").groupBy("name").agg(F.count("*").alias("n"), F.sum("o_custkey").alias("keys"))


@register("f15_planned_tokens", f"WITH {STAGES} SELECT source, CAST(sum(greatest(0, ep * 2000 - greatest(sp * 2000, 50000))) AS BIGINT) AS planned FROM g GROUP BY source")
def planned_tokens(spark, sf_dir):
    return schedule.planned_tokens(_schedule(spark), 2_000, 50_000)


@register("f17_epoch_cap", f"WITH {STAGES}, p AS (SELECT source, sum(greatest(0, ep * 2000 - greatest(sp * 2000, 50000))) AS planned FROM g GROUP BY source), u(source, n) AS (VALUES ('a', 40000), ('c', 1)) SELECT p.source, CAST(planned AS BIGINT) AS planned, planned / CAST(n AS DOUBLE) AS epochs, CASE WHEN planned = 0 THEN NULL WHEN n IS NULL THEN 'empty cache' WHEN planned / CAST(n AS DOUBLE) > 2.5 + 1e-9 THEN 'over the cap' END AS violation FROM p LEFT JOIN u USING (source)")
def epoch_cap(spark, sf_dir):
    unique = spark.createDataFrame([("a", 40_000), ("c", 1)], "source string, unique_tokens long")
    return schedule.epoch_violations(schedule.planned_tokens(_schedule(spark), 2_000, 50_000), unique, 2.5)


@register("f1_token_budget", "SELECT doc_id, CAST(least(n, 50000 - (e - n)) AS BIGINT) AS take FROM (SELECT doc_id, n_chars AS n, sum(n_chars) OVER (ORDER BY doc_id) AS e FROM documents) WHERE e - n < 50000")
def token_budget(spark, sf_dir):
    return schedule.take_budget(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 50_000).select("doc_id", "take")


@register("f4_ring_positions", "WITH f AS (SELECT source AS file, sum(n_chars) AS n FROM documents GROUP BY source), e AS (SELECT file, sum(n) OVER (ORDER BY file) AS e, n FROM f), t AS (SELECT sum(n) AS t FROM f), p AS (SELECT o_orderkey, o_orderkey * 997 AS pt FROM orders) SELECT o_orderkey, CAST(floor(pt / t) + 1 AS BIGINT) AS epoch, file, CAST(pt % t - (e - n) AS BIGINT) AS offset FROM p CROSS JOIN t JOIN e ON pt % t >= e - n AND pt % t < e")
def ring_positions(spark, sf_dir):
    files = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("file")).agg(F.sum("n_chars").alias("n_tokens"))
    points = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * 997).alias("at"))
    return schedule.ring(points, "at", files).select("o_orderkey", "epoch", "file", "offset")


@register("f5_rank_windows", "SELECT d AS draw, r AS rank, r * 128 + d * (4 * 128 + 1) AS start FROM range(100) AS a(d), range(4) AS b(r)")
def rank_windows(spark, sf_dir):
    return schedule.rank_windows(spark, 4, 100, 128)


@register("f7_best_fit_crop")
def best_fit_crop(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.floor(F.col("n_chars") / 4).alias("n"))
    return schedule.pack_best_fit(docs, "doc_id", "n", capacity=2049, buffer=1000, crop=True, packers=2)


@register("f8_best_fit_pad")
def best_fit_pad(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.floor(F.sum(F.length("text")) / 4).alias("n"))
    return schedule.pack_best_fit(turns, "conv_id", "n", capacity=2049, buffer=100, crop=False)


@register("f9_one_per_row", "WITH t AS (SELECT conv_id, CAST(sum(length(text)) AS BIGINT) AS n FROM conversations GROUP BY conv_id), r AS (SELECT *, CAST(floor((row_number() OVER (ORDER BY conv_id) - 1) / 8) AS BIGINT) AS batch FROM t) SELECT conv_id, batch, max(n) OVER (PARTITION BY batch) AS width, max(n) OVER (PARTITION BY batch) - n AS padding FROM r")
def one_per_row(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("n"))
    return schedule.one_per_row(turns, "conv_id", "n", 8, 10**9).select("conv_id", "batch", "width", "padding")


# --- evaluation -------------------------------------------------------------------------------------------------

TOKENS = "w AS (SELECT doc_id, lang, unnest(regexp_extract_all(text, '[^ \\t\\n\\x0b\\f\\r]+')) AS word, unnest(range(len(regexp_extract_all(text, '[^ \\t\\n\\x0b\\f\\r]+')))) AS pos FROM documents), n AS (SELECT *, (1 + (length(word) * 7 + pos) % 13) / 4.0 AS nats, CASE WHEN pos % 50 = 0 THEN 0 ELSE strlen(word) END AS bytes FROM w)"


def _tokens(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select("doc_id", "lang", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^ \t\n\x0b\f\r]+"), F.lit(0))).alias("pos", "word"))
    return words.withColumns({"nats": (1 + (F.length("word") * 7 + F.col("pos")) % 13) / 4.0, "bytes": F.when(F.col("pos") % 50 == 0, 0).otherwise(F.octet_length("word"))})


@register("i4_bits_per_byte", f"WITH {TOKENS} SELECT lang, round(CAST(sum(CASE WHEN bytes > 0 THEN nats END) AS DOUBLE) / (ln(2) * sum(bytes)), 6) AS bpb FROM n GROUP BY lang")
def bits_per_byte(spark, sf_dir):
    return _tokens(spark, sf_dir).groupBy("lang").agg(F.round(evaluation.bits_per_byte(F.col("nats"), F.col("bytes")), 6).alias("bpb"))


@register("i5_bits_by_position", f"WITH {TOKENS} SELECT bucket, round(CAST(sum(CASE WHEN bytes > 0 THEN nats END) AS DOUBLE) / (ln(2) * sum(bytes)), 6) AS bpb FROM (SELECT *, CAST(floor(pos / 256) AS BIGINT) AS bucket FROM n) GROUP BY ROLLUP (bucket)")
def bits_by_position(spark, sf_dir):
    rows = _tokens(spark, sf_dir).withColumn("bucket", F.floor(F.col("pos") / 256))
    return rows.rollup("bucket").agg(F.round(evaluation.bits_per_byte(F.col("nats"), F.col("bytes")), 6).alias("bpb"))


@register("i6_auc", "WITH s AS (SELECT n_chars % 97 AS score, quality = 1 AS pos FROM documents JOIN labels USING (doc_id)), p AS (SELECT sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS w, count(*) AS n FROM s a, s b WHERE a.pos AND NOT b.pos) SELECT CAST((SELECT count(*) FROM s WHERE pos) AS BIGINT) AS n_positive, CAST((SELECT count(*) FROM s WHERE NOT pos) AS BIGINT) AS n_negative, round(CAST(w AS DOUBLE) / n, 6) AS auc FROM p")
def auc(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select((F.col("n_chars") % 97).alias("score"), (F.col("quality") == 1).alias("pos"))
    return evaluation.auc(rows, "score", "pos").withColumn("auc", F.round("auc", 6))


@register("i7_nearest_rank", "SELECT o_totalprice AS percentile FROM (SELECT o_totalprice, row_number() OVER (ORDER BY o_totalprice) - 1 AS i, count(*) OVER () AS n FROM orders) WHERE i = CAST(round_even(0.95 * (n - 1), 0) AS BIGINT)")
def nearest_rank(spark, sf_dir):
    return evaluation.nearest_rank(table(spark, sf_dir, "orders"), "o_totalprice", 0.95)


@register("i8_recall_at_threshold", "WITH s AS (SELECT n_chars, quality, lang FROM documents JOIN labels USING (doc_id)), t AS (SELECT n_chars AS cut FROM (SELECT n_chars, row_number() OVER (ORDER BY n_chars) - 1 AS i, count(*) OVER () AS n FROM s WHERE quality = 0) WHERE i = CAST(round_even(0.95 * (n - 1), 0) AS BIGINT)) SELECT lang, round(avg(CASE WHEN n_chars > cut THEN 1.0 ELSE 0.0 END), 6) AS recall FROM s, t WHERE quality = 1 GROUP BY ROLLUP (lang)")
def recall_at_threshold(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("n_chars", "quality", "lang")
    cut = evaluation.nearest_rank(rows.where("quality = 0"), "n_chars", 0.95)
    return rows.where("quality = 1").crossJoin(F.broadcast(cut)).rollup("lang").agg(F.round(F.avg((F.col("n_chars") > F.col("percentile")).cast("double")), 6).alias("recall"))


@register("i13_multiple_choice_accuracy", "WITH c AS (SELECT item_id, k, (item_id * 31 + k * 17) % 23 AS loss FROM benchmark, range(4) AS r(k)), b AS (SELECT item_id, arg_min(k, loss * 10 + k) AS choice FROM c GROUP BY item_id) SELECT count(*) AS n, round(avg(CASE WHEN choice = item_id % 4 THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round((avg(CASE WHEN choice = item_id % 4 THEN 1.0 ELSE 0.0 END) - 0.25) / 0.75, 6) AS centered FROM b")
def multiple_choice_accuracy(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    rows = rows.withColumn("loss", (F.col("item_id") * 31 + F.col("k") * 17) % 23)
    best = rows.groupBy("item_id").agg(F.min_by("k", F.struct("loss", "k")).alias("choice"))
    accuracy = F.avg((F.col("choice") == F.col("item_id") % 4).cast("double"))
    return best.agg(F.count("*").alias("n"), F.round(accuracy, 6).alias("accuracy"), F.round(evaluation.centered(accuracy, F.lit(0.25)), 6).alias("centered"))


@register("i16_any_of_n", "SELECT count(*) AS problems, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) AS passed FROM (SELECT user_id, bool_or(event_type = 'purchase') AS hit FROM events GROUP BY user_id)")
def any_of_n(spark, sf_dir):
    hits = table(spark, sf_dir, "events").groupBy("user_id").agg(F.bool_or(F.col("event_type") == "purchase").alias("hit"))
    return hits.agg(F.count("*").alias("problems"), F.sum(F.col("hit").cast("long")).alias("passed"))


@register("i18_pass_at_k", "WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, event_type = 'purchase' AS ok FROM events), f AS (SELECT user_id, min(CASE WHEN ok THEN i END) AS hit FROM s GROUP BY user_id) SELECT k, round(avg(CASE WHEN hit <= k THEN 1.0 ELSE 0.0 END), 6) AS pass_at_k FROM f, range(1, 9) AS r(k) GROUP BY k")
def pass_at_k(spark, sf_dir):
    samples = table(spark, sf_dir, "events").select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("i"), (F.col("event_type") == "purchase").alias("ok"))
    return evaluation.pass_at(samples, "user_id", "i", "ok", 8).withColumn("pass_at_k", F.round("pass_at_k", 6))


@register("i19_advantage", "SELECT event_id, round(value - avg(value) OVER (PARTITION BY user_id), 3) AS advantage FROM events")
def advantage(spark, sf_dir):
    return evaluation.advantage(table(spark, sf_dir, "events"), "user_id", "value").select("event_id", F.round("advantage", 3).alias("advantage"))


@register("h35_top_mean", "SELECT vec_id, round(list_sum(list_sort(embedding, 'DESC')[1:3]) / 3, 5) AS peak FROM embeddings")
def top_mean(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(evaluation.top_mean(F.transform("embedding", lambda x: x.cast("double")), 3), 5).alias("peak"))


@register("i21_instruction_metrics", "WITH s AS (SELECT item_id, i, (item_id * 7 + i * 3) % 5 < 3 AS ok, CASE WHEN i = 0 THEN 'length' ELSE 'format' END || ':' || i AS instruction FROM benchmark, range(3) AS r(i)) SELECT split_part(instruction, ':', 1) AS family, instruction, round(avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM s GROUP BY GROUPING SETS ((), (1), (2))")
def instruction_metrics(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i"))
    rows = rows.withColumns({"ok": (F.col("item_id") * 7 + F.col("i") * 3) % 5 < 3, "instruction": F.concat(F.when(F.col("i") == 0, "length").otherwise("format"), F.lit(":"), F.col("i").cast("string"))})
    rows = rows.withColumn("family", F.split_part("instruction", F.lit(":"), F.lit(1)))
    return rows.groupingSets([[], ["family"], ["instruction"]], "family", "instruction").agg(F.round(F.avg(F.col("ok").cast("double")), 6).alias("accuracy"))


@register("i34_power_law", "SELECT l_returnflag, round(regr_slope(ln(l_extendedprice), ln(l_quantity)), 6) AS slope, round(regr_intercept(ln(l_extendedprice), ln(l_quantity)), 6) AS intercept FROM lineitem GROUP BY l_returnflag")
def power_law(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.ln("l_quantity").alias("x"), F.ln("l_extendedprice").alias("y"))
    return evaluation.line_fit(rows, "x", "y", ["l_returnflag"]).select("l_returnflag", F.round("slope", 6).alias("slope"), F.round("intercept", 6).alias("intercept"))


@register("i39_smoothed_values")
def smoothed_values(spark, sf_dir):
    return evaluation.debiased_average(table(spark, sf_dir, "events"), "event_id", "value", 0.9)


@register("j12_running_minimum", "SELECT o_orderkey, min(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS best FROM orders")
def running_minimum(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.min("o_totalprice").over(w).alias("best"))


@register("j6_top_topics", "SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 12")
def top_topics(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source").limit(12)


# --- lineage ----------------------------------------------------------------------------------------------------

LISTING = "p AS (SELECT CASE o_orderkey % 4 WHEN 0 THEN 'model_' || (o_orderkey % 50) || '.pt' WHEN 1 THEN 'meta_' || (o_orderkey % 75) || '.json' ELSE 'optim_' || CAST(floor(o_orderkey / 8) % 60 AS BIGINT) || '_rank' || (o_orderkey % 2) || '.pt' END AS path FROM orders)"


def _listing(spark, sf_dir):
    k = F.col("o_orderkey")
    s = lambda n: (k % n).cast("string")
    path = F.when(k % 4 == 0, F.concat(F.lit("model_"), s(50), F.lit(".pt"))).when(k % 4 == 1, F.concat(F.lit("meta_"), s(75), F.lit(".json"))).otherwise(F.concat(F.lit("optim_"), (F.floor(k / 8) % 60).cast("string"), F.lit("_rank"), s(2), F.lit(".pt")))
    return table(spark, sf_dir, "orders").select(path.alias("path"))


@register("e15_complete_steps", f"WITH {LISTING}, s AS (SELECT CAST(regexp_extract(path, '_([0-9]+)', 1) AS BIGINT) AS step, path LIKE 'model%' AS model, path LIKE 'meta%' AS meta, regexp_extract(path, 'rank([0-9]+)', 1) AS rank FROM p) SELECT step FROM s GROUP BY step HAVING bool_or(model) AND bool_or(meta) AND count(DISTINCT CASE WHEN rank IN ('0', '1') THEN rank END) = 2")
def complete_steps(spark, sf_dir):
    return lineage.complete_steps(_listing(spark, sf_dir), ranks=[0, 1])


@register("m14_newest_step", f"WITH {LISTING}, s AS (SELECT CAST(regexp_extract(path, '_([0-9]+)', 1) AS BIGINT) AS step, path LIKE 'model%' AS model, path LIKE 'meta%' AS meta FROM p) SELECT max(step) AS step FROM (SELECT step FROM s GROUP BY step HAVING bool_or(model) AND bool_or(meta))")
def newest_step(spark, sf_dir):
    return lineage.complete_steps(_listing(spark, sf_dir)).agg(F.max("step").alias("step"))


@register("e12_verified_objects", "WITH a AS (SELECT p_name AS path, p_size AS size, p_brand AS oid FROM part WHERE p_partkey % 2 = 0), b AS (SELECT p_name AS path, CASE WHEN p_partkey % 6 = 0 THEN p_size + 1 ELSE p_size END AS size, CASE WHEN p_partkey % 10 = 0 THEN 'x' ELSE p_brand END AS oid, p_partkey FROM part WHERE p_partkey % 8 <> 0) SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN b.p_partkey IS NULL THEN 'missing' WHEN a.size <> b.size THEN 'size differs' WHEN a.oid <> b.oid THEN 'content differs' ELSE 'ok' END AS verdict FROM part q JOIN (SELECT p_partkey AS k, p_size AS size, p_brand AS oid FROM part WHERE p_partkey % 2 = 0) a ON a.k = q.p_partkey LEFT JOIN b ON b.p_partkey = q.p_partkey) GROUP BY verdict")
def verified_objects(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    a = part.where(k % 2 == 0).select(k.alias("path"), F.col("p_size").alias("size"), F.col("p_brand").alias("oid"))
    b = part.where(k % 8 != 0).select(k.alias("path"), F.when(k % 6 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).alias("size"), F.when(k % 10 == 0, "x").otherwise(F.col("p_brand")).alias("oid"))
    return lineage.verify(a, b).groupBy("verdict").agg(F.count("*").alias("n"))


@register("m12_retention", f"WITH {LISTING}, s AS (SELECT DISTINCT CAST(regexp_extract(path, '_([0-9]+)', 1) AS BIGINT) AS step FROM p) SELECT step FROM (SELECT step, row_number() OVER (ORDER BY step DESC) AS n FROM s WHERE step % 3 = 0) WHERE n > 5")
def retention(spark, sf_dir):
    steps = _listing(spark, sf_dir).select(lineage.step_of(F.col("path")).alias("step")).distinct()
    return lineage.prunable(steps.where("step % 3 = 0"), 5)


@register("e14_config_diff", "WITH a AS (SELECT 'n' || c_custkey AS field, CAST(c_nationkey AS VARCHAR) AS v FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT 'n' || c_custkey AS field, CAST(CASE WHEN c_custkey % 5 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS VARCHAR) AS v FROM customer WHERE c_custkey % 7 <> 0) SELECT coalesce(a.field, b.field) AS field, a.v AS parent, b.v AS child FROM a FULL JOIN b ON a.field = b.field WHERE a.v IS DISTINCT FROM b.v")
def config_diff(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    field = F.concat(F.lit("n"), F.col("c_custkey").cast("string")).alias("field")
    a = c.where("c_custkey % 3 <> 0").select(field, F.col("c_nationkey").cast("string").alias("value"))
    b = c.where("c_custkey % 7 <> 0").select(field, F.when(F.col("c_custkey") % 5 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")).cast("string").alias("value"))
    return lineage.diff(a, b)
