"""Queries of readers and writers: tables are written as the files that they read, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from textmill.catalog import register
from textmill.operators import quality
from textmill.sources import files, sinks
from textmill.sources.scratch import folder
from textmill.sources.tables import conversations, table


@register("a10_jsonl_conversations", """
SELECT count(*) AS conversations, CAST(sum(n) AS BIGINT) AS messages, CAST(sum(c) AS BIGINT) AS chars
FROM (SELECT conv_id, count(*) AS n, sum(length(coalesce(text, ''))) AS c FROM conversations GROUP BY conv_id)
""")
def jsonl_conversations(spark, sf_dir):
    path = folder(spark, "jsonl")
    talks = conversations(spark, sf_dir)
    talks.select(F.explode(F.array(F.to_json("messages"), F.lit("  "))).alias("value")).write.text(path)
    size = F.aggregate("messages", F.lit(0).cast("long"), lambda n, m: n + F.coalesce(F.length(m["content"]), F.lit(0)))
    rows = files.jsonl_conversations(spark, path)
    return rows.agg(F.count("*").alias("conversations"), F.sum(F.size("messages")).cast("long").alias("messages"), F.sum(size).alias("chars"))


@register("a11_jsonl_parts", "SELECT o_orderkey, o_custkey FROM orders")
def jsonl_parts(spark, sf_dir):
    path = folder(spark, "parts")
    table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").write.json(f"{path}/written")
    fs, at = files._fs(spark, f"{path}/written")
    for status in fs.listStatus(at):
        name = status.getPath().getName()
        if name.startswith("part-"):
            fs.rename(status.getPath(), files._fs(spark, f"{path}/{name.split('-c000')[0]}.jsonl")[1])
    return files.jsonl_parts(spark, path, "o_orderkey long, o_custkey long")


@register("a12_strict_violations", """
SELECT * FROM (SELECT 'rows' AS violation, count(*) AS n FROM orders
  UNION ALL SELECT 'duplicate o_custkey', count(*) FROM (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 1)
  UNION ALL SELECT 'duplicate o_orderkey', count(*) FROM (SELECT o_orderkey FROM orders GROUP BY o_orderkey HAVING count(*) > 1)) WHERE n > 0
""")
def strict_violations(spark, sf_dir):
    return files.strict_violations(table(spark, sf_dir, "orders"), -1, ["o_custkey", "o_orderkey"])


@register("a15_ragged_results", """
SELECT trim(p_name) AS task, CASE WHEN p_size % 4 <> 0 THEN p_size / 8.0 END AS accuracy, CASE WHEN p_size % 3 <> 0 THEN -p_size / 4.0 END AS centered
FROM part WHERE p_size % 7 <> 0 AND p_size % 5 <> 0
""")
def ragged_results(spark, sf_dir):
    path, size = folder(spark, "csv"), F.col("p_size")
    number = lambda keep, x: F.when(keep, x.cast("string")).otherwise("")
    accuracy = F.when(size % 7 == 0, "n/a").otherwise(number(size % 4 != 0, size / 8))
    fields = F.when(size % 5 == 0, F.concat_ws(",", "p_name", accuracy)).otherwise(F.concat_ws(" , ", "p_name", accuracy, number(size % 3 != 0, -size / 4), F.lit("more")))
    table(spark, sf_dir, "part").select(F.explode(F.array(fields, F.lit("Task, Accuracy, Centered"))).alias("value")).write.text(path)
    return files.ragged_results(spark, path)


@register("a16_sweep", "SELECT o_orderkey, o_totalprice > 100000 AS high, CAST(o_custkey AS DOUBLE) / 4 AS val_bpb FROM orders")
def sweep(spark, sf_dir):
    path = folder(spark, "sweep")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") > 100_000).alias("high"), (F.col("o_custkey") / 4).alias("val_bpb"))
    rows.write.option("header", True).csv(path)
    return files.csv_table(spark, path, "o_orderkey long, high boolean, val_bpb double")


@register("c25_completed_runs", "SELECT o_orderkey, o_custkey / 4.0 AS val_bpb FROM orders WHERE o_custkey % 3 <> 0")
def completed_runs(spark, sf_dir):
    bpb = F.when(F.col("o_custkey") % 6 == 0, 0.0).when(F.col("o_custkey") % 3 != 0, F.col("o_custkey") / 4)
    return table(spark, sf_dir, "orders").select("o_orderkey", bpb.alias("val_bpb")).where("val_bpb > 0")


@register("c26_pending_records", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def pending_records(spark, sf_dir):
    logged = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(logged, "o_orderkey", "left_anti")


@register("a17_log_values", """
SELECT o_custkey AS run, CAST(arg_max(o_orderkey, o_orderkey) AS DOUBLE) AS total,
       CAST(arg_max(o_orderkey, o_orderkey) FILTER (o_orderkey % 2 = 0) AS DOUBLE) / 4 AS bpb
FROM orders GROUP BY o_custkey
""")
def log_values(spark, sf_dir):
    k = F.col("o_orderkey")
    lines = F.array(F.concat(F.lit("total     : "), F.format_number(k, 0)), F.concat(F.when(k % 2 == 0, "Validation bpb: ").otherwise("train bpb: "), (k / 4).cast("string")))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), k.alias("line"), F.explode(lines).alias("value"))
    return files.log_values(rows, {"total": r"^total\s+: ([\d,]+)", "bpb": r"Validation bpb: ([\d.]+)$"})


@register("a18_section_values", """
SELECT p_partkey, CAST(p_size AS VARCHAR) AS core, CASE WHEN p_size % 2 = 0 THEN p_brand END AS brand,
       epoch(CAST('2020-01-01' AS TIMESTAMP)) + p_size AS seconds FROM part
""")
def section_values(spark, sf_dir):
    size = F.col("p_size")
    stamp = F.concat(F.lit("timestamp: 2020-01-01 00:00:"), F.lpad(size.cast("string"), 2, "0"))
    section = F.concat_ws("\n", F.lit("## Part"), F.lit("CORE metric: 0"), F.concat(F.lit("- CORE : "), size), F.when(size % 2 == 0, F.concat(F.lit("brand: "), F.col("p_brand"))), F.lit("timestamp: soon"), stamp)
    rows = table(spark, sf_dir, "part").select("p_partkey", files.section_values(section, ["CORE", "brand"]).alias("v"), files.section_time(section, "timestamp:").alias("t"))
    return rows.select("p_partkey", F.col("v")["CORE"].alias("core"), F.col("v")["brand"].alias("brand"), F.unix_timestamp("t").cast("double").alias("seconds"))


@register("a21_drawn_tables", "SELECT p_brand AS brand, CAST(p_partkey AS VARCHAR) AS part_key, CAST(p_size AS VARCHAR) AS size FROM part WHERE p_size % 6 <> 0")
def drawn_tables(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.when(F.col("p_size") % 6 == 0, F.format_string("| %d |", "p_partkey")).otherwise(F.format_string("| %d | %d |", "p_partkey", "p_size")).alias("value"))
    head = rows.groupBy("p_brand").agg(F.lit(-1).cast("long").alias("p_partkey")).withColumn("value", F.lit("| Part Key | Size |"))
    rule = head.withColumns({"p_partkey": F.lit(0).cast("long"), "value": F.lit("+---+---+")})
    found = files.drawn_table(rows.unionByName(head).unionByName(rule), by="p_brand", order="p_partkey")
    return found.select(F.col("p_brand").alias("brand"), F.col("row")["part_key"].alias("part_key"), F.col("row")["size"].alias("size"))


@register("a19_token_files", "SELECT count(*) AS tokens, CAST(sum(p_partkey % 60000) AS BIGINT) AS total FROM part")
def token_files(spark, sf_dir):
    ids = table(spark, sf_dir, "part").repartition(3).select((F.col("p_partkey") % 60_000).alias("id"))
    hexed = F.format_string("%02x%02x", F.col("id") % 256, F.floor(F.col("id") / 256))
    path = folder(spark, "tokens")
    _write_bytes(ids.groupBy((F.col("id") % 3).alias("file")).agg(F.unhex(F.concat_ws("", F.collect_list(hexed))).alias("content")), path)
    rows = files.token_file(spark, path)
    return rows.agg(F.sum(F.size("tokens")).cast("long").alias("tokens"), F.sum(F.aggregate("tokens", F.lit(0).cast("long"), lambda n, x: n + x)).alias("total"))


def _write_bytes(rows, path):
    """Writes a few small files (file, content) from the driver."""
    spark = rows.sparkSession
    for r in rows.collect():
        fs, at = files._fs(spark, f"{path}/{r['file']}.bin")
        out = fs.create(at, True)
        out.write(bytearray(r["content"]))
        out.close()


@register("a20_inventory", "SELECT p_brand AS name, CAST(sum(length(p_name)) + count(*) AS BIGINT) AS size FROM part GROUP BY p_brand")
def inventory(spark, sf_dir):
    path = folder(spark, "inventory")
    table(spark, sf_dir, "part").select("p_brand", F.col("p_name").alias("value")).write.partitionBy("p_brand").text(path)
    found = files.inventory(spark, path).where(F.regexp_like("path", F.lit("/part-")))
    return found.groupBy(F.url_decode(F.regexp_extract("path", "p_brand=([^/]+)", 1)).alias("name")).agg(F.sum("size").alias("size"))


@register("a4_resumed_scan", """
SELECT doc_id, e AS epoch FROM (SELECT doc_id, doc_id // 100 AS f, doc_id % 100 // 8 AS g FROM documents), (VALUES (1), (2)) AS t(e)
WHERE e > 1 OR f > 3 OR f = 3 AND g > 5
""")
def resumed_scan(spark, sf_dir):
    k = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.floor(k / 100).alias("file"), F.floor(k % 100 / 8).alias("row_group"))
    return files.after(rows, 3, 5, epochs=2).select("doc_id", "epoch")


@register("a7_resharded", """
WITH RECURSIVE n AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents),
r AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS k FROM n WHERE i >= 20),
s AS (SELECT k, doc_id, 0 AS shard, n_chars AS filled FROM r WHERE k = 1
  UNION ALL SELECT r.k, r.doc_id, CASE WHEN s.filled >= 30000 THEN s.shard + 1 ELSE s.shard END, CASE WHEN s.filled >= 30000 THEN r.n_chars ELSE s.filled + r.n_chars END FROM s JOIN r ON r.k = s.k + 1)
SELECT doc_id, 'shard_' || lpad(CAST(shard AS VARCHAR), 5, '0') AS shard FROM s UNION ALL SELECT doc_id, 'shard_99999' FROM n WHERE i < 20
""")
def resharded(spark, sf_dir):
    return sinks.resharded(table(spark, sf_dir, "documents"), "doc_id", "n_chars", validation=20, budget=30_000)


@register("b1_text_shards", "SELECT source, count(*) AS documents, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents WHERE text IS NOT NULL GROUP BY source")
def text_shards(spark, sf_dir):
    path = folder(spark, "shards")
    sinks.write_text_shards(table(spark, sf_dir, "documents"), path, by=["source"])
    back = spark.read.schema("text string, source string").parquet(path).where("text IS NOT NULL")
    return back.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.length("text")).alias("chars"))


@register("b4_json_lines", "SELECT conv_id, turn, role, md5(text) AS digest FROM conversations")
def json_lines(spark, sf_dir):
    path = folder(spark, "lines")
    turns = table(spark, sf_dir, "conversations")
    sinks.append_lines(turns.where("turn % 2 = 0"), path)
    sinks.append_lines(turns.where("turn % 2 <> 0 OR turn IS NULL"), path)
    return spark.read.schema("conv_id long, turn int, role string, text string").json(path).select("conv_id", "turn", "role", F.md5("text").alias("digest"))


@register("b13_manifest", """
SELECT source AS shard, count(*) AS documents, CAST(sum(n_chars) AS BIGINT) AS chars, round(count(*) / (SELECT count(*) FROM documents), 9) AS share,
       round(sum(n_chars) / (SELECT sum(n_chars) FROM documents), 9) AS chars_share FROM documents GROUP BY source
""")
def manifest(spark, sf_dir):
    out = sinks.manifest(table(spark, sf_dir, "documents").withColumnRenamed("source", "shard"))
    return out.withColumns({"share": F.round("share", 9), "chars_share": F.round("chars_share", 9)})


@register("b14_card_lines", """
SELECT '| ' || source || ' | ' || count(*) || ' | ' || printf('%.2f', 100.0 * count(*) / (SELECT count(*) FROM documents)) || '% |' AS line FROM documents GROUP BY source
""")
def card_lines(spark, sf_dir):
    return sinks.card_table(table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n")), "source").select("line")


@register("b16_result_lines", """
WITH t AS (SELECT p_brand AS task, avg(CASE WHEN p_size % 3 = 0 THEN 1.0 ELSE 0.0 END) AS a FROM part GROUP BY p_brand)
SELECT printf('%-35s, %-10s, %-10s', 'Task', 'Accuracy', 'Centered') AS line
UNION ALL SELECT printf('%-35s, %-10s, %-10s', task, printf('%.6f', a), printf('%.6f', (a - 0.25) / 0.75)) FROM t
UNION ALL SELECT printf('%-35s, %-10s, %-10s', 'CORE', '', printf('%.6f', avg((a - 0.25) / 0.75))) FROM t
""")
def result_lines(spark, sf_dir):
    acc = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("task")).agg(F.avg((F.col("p_size") % 3 == 0).cast("double")).alias("accuracy"))
    return sinks.result_lines(acc.withColumn("centered", (F.col("accuracy") - 0.25) / 0.75)).select("line")


METRICS = "m AS (SELECT CASE p_size % 5 WHEN 0 THEN 'CORE' WHEN 1 THEN 'ChatCORE' ELSE p_brand END AS metric, ['base', 'sft', 'rl'][1 + p_size % 3] AS stage, max(p_partkey) AS value FROM part GROUP BY ALL)"


@register("b17_metric_table", f"""
WITH {METRICS}, w AS (SELECT metric, max(value) FILTER (stage = 'base') AS base, max(value) FILTER (stage = 'sft') AS sft, max(value) FILTER (stage = 'rl') AS rl FROM m GROUP BY metric)
SELECT *, row_number() OVER (ORDER BY metric <> 'CORE', metric = 'ChatCORE', metric) AS line FROM w
""")
def metric_table(spark, sf_dir):
    from pyspark.sql import Window

    size = F.col("p_size")
    metric = F.when(size % 5 == 0, "CORE").when(size % 5 == 1, "ChatCORE").otherwise(F.col("p_brand"))
    stage = F.get(F.array(*map(F.lit, ("base", "sft", "rl"))), (size % 3).cast("int"))
    values = table(spark, sf_dir, "part").groupBy(metric.alias("metric"), stage.alias("stage")).agg(F.max("p_partkey").alias("value"))
    wide = sinks.metric_table(values, ["base", "sft", "rl"])
    return wide.withColumn("line", F.row_number().over(Window.orderBy("place"))).drop("place")


@register("b20_publishable_steps", """
WITH f AS (SELECT l_orderkey AS step, 'k' || l_linenumber % 3 AS kind, l_linenumber AS no, l_partkey AS a,
  CASE WHEN l_partkey % 11 = 0 THEN l_partkey + 1 ELSE l_partkey END AS b, l_suppkey % 13 <> 0 AS valid FROM lineitem)
SELECT step FROM f GROUP BY step HAVING bool_and(a = b AND valid) AND count(DISTINCT kind) = 3
""")
def publishable_steps(spark, sf_dir):
    k = F.col("l_partkey")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("step"), F.concat(F.lit("k"), F.col("l_linenumber") % 3).alias("kind"), F.concat_ws("/", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("path"), k.alias("a"), F.when(k % 11 == 0, k + 1).otherwise(k).alias("b"), (F.col("l_suppkey") % 13 != 0).alias("valid"))
    return sinks.publishable(rows.select("path", F.col("a").alias("size")), rows.select("step", "kind", "path", F.col("b").alias("size"), "valid"), ["k0", "k1", "k2"])


@register("h2_joined_pages", r"""
SELECT doc_id, md5(array_to_string(list_filter([split_part(text, chr(10), 1), '', split_part(text, chr(10), 2), NULL, split_part(text, chr(10), 3)], lambda x: x <> ''), chr(10) || chr(10))) AS digest
FROM documents WHERE text IS NOT NULL
""")
def joined_pages(spark, sf_dir):
    line = lambda i: F.split_part("text", F.lit("\n"), F.lit(i))
    pages = F.array(line(1), F.lit(""), line(2), F.lit(None).cast("string"), line(3))
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.md5(quality.joined_pages(pages)).alias("digest"))
