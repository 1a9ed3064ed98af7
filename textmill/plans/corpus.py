"""Queries of corpus curation: sources, waterfall, splits, samples, shards, text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from textmill.catalog import register
from textmill.functions import ordering, text
from textmill.operators import quality, sampling, sharding
from textmill.sources.tables import books, table

#: documents as book metadata, in SQL.
BOOKS = """b AS (
  SELECT doc_id, 'B' || doc_id AS barcode, CASE lang WHEN 'en' THEN 'eng' ELSE lang END AS language,
    CASE WHEN doc_id % 11 = 0 THEN '18uu' WHEN doc_id % 13 = 0 THEN '9999' ELSE CAST(1850 + doc_id % 100 AS VARCHAR) END AS date1,
    CASE WHEN doc_id % 3 = 0 THEN NULL ELSE CAST(1900 + doc_id % 40 AS VARCHAR) END AS date2,
    substr('sstcqmsrd', CAST(1 + doc_id % 9 AS INT), 1) AS date_type,
    CASE WHEN doc_id % 29 = 0 THEN NULL ELSE 84 + doc_id % 17 END AS ocr_src, 84 + (doc_id * 7) % 17 AS ocr_gen,
    CASE WHEN doc_id % 31 = 0 THEN NULL ELSE CAST(1.0 AS DOUBLE) - (doc_id % 25) / CAST(100.0 AS DOUBLE) END AS share,
    92 + (doc_id * 3) % 9 AS tokenizability, CAST(floor(n_chars / 4) AS BIGINT) AS tokens, n_chars AS chars,
    CAST(1 + floor(n_chars / 500) AS BIGINT) AS pages, length(text) - length(replace(text, '.', '')) AS sentences,
    source AS topic, text FROM documents),
y AS (
  SELECT *, coalesce(CASE WHEN y1 BETWEEN 1000 AND 2100 THEN y1 END, CASE WHEN y2 BETWEEN 1000 AND 2100 THEN y2 END) AS year,
    CASE WHEN y1 BETWEEN 1000 AND 2100 THEN 'date1' WHEN y2 BETWEEN 1000 AND 2100 THEN 'date2' END AS year_source,
    CAST(abs(ocr_src - ocr_gen) AS DOUBLE) AS disagreement
  FROM (SELECT *, TRY_CAST(regexp_extract(date1, '[0-9][0-9][0-9][0-9]') AS INT) AS y1,
               TRY_CAST(regexp_extract(coalesce(date2, ''), '[0-9][0-9][0-9][0-9]') AS INT) AS y2 FROM b))"""


def waterfall(share: float = 0.9, ocr: int = 90, apart: int = 10, tokenizability: int = 95) -> str:
    return f"""CASE WHEN language IS DISTINCT FROM 'eng' THEN 'language' WHEN share IS NULL THEN 'language_distribution_missing'
    WHEN share < {share} THEN 'language_low_english_proportion' WHEN date_type IN ('c', 'd', 'n', '|') THEN 'date_type_invalid'
    WHEN year IS NULL THEN 'year_unparseable' WHEN year >= 1930 THEN 'year_too_recent'
    WHEN ocr_src IS NULL OR ocr_gen IS NULL THEN 'ocr_missing' WHEN ocr_src < {ocr} OR ocr_gen < {ocr} THEN 'ocr_low'
    WHEN disagreement > {apart} THEN 'ocr_disagree' WHEN tokenizability < {tokenizability} THEN 'tokenizability_low'
    WHEN tokens < 125 THEN 'too_few_tokens' WHEN chars < 500 THEN 'too_few_chars' WHEN pages < 3 THEN 'too_few_pages'
    WHEN sentences IS NULL OR (sentences < 20 AND tokens < 2000) THEN 'too_few_sentences' WHEN coalesce(text, '') = '' THEN 'empty_text' END"""


LEGACY = """CASE WHEN language IS DISTINCT FROM 'eng' THEN 'language' WHEN year IS NULL THEN 'year_unparseable'
    WHEN year >= 1930 THEN 'year_too_recent' WHEN ocr_src IS NULL OR ocr_gen IS NULL THEN 'ocr_missing'
    WHEN ocr_src <= 85 OR ocr_gen <= 85 THEN 'ocr_low' WHEN disagreement >= 15 THEN 'ocr_disagree' END"""


@register("c1_rejection_histogram", f"WITH {BOOKS} SELECT coalesce({waterfall()}, 'pass') AS reason, count(*) AS n FROM y GROUP BY 1")
def rejection_histogram(spark, sf_dir):
    return quality.rejections(quality.classified(books(spark, sf_dir)))


@register("c16_pass_columns", f"WITH {BOOKS} SELECT barcode, CAST(year AS INT) AS year, year_source, round(share, 6) AS share, CAST(disagreement AS DOUBLE) AS disagreement, tokens, pages FROM (SELECT *, {waterfall()} AS r FROM y) WHERE r IS NULL")
def pass_columns(spark, sf_dir):
    rows = quality.classified(books(spark, sf_dir)).where("reject_reason IS NULL")
    return rows.select("barcode", "year", "year_source", F.round("share", 6).alias("share"), "disagreement", "tokens", "pages")


@register("c17_legacy_histogram", f"WITH {BOOKS} SELECT coalesce({LEGACY}, 'pass') AS reason, count(*) AS n FROM y GROUP BY 1")
def legacy_histogram(spark, sf_dir):
    rows = quality.derived(books(spark, sf_dir), quality.SMALL).withColumn("reject_reason", quality.legacy_reason())
    return quality.rejections(rows)


def _profile_sql(name: str, reason: str) -> str:
    return f"SELECT '{name}' AS profile, CAST(count(*) FILTER (WHERE r IS NULL) AS BIGINT) AS n_passed, CAST(coalesce(sum(tokens) FILTER (WHERE r IS NULL), 0) AS BIGINT) AS tokens, CAST(coalesce(sum(pages) FILTER (WHERE r IS NULL), 0) AS BIGINT) AS pages FROM (SELECT *, {reason} AS r FROM y)"


@register("i2_profile_comparison", f"WITH {BOOKS} " + " UNION ALL ".join([_profile_sql("premium_strict", waterfall()), _profile_sql("relaxed_premium", waterfall(0.8, 85, 15, 90)), _profile_sql("legacy", LEGACY)]))
def profile_comparison(spark, sf_dir):
    return quality.compare_profiles(books(spark, sf_dir), quality.PROFILES)


@register("i3_topic_decades", f"WITH {BOOKS} SELECT topic, CAST(floor(year / 10) * 10 AS BIGINT) AS decade, count(*) AS n, grouping(topic) + 2 * grouping(decade) AS level FROM (SELECT *, CAST(floor(year / 10) * 10 AS BIGINT) AS decade FROM y WHERE year IS NOT NULL) GROUP BY GROUPING SETS ((topic, decade), (topic), ())".replace("SELECT topic, CAST(floor(year / 10) * 10 AS BIGINT) AS decade, count(*) AS n, grouping(topic) + 2 * grouping(decade) AS level", "SELECT topic, decade, count(*) AS n, CAST(grouping(topic) + 2 * grouping(decade) AS BIGINT) AS level"))
def topic_decades(spark, sf_dir):
    rows = quality.derived(books(spark, sf_dir), quality.SMALL).where("year IS NOT NULL").withColumn("decade", (F.floor(F.col("year") / 10) * 10).cast("long"))
    out = rows.rollup("topic", "decade").agg(F.count("*").alias("n"), F.grouping("topic").alias("t"), F.grouping("decade").alias("d"))
    return out.select("topic", "decade", "n", (F.col("t") + 2 * F.col("d")).cast("long").alias("level"))


@register("a3_row_group_stride", "SELECT doc_id, CAST(floor(doc_id / 64) AS BIGINT) AS row_group FROM documents WHERE floor(doc_id / 64) % 4 = 1")
def row_group_stride(spark, sf_dir):
    return sampling.stride(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", group=64, start=1, step=4)


@register("a2_last_shard_is_validation", "SELECT source, source = (SELECT max(source) FROM documents) AS is_val, count(*) AS n FROM documents GROUP BY source")
def last_shard(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return sampling.last_is_validation(docs, "source").groupBy("source", "is_val").agg(F.count("*").alias("n"))


@register("a8_nonblank_text", r"SELECT doc_id FROM documents WHERE regexp_matches(text, '[^\s]')")
def nonblank(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.regexp_like("text", F.lit(r"(?U)\S"))).select("doc_id")



@register("d4_validation_split", """
WITH RECURSIVE k AS (SELECT 'B' || doc_id AS barcode FROM documents),
c(barcode, pos, crc) AS (
  SELECT barcode, 1, CAST(4294967295 AS BIGINT) FROM k
  UNION ALL
  SELECT barcode, pos + 1, s8 FROM (
    SELECT barcode, pos, xor(s7 >> 1, CASE WHEN s7 & 1 = 1 THEN 3988292384 ELSE 0 END) AS s8 FROM (
    SELECT *, xor(s6 >> 1, CASE WHEN s6 & 1 = 1 THEN 3988292384 ELSE 0 END) AS s7 FROM (
    SELECT *, xor(s5 >> 1, CASE WHEN s5 & 1 = 1 THEN 3988292384 ELSE 0 END) AS s6 FROM (
    SELECT *, xor(s4 >> 1, CASE WHEN s4 & 1 = 1 THEN 3988292384 ELSE 0 END) AS s5 FROM (
    SELECT *, xor(s3 >> 1, CASE WHEN s3 & 1 = 1 THEN 3988292384 ELSE 0 END) AS s4 FROM (
    SELECT *, xor(s2 >> 1, CASE WHEN s2 & 1 = 1 THEN 3988292384 ELSE 0 END) AS s3 FROM (
    SELECT *, xor(s1 >> 1, CASE WHEN s1 & 1 = 1 THEN 3988292384 ELSE 0 END) AS s2 FROM (
    SELECT *, xor(s0 >> 1, CASE WHEN s0 & 1 = 1 THEN 3988292384 ELSE 0 END) AS s1 FROM (
    SELECT barcode, pos, xor(crc, CAST(ascii(substr(barcode, pos, 1)) AS BIGINT)) AS s0 FROM c WHERE pos <= length(barcode)))))))))))
SELECT barcode, xor(crc, CAST(4294967295 AS BIGINT)) % 20 = 0 AS is_val FROM c WHERE pos = length(barcode) + 1
""")
def validation_split(spark, sf_dir):
    return books(spark, sf_dir).select("barcode", ordering.in_crc_split("barcode", 20).alias("is_val"))


@register("b5_char_budget_shards", """
WITH RECURSIVE d AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) AS p FROM documents),
s(p, doc_id, n, filled, shard) AS (
  SELECT p, doc_id, n_chars, n_chars, CAST(0 AS BIGINT) FROM d WHERE p = 1
  UNION ALL
  SELECT d.p, d.doc_id, d.n_chars, CASE WHEN s.filled >= 100000 THEN 0 ELSE s.filled END + d.n_chars, s.shard + CASE WHEN s.filled >= 100000 THEN 1 ELSE 0 END
  FROM s JOIN d ON d.p = s.p + 1)
SELECT shard, count(*) AS docs, CAST(sum(n) AS BIGINT) AS chars FROM s GROUP BY shard
""")
def char_budget_shards(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return sharding.greedy_shards(docs, "doc_id", "n_chars", 100_000).groupBy("shard").agg(F.count("*").alias("docs"), F.sum("n_chars").alias("chars"))


@register("b5_approximate_shards", "SELECT shard, count(*) AS docs FROM (SELECT CAST(floor((sum(n_chars) OVER (ORDER BY doc_id) - n_chars) / 100000) AS BIGINT) AS shard FROM documents) GROUP BY shard")
def approximate_shards(spark, sf_dir):
    docs = sharding.running_total(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars")
    return docs.groupBy(F.floor((F.col("running") - F.col("n_chars")) / 100_000).alias("shard")).agg(F.count("*").alias("docs"))


@register("b8_hash_shuffle", "SELECT doc_id, row_number() OVER (ORDER BY md5('42:shuffle:' || doc_id), doc_id) - 1 AS position FROM documents")
def hash_shuffle(spark, sf_dir):
    return sampling.shuffled(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", seed=42, scope="shuffle")


@register("b15_audit_rows", f"WITH {BOOKS} SELECT barcode, topic, CAST(year AS INT) AS year, tokens, chars, pages, coalesce(r, 'pass') AS outcome FROM (SELECT *, {waterfall()} AS r FROM y)")
def audit_rows(spark, sf_dir):
    rows = quality.classified(books(spark, sf_dir))
    return rows.select("barcode", "topic", "year", "tokens", "chars", "pages", F.coalesce("reject_reason", F.lit("pass")).alias("outcome"))


@register("b10_token_shards", """
WITH s AS (SELECT doc_id, greatest(1, CAST(floor(n_chars / 4) AS BIGINT)) AS n, sum(greatest(1, CAST(floor(n_chars / 4) AS BIGINT))) OVER (ORDER BY doc_id) AS e FROM documents),
f AS (SELECT doc_id, e - n AS b, e, unnest(range(CAST(floor((e - n) / 10000) AS BIGINT), CAST(floor((e - 1) / 10000) AS BIGINT) + 1)) AS file FROM s)
SELECT doc_id, CAST(file AS BIGINT) AS file, CAST(greatest(b, file * 10000) - b AS BIGINT) AS first_token, CAST(least(e, (file + 1) * 10000) - greatest(b, file * 10000) AS BIGINT) AS n_tokens FROM f
""")
def token_shards(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.greatest(F.lit(1), F.floor(F.col("n_chars") / 4)).cast("long").alias("n"))
    return sharding.token_files(docs, "doc_id", "n", 10_000)


@register("d16_head_sample", "SELECT doc_id, md5(substr(text, 1, 100)) AS digest FROM documents")
def head_sample(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.sample_head(F.col("text"), 100)).alias("digest"))


@register("d17_window_sample", "SELECT doc_id, md5(substr(text, 1 + CASE WHEN length(text) > 100 THEN CAST(CAST('0x' || substr(md5('7:window:' || doc_id), 1, 8) AS BIGINT) % (length(text) - 99) AS BIGINT) ELSE 0 END, 100)) AS digest FROM documents")
def window_sample(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    pick = ordering.hash_pick(ordering.hash_order(7, "window", "doc_id"), 2**32)
    return docs.select("doc_id", F.md5(text.sample_window(F.col("text"), 100, pick)).alias("digest"))


@register("d18_chunk_sample", "SELECT doc_id, md5(CASE WHEN length(text) <= 90 THEN text ELSE substr(text, 1, 30) || substr(text, 1 + CAST(round_even((length(text) - 30) / 2.0, 0) AS BIGINT), 30) || substr(text, length(text) - 29, 30) END) AS digest FROM documents")
def chunk_sample(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.sample_chunks(F.col("text"), 90, 3)).alias("digest"))


@register("d19_char_budget_cut", "SELECT doc_id, CAST(running AS BIGINT) AS running FROM (SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY doc_id) AS running FROM documents) WHERE running - n_chars <= 200000")
def char_budget_cut(spark, sf_dir):
    return sharding.budget_cut(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id", "n_chars", 200_000, inclusive=True).select("doc_id", "running")


@register("d20_byte_budget_cut", "SELECT doc_id, CAST(running AS BIGINT) AS running FROM (SELECT doc_id, strlen(text) AS n, sum(strlen(text)) OVER (ORDER BY doc_id) AS running FROM documents) WHERE running - n < 200000")
def byte_budget_cut(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n"))
    return sharding.budget_cut(docs, "doc_id", "n", 200_000).select("doc_id", "running")


@register("d5_holdouts", """
WITH r AS (SELECT DISTINCT conv_id, conv_id % 10 AS route, (conv_id * 37) % 101 AS score FROM conversations),
k AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY md5('1930:' || route || ':' || conv_id), conv_id) AS p, count(*) OVER (PARTITION BY route) AS n FROM r WHERE score >= 80)
SELECT route, conv_id FROM k WHERE p <= least(512, greatest(16, CAST(round_even(0.015 * n, 0) AS BIGINT)))
""")
def holdouts(spark, sf_dir):
    return sampling.holdouts(_graded(spark, sf_dir), seed=1930)


@register("d7_training_pool", """
WITH r AS (SELECT DISTINCT conv_id, conv_id % 10 AS route, (conv_id * 37) % 101 AS score FROM conversations),
k AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY md5('1930:' || route || ':' || conv_id), conv_id) AS p, count(*) OVER (PARTITION BY route) AS n FROM r WHERE score >= 80),
h AS (SELECT route, conv_id FROM k WHERE p <= least(512, greatest(16, CAST(round_even(0.015 * n, 0) AS BIGINT))))
SELECT route, conv_id FROM r WHERE score >= 40 AND NOT EXISTS (SELECT 1 FROM h WHERE h.route = r.route AND h.conv_id = r.conv_id)
""")
def training_pool(spark, sf_dir):
    rows = _graded(spark, sf_dir)
    return sampling.pool(rows, sampling.holdouts(rows, seed=1930), threshold=40).select("route", "conv_id")


def _graded(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    return rows.select("conv_id", (F.col("conv_id") % 10).alias("route"), ((F.col("conv_id") * 37) % 101).alias("score"))


@register("d8_first_per_route", """
SELECT route, conv_id, p AS place FROM (
  SELECT conv_id, conv_id % 10 AS route, row_number() OVER (PARTITION BY conv_id % 10 ORDER BY md5('5:' || (conv_id % 10) || ':' || conv_id), conv_id) AS p
  FROM (SELECT DISTINCT conv_id FROM conversations)) WHERE p <= 5
""")
def first_per_route(spark, sf_dir):
    return sampling.first_per_group(_graded(spark, sf_dir), "route", "conv_id", 5, seed=5).select("route", "conv_id", "place")


@register("d9_domain_balance", """
WITH h AS (SELECT doc_id, source, md5('9:balance:' || doc_id) AS h FROM documents),
w AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY h, doc_id) AS k, min(h) OVER (PARTITION BY source) AS g FROM h)
SELECT doc_id, source, row_number() OVER (ORDER BY k, g) - 1 AS position FROM w
""")
def domain_balance(spark, sf_dir):
    return sampling.round_robin(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", seed=9)


@register("d12_fractional_epochs", """
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('3:epochs:' || doc_id), doc_id) AS p, count(*) OVER () AS n FROM documents)
SELECT doc_id, e AS epoch FROM r, (VALUES (0), (1)) AS t(e) UNION ALL
SELECT doc_id, 2 FROM r WHERE p <= greatest(1, CAST(round_even(n * 0.25, 0) AS BIGINT))
""")
def fractional_epochs(spark, sf_dir):
    return sampling.epochs(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 2.25, seed=3)


@register("e9_labelled_exclusion", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def labelled_exclusion(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@register("e10_labelled_selection", "SELECT doc_id FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND quality = 1)")
def labelled_selection(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").where("quality = 1"), "doc_id", "left_semi")


@register("h9_terminal_marks", r"""
WITH t AS (SELECT conv_id, turn, regexp_replace(text, '\s+$', '') AS b FROM conversations),
u AS (SELECT *, rtrim(b, '"''`’”)]}»') AS c FROM t)
SELECT conv_id, turn, b <> '' AND c <> '' AND ((length(b) - length(replace(b, '```', ''))) / 3) % 2 = 0 AND position(right(c, 1) IN '.!?…:;,-–—') = 0 AS needs FROM u
""")
def terminal_marks(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.needs_terminal_mark(F.col("text")).alias("needs"))


@register("h10_repaired_turns", r"""
WITH t AS (SELECT conv_id, turn, role, text, regexp_replace(text, '\s+$', '') AS b FROM conversations),
u AS (SELECT *, rtrim(b, '"''`’”)]}»') AS c FROM t)
SELECT conv_id, turn, md5(CASE WHEN role = 'user' AND b <> '' AND c <> '' AND ((length(b) - length(replace(b, '```', ''))) / 3) % 2 = 0 AND position(right(c, 1) IN '.!?…:;,-–—') = 0
  THEN b || '.' || substr(text, length(b) + 1) ELSE text END) AS digest FROM u
""")
def repaired_turns(spark, sf_dir):
    said = F.when(F.col("role") == "user", text.add_terminal_mark(F.col("text"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(said).alias("digest"))


@register("h20_word_and_byte_counts", r"SELECT doc_id, CAST(len(regexp_extract_all(text, '[^\s]+')) AS BIGINT) AS words, CAST(strlen(text) AS BIGINT) AS bytes FROM documents")
def word_and_byte_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.word_count(F.col("text")).cast("long").alias("words"), F.octet_length("text").cast("long").alias("bytes"))


@register("h22_pre_token_counts")
def pre_token_counts(spark, sf_dir):
    """Pre-tokens of the corpus by count: the data-sized part of training a byte-pair vocabulary."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.explode(text.pre_tokens(F.col("text"))).alias("piece")).groupBy("piece").agg(F.count("*").alias("n"))


@register("h4_final_numbers", r"SELECT doc_id, nullif(replace(regexp_extract('Total: #### ' || n_chars || ',' || (doc_id % 7) || CASE WHEN doc_id % 5 = 0 THEN '' ELSE ' end' END, '#### (-?[0-9.,]+)', 1), ',', ''), '') AS answer FROM documents")
def final_numbers(spark, sf_dir):
    completion = F.concat(F.lit("Total: #### "), F.col("n_chars").cast("string"), F.lit(","), (F.col("doc_id") % 7).cast("string"), F.when(F.col("doc_id") % 5 == 0, "").otherwise(" end"))
    return table(spark, sf_dir, "documents").select("doc_id", text.final_number(completion).alias("answer"))


@register("h3_multiple_choice", "SELECT item_id, md5('Multiple Choice question: ' || text || chr(10) || '- ' || substr(text, 1, 5) || '=A' || chr(10) || '- ' || substr(text, 6, 5) || '=B' || chr(10) || chr(10) || 'Respond only with the letter of the correct answer.') AS digest FROM benchmark")
def multiple_choice(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    prompt = text.multiple_choice(F.col("text"), F.array(F.lit("A"), F.lit("B")), F.array(F.substring("text", 1, 5), F.substring("text", 6, 5)))
    return items.select("item_id", F.md5(prompt).alias("digest"))


@register("h25_reply_verdicts", r"""
WITH t AS (SELECT regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS b FROM conversations WHERE role = 'assistant')
SELECT CASE WHEN b = '' THEN 'EMPTY' WHEN position(right(b, 1) IN '.?!…"''') > 0 THEN 'clean' WHEN length(b) > 350 THEN 'RAN ON' ELSE 'NO STOP' END AS verdict, count(*) AS n FROM t GROUP BY 1
""")
def reply_verdicts(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    return rows.groupBy(text.reply_verdict(F.col("text"), 100).alias("verdict")).agg(F.count("*").alias("n"))


@register("h23_slugs", "SELECT DISTINCT replace(lower(p_type), ' ', '-') AS slug FROM part")
def slugs(spark, sf_dir):
    return table(spark, sf_dir, "part").select(text.slug(F.col("p_type")).alias("slug")).distinct()


@register("h29_letter_counts", "SELECT p_partkey, CAST(length(p_name) - length(replace(p_name, 'e', '')) AS INT) AS letters, array_to_string(string_split(p_name, ''), ',') AS spelled FROM part")
def letter_counts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.letter_count(F.col("p_name"), F.lit("e")).alias("letters"), text.spelled(F.col("p_name")).alias("spelled"))
