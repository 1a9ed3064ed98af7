"""Queries of curricula, over conversations as graded rows: ten routes, scores from 0 to 100, four domains."""

from __future__ import annotations

from pyspark.sql import functions as F

from textmill.catalog import register
from textmill.operators import curriculum, dedup, lineage, records, sampling
from textmill.operators.curriculum import Route
from textmill.sources.tables import table


def _graded(spark, sf_dir):
    c = F.col("conv_id")
    return table(spark, sf_dir, "conversations").select("conv_id").distinct().select("conv_id", F.concat(F.lit("r"), c % 10).alias("route"), (c * 37 % 101).alias("score"), (c % 4).alias("domain"))


ROUTES = [Route("r0", 40), Route("r1", 60, 4, 2), Route("r2", 0, 6, 3, "calibration", 2), Route("r3", 90, 3, 2, "robustness", 2), Route("r4", 0, None, 1, "authentic", 3)]

BASE = """
r AS (SELECT DISTINCT conv_id, 'r' || (conv_id % 10) AS route, conv_id * 37 % 101 AS score, conv_id % 4 AS domain FROM conversations),
k AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY md5('1930:' || route || ':' || conv_id), conv_id) AS p, count(*) OVER (PARTITION BY route) AS n FROM r WHERE score >= 80),
h AS (SELECT route, conv_id FROM k WHERE p <= least(512, greatest(16, CAST(round_even(0.015 * n, 0) AS BIGINT)))),
spec(route, threshold, most, passes, kind, stage) AS (VALUES ('r0', 40, NULL, 1, 'graded', 1), ('r1', 60, 4, 2, 'graded', 1),
  ('r2', 0, 6, 3, 'calibration', 2), ('r3', 90, 3, 2, 'robustness', 2), ('r4', 0, NULL, 1, 'authentic', 3)),
free AS (SELECT r.*, spec.* EXCLUDE (route) FROM r JOIN spec USING (route)
  WHERE kind IN ('robustness', 'authentic') OR (score >= threshold AND NOT EXISTS (SELECT 1 FROM h WHERE h.route = r.route AND h.conv_id = r.conv_id))),
chosen AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY route ORDER BY md5('6:' || route || ':' || conv_id), conv_id) AS place FROM free) WHERE most IS NULL OR place <= most)"""


def _held(rows):
    return sampling.holdouts(rows, seed=1930)


@register("d6_holdout_rows", f"WITH {BASE} SELECT r.route, r.conv_id, r.score FROM r JOIN h USING (route, conv_id)")
def holdout_rows(spark, sf_dir):
    rows = _graded(spark, sf_dir)
    return curriculum.held_rows(rows, _held(rows)).select("route", "conv_id", "score")


@register("g4_flat_curriculum", f"WITH {BASE} SELECT route, conv_id, unnest(range(1, passes + 1)) AS pass FROM chosen")
def flat_curriculum(spark, sf_dir):
    rows = _graded(spark, sf_dir)
    return curriculum.flat(rows, _held(rows), ROUTES, seed=6)


@register("g5_balanced_curriculum", f"""
WITH {BASE}, b AS (SELECT *, md5('6:balance:' || conv_id) AS x FROM free),
t AS (SELECT *, row_number() OVER (PARTITION BY route, domain ORDER BY x, conv_id) AS k, min(x) OVER (PARTITION BY route, domain) AS g FROM b),
c AS (SELECT *, row_number() OVER (PARTITION BY route ORDER BY k, g) AS place FROM t)
SELECT route, conv_id, unnest(range(1, passes + 1)) AS pass FROM c WHERE most IS NULL OR place <= most
""")
def balanced_curriculum(spark, sf_dir):
    rows = _graded(spark, sf_dir)
    return curriculum.flat(rows, _held(rows), ROUTES, seed=6, domain="domain")


@register("g7_robustness_rows", f"WITH {BASE} SELECT route, conv_id, place FROM chosen WHERE kind = 'robustness'")
def robustness_rows(spark, sf_dir):
    rows = _graded(spark, sf_dir)
    return curriculum.selected(rows, _held(rows), [r for r in ROUTES if r.kind == "robustness"], seed=6).select("route", "conv_id", "place")


@register("g10_curriculum_summary", f"""
WITH {BASE}, n AS (SELECT s.*, (SELECT count(*) FROM chosen c WHERE c.route = s.route) AS rows FROM spec s)
SELECT route, stage, threshold, passes, rows, rows * passes AS presentations,
       CAST(sum(rows * passes) OVER (ORDER BY stage RANGE UNBOUNDED PRECEDING) AS BIGINT) AS cumulative FROM n
""")
def curriculum_summary(spark, sf_dir):
    rows = _graded(spark, sf_dir)
    return curriculum.summary(rows, _held(rows), ROUTES, seed=6)


#: Named mixtures: which routes each presents.
RECIPES = {
    "plain": [Route("r0", 40), Route("r1", 40)],
    "strict": [Route("r0", 80), Route("r1", 80)],
    "repeated": [Route("r0", 40, None, 2)],
    "staged": [Route("r0", 60), Route("r2", 60, 5, 1, "calibration", 2)],
    "authentic": [Route("r4", 0, None, 1, "authentic")],
}


@register("g11_recipes", f"""
WITH {BASE}, x(recipe, route, threshold, most, passes, open) AS (VALUES ('plain', 'r0', 40, 99999, 1, true), ('plain', 'r1', 40, 99999, 1, true), ('strict', 'r0', 80, 99999, 1, true),
  ('strict', 'r1', 80, 99999, 1, true), ('repeated', 'r0', 40, 99999, 2, true), ('staged', 'r0', 60, 99999, 1, true), ('staged', 'r2', 60, 5, 1, true), ('authentic', 'r4', 0, 99999, 1, false)),
f AS (SELECT x.recipe, x.route, x.passes, least(x.most, count(*)) AS n FROM x JOIN r USING (route) LEFT JOIN h ON h.route = r.route AND h.conv_id = r.conv_id
  WHERE NOT x.open OR (r.score >= x.threshold AND h.conv_id IS NULL) GROUP BY x.recipe, x.route, x.passes, x.most)
SELECT recipe, CAST(sum(n * passes) AS BIGINT) AS presentations FROM f GROUP BY recipe
""")
def recipes(spark, sf_dir):
    rows = _graded(spark, sf_dir)
    held, out = _held(rows), None
    for name, routes in RECIPES.items():
        n = curriculum.flat(rows, held, routes, seed=6).groupBy(F.lit(name).alias("recipe")).agg(F.count("*").alias("presentations"))
        out = n if out is None else out.unionByName(n)
    return out


@register("d10_train_val", """
WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY md5('4:split:' || doc_id), doc_id) - 1 AS position, count(*) OVER () AS n FROM documents)
SELECT doc_id, position < least(256, n // 2) AS is_val FROM o
""")
def train_val(spark, sf_dir):
    return sampling.train_val(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", seed=4).select("doc_id", "is_val")


@register("d11_pool_share", """
WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY md5('8:share:' || doc_id), doc_id) - 1 AS position, count(*) OVER () AS n FROM documents)
SELECT doc_id FROM o WHERE position < greatest(1, CAST(round_even(n * 0.3, 0) AS BIGINT))
""")
def pool_share(spark, sf_dir):
    return sampling.share_of(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0.3, seed=8)


@register("d3_not_committed", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def not_committed(spark, sf_dir):
    return dedup.not_committed(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@register("d2_claims_of_committed", """
WITH d AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS first FROM documents)
SELECT doc_id FROM d WHERE doc_id = first AND doc_id NOT IN (SELECT doc_id FROM labels)
""")
def claims_of_committed(spark, sf_dir):
    """Committed rows claim the keys of their copies, and only then are left out themselves."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest"))
    kept = dedup.claim_dedup(rows.withColumn("others", F.array().cast("array<string>")), order="doc_id", key="digest", duplicates="others").where("NOT is_duplicate")
    return dedup.not_committed(kept, table(spark, sf_dir, "labels"), "doc_id").select("doc_id")


@register("d21_choice_chains", """
WITH c AS (SELECT c_custkey, [md5('5:topic:' || c_custkey), md5('5:persona:' || c_custkey)] AS h FROM customer),
o AS (SELECT c_custkey, list(x ORDER BY md5('5:part-' || x || ':' || c_custkey)) AS parts FROM customer, (SELECT unnest(['greeting', 'history', 'letters', 'numbers', 'trade']) AS x) GROUP BY c_custkey)
SELECT c_custkey, ['arts', 'sciences', 'travel'][1 + CAST('0x' || substr(h[1], 1, 8) AS BIGINT) % 3] AS topic,
       ['child', 'clerk', 'farmer', 'nurse'][1 + CAST('0x' || substr(h[2], 1, 8) AS BIGINT) % 4] AS persona, array_to_string(parts[1:3], ',') AS parts
FROM c JOIN o USING (c_custkey)
""")
def choice_chains(spark, sf_dir):
    key = F.col("c_custkey")
    parts = curriculum.choices(key, 5, "part", ["greeting", "history", "letters", "numbers", "trade"], 3)
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        curriculum.choice(key, 5, "topic", ["arts", "sciences", "travel"]).alias("topic"),
        curriculum.choice(key, 5, "persona", ["child", "clerk", "farmer", "nurse"]).alias("persona"),
        F.array_join(parts, ",").alias("parts"),
    )


WORDS = ["Amber", "basket", "Cotton", "dwell", "engine", "Ferry"]


def _pick(scope: str, n: str) -> str:
    return f"CAST('0x' || substr(md5('9:{scope}:' || at_), 1, 8) AS BIGINT) % ({n})"


def _letters(offset: int) -> str:
    texts = ", ".join(f"'{t}'" for t in curriculum.TEMPLATES)
    return f"""
WITH p AS (SELECT p_partkey AS place, p_partkey + {offset} AS at_ FROM part),
w AS (SELECT *, {WORDS!r}[1 + {_pick('word', '6')}] AS word FROM p),
l AS (SELECT *, CASE WHEN {_pick('from', '10')} < 9 THEN substr(word, 1 + {_pick('own', 'length(word)')}, 1)
  ELSE substr('abcdefghijklmnopqrstuvwxyz', 1 + {_pick('other', '26')}, 1) END AS letter, CASE WHEN {_pick('quote', '2')} = 0 THEN '''' ELSE '' END AS q FROM w),
t AS (SELECT *, replace(replace([{texts}][1 + {_pick('template', '4')}], '{{letter}}', q || letter || q), '{{word}}', q || word || q) AS body FROM l)
SELECT place, CASE WHEN {_pick('case', '10')} < 3 THEN lower(body) ELSE body END || CASE WHEN {_pick('mark', '2')} = 0 THEN '?' ELSE '' END AS question, word, letter,
       CAST(length(word) - length(replace(word, letter, '')) AS BIGINT) AS count, array_to_string(string_split(word, ''), ',') AS spelled FROM t"""


@register("d22_letter_tasks", _letters(0))
def letter_tasks(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("place"))
    return rows.select("place", curriculum.letter_task(F.col("place"), WORDS, seed=9).alias("t")).select("place", "t.*")


@register("d23_test_letter_tasks", _letters(curriculum.TEST_OFFSET))
def test_letter_tasks(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("place"))
    return rows.select("place", curriculum.letter_task(F.col("place"), WORDS, seed=9, test=True).alias("t")).select("place", "t.*")


@register("d24_capped_mixture", """
WITH a AS (SELECT 0 AS i, 'items' AS task, item_id AS local FROM benchmark UNION ALL SELECT 1, 'talks', conv_id FROM (SELECT DISTINCT conv_id FROM conversations)),
p AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || i || ':' || local), i, local) - 1 AS position FROM a)
SELECT sha256(string_agg(i || ':' || task || ':' || local || chr(10), '' ORDER BY position)) AS digest, count(*) AS rows FROM p WHERE position < 30
""")
def capped_mixture(spark, sf_dir):
    from textmill.operators import conversations as conv

    tasks = {"items": table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("k")), "talks": table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("k")).distinct()}
    chosen = curriculum.capped(conv.mixture(tasks, "k"), 30)
    return chosen.agg(F.count("*").alias("rows")).withColumn("digest", F.lit(curriculum.selection_digest(chosen)))


@register("g13_key_differences", """
SELECT 'only documents' AS side, count(*) AS n FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels)
UNION ALL SELECT 'both', count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)
UNION ALL SELECT 'only labels', count(*) FROM (SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents)
""")
def key_differences(spark, sf_dir):
    return records.key_differences(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id", "documents", "labels")


@register("b18_promoted_shards", """
WITH s AS (SELECT p_partkey AS i FROM part WHERE p_size % 7 <> 0), f AS (SELECT p_partkey AS i FROM part WHERE p_size % 5 <> 0)
SELECT coalesce(s.i, f.i) AS index, CASE WHEN s.i IS NULL THEN 'delete orphan' WHEN f.i IS NULL THEN 'missing' ELSE 'ok' END AS action FROM s FULL JOIN f ON s.i = f.i
""")
def promoted_shards(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "index")
    return lineage.promote(part.where("p_size % 7 <> 0").select("index"), part.where("p_size % 5 <> 0").select("index"))
