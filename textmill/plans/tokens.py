"""Queries of tokens, prompts and programs, with a public vocabulary file."""

from __future__ import annotations

from pyspark.sql import functions as F

from textmill.catalog import register
from textmill.functions import text
from textmill.operators import conversations as conv
from textmill.operators import tokens
from textmill.sources.tables import table

#: Ids beyond those of the vocabulary, as marks of turns.
MARKS = tokens.Marks(begin=50_257, user=50_258, user_end=50_259, assistant=50_260, assistant_end=50_261)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def talks(spark, sf_dir):
    """Conversations as (conv_id, messages), with a leading system turn or none and roles in turn from a user on."""
    turns = table(spark, sf_dir, "conversations")
    part = F.array(F.struct(F.lit("text").alias("type"), F.coalesce("text", F.lit("")).alias("text")))
    rows = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", part.alias("parts")))).alias("m"))
    messages = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["parts"].alias("parts")))
    plain = F.transform("m", lambda x: F.struct(x["role"].alias("role")))
    return rows.where(conv.alternates(plain)).select("conv_id", messages.alias("messages"))


@register("h37_rendered_conversations")
def rendered_conversations(spark, sf_dir):
    return tokens.rendered(talks(spark, sf_dir), vocabulary(), MARKS)


@register("h38_rendered_for_completion")
def rendered_for_completion(spark, sf_dir):
    rows = talks(spark, sf_dir).where(F.element_at("messages", -1)["role"] == "assistant")
    return tokens.rendered(rows, vocabulary(), MARKS, completion=True).select("key", "ids")


@register("h48_byte_lengths")
def byte_lengths(spark, sf_dir):
    return tokens.byte_lengths(spark, vocabulary())


@register("h49_round_trips", "SELECT item_id AS key, md5(text) AS digest FROM benchmark")
def round_trips(spark, sf_dir):
    ids = tokens.encoded(table(spark, sf_dir, "benchmark"), vocabulary(), key="item_id", prepend=[tokens.special_id(vocabulary(), "<|bos|>", "<|endoftext|>")])
    return tokens.decoded(ids, vocabulary()).select("key", F.md5("text").alias("digest"))


@register("i23_tokenizer_metrics")
def tokenizer_metrics(spark, sf_dir):
    return tokens.metrics(table(spark, sf_dir, "documents"), vocabulary())


@register("i24_compression", """
WITH r AS (SELECT item_id AS key, strlen(text) AS n_bytes, length(text) AS ours, len(string_split(text, ' ')) + item_id % 3 * 100 AS theirs FROM benchmark)
SELECT key, n_bytes, ours AS our_tokens, theirs AS their_tokens, round(n_bytes / ours, 6) AS our_ratio, round(n_bytes / theirs, 6) AS their_ratio,
       round(100 * (theirs - ours) / theirs, 6) AS relative_diff, CASE WHEN ours < theirs THEN 'ours' WHEN ours > theirs THEN 'theirs' ELSE 'tie' END AS winner FROM r
""")
def compression(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("key"), F.octet_length("text").cast("long").alias("n_bytes"), "text")
    ours = items.select("key", "n_bytes", F.length("text").cast("long").alias("tokens"))
    theirs = items.select("key", "n_bytes", (F.size(F.split("text", " ")) + F.col("key") % 3 * 100).alias("tokens"))
    out = tokens.compared(ours, theirs)
    return out.withColumns({c: F.round(c, 6) for c in ("our_ratio", "their_ratio", "relative_diff")})


def _prompts(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark")
    half = F.floor(F.length("text") / 2).cast("int")
    return items.select("item_id", F.substr("text", F.lit(1), half).alias("a"), F.substr("text", half + 1).alias("b"), F.array(F.lit("Q: x y"), F.lit("Q: z w")).alias("shots"))


PROMPTS = r"""p AS (SELECT item_id, substr(text, 1, length(text) // 2) AS a, substr(text, length(text) // 2 + 1) AS b, 'Q: x y' || chr(10) || chr(10) || 'Q: z w' || chr(10) || chr(10) AS s FROM benchmark)"""


@register("h27_all_prompts", rf"""
WITH {PROMPTS}
SELECT item_id, md5(s || a || ' => ' || b) AS choice_1, md5(s || a || ' => none') AS choice_2, md5(s || a || ' => ' || b) AS schema_1, md5(s || 'it => ' || b) AS schema_2,
       md5(regexp_replace(s || trim(a, ' ' || chr(10) || chr(9)) || ' => ', '^\s+|\s+$', '', 'g')) AS without, md5(s || trim(a, ' ' || chr(10) || chr(9)) || ' => ' || b) AS with_it FROM p
""")
def all_prompts(spark, sf_dir):
    rows, by = _prompts(spark, sf_dir), " => "
    choice = text.choice_prompts(F.col("a"), F.array("b", F.lit("none")), F.col("shots"), by)
    schema = text.schema_prompts(F.array("a", F.lit("it")), F.col("b"), F.col("shots"), by)
    both = text.continuation_prompts(F.col("a"), F.col("b"), F.col("shots"), by)
    at = lambda c, i: F.md5(F.get(c, F.lit(i)))
    return rows.select("item_id", at(choice, 0).alias("choice_1"), at(choice, 1).alias("choice_2"), at(schema, 0).alias("schema_1"), at(schema, 1).alias("schema_2"), at(both, 0).alias("without"), at(both, 1).alias("with_it"))


@register("h34_continuation_spans", """
SELECT p_partkey, p_size % 4 AS choice_start, p_size % 4 + 2 AS choice_stop, 3 AS schema_start, 5 AS schema_stop,
       greatest(p_size % 9 + 1 - greatest(p_size % 9 + 4 - 6, 0), 0) AS next_start, least(p_size % 9 + 4, 6) AS next_stop FROM part
""")
def continuation_spans(spark, sf_dir):
    n = (F.col("p_size") % 4).cast("int")
    same = lambda k: F.array_repeat(F.lit(7), k)
    choice = text.continuation_spans("choice", F.array(F.concat(same(n), F.array(F.lit(1), F.lit(2))), F.concat(same(n), F.array(F.lit(3), F.lit(4), F.lit(5)))))
    schema = text.continuation_spans("schema", F.array(F.array(*map(F.lit, (1, 2, 3, 8, 9))), F.array(*map(F.lit, (4, 8, 9)))))
    m = (F.col("p_size") % 9 + 1).cast("int")
    after = text.continuation_spans("continuation", F.array(same(m), F.concat(same(m), F.array(*map(F.lit, (1, 2, 3))))), 6)
    at = lambda c, i, f: F.get(c, F.lit(i))[f].cast("long")
    rows = table(spark, sf_dir, "part").select("p_partkey", choice.alias("c"), schema.alias("s"), after.alias("a"))
    return rows.select("p_partkey", *(at(c, 0, f).alias(f"{name}_{f}") for c, name in (("c", "choice"), ("s", "schema"), ("a", "next")) for f in ("start", "stop")))


@register("h8_program_sources", r"""
SELECT p_partkey, md5('import re' || chr(10) || 'from a import b' || chr(10) || chr(10) || 'def ' || p_brand || '():' || chr(10) || '  return ' || p_size || chr(10) || chr(10) || 'def check(f): pass' || chr(10) || 'check(' || p_brand || ')') AS digest FROM part
""")
def program_sources(spark, sf_dir):
    prompt = F.lit("import re\n# note\nfrom a import b\n\ndef f():\nimport os\n")
    code = F.concat(F.lit("def "), "p_brand", F.lit("():\n  return "), "p_size")
    completion = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("So:\n```python\n"), code, F.lit("\n```\nDone."))).otherwise(F.concat(F.lit("\n"), code, F.lit("  \n")))
    return table(spark, sf_dir, "part").select("p_partkey", F.md5(text.program_source(prompt, completion, F.lit("def check(f): pass"), F.col("p_brand"))).alias("digest"))


@register("h39_fitted_turns", """
WITH t AS (SELECT conv_id, turn, role, CAST(length(coalesce(text, '')) AS BIGINT) AS n FROM conversations),
x AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS e FROM t),
l AS (SELECT conv_id, coalesce(sum(n) FILTER (e = 0), 0) AS lead FROM x GROUP BY conv_id),
s AS (SELECT conv_id, e, sum(n) AS size FROM x WHERE e > 0 GROUP BY ALL),
u AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY e DESC) AS used, row_number() OVER (PARTITION BY conv_id ORDER BY e DESC) AS k FROM s JOIN l USING (conv_id)),
k AS (SELECT conv_id, e, greatest(size - (700 - lead), 0) AS over FROM u WHERE used <= 700 - lead OR k = 1),
b AS (SELECT x.*, sum(n) OVER (PARTITION BY conv_id, e ORDER BY turn) AS upto FROM x),
r AS (SELECT b.conv_id, b.turn, least(n, greatest(upto - over, 0)) AS kept FROM b JOIN k USING (conv_id, e))
SELECT conv_id, turn, CAST(kept AS BIGINT) AS kept FROM r WHERE kept > 0 UNION ALL SELECT conv_id, turn, n FROM x WHERE e = 0
""")
def fitted_turns(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("tokens"))
    return conv.fitted(turns, 800, reply=100).select("conv_id", "turn", F.col("kept").cast("long").alias("kept"))
