"""Queries of the slips, over the texts of conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from textmill.catalog import register
from textmill.functions import noise
from textmill.sources.tables import table


def _slips(spark, sf_dir, family):
    key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    slips = (f(F.col("text"), key).alias(f.__name__) for f in noise.FAMILIES[family])
    return table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", *slips)


def _hash(scope: str) -> str:
    return f"CAST('0x' || substr(md5('{scope}:' || conv_id || ':' || turn), 1, 8) AS BIGINT)"


TURNS = r"""
t AS (SELECT conv_id, turn, text, regexp_replace(text, '\s+$', '') AS bare,
  list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws
  FROM conversations WHERE text IS NOT NULL)"""


def _letters(name: str, least: int, change: str) -> str:
    """A column: text with the word w at a picked place changed, j being a number from the hash of the slip."""
    fit = f"list_filter(range(1, len(ws) + 1), lambda i: length(ws[i]) >= {least} AND regexp_matches(ws[i], '^\\p{{L}}+$'))"
    at = f"{fit}[1 + ({_hash(f'{name}-word')} % greatest(len({fit}), 1))]"
    return f"CASE WHEN len({fit}) > 0 THEN array_to_string(list_transform(ws, lambda w, i: CASE WHEN i = {at} THEN {change} ELSE w END), ' ') ELSE text END AS {name}"


@register("h12_punctuation_slips", rf"""
WITH {TURNS}, e AS (SELECT *, rtrim(bare, '"''’”)]') AS core FROM t),
d AS (SELECT *, regexp_replace(rtrim(core, '.?!,;:…'), '\s+$', '') || substr(bare, length(core) + 1) AS dropped,
  trim(regexp_replace(text, '[^\p{{L}}\p{{N}}\s]', '', 'g')) AS stripped FROM e)
SELECT conv_id, turn, CASE WHEN dropped = '' THEN text ELSE dropped END AS drop_end,
  bare || CASE WHEN right(bare, 1) IN ('?', '!') THEN repeat(right(bare, 1), CAST({_hash('add_marks')} % 3 + 1 AS BIGINT))
    ELSE ['?', '!', '??', '!!', '?!'][1 + ({_hash('add_marks')} % 5)] END AS add_marks,
  CASE WHEN stripped = '' THEN text ELSE stripped END AS strip_marks
FROM d
""")
def punctuation_slips(spark, sf_dir):
    return _slips(spark, sf_dir, "punctuation")


@register("h13_case_slips", rf"""
WITH {TURNS}
SELECT conv_id, turn, lower(text) AS lower, upper(replace(text, 'ß', 'SS')) AS upper, lower(substr(text, 1, 1)) || substr(text, 2) AS leading_lower,
  {_letters('caps_slip', 2, f"upper(replace(substr(w, 1, CAST({_hash('caps_slip')} % 2 + 2 AS BIGINT)), 'ß', 'SS')) || substr(w, CAST({_hash('caps_slip')} % 2 + 3 AS BIGINT))")}
FROM t
""")
def case_slips(spark, sf_dir):
    return _slips(spark, sf_dir, "case")


@register("h14_spacing_slips", rf"""
WITH {TURNS}, p AS (SELECT *, CAST({_hash('missing_space')} % greatest(len(ws) - 1, 1) AS BIGINT) AS m,
  CAST({_hash('extra_space')} % greatest(len(ws) - 1, 1) AS BIGINT) AS x FROM t)
SELECT conv_id, turn,
  CASE WHEN len(ws) < 2 THEN text ELSE array_to_string(ws[1:m + 1], ' ') || array_to_string(ws[m + 2:], ' ') END AS missing_space,
  CASE WHEN len(ws) < 2 THEN text ELSE array_to_string(ws[1:x + 1], ' ') || '   ' || array_to_string(ws[x + 2:], ' ') END AS extra_space
FROM p
""")
def spacing_slips(spark, sf_dir):
    return _slips(spark, sf_dir, "spacing")


@register("h16_word_slips", rf"""
WITH {TURNS}, p AS (SELECT *, CAST({_hash('drop_word')} % greatest(len(ws), 1) AS BIGINT) AS d,
  CAST({_hash('repeat_word')} % greatest(len(ws), 1) AS BIGINT) AS r FROM t)
SELECT conv_id, turn,
  CASE WHEN len(ws) < 4 THEN text ELSE array_to_string(list_filter(ws, lambda w, i: i <> d + 1), ' ') END AS drop_word,
  CASE WHEN len(ws) < 2 THEN text ELSE array_to_string(list_transform(ws, lambda w, i: CASE WHEN i = r + 1 THEN w || ' ' || w ELSE w END), ' ') END AS repeat_word,
  replace(replace(text, '''', ''), '’', '') AS drop_apostrophes
FROM p
""")
def word_slips(spark, sf_dir):
    return _slips(spark, sf_dir, "word")


def _at(name: str, n: str) -> str:
    return f"CAST({_hash(name)} % ({n}) AS BIGINT)"


@register("h15_letter_slips", rf"""
WITH {TURNS}
SELECT conv_id, turn,
  {_letters('transpose', 4, f"substr(w, 1, {_at('transpose', 'length(w) - 1')}) || substr(w, {_at('transpose', 'length(w) - 1')} + 2, 1) || substr(w, {_at('transpose', 'length(w) - 1')} + 1, 1) || substr(w, {_at('transpose', 'length(w) - 1')} + 3)")},
  {_letters('drop_letter', 4, f"substr(w, 1, {_at('drop_letter', 'length(w) - 1')} + 1) || substr(w, {_at('drop_letter', 'length(w) - 1')} + 3)")},
  {_letters('double_letter', 3, f"substr(w, 1, {_at('double_letter', 'length(w)')} + 1) || substr(w, {_at('double_letter', 'length(w)')} + 1)")}
FROM t
""")
def letter_slips(spark, sf_dir):
    return _slips(spark, sf_dir, "character").drop("neighbour_key")


@register("h17_noised_turns")
def noised_turns(spark, sf_dir):
    return noise.noised(table(spark, sf_dir, "conversations"), 0.3, end_rate=0.2, seed=11).select("conv_id", "turn", "role", "text")
