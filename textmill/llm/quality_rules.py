"""Quality rules as a bitmask ledger: built-in functions only.

Every rule is evaluated once.  The ledger holds the measurements and one failure bit a rule; a policy is a versioned
mask over those bits, so other policies and ablations need bits alone, never the text again.

Measurements (words are ``[^\\x20\\x09-\\x0D]+`` of the whole text):

* n_words, and word_chars: code points in words
* n_symbols: characters of ``[#*$%&|<>]``
* n_lines: lines (parted by \\n) that have a word; n_dup_lines: those equal to an earlier line
* n_repeat_words: words covered by a window of three words that occurs twice or more in the text

Repeated windows are found inside the row: the hashes of the windows, each with its place in the low bits, are sorted
as longs; equal neighbours (compared by the whole hash) are repeats; a second sort of their places gives the cover.
That is O(n log n) for a text of n words, without an exchange.

Defined cases: a null text has no words; an empty text and one of spaces likewise (they fail the base rules); a null
id stays null; repeated rows get a row each; an empty table gives none.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.llm.shared import fresh

SPACES = "\t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def _here(value: Column) -> Column:
    """value, computed where it stands: the condition is always true but not deterministic to the optimizer, which
    would otherwise push a filter on the result down and write the whole nested expression into it."""
    return F.when(F.spark_partition_id() >= 0, value)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")

#: The rules in order of their bits, as conditions on the measurements under which a document fails.
RULES = {
    "few_words": lambda m: m["n_words"] < 50,
    "repeated_windows": lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"],
    "many_symbols": lambda m: 10 * m["n_symbols"] > m["n_words"],
    "short_words": lambda m: m["word_chars"] < 2 * m["n_words"],
    "long_words": lambda m: m["word_chars"] > 15 * m["n_words"],
    "repeated_lines": lambda m: 10 * m["n_dup_lines"] > 3 * m["n_lines"],
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A document is kept if it fails none of the rules."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return reduce(or_, (BIT[r] for r in self.rules), 0)


BASE = Policy("base", ("few_words", "repeated_windows"))
POLICIES = {p.version: p for p in (BASE, Policy("v1", (*BASE.rules, "many_symbols")), Policy("v2", tuple(RULES)))}


def _words(text: Column) -> Column:
    """The words; an empty array for a text without any."""
    spaced = F.trim(F.translate(text, SPACES, " " * len(SPACES)))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " +"))


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the columns of MEASURES added, as longs (existing columns of such names are replaced)."""
    keep = [c for c in docs.columns if c.lower() not in MEASURES]
    text, words, hashes, windows, low, order, places = fresh(docs, *(f"_tm_{x}" for x in ("text", "words", "hashes", "windows", "low", "order", "places")))
    at = lambda a, i: F.get(F.col(a), i)  # noqa: E731  null beyond the ends
    n = F.size(F.col(words))
    lines = F.filter(F.split(F.col(text), "\n"), lambda x: F.trim(F.translate(x, SPACES, " " * len(SPACES))) != "")
    bare = F.translate(F.col(text), " " + SPACES, "")

    df = docs.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias(text))
    df = df.withColumn(words, _words(F.col(text)))
    df = df.withColumn(hashes, F.transform(F.col(words), lambda w: F.xxhash64(w)))
    pairs = F.when(n < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.slice(F.col(hashes), 1, F.greatest(n - 2, F.lit(0))), lambda h, i: F.xxhash64(h, at(hashes, i + 1), at(hashes, i + 2))))
    df = df.withColumn(windows, pairs)
    # Bits that a place needs; the hash keeps the others.
    df = df.withColumn(low, F.length(F.bin(F.size(F.col(windows)).cast("long"))).cast("int"))
    packed = F.transform(F.col(windows), lambda h, i: F.call_function("shiftleft", h, F.col(low)).bitwiseOR(i.cast("long")))
    df = df.withColumn(order, F.sort_array(packed))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), F.col(low)) - 1
    place = lambda x: x.bitwiseAND(mask).cast("int")
    same = lambda x, y: F.coalesce((F.call_function("shiftright", x, F.col(low)) == F.call_function("shiftright", y, F.col(low))) & (at(windows, place(x)) == at(windows, place(y))), F.lit(False))
    repeated = F.transform(F.col(order), lambda x, j: F.when(same(x, F.when(j > 0, at(order, F.greatest(j - 1, F.lit(0))))) | same(x, at(order, j + 1)), place(x)).otherwise(F.lit(-1)))
    df = df.withColumn(places, F.sort_array(F.filter(repeated, lambda p: p >= 0)))
    covered = F.aggregate(F.transform(F.col(places), lambda p, j: F.least(F.lit(3), F.coalesce(at(places, j + 1) - p, F.lit(3))).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)

    return df.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length(F.col(text)) - F.length(F.translate(F.col(text), SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        _here(covered).alias("n_repeat_words"),
    )


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the measurements and ``failed_bits``: bit i is set if the document fails the i-th rule."""
    df = measure(docs, text_col)
    m = {c: F.col(c) for c in MEASURES}
    bits = reduce(lambda a, b: a.bitwiseOR(b), (F.when(rule(m), F.lit(BIT[name]).cast("long")).otherwise(F.lit(0).cast("long")) for name, rule in RULES.items()))
    return df.select(*[c for c in df.columns if c.lower() != "failed_bits"], _here(bits).alias("failed_bits"))


def passes(policy: Policy, bits: Column | None = None) -> Column:
    return (F.col("failed_bits") if bits is None else bits).bitwiseAND(F.lit(policy.mask).cast("long")) == 0


def ablation(book: DataFrame, policy: Policy) -> DataFrame:
    """Per rule of policy: documents that fail it, that fail it alone, and that are kept without it.

    The ledger is reduced to one row per distinct mask (at most 2 ** rules) before anything else.
    """
    masks = book.groupBy(F.col("failed_bits").bitwiseAND(F.lit(policy.mask).cast("long")).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in policy.rules)))
    per = masks.select("bits", "n", rules.alias("r"))
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0)).cast("long")
    return per.groupBy(F.lit(policy.version).alias("version"), F.col("r.rule").alias("rule")).agg(
        count(F.col("bits").bitwiseAND(F.col("r.bit")) != 0).alias("n_failed"),
        count(F.col("bits") == F.col("r.bit")).alias("n_failed_alone"),
        count(F.col("bits").bitwiseAND(F.expr("~r.bit")) == 0).alias("n_kept_without"),
    )
