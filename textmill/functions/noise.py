"""Slips of the hand in user turns: expressions that damage a text a little, with every choice from a hash.

Each slip takes a text and a key (a column of text: seed, conversation and turn); the same key gives the same slip.
Where a slip finds nothing to act on, the text stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions.ordering import hash_pick, hash_uniform

#: Marks that a slip drops at the end, and characters that may close a sentence behind them.
END_MARKS = ".?!,;:…"
CLOSERS = "\"'’”)]"
#: Marks put behind a text, and apostrophes.
ADDED_MARKS = ("?", "!", "??", "!!", "?!")
APOSTROPHES = "'’"
#: The keys beside each letter.
NEIGHBOURS = {
    "a": "qwsz", "b": "vghn", "c": "xdfv", "d": "serfcx", "e": "wsdr", "f": "drtgvc", "g": "ftyhbv", "h": "gyujnb", "i": "ujko",
    "j": "huikmn", "k": "jiolm", "l": "kop", "m": "njk", "n": "bhjm", "o": "iklp", "p": "ol", "q": "wa", "r": "edft",
    "s": "awedxz", "t": "rfgy", "u": "yhji", "v": "cfgb", "w": "qase", "x": "zsdc", "y": "tghu", "z": "asx",
}


def _digest(key: Column, scope: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(scope), key))


def _pick(key: Column, scope: str, n: Column | int) -> Column:
    return hash_pick(_digest(key, scope), n).cast("int")


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def _right_bare(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+$", "")


def _or_text(value: Column, text: Column) -> Column:
    return F.when(value == "", text).otherwise(value)


def _let(value: Column, body) -> Column:
    """body of a value that is computed once, whatever the number of its uses (also inside lambdas)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _one_word(text: Column, key: Column, scope: str, least: int, change) -> Column:
    """text with one of its words of at least so many letters (and letters only) changed."""

    def of(words: Column) -> Column:
        fit = F.filter(F.transform(words, lambda w, i: F.when((F.length(w) >= least) & F.regexp_like(w, F.lit(r"^\p{L}+$")), i)), lambda i: i.isNotNull())
        at = _let(fit, lambda f: F.get(f, _pick(key, f"{scope}-word", F.greatest(F.size(f), F.lit(1)))))
        put = lambda i: F.concat(F.slice(words, F.lit(1), i), F.array(change(F.get(words, i))), F.slice(words, i + 2, F.greatest(F.size(words) - i - 1, F.lit(0))))
        return _let(at, lambda i: F.when(i.isNotNull(), F.array_join(put(i), " ")))

    return F.coalesce(_let(_words(text), of), text)


def drop_end(text: Column, key: Column) -> Column:
    bare = _right_bare(text)
    core = F.rtrim(bare, F.lit(CLOSERS))
    return _or_text(F.concat(_right_bare(F.rtrim(core, F.lit(END_MARKS))), F.substr(bare, F.length(core) + 1)), text)


def add_marks(text: Column, key: Column) -> Column:
    bare = _right_bare(text)
    more = F.repeat(F.substring(bare, -1, 1), _pick(key, "add_marks", 3) + 1)
    return F.concat(bare, F.when(F.substring(bare, -1, 1).isin("?", "!"), more).otherwise(F.get(F.array(*map(F.lit, ADDED_MARKS)), _pick(key, "add_marks", len(ADDED_MARKS)))))


def strip_marks(text: Column, key: Column) -> Column:
    return _or_text(F.trim(F.regexp_replace(text, r"(?U)[^\p{L}\p{N}\s]", "")), text)


def lower(text: Column, key: Column) -> Column:
    return F.lower(text)


def upper(text: Column, key: Column) -> Column:
    return F.upper(text)


def caps_slip(text: Column, key: Column) -> Column:
    n = _pick(key, "caps_slip", 2) + 2
    return _one_word(text, key, "caps_slip", 2, lambda w: F.concat(F.upper(F.substr(w, F.lit(1), n)), F.substr(w, n + 1)))


def leading_lower(text: Column, key: Column) -> Column:
    return F.concat(F.lower(F.substring(text, 1, 1)), F.substr(text, F.lit(2)))


def _gap(text: Column, key: Column, scope: str, join: str) -> Column:
    """text with other characters than a space between two neighbouring words."""

    def of(words: Column) -> Column:
        at = _pick(key, scope, F.greatest(F.size(words) - 1, F.lit(1)))
        part = lambda i: F.array(F.array_join(F.slice(words, F.lit(1), i + 1), " "), F.array_join(F.slice(words, i + 2, F.greatest(F.size(words) - i - 1, F.lit(0))), " "))
        return _let(at, lambda i: F.when(F.size(words) >= 2, F.array_join(part(i), join)))

    return F.coalesce(_let(_words(text), of), text)


def missing_space(text: Column, key: Column) -> Column:
    return _gap(text, key, "missing_space", "")


def extra_space(text: Column, key: Column) -> Column:
    return _gap(text, key, "extra_space", "   ")


def transpose(text: Column, key: Column) -> Column:
    def change(w: Column) -> Column:
        j = _pick(key, "transpose", F.length(w) - 1)
        return F.concat(F.substr(w, F.lit(1), j), F.substr(w, j + 2, F.lit(1)), F.substr(w, j + 1, F.lit(1)), F.substr(w, j + 3))

    return _one_word(text, key, "transpose", 4, change)


def drop_letter(text: Column, key: Column) -> Column:
    def change(w: Column) -> Column:
        j = _pick(key, "drop_letter", F.length(w) - 1) + 1
        return F.concat(F.substr(w, F.lit(1), j), F.substr(w, j + 2))

    return _one_word(text, key, "drop_letter", 4, change)


def double_letter(text: Column, key: Column) -> Column:
    def change(w: Column) -> Column:
        j = _pick(key, "double_letter", F.length(w))
        return F.concat(F.substr(w, F.lit(1), j + 1), F.substr(w, j + 1))

    return _one_word(text, key, "double_letter", 3, change)


def neighbour_key(text: Column, key: Column) -> Column:
    beside = F.create_map(*(F.lit(x) for pair in NEIGHBOURS.items() for x in pair))

    def put(w: Column, at: Column) -> Column:
        old = F.substr(w, at + 1, F.lit(1))
        near = F.try_element_at(beside, F.lower(old))
        new = F.substr(near, _pick(key, "neighbour_key-letter", F.greatest(F.length(near), F.lit(1))) + 1, F.lit(1))
        return F.concat(F.substr(w, F.lit(1), at), F.when(old == F.lower(old), new).otherwise(F.upper(new)), F.substr(w, at + 2))

    def change(w: Column) -> Column:
        spots = F.filter(F.transform(F.split(w, ""), lambda c, i: F.when(F.lower(c).isin(*NEIGHBOURS), i)), lambda i: i.isNotNull())
        at = _let(spots, lambda s: F.get(s, _pick(key, "neighbour_key", F.greatest(F.size(s), F.lit(1)))))
        return _let(at, lambda i: F.when(i.isNotNull(), put(w, i)).otherwise(w))

    return _one_word(text, key, "neighbour_key", 3, change)


def drop_word(text: Column, key: Column) -> Column:
    def of(words: Column) -> Column:
        at = _pick(key, "drop_word", F.greatest(F.size(words), F.lit(1)))
        return _let(at, lambda x: F.when(F.size(words) >= 4, F.array_join(F.filter(words, lambda w, i: i != x), " ")))

    return F.coalesce(_let(_words(text), of), text)


def repeat_word(text: Column, key: Column) -> Column:
    def of(words: Column) -> Column:
        at = _pick(key, "repeat_word", F.greatest(F.size(words), F.lit(1)))
        twice = lambda x: F.transform(words, lambda w, i: F.when(i == x, F.concat_ws(" ", w, w)).otherwise(w))
        return _let(at, lambda x: F.when(F.size(words) >= 2, F.array_join(twice(x), " ")))

    return F.coalesce(_let(_words(text), of), text)


def drop_apostrophes(text: Column, key: Column) -> Column:
    return F.translate(text, APOSTROPHES, "")


FAMILIES = {
    "punctuation": (drop_end, add_marks, strip_marks),
    "case": (lower, upper, caps_slip, leading_lower),
    "spacing": (missing_space, extra_space),
    "character": (transpose, drop_letter, double_letter, neighbour_key),
    "word": (drop_word, repeat_word, drop_apostrophes),
}


def noised(turns: DataFrame, rate: float, *, end_rate: float = 0.0, seed: int = 0, text: str = "text", role: str = "role", keys: tuple[str, ...] = ("conv_id", "turn")) -> DataFrame:
    """turns with slips in user texts, in the share rate of them: one slip in 60 % of these, two in 30 % and three in 10 %,
    of different families.  In the share end_rate, drawn on its own, end marks go.  A text of which nothing is left stays
    as it was; other roles are left alone.
    """
    key = F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys))
    at = lambda scope: hash_uniform(_digest(key, scope))
    n = F.when(at("rate") >= rate, 0).when(at("count") < 0.6, 1).when(at("count") < 0.9, 2).otherwise(3)
    order = F.transform(F.array_sort(F.array(*(F.struct(_digest(key, f"family-{f}"), F.lit(f).alias("family")) for f in FAMILIES))), lambda x: x["family"])
    out = turns.withColumns({"_n": F.when(F.col(role) == "user", n).otherwise(-1), "_order": order, "_now": F.col(text)})
    for i in range(3):
        value = None
        for family, slips in FAMILIES.items():
            for j, slip in enumerate(slips):
                here = (F.col("_n") > i) & (F.get("_order", F.lit(i)) == family) & (_pick(key, f"slip-{family}", len(slips)) == j)
                changed = slip(F.col("_now"), key)
                value = F.when(here, changed) if value is None else value.when(here, changed)
        out = out.withColumn("_now", value.otherwise(F.col("_now")))
    ended = F.when((F.col("_n") >= 0) & (at("end") < end_rate), drop_end(F.col("_now"), key)).otherwise(F.col("_now"))
    bare = F.regexp_replace(ended, r"(?U)^\s+|\s+$", "")
    return out.withColumn(text, F.when((F.col("_n") >= 0) & (bare != ""), bare).otherwise(F.col(text))).drop("_n", "_order", "_now")
