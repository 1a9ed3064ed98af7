"""Deterministic order, choice and rounding.

A shuffle is an order by md5 of "seed:scope:key": it needs no state, is the same however the input is partitioned, and
any engine can reproduce it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_order(seed: int | str | Column, scope: str | Column, *keys: Column | str) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(str(x))
    return F.md5(F.concat_ws(":", as_col(seed).cast("string"), as_col(scope), *((k if isinstance(k, Column) else F.col(k)).cast("string") for k in keys)))


def hash_uniform(digest: Column) -> Column:
    """A number in [0, 1) from the first 8 hex digits of a digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(2.0**32)


def hash_pick(digest: Column, n: Column | int) -> Column:
    """An integer in [0, n) from the first 8 hex digits of a digest."""
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(n) if isinstance(n, int) else n)


def half_even(x: Column) -> Column:
    return F.bround(x).cast("long")


def in_crc_split(key: Column | str, divisor: int) -> Column:
    """Whether crc32 of the key's UTF-8 is divisible by divisor: a split that no other row can change."""
    return F.crc32((F.col(key) if isinstance(key, str) else key).cast("string").cast("binary")) % divisor == 0


def split_divisor(expected: int, wanted: int) -> int:
    return max(1, round(expected / wanted)) if wanted else 1
