"""A calculator for tool calls: sums and products of numbers, and counts of a string in a string."""

from __future__ import annotations

import operator
import re

_NUMBER = re.compile(r"\s*(\d+\.?\d*|\.\d+)")
_COUNT = re.compile(r"""\s*(["'])((?:(?!\1)[^\\])*)\1\s*\.\s*count\(\s*(["'])((?:(?!\3)[^\\])*)\3\s*\)\s*""")
_ARITHMETIC = re.compile(r"[0-9*+\-/.() ]+")


def calculate(expression: str | None) -> int | float | None:
    """The value of an expression of numbers, + - * / and parentheses, or of "text".count("x"); null for anything else.

    Commas are ignored; powers are refused; so is what has no value.
    """
    if expression is None:
        return None
    expression = expression.replace(",", "")
    if found := _COUNT.fullmatch(expression):
        return found[2].count(found[4])
    if not _ARITHMETIC.fullmatch(expression) or "**" in expression or len(expression) > 1000:
        return None
    try:
        value, rest = _sum(expression, 0)
    except (ValueError, ZeroDivisionError, OverflowError, RecursionError):
        return None
    return value if not rest.strip() else None


def _sum(text: str, depth: int) -> tuple[int | float, str]:
    value, rest = _product(text, depth)
    while (bare := rest.lstrip())[:1] in ("+", "-"):
        other, rest = _product(bare[1:], depth)
        value = (operator.add if bare[0] == "+" else operator.sub)(value, other)
    return value, rest


def _product(text: str, depth: int) -> tuple[int | float, str]:
    value, rest = _factor(text, depth)
    while (bare := rest.lstrip())[:1] in ("*", "/"):
        floor = bare.startswith("//")
        other, rest = _factor(bare[2 if floor else 1 :], depth)
        value = value * other if bare[0] == "*" else value // other if floor else value / other
    return value, rest


def _factor(text: str, depth: int) -> tuple[int | float, str]:
    if depth > 50:
        raise ValueError("too deep")
    bare = text.lstrip()
    if bare[:1] in ("+", "-"):
        value, rest = _factor(bare[1:], depth + 1)
        return (value if bare[0] == "+" else -value), rest
    if bare[:1] == "(":
        value, rest = _sum(bare[1:], depth + 1)
        if rest.lstrip()[:1] != ")":
            raise ValueError("unclosed")
        return value, rest.lstrip()[1:]
    if not (found := _NUMBER.match(bare)):
        raise ValueError("no number")
    return (float(found[1]) if "." in found[1] else int(found[1])), bare[found.end() :]
