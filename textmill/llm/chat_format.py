"""Chat formatting in budgeted windows.

A conversation is cut at turns into windows of at most a budget of tokens.  Running sums of the turns' tokens decide
where: a window takes turns while they fit.  A later window starts with the conversation's system turn and as many of
the last turns as a history budget allows; those are repeated for context only.  The loss mask covers the texts of
assistant turns, each in the one window where it is new.

A turn is ``<s>role\\ntext</s>\\n``.  Control strings inside roles and texts are escaped reversibly: every backslash is
doubled and a backslash goes behind the first character of each control string, so none is left in the output.

Rows are dealt by conversation and sorted; a task streams them and holds one window, so a conversation may have any
number of turns.

Defined cases: null roles and texts are empty; a null turn sorts first; rows without conv_id are one conversation;
rows that share a turn follow in order of role and text; a turn that alone exceeds the budget gets a window of its
own, which is longer; a later window whose first new turn does not fit beside the system turn starts without it
(``has_system`` tells), so a system turn of any length makes no other window exceed the budget; other columns are
ignored; an empty table gives no windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.byte_bpe import byte_bpe
from textmill.llm.shared import as_texts, batch_of, bounded_batches

#: Control strings of common chat templates; the first two mark turns here.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
OPEN, CLOSE = CONTROL[:2]
_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """
    >>> escape("a\\\\b <s>")
    'a\\\\\\\\b <\\\\s>'
    """
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn, and where its text starts and ends in it."""
    head = OPEN + escape(role).replace("\n", "\\n") + "\n"
    body = escape(text)
    return head + body + CLOSE + "\n", len(head), len(head) + len(body)


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted window."""
    out = []
    for turn in formatted.split(CLOSE + "\n")[:-1]:
        role, _, text = turn.removeprefix(OPEN).partition("\n")
        out.append((_ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], role), unescape(text)))
    return out


WINDOW = "conv_id long, window long, text string, loss array<struct<start: long, end: long>>, n_context int, n_turns int, n_tokens long, has_system boolean"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_WINDOW = pa.schema([("conv_id", pa.int64()), ("window", pa.int64()), ("text", pa.string()), ("loss", _SPANS), ("n_context", pa.int32()), ("n_turns", pa.int32()), ("n_tokens", pa.int64()), ("has_system", pa.bool_())])


class _Conversation:
    """The windows of one conversation, turn by turn."""

    def __init__(self, conv: int | None, budget: int, history: int):
        self.conv, self.budget, self.history = conv, budget, history
        self.system: tuple | None = None
        self.past: list[tuple] = []  # turns that the next window may repeat
        self.new: list[tuple] = []
        self.context: list[tuple] = []
        self.used = 0
        self.windows = 0

    def add(self, role: str, text: str, tokens_of) -> Iterator[tuple]:
        turn, start, end = render(role, text)
        item = (turn, start, end, role, tokens_of(turn))
        if self.new and self.used + item[4] > self.budget:
            yield self.window()
            self.begin(item[4])
        self.new.append(item)
        self.used += item[4]
        if role == "system" and self.system is None and self.windows == 0 and len(self.new) == 1:
            self.system = item

    def begin(self, needed: int) -> None:
        first = [self.system] if self.system and self.system[4] + needed <= self.budget else []
        room = min(self.history, self.budget - needed - sum(x[4] for x in first))
        kept: list[tuple] = []
        for item in reversed(self.past):
            if item is self.system or item[4] > room:
                break
            kept.insert(0, item)
            room -= item[4]
        self.context = first + kept
        self.used = sum(x[4] for x in self.context)

    def window(self) -> tuple:
        at, spans, parts = 0, [], []
        for i, (turn, start, end, role, _) in enumerate(self.context + self.new):
            if i >= len(self.context) and role == "assistant" and end > start:
                spans.append({"start": at + start, "end": at + end})
            parts.append(turn)
            at += len(turn)
        with_system = any(x is self.system for x in self.context + self.new)
        out = (self.conv, self.windows, "".join(parts), spans, len(self.context), len(self.new), self.used, with_system)
        self.past = [x for x in self.context if x is not self.system] + self.new
        self.new, self.windows = [], self.windows + 1
        return out


def format_windows(turns: DataFrame, vocabulary: str, *, budget: int = 1024, history: int = 256) -> DataFrame:
    """Windows of conversations (conv_id, turn, role, text): formatted text, loss spans (code points), n_context
    repeated turns at its start, n_turns new ones, n_tokens, has_system.

    A conversation's windows are consecutive rows of one partition, in order.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, now = byte_bpe(vocabulary), None
        tokens_of = lambda turn: len(encoder.ids(turn)) // 4
        for batch in batches:
            out = []
            for conv, role, text in zip(batch.column(0).to_pylist(), as_texts(batch.column(1)), as_texts(batch.column(2)), strict=True):
                if now is None or now.conv != conv:
                    if now is not None and now.new:
                        out.append(now.window())
                    now = _Conversation(conv, budget, history)
                out += now.add(role, text, tokens_of)
            if out:
                yield batch_of(_WINDOW, [list(c) for c in zip(*out, strict=True)])
        if now is not None and now.new:
            yield batch_of(_WINDOW, [[x] for x in now.window()])

    rows = bounded_batches(turns).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(stream, WINDOW)


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
_READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])


def read_back(windows: DataFrame, *, in_order: bool = False) -> DataFrame:
    """Digests of every conversation, parsed from its windows.

    Windows are dealt by conversation and sorted, unless in_order says that they come straight from format_windows,
    where they already are.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None

        def closed() -> tuple:
            n, turns, chars, loss, formatted, count = state
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), formatted, count

        for batch in batches:
            out = []
            for at, window, text, spans, context in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if state is None or window == 0:
                    if state is not None:
                        out.append(closed())
                    conv, state = at, [0, sha256(), 0, sha256(), 0, 0]
                for role, body in parse_turns(text)[context:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode())
                for span in spans:
                    said = unescape(text[span["start"] : span["end"]])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
                state[5] += 1
            if out:
                yield batch_of(_READ, [list(c) for c in zip(*out, strict=True)])
        if state is not None:
            yield batch_of(_READ, [[x] for x in closed()])

    rows = windows.select("conv_id", "window", "text", "loss", "n_context")
    if not in_order:
        rows = bounded_batches(rows).repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return rows.mapInArrow(stream, READ)
