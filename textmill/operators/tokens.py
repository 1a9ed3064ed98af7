"""Tokens: encoding and decoding with a given vocabulary file, conversations as ids and masks, tokenizer metrics.

Vocabularies are files of the tokenizers library, opened once a worker; a vocabulary is never trained here.  Control
tokens (the marks of turns) are ids that the caller names, as public vocabularies have none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IDS = pa.list_(pa.int32())


@lru_cache(maxsize=4)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@dataclass(frozen=True)
class Marks:
    """Ids of the control tokens of a rendered conversation."""

    begin: int
    user: int
    user_end: int
    assistant: int
    assistant_end: int


def special_id(path: str, *names: str) -> int:
    """The id of the first of the names that the vocabulary has."""
    for name in names:
        if (found := tokenizer(path).token_to_id(name)) is not None:
            return found
    raise KeyError(names[0])


def _ids(path: str, texts: list[str]) -> list[list[int]]:
    return [e.ids for e in tokenizer(path).encode_batch(texts, add_special_tokens=False)]


def encoded(df: DataFrame, path: str, *, key: str, text: str = "text", prepend: list[int] = (), append: list[int] = ()) -> DataFrame:
    """(key, ids) of texts; null texts have no ids of their own."""
    schema = pa.schema([("key", pa.int64()), ("ids", IDS)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [[*prepend, *x, *append] for x in _ids(path, [t or "" for t in batch.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, IDS)], schema=schema)

    return df.select(F.col(key).cast("long").alias("key"), F.col(text).cast("string")).mapInArrow(scan, "key long, ids array<int>")


def decoded(df: DataFrame, path: str, *, key: str = "key", ids: str = "ids") -> DataFrame:
    """(key, text) of ids; control tokens are left out."""
    schema = pa.schema([("key", pa.int64()), ("text", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = tokenizer(path).decode_batch([x or [] for x in batch.column(1).to_pylist()], skip_special_tokens=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], schema=schema)

    return df.select(F.col(key).cast("long").alias("key"), F.col(ids).cast("array<int>")).mapInArrow(scan, "key long, text string")


def byte_lengths(spark: SparkSession, path: str, *, count_special: bool = False) -> DataFrame:
    """(token, n_bytes): the bytes of each token's text; special ones have none, unless they count."""
    t = tokenizer(path)
    special = {} if count_special else {i for i, a in t.get_added_tokens_decoder().items() if a.special}
    rows = [(i, 0 if i in special else len(t.decode([i], skip_special_tokens=False).encode())) for i in range(t.get_vocab_size())]
    return spark.createDataFrame(pa.table({"token": pa.array([r[0] for r in rows], pa.int64()), "n_bytes": pa.array([r[1] for r in rows], pa.int64())}))


MESSAGES = "array<struct<role: string, parts: array<struct<type: string, text: string>>>>"


def turns_of(messages: list[dict]) -> list[tuple[str, list[tuple[str, str]]]]:
    """(role, parts) with a leading system text in front of the first user text; roles must take turns, user first."""
    turns = [(m["role"], [(p["type"], p["text"] or "") for p in m["parts"] or []]) for m in messages or []]
    if turns and turns[0][0] == "system":
        if len(turns) < 2 or turns[1][0] != "user":
            raise ValueError("a system message must be followed by a user message")
        lead = "".join(t for _, t in turns[0][1])
        turns = [("user", [("text", lead + "\n\n" + "".join(t for _, t in turns[1][1]))]), *turns[2:]]
    if not turns or any(role != ("user", "assistant")[i % 2] for i, (role, _) in enumerate(turns)):
        raise ValueError("user and assistant must take turns")
    return turns


def part_text(kind: str, text: str) -> str:
    """A tool call and its output are written as <<call=output>>, which the two parts form together."""
    if kind not in ("text", "python", "python_output"):
        raise ValueError(f"unknown part {kind!r}")
    return {"text": text, "python": f"<<{text}=", "python_output": f"{text}>>"}[kind]


def render(messages: list[dict], path: str, marks: Marks, most: int) -> tuple[list[int], list[int]]:
    """(ids, mask) of one conversation: the mask is 1 over what the assistant says, with its end mark."""
    ids, mask = [marks.begin], [0]
    for role, parts in turns_of(messages):
        start, end, on = (marks.user, marks.user_end, 0) if role == "user" else (marks.assistant, marks.assistant_end, 1)
        said = [i for part in _ids(path, [part_text(k, t) for k, t in parts]) for i in part] if parts else []
        ids += [start, *said, end]
        mask += [0, *([on] * len(said)), on]
    return ids[:most], mask[:most]


def rendered(talks: DataFrame, path: str, marks: Marks, *, key: str = "conv_id", messages: str = "messages", most: int = 2048, completion: bool = False) -> DataFrame:
    """(key, ids, mask) of conversations (messages as MESSAGES), cut to the first most ids.

    For a completion the last message, which must be the assistant's, goes, and the assistant's start mark follows.
    """
    schema = pa.schema([("key", pa.int64()), ("ids", IDS), ("mask", IDS)])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, masks = [], []
            for talk in batch.column(1).to_pylist():
                if completion:
                    if not talk or talk[-1]["role"] != "assistant":
                        raise ValueError("the last message must be the assistant's")
                    talk = talk[:-1]
                i, m = render(talk, path, marks, most)
                ids.append([*i, marks.assistant] if completion else i)
                masks.append([*m, 0] if completion else m)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, IDS), pa.array(masks, IDS)], schema=schema)

    return talks.select(F.col(key).cast("long").alias("key"), F.col(messages).cast(MESSAGES)).mapInArrow(scan, "key long, ids array<int>, mask array<int>")


def visible(ids: list[int], mask: list[int], path: str, *, with_ids: bool = False) -> str:
    """Tokens in green where the mask is 1 and in red elsewhere, for reading on a terminal."""
    green, red, gray, plain = "\033[92m", "\033[91m", "\033[90m", "\033[0m"
    t, out = tokenizer(path), []
    for i, m in zip(ids, mask, strict=True):
        out.append(f"{green if m else red}{t.decode([i], skip_special_tokens=False)}{plain}")
        if with_ids:
            out.append(f"{gray}({i}){plain}")
    return "|".join(out)


def metrics(df: DataFrame, path: str, *, text: str = "text", opening: int = 10_000) -> DataFrame:
    """One row: bytes a token in all, in the first characters of the texts and beyond; their difference; tokens a word;
    the percentage of tokens of a single byte.  Nothing to divide by gives NaN."""
    schema = pa.schema([("part", pa.string()), ("n_bytes", pa.int64()), ("tokens", pa.int64()), ("words", pa.int64()), ("single", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizer(path)
        single = {i for i in range(t.get_vocab_size()) if len(t.id_to_token(i) or "") == 1}
        for batch in batches:
            texts = [x or "" for x in batch.column(0).to_pylist()]
            for name, parts in (("opening", [x[:opening] for x in texts]), ("body", [x[opening:] for x in texts])):
                parts = [x for x in parts if x]
                ids = _ids(path, parts)
                row = [name, sum(len(x.encode()) for x in parts), sum(map(len, ids)), sum(len(x.split()) for x in parts), sum(i in single for x in ids for i in x)]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

    rows = df.select(F.col(text).cast("string")).mapInArrow(scan, "part string, n_bytes long, tokens long, words long, single long")
    of = lambda c, part=None: F.sum(c if part is None else F.when(F.col("part") == part, F.col(c)))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(float("nan")))
    first, rest = ratio(of("n_bytes", "opening"), of("tokens", "opening")), ratio(of("n_bytes", "body"), of("tokens", "body"))
    return rows.agg(
        F.round(ratio(of("n_bytes"), of("tokens")), 4).alias("bytes_per_token"),
        F.round(first, 4).alias("opening_bytes_per_token"),
        F.round(rest, 4).alias("body_bytes_per_token"),
        F.round(first - rest, 4).alias("body_gap"),
        F.round(ratio(of("tokens"), of("words")), 4).alias("fertility"),
        F.round(ratio(100 * of("single"), of("tokens")), 3).alias("byte_fallback_percent"),
    )


def compared(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(key, n_bytes, tokens and ratio of both, relative_diff, winner) of tables (key, n_bytes, tokens): how many per
    cent fewer tokens ours take."""
    b = theirs.select("key", F.col("tokens").alias("their_tokens"))
    rows = ours.join(b, "key").select("key", "n_bytes", F.col("tokens").alias("our_tokens"), "their_tokens")
    winner = F.when(F.col("our_tokens") < F.col("their_tokens"), "ours").when(F.col("our_tokens") > F.col("their_tokens"), "theirs").otherwise("tie")
    return rows.withColumns(
        {
            "our_ratio": F.col("n_bytes") / F.col("our_tokens"),
            "their_ratio": F.col("n_bytes") / F.col("their_tokens"),
            "relative_diff": 100 * (F.col("their_tokens") - F.col("our_tokens")) / F.col("their_tokens"),
            "winner": winner,
        }
    )
