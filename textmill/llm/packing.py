"""Sequence packing by power-of-two decomposition.

A document of n tokens is cut into full sequences and then the binary digits of what is left, largest first.  Every
piece is a sequence by itself: its length is a power of two, so nothing is padded, no sequence crosses documents, and
sequences of equal length form a bucket from which batches are drawn.  Cutting needs no other document, so the plan
is one scan without an exchange, whatever the size or the skew of the input.

Defined cases: a null or empty text is the end token alone; a null id stays null; repeated rows give their pieces
once a row; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.byte_bpe import byte_bpe
from textmill.llm.shared import as_texts, batch_of, bounded_batches

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int"


def decompose(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; longest must be a power of two.

    >>> decompose(11, 4)
    [(0, 4), (4, 4), (8, 2), (10, 1)]
    """
    out = [(at, longest) for at in range(0, n - longest + 1, longest)]
    at, bit = len(out) * longest, longest >> 1
    while bit:
        if n & bit:
            out.append((at, bit))
            at += bit
        bit >>= 1
    return out


def pack(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", sequence: int = 2048, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, bucket (log2 of length), sequence_id, offset.

    with_ids adds ``ids``, the piece's tokens as array<int>.  sequence_id holds the number of the input partition and
    the piece's place in it: unique, and the same when a lost task runs again, as a partition's rows keep their order.
    """
    if sequence < 1 or sequence & (sequence - 1):
        raise ValueError("sequence must be a power of two")
    kinds = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("bucket", pa.int32())]
    schema = pa.schema(kinds + [("ids", pa.list_(pa.int32()))] * with_ids)
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        encoder = byte_bpe(vocabulary)
        for batch in batches:
            rows: list[list] = [[] for _ in schema]
            for doc, text in zip(batch.column(0).to_pylist(), as_texts(batch.column(1)), strict=True):
                ids = encoder.ids(text) + end
                n = len(ids) // 4
                for start, length in decompose(n, sequence):
                    piece = ids[4 * start : 4 * (start + length)]
                    row = (doc, start, length, zlib.crc32(piece), n, length.bit_length() - 1, *[np.frombuffer(piece, "<i4")] * with_ids)
                    for column, value in zip(rows, row, strict=True):
                        column.append(value)
            yield batch_of(schema, rows)

    source = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = source.mapInArrow(cut, PIECES + ", ids array<int>" * with_ids)
    return pieces.select("*", F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Writes pieces (packed with ids) with a folder for each length, as a loader draws batches of one length."""
    pieces.write.partitionBy("bucket").parquet(path)
