"""SentencePiece unigram encoding and decoding over a double-array trie.

The pieces' UTF-8 is stored in a double array: the child of a node by byte b is at base[node] + b, if check there is
the node.  Viterbi walks the trie from every character of a chunk and keeps, for each end, the best score, where its
last piece starts and its id.  Characters without a piece fall back to byte pieces; decoding joins pieces, turns byte
pieces into text again and U+2581 into spaces.  See ``unigram`` for the tokenizer's rules.

Encoding and decoding give the text back, except that U+2581 itself becomes a space (as in the library).

Defined cases: null and empty texts have no ids and decode to the empty text; a null id stays null; repeated rows are
encoded each; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.shared import as_texts, batch_of, bounded_batches
from textmill.llm.unigram import SPACE, Chunks, Pieces, chunks_of


class DoubleArray:
    """A byte trie of keys: base, check, and the value of each node that ends a key (-1 else)."""

    def __init__(self, keys: dict[bytes, int]):
        tree: dict = {}
        for key, value in keys.items():
            node = tree
            for b in key:
                node = node.setdefault(b, {})
            node[-1] = value
        size = 1024
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0] = 0
        free = 1  # no slot before it is free
        queue = [(0, tree)]
        while queue:
            at, node = queue.pop()
            value[at] = node.get(-1, -1)
            letters = sorted(b for b in node if b >= 0)
            if not letters:
                continue
            while check[free] >= 0:
                free += 1
                if free + 512 > len(check):
                    base += [0] * len(base)
                    check += [-1] * len(check)
                    value += [-1] * len(value)
            start, tries = max(free - letters[0], 1), 0
            while any(check[start + b] >= 0 for b in letters):
                start, tries = start + 1, tries + 1
                if start + 512 > len(check):
                    base += [0] * len(base)
                    check += [-1] * len(check)
                    value += [-1] * len(value)
            if tries > 64:  # crowded: give up the gaps before here
                free = max(free, start - 256)
            base[at] = start
            for b in letters:
                check[start + b] = at
                queue.append((start + b, node[b]))
        self.base, self.check, self.value = base, check, value

    def prefixes(self, text: bytes, at: int) -> Iterator[tuple[int, int]]:
        """(end, value) of the keys that start at a place, shortest first."""
        base, check, value, node = self.base, self.check, self.value, 0
        for end in range(at, len(text)):
            after = base[node] + text[end]
            if check[after] != node or after == 0:
                return
            node = after
            if value[node] >= 0:
                yield end + 1, value[node]


class Codec:
    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.trie = DoubleArray({t.encode(): i for t, i in pieces.ids.items()})
        self.score = [0.0] * len(pieces.texts)
        for t, i in pieces.ids.items():
            self.score[i] = pieces.scores[t]
        self.bytes_of = {i: b for b, i in enumerate(pieces.byte_ids)}
        self.chunks = Chunks(lambda chunk: np.array(self.solve(chunk), "<i4").tobytes())
        self.plain = [None if i in self.bytes_of else t.replace(SPACE, " ").encode() for i, t in enumerate(pieces.texts)]
        for i, b in self.bytes_of.items():
            self.plain[i] = bytes([b])

    def solve(self, chunk: str) -> list[int]:
        """Ids of the best path."""
        text = chunk.encode()
        n = len(text)
        best: list = [None] * (n + 1)
        best[0] = 0.0
        start, piece = [0] * (n + 1), [0] * (n + 1)
        base, check, value, score, unknown = self.trie.base, self.trie.check, self.trie.value, self.score, self.pieces.unknown
        at = 0
        while at < n:
            lead = text[at]
            one = at + (1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4)
            here, single, node, end = best[at], False, 0, at
            while end < n:
                after = base[node] + text[end]
                if check[after] != node:
                    break
                node, end = after, end + 1
                i = value[node]
                if i >= 0:
                    total = here + score[i]
                    if best[end] is None or total > best[end]:
                        best[end], start[end], piece[end] = total, at, i
                    single |= end == one
            if not single:
                total = here + unknown
                if best[one] is None or total > best[one]:
                    best[one], start[one], piece[one] = total, at, -1
            at = one
        ids: list[int] = []
        at = n
        while at:
            before = start[at]
            if piece[at] < 0:
                ids += [self.pieces.byte_ids[b] for b in reversed(text[before:at])]
            else:
                ids.append(piece[at])
            at = before
        return ids[::-1]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        return b"".join(map(self.chunks.__getitem__, chunks_of(text, self.pieces.chunked)))

    def decode(self, ids: bytes) -> str:
        text = b"".join(map(self.plain.__getitem__, np.frombuffer(ids, "<i4").tolist())).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


_made: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec a worker process and vocabulary."""
    if path not in _made:
        _made[path] = Codec(Pieces.load(path))
    return _made[path]


def encode(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, ids_crc32 (of the ids as little-endian 32-bit), decoded_sha256 (of what the
    ids decode to), round_trip (whether that is the text), and ids."""
    kinds = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("decoded_sha256", pa.string()), ("round_trip", pa.bool_())]
    schema = pa.schema(kinds + [("ids", pa.list_(pa.int32()))] * with_ids)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), as_texts(batch.column(1)), strict=True):
                ids = own.encode(text)
                back = own.decode(ids)
                rows.append((doc, len(ids) // 4, zlib.crc32(ids), sha256(back.encode()).hexdigest(), back == text, *[np.frombuffer(ids, "<i4")] * with_ids))
            if rows:
                yield batch_of(schema, [list(c) for c in zip(*rows, strict=True)])

    rows = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scan, "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean" + ", ids array<int>" * with_ids)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, text) of rows with doc_id and ids."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in batches:
            texts = [own.decode(np.asarray(x or [], "<i4").tobytes()) for x in batch.column(1).to_pylist()]
            yield batch_of(schema, [batch.column(0), texts])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(scan, "doc_id long, text string")
