"""Language-model scores by Brown class-based bigrams.

Every word has a class; P(word | before) = P(class | class before) * P(word | class).  Counts come from all training
documents:

1. Word counts, summed in the tasks and then by word; the table is written, as its size follows the corpus.
2. Contexts: for each training word its neighbours with their counts, from one pass over the text.  Neighbours among
   the common words are known by place; pairs of two other words are kept apart, by word.
3. Classes of the most frequent words (more with a larger vocabulary, 2,048 at most) by exchange: each in turn moves to the class that
   raises the likelihood of the class bigrams most, until none moves.
4. Classes of all common words by sweeps over their contexts: each moves to its likeliest class under the class bigrams
   of the sweep before, until none moves or a sweep raises the likelihood by less than a set share of it.  A sweep that
   lowers it is taken back, and from then on an eighth of the moves is made at a time.  Words seen fewer than FLOOR times
   are not swept but classed once, by their contexts.
5. All other words get their likeliest class by their own contexts with common words.
6. Transitions are counted from all pairs and smoothed by adding a constant; a word's emission is (count + a) / (class
   tokens + a * (class words + 1)), so each class keeps one share for words never seen, and the model is a
   distribution.  A word never seen in training, or only beside such others, has no contexts: it takes the class most
   training words have that share its bucket of last two bytes.
7. Scores: pairs of common words are scored in the tasks; the other words of a chunk of texts are asked for once each, of
   the parts that have their counts and classes, and the pairs they are in are scored with the answers.

Tables between steps have rows of packed arrays, the words of each part joined, as millions of rows of a word each cost
more than the work on them.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; one end token closes each text.

Defined cases: a null or empty text is the end token alone; a null id counts as the empty string in the split (so it
is held out) and stays null; repeated rows count and score each; other columns are ignored; an empty table gives no
rows; without any training token the counts are zero.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.shared import batch_of, bounded_batches, discard, written

END = b""
CHUNK_BYTES = 4 << 20  # of texts whose words are taken at once
FLUSH_WORDS = 1_000_000  # as an Arrow column
FLUSH_NAMES = 250_000  # as Python bytes
FLUSH_PAIRS = 2_000_000
ROW_CONTEXTS = 1 << 17
SPREAD = 4096  # common words, the first, whose contexts are summed in many parts by neighbour before they meet
LONGEST_COMMON_WORD = 64
MOST_UNITS = 2048  # of the exchange on the driver, so at most that squared of contexts
FLOOR = 10  # words seen less often take part in no sweep: their classes would learn single texts
MOST_PARTS = 10_000

_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32
_IN_WORD = np.ones(256, bool)
_IN_WORD[[9, 10, 11, 12, 13, 32]] = False


def held_out(doc: int | None, folds: int = 10) -> bool:
    return zlib.crc32(b"" if doc is None else str(doc).encode()) % folds == 0


def tokens_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts in order, an end token after those of each; tokens of each text)."""
    texts = texts.cast(pa.large_binary())
    texts = texts.fill_null(b"") if texts.null_count else texts
    n = len(texts)
    if not n:
        return pa.array([], pa.large_binary()), np.zeros(0, np.int64)
    at = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    inside = _IN_WORD[raw]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    heads, lasts = at[:-1][at[:-1] < len(raw)], at[1:][at[1:] > 0] - 1  # words end with their text
    starts[heads], ends[lasts] = inside[heads], inside[lasts]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    words = np.diff(np.searchsorted(starts, at))
    offsets = np.zeros(len(starts) + n + 1, np.int64)
    offsets[1 + np.arange(len(starts)) + np.repeat(np.arange(n), words)] = ends - starts
    return _column(np.cumsum(offsets), _LOWERED[raw[inside]]), words + 1


def _column(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches joined to some CHUNK_BYTES; larger ones stay alone."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if held and size + batch.nbytes > 2 * CHUNK_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
        if len(batch):
            held.append(batch)
            size += batch.nbytes
        if size >= CHUNK_BYTES:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def _training(chunk: pa.RecordBatch, folds: int) -> pa.Array:
    return chunk.column(1).filter(pa.array([not held_out(d, folds) for d in chunk.column(0).to_pylist()], pa.bool_()))


def _distinct(words: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(distinct words, number of each word's)."""
    encoded = words.dictionary_encode()
    return encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False)


# Tasks exchange rows of packed arrays, not of words: one for all that a task has for a part.  A word's part is its
# CRC-32 modulo the number of parts; that of a common word's contexts comes from its place, of the most frequent words'
# from the neighbour too.
COUNTS, COMMON, SPLIT, RARE, PAIRS, STATE, ASKED, ANSWER = range(8)
_BYTES = ("words", "sizes", "n", "places", "counts", "contexts", "lengths", "values", "others", "other_sizes", "first", "second", "often", "extra")
_PACKED = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("chunk", pa.int64()), *((c, pa.binary()) for c in _BYTES)])
_KINDS = "part int, kind int, chunk long, " + ", ".join(f"{c} binary" for c in _BYTES)


def _rows(rows: list[dict]) -> pa.RecordBatch:
    return batch_of(_PACKED, [[x.tobytes() if isinstance(x := r.get(f.name), np.ndarray) else x for r in rows] for f in _PACKED])


def _unpacked(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    """Rows as name -> number or buffer, without what is null."""
    for batch in batches:
        columns = [(f.name, batch.column(i)) for i, f in enumerate(batch.schema)]
        for i in range(len(batch)):
            yield {name: c[i].as_buffer() if pa.types.is_binary(c.type) else c[i].as_py() for name, c in columns if c[i].is_valid}


def _numbers(row: dict, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(row[name], kind) if name in row and len(row[name]) else np.zeros(0, kind)


def _packed(words: pa.Array, name: str = "words", sizes: str = "sizes") -> dict:
    at = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    data = words.buffers()[2]
    return {name: data.slice(at[0], at[-1] - at[0]).to_pybytes() if at[-1] > at[0] else b"", sizes: np.diff(at).astype("<u4")}


def _words(row: dict, name: str = "words", sizes: str = "sizes") -> pa.Array:
    return _column(np.concatenate([[0], np.cumsum(_numbers(row, sizes, "<u4"), dtype=np.int64)]), _numbers(row, name, "u1"))


def _part_of(words: list[bytes], parts: int) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % parts


def _by_part(part: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """(order by part, (part, from, to) of those that occur)."""
    order = np.argsort(part, kind="stable")
    found, first = np.unique(part[order], return_index=True)
    return order, list(zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(part)][: len(found)], strict=True))


def _grouped(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[dict]]]]:
    """(part, its rows by kind) of a task."""
    held: dict[int, dict[int, list[dict]]] = defaultdict(lambda: defaultdict(list))
    for row in _unpacked(batches):
        held[row["part"]][row["kind"]].append(row)
    while held:
        yield held.popitem()


def _joined(rows: list[dict], name: str, kind: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(_numbers(r, name, kind) for r in rows)])


def _all_words(rows: list[dict], *names: str) -> pa.Array:
    return pa.concat_arrays([_words(r, *names) for r in rows] or [pa.array([], pa.large_binary())])


def _list(words: pa.Array) -> list[bytes]:
    return words.to_numpy(zero_copy_only=False).tolist()  # to_pylist takes several times as long


def _found(words: pa.Array, among: pa.Array) -> np.ndarray:
    """Place of each word among others, -1 if it is not there."""
    return pc.index_in(words, value_set=among).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def _parts(docs: DataFrame) -> int:
    """Parts of the vocabulary: shuffle partitions, more for tables that would fill a task."""
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTS, size >> 26 if size < 1 << 50 else 1))


@dataclass
class Model:
    """What the tasks need: the common words, and tables by class."""

    words: list[bytes]  # common words, most frequent first
    counts: np.ndarray
    n_suffixes: int
    classes: np.ndarray | None = None  # of each common word, then of each bucket of words never seen
    transitions: np.ndarray | None = None  # log10, class before x class
    shares: np.ndarray | None = None  # log10 of the emission's denominator, by class
    tokens: int = 0
    vocabulary: int = 0

    def __post_init__(self):
        self.places = {w: i for i, w in enumerate(self.words)}

    def suffix(self, word: bytes) -> int:
        return len(self.words) + zlib.crc32(word[-2:]) % self.n_suffixes

    def at(self, words: list[bytes]) -> np.ndarray:
        """Place of each word, or -1."""
        return np.fromiter(map(self.places.get, words, repeat(-1)), np.int64, len(words))

    def units(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(place or -1, place or bucket) of each word."""
        at = self.at(words)
        unit = at.copy()
        rare = np.flatnonzero(at < 0)
        if len(rare):
            unit[rare] = [self.suffix(words[i]) for i in rare.tolist()]
        return at, unit


def _tally(held: list[tuple[pa.Array, np.ndarray]]) -> tuple[pa.Array, np.ndarray]:
    """Distinct words and the sums of their counts."""
    words, codes = _distinct(pa.concat_arrays([w for w, _ in held]))
    out = np.zeros(len(words), np.int64)
    np.add.at(out, codes, np.concatenate([n for _, n in held]))
    return words, out


def _counted(docs: DataFrame, folds: int, parts: int) -> DataFrame:
    """Packed (words, n) by part; counts: words by power of two of their n, places: tokens and words."""

    def dealt(words: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        order, found = _by_part(_part_of(_list(words), parts))
        words, n = words.take(pa.array(order)), n[order]
        return _rows([{"part": p, "kind": COUNTS, "n": n[i:j], **_packed(words[i:j])} for p, i, j in found])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray]] = []
        for chunk in _chunks(batches):
            words, codes = _distinct(tokens_of(_training(chunk, folds))[0])
            held.append((words, np.bincount(codes, minlength=len(words))))
            if sum(len(w) for w, _ in held) > FLUSH_WORDS:
                held = [_tally(held)]
                if len(held[0][0]) > FLUSH_WORDS // 2:
                    yield dealt(*held[0])
                    held = []
        if held:
            yield dealt(*_tally(held))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _grouped(batches):
            words, n = _tally([(_words(r), _numbers(r, "n", "<i8")) for r in rows[COUNTS]])
            short = pc.binary_length(words).to_numpy(zero_copy_only=False) <= LONGEST_COMMON_WORD
            sizes = np.bincount(np.frexp(n[short].astype(float))[1] - 1, minlength=64)
            yield _rows([{"part": part, "kind": COUNTS, "n": n, "counts": sizes, "places": np.array([n.sum(), len(n)]), **_packed(words)}])

    return docs.mapInArrow(scan, _KINDS).repartitionById(parts, F.col("part")).mapInArrow(merge, _KINDS)


def _most_frequent(counts: DataFrame, least: int) -> DataFrame:
    """(word, n) of those seen so often at least that are not too long."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _unpacked(batches):
            words, n = _words(row), _numbers(row, "n", "<i8")
            some = np.flatnonzero((n >= least) & (pc.binary_length(words).to_numpy(zero_copy_only=False) <= LONGEST_COMMON_WORD))
            for at in range(0, len(some), 16384):
                part = some[at : at + 16384]
                yield pa.RecordBatch.from_arrays([words.take(pa.array(part)).cast(pa.binary()), pa.array(n[part])], names=["word", "n"])

    return counts.select("words", "sizes", "n").mapInArrow(take, "word binary, n long")


COUNT = np.int64(1) << 32  # a context is (2 * neighbour + side) * COUNT + count; side 0 is after the word, 1 before it


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order and the sums of their counts, of runs that are in order."""
    if len(held) == 1:
        return held[0]
    keys, n = (np.concatenate(x) for x in zip(*held, strict=True))
    return _sorted(keys, n, np.argsort(keys, kind="stable"))  # quick on a few runs


def _crossed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order and the sums of their counts, of keys in any order."""
    return _sorted(keys, n, np.argsort(keys))


def _sorted(keys: np.ndarray, n: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n[order], first) if len(keys) else n


def _contexts(docs: DataFrame, model, folds: int, parts: int) -> DataFrame:
    """Packed contexts of words in the training text, by part; a text begins after an end.

    COMMON: places, counts (of their contexts) and contexts.  RARE: words, lengths and values of others.  PAIRS: words,
    others and n of the pairs of two such.
    """

    def flushed(held: list[tuple[np.ndarray, np.ndarray]], names: list[bytes], common: int) -> pa.RecordBatch:
        pairs, n = _summed(held)
        a, b = pairs >> 32, pairs & 0xFFFFFFFF
        right, left = b < common, a < common
        owner = np.concatenate([a[right], b[left]])
        value = np.concatenate([b[right] * 2 * COUNT + n[right], (a[left] * 2 + 1) * COUNT + n[left]])
        words = pa.array(names, pa.large_binary())
        part_of = np.concatenate([np.arange(common) % parts, _part_of(names, parts)])
        key = np.where(owner < min(common, SPREAD), (owner + (value >> 41)) % parts, part_of[owner]) << 32 | owner
        order = np.argsort(key)
        key, value = key[order], value[order]
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        bounds, who = np.append(starts, len(key)), key[starts] & 0xFFFFFFFF
        lengths = np.diff(bounds).astype("<u4")
        rows = []
        for p, i, k in _by_part(key[starts] >> 32)[1]:
            j = i + int(np.searchsorted(who[i:k], common))
            if i < j:
                rows.append({"part": p, "kind": COMMON, "places": who[i:j].astype("<u4"), "counts": lengths[i:j], "contexts": value[bounds[i] : bounds[j]]})
            if j < k:
                rows.append({"part": p, "kind": RARE, "lengths": lengths[j:k], "values": value[bounds[j] : bounds[k]], **_packed(words.take(pa.array(who[j:k] - common)))})
        both = np.flatnonzero(~right & ~left)
        order, found = _by_part(part_of[a[both]])
        both = both[order]
        for p, i, j in found:
            first, second = (words.take(pa.array(x[both[i:j]] - common)) for x in (a, b))
            rows.append({"part": p, "kind": PAIRS, "n": n[both[i:j]], **_packed(first), **_packed(second, "others", "other_sizes")})
        return _rows(rows)

    def counted(seq: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ends = np.cumsum(sizes)
        before = np.roll(seq, 1)
        before[ends - sizes] = seq[ends - 1]
        return np.unique(before << 32 | seq, return_counts=True)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        common = len(m.words)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        names: dict[bytes, int] = {}
        for chunk in _chunks(batches):
            words, sizes = tokens_of(_training(chunk, folds))
            distinct, codes = _distinct(words)
            own = _list(distinct)
            at = m.at(own)
            rare = np.flatnonzero(at < 0)
            at[rare] = [common + names.setdefault(own[i], len(names)) for i in rare.tolist()]
            held.append(counted(at[codes], sizes))
            if sum(len(x) for x, _ in held) > FLUSH_PAIRS:
                held = [_summed(held)]
            if len(held[0][0]) > FLUSH_PAIRS // 2 or len(names) > FLUSH_NAMES:
                yield flushed(held, list(names), common)
                held, names = [], {}
        if held:
            yield flushed(held, list(names), common)

    return docs.mapInArrow(scan, _KINDS)


def _summed_contexts(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts with one entry for each neighbour and side: (owner, value) in order."""
    keys, n = _crossed(owner << 32 | value >> 32, value & 0xFFFFFFFF)
    return keys >> 32, (keys & 0xFFFFFFFF) << 32 | n


def _of_places(rows: list[dict], column: str) -> tuple[np.ndarray, np.ndarray]:
    return _summed_contexts(np.repeat(_joined(rows, "places", "<u4").astype(np.int64), _joined(rows, "counts", "<u4")), _joined(rows, column, "<i8"))


def _by_place(part: int, kind: int, owner: np.ndarray, value: np.ndarray) -> Iterator[dict]:
    """Packed rows of some ROW_CONTEXTS, a place in one of them; those of SPLIT in a column that sweeps don't read."""
    column = "extra" if kind == SPLIT else "contexts"
    places, starts = np.unique(owner, return_index=True)
    bounds = np.append(starts, len(owner))
    i = 0
    while i < len(places):
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + ROW_CONTEXTS, "right")) - 1)
        yield {"part": part, "kind": kind, "places": places[i:j].astype("<u4"), "counts": np.diff(bounds[i : j + 1]).astype("<u4"), column: value[bounds[i] : bounds[j]]}
        i = j


def _met(rows: DataFrame) -> DataFrame:
    """SPLIT rows, dealt by part, as COMMON rows."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, of in _grouped(batches):
            for row in _by_place(part, COMMON, *_of_places(of[SPLIT], "extra")):
                yield _rows([row])

    return rows.mapInArrow(meet, _KINDS)


def _merged(rows: DataFrame, parts: int) -> DataFrame:
    """Packed rows by part of counts and contexts: of common words with one entry for each neighbour and side (SPLIT: of
    the first SPREAD, for the part where they meet), and a row with all words of the part, n, lengths and values of the
    contexts of those that are not common, and their pairs (first: place among the words; second: place among the
    others; often)."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, of in _grouped(batches):
            owner, value = _of_places(of.pop(COMMON, []), "contexts")
            first = int(np.searchsorted(owner, SPREAD))
            for row in _by_place(part, COMMON, owner[first:], value[first:]):
                yield _rows([row])
            order, found = _by_part(owner[:first] % parts)
            some = [row for p, i, j in found for row in _by_place(p, SPLIT, owner[order[i:j]], value[order[i:j]])]
            for i in range(0, len(some), 256):
                yield _rows(some[i : i + 256])
            if not of[COUNTS]:
                continue
            words, n = _all_words(of[COUNTS]), _joined(of[COUNTS], "n", "<i8")
            rare = of.pop(RARE, [])
            owner, value = _summed_contexts(np.repeat(_found(_all_words(rare), words), _joined(rare, "lengths", "<u4")), _joined(rare, "values", "<i8"))
            pairs = of.pop(PAIRS, [])
            others, codes = _distinct(_all_words(pairs, "others", "other_sizes"))
            keys, often = _crossed(_found(_all_words(pairs), words) << 32 | codes, _joined(pairs, "n", "<i8"))
            yield _rows([{"part": part, "kind": RARE, "n": n, "lengths": np.bincount(owner, minlength=len(words)).astype("<u4"), "values": value, "first": (keys >> 32).astype("<u4"), "second": (keys & 0xFFFFFFFF).astype("<u4"), "often": often, **_packed(words), **_packed(others, "others", "other_sizes")}])

    return rows.mapInArrow(merge, _KINDS)


def _by_class(lengths: np.ndarray, values: np.ndarray, classes: np.ndarray, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """(after, before): counts of neighbours by class of each row of contexts."""
    row = np.repeat(np.arange(0, 2 * len(lengths), 2), lengths)
    code, n = values >> 32, values & 0xFFFFFFFF
    kind = classes[code >> 1]
    at = (row | code & 1) * n_classes + kind
    if (kind < 0).any():  # neighbours without a class
        at, n = at[kind >= 0], n[kind >= 0]
    out = np.bincount(at, n, len(lengths) * 2 * n_classes).reshape(-1, 2, n_classes)
    return out[:, 0], out[:, 1]


def _likeliest(after: np.ndarray, before: np.ndarray, table: np.ndarray, add: float) -> np.ndarray:
    """Log-likelihood of each row's occurrences in each class, under class bigrams table."""
    n = len(table)
    steps = np.log((table + add) / (table.sum(1, keepdims=True) + add * n))
    occurrences = np.maximum(after.sum(1), before.sum(1))
    return after @ steps.T + before @ steps - occurrences[:, None] * np.log(table.sum(0) + add)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def _likelihood(table: np.ndarray) -> float:
    return float(_xlogx(table).sum() - _xlogx(table.sum(0)).sum() - _xlogx(table.sum(1)).sum())


def exchange(contexts: list[np.ndarray], n_classes: int) -> np.ndarray:
    """Classes of units by exchange clustering of their contexts with each other, until none moves."""
    n = len(contexts)
    classes = np.arange(n) % n_classes
    nexts, befores, loops = [], [], np.zeros(n)
    for u, values in enumerate(contexts):
        code, count = values // COUNT, (values % COUNT).astype(float)
        other, side = code // 2, code % 2
        loops[u] = count[(other == u) & (side == 0)].sum()
        for kept, s in ((nexts, 0), (befores, 1)):
            these = (side == s) & (other != u)
            kept.append((other[these], count[these]))
    table = np.zeros((n_classes, n_classes))
    for u in range(n):
        np.add.at(table, (classes[u], classes[nexts[u][0]]), nexts[u][1])
        table[classes[u], classes[u]] += loops[u]
    logs = _xlogx(table)

    def put(k: int, after: np.ndarray, before: np.ndarray, loop: float, sign: int) -> None:
        table[k] += sign * after
        table[:, k] += sign * before
        table[k, k] += sign * loop
        logs[k], logs[:, k] = _xlogx(table[k]), _xlogx(table[:, k])

    moved = True
    while moved:
        moved = False
        for u in range(n):
            after = np.bincount(classes[nexts[u][0]], nexts[u][1], n_classes)
            before = np.bincount(classes[befores[u][0]], befores[u][1], n_classes)
            loop, own = loops[u], classes[u]
            right, left = after.sum() + loop, before.sum() + loop
            if not right and not left:
                continue
            put(own, after, before, loop, -1)
            rows, columns, corner = table.sum(1) + before, table.sum(0) + after, np.diagonal(table)  # wherever it moves
            some, other = np.flatnonzero(after), np.flatnonzero(before)
            gain = (_xlogx(table[:, some] + after[some]) - logs[:, some]).sum(1) + (_xlogx(table[other] + before[other, None]) - logs[other]).sum(0)
            gain += _xlogx(corner + after + before + loop) - _xlogx(corner + after) - _xlogx(corner + before) + _xlogx(corner)
            gain -= _xlogx(rows + right) - _xlogx(rows) + _xlogx(columns + left) - _xlogx(columns)
            best = int(np.argmax(gain))
            if gain[best] <= gain[own] + 1e-6:
                best = own
            moved = moved or best != own
            classes[u] = best
            put(best, after, before, loop, 1)
    return classes


_VERDICT = pa.schema([("place", pa.int64()), ("class", pa.int64()), ("table", pa.binary())])


def _swept(contexts: DataFrame, classes: np.ndarray, n_classes: int, table: np.ndarray | None, add: float) -> tuple[np.ndarray, np.ndarray]:
    """(classes after a sweep under table, class bigrams of the classes before it); without table none moves."""
    shared = contexts.sparkSession.sparkContext.broadcast((classes, table))

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_classes, under = shared.value
        total = np.zeros((n_classes, n_classes))
        for part in _unpacked(batches):
            place = _numbers(part, "places", "<u4").astype(np.int64)
            after, before = _by_class(_numbers(part, "counts", "<u4"), _numbers(part, "contexts", "<i8"), own_classes, n_classes)
            own = own_classes[place]
            np.add.at(total, own[own >= 0], after[own >= 0])
            if under is not None:
                score = _likeliest(after, before, under, add)
                best = score.argmax(1)
                rows = np.arange(len(own))
                moved = np.flatnonzero(((own < 0) | (score[rows, best] > score[rows, own] + 1e-6)) & (after.any(1) | before.any(1)))
                if len(moved):
                    yield batch_of(_VERDICT, [place[moved], best[moved], pa.nulls(len(moved), pa.binary())])
        yield batch_of(_VERDICT, [[None], [None], [total.tobytes()]])

    found = contexts.mapInArrow(sweep, "place long, class long, table binary").toArrow()
    shared.destroy()
    total, after = np.zeros((n_classes, n_classes)), classes.copy()
    for part in found.column(2).drop_null().to_pylist():
        total += np.frombuffer(part).reshape(n_classes, n_classes)
    places, best = (found.column(i).drop_null().to_numpy() for i in (0, 1))
    after[places] = best
    return after, total


def _among(units: int):
    """Of packed contexts, (place, contexts) of the first units with each other."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _unpacked(batches):
            places, values = _numbers(part, "places", "<u4"), _numbers(part, "contexts", "<i8")
            ends = np.cumsum(_numbers(part, "counts", "<u4"), dtype=np.int64)
            some = np.flatnonzero(places < units).tolist()
            kept = [x[x < 2 * units * COUNT].tobytes() for x in (values[ends[i - 1] if i else 0 : ends[i]] for i in some)]
            yield pa.RecordBatch.from_arrays([pa.array(places[some].astype(np.int64)), pa.array(kept, pa.binary())], names=["place", "contexts"])

    return take


def _clustered(contexts: DataFrame, model: Model, classes: int, units: int, add: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """(class of each common word or -1 where none of its neighbours has one, class bigrams of the common words)."""
    units = min(units, len(model.words))
    lasting = max(units, int((model.counts >= FLOOR).sum()))  # words that sweeps move, the first ones
    own: list[np.ndarray] = [np.zeros(0, np.int64)] * units
    for place, values in zip(*(c.to_pylist() for c in contexts.mapInArrow(_among(units), "place long, contexts binary").toArrow().columns), strict=True):
        own[place] = np.frombuffer(values, np.int64)
    now = np.full(len(model.words), -1)
    now[:units] = exchange(own, classes)
    _, table = _swept(contexts, now, classes, None, add)
    now, table = _seeded(contexts, now, lasting, table, add)
    after, table = _swept(contexts, now, classes, table, add)
    likelihood, parts = _likelihood(table), 1
    order = np.random.default_rng(0).permutation(len(now))
    while True:
        moving = np.flatnonzero((after != now)[:lasting])
        some = moving[order[moving] % parts == 0]
        if not len(some):
            break
        tried = now.copy()
        tried[some] = after[some]
        following, counted = _swept(contexts, tried, classes, table, add)
        gain = _likelihood(counted) - likelihood
        if gain > 0:
            now, after, table, likelihood = tried, following, counted, likelihood + gain
            if gain < tolerance * abs(likelihood):
                break
        elif parts == 1:
            parts = 8
        else:
            break
    return _seeded(contexts, now, len(now), table, add)


def _seeded(contexts: DataFrame, now: np.ndarray, upto: int, table: np.ndarray, add: float) -> tuple[np.ndarray, np.ndarray]:
    """now with the words before upto that have no class in the likeliest by their contexts, and the class bigrams as
    of the last sweep."""
    while (now[:upto] < 0).any():
        after, table = _swept(contexts, now, len(table), table, add)
        after[upto:], after[now >= 0] = now[upto:], now[now >= 0]
        if (after == now).all():
            break
        now = after
    return now, table


VOTES, STEPS, TOKENS, WORDS = (np.int64(k) << 40 for k in range(4))


def _assigned(merged: DataFrame, model, known: np.ndarray, table: np.ndarray, add: float, parts: int) -> DataFrame:
    """Packed rows by part: words, n and unit (places) of each, which is its class or, without a class, their number and
    the bucket of its last bytes; pairs for the part of the second word (ASKED: words, unit of the first, number of the
    second, often); and of each part sums by unit (first: key, often)."""
    n_classes, n_units = len(table), len(table) + model.value.n_suffixes
    shared = merged.sparkSession.sparkContext.broadcast((known, table))

    def buckets(m: Model, words: list[bytes]) -> np.ndarray:
        return np.fromiter((zlib.crc32(w[-2:]) for w in words), np.int64, len(words)) % m.n_suffixes

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, under = shared.value
        m = model.value
        unit_of = np.where(classes < 0, n_classes + buckets(m, m.words), classes)
        for row in _unpacked(batches):
            words, n, lengths, values = _words(row), _numbers(row, "n", "<i8"), _numbers(row, "lengths", "<u4"), _numbers(row, "values", "<i8")
            own = _list(words)
            at, bucket = m.at(own), buckets(m, own)
            unit = n_classes + bucket
            ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
            for i in range(0, len(own), 8192):
                j = min(i + 8192, len(own))
                after, before = _by_class(lengths[i:j], values[ends[i] : ends[j]], classes, n_classes)
                some = np.flatnonzero(after.sum(1) + before.sum(1))
                unit[i + some] = _likeliest(after[some], before[some], under, add).argmax(1)
            unit[at >= 0] = unit_of[at[at >= 0]]
            code, left = values >> 32, np.repeat(unit, lengths)
            right = unit_of[code >> 1]
            steps = np.where(code & 1, right * n_units + left, left * n_units + right)
            classed = unit < n_classes
            sums = [_crossed(VOTES + bucket[classed] * n_classes + unit[classed], np.ones(int(classed.sum()), np.int64)), _crossed(STEPS + steps, values & 0xFFFFFFFF), _crossed(TOKENS + unit, n), _crossed(WORDS + unit, np.ones_like(n))]
            yield _rows([{"part": row["part"], "kind": COUNTS, "n": n, "places": unit.astype("<u4"), "first": np.concatenate([k for k, _ in sums]), "often": np.concatenate([x for _, x in sums]), **_packed(words)}])
            others = _words(row, "others", "other_sizes")
            first, second, often = (_numbers(row, c, k) for c, k in (("first", "<u4"), ("second", "<u4"), ("often", "<i8")))
            keys, often = _crossed(second.astype(np.int64) << 32 | unit[first], often)
            second, first = keys >> 32, keys & 0xFFFFFFFF
            order, found = _by_part(_part_of(_list(others), parts)[second])
            rows = []
            for p, i, j in found:
                asked, code = np.unique(second[order[i:j]], return_inverse=True)
                rows.append({"part": p, "kind": ASKED, "places": first[order[i:j]].astype("<u4"), "second": code.astype("<u4"), "often": often[order[i:j]], **_packed(others.take(pa.array(asked)))})
            if rows:
                yield _rows(rows)

    return merged.mapInArrow(assign, _KINDS)


def _sums(rows: DataFrame, function) -> tuple[np.ndarray, np.ndarray]:
    """(keys, sums) of the packed (key, n) that function makes of rows in tasks."""

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64)), *function(batches)]
        keys, n = _summed(held)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "n"])

    found = rows.mapInArrow(listed, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    return tuple(found.column(i).to_numpy() for i in (0, 1))


def _steps_of_pairs(batches: Iterator[pa.RecordBatch], n_units: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for _, of in _grouped(batches):
        words, unit = _all_words(of[COUNTS]), _joined(of[COUNTS], "places", "<u4").astype(np.int64)
        for row in of[ASKED]:
            second = unit[_found(_words(row), words)][_numbers(row, "second", "<u4")]
            yield _crossed(_numbers(row, "places", "<u4").astype(np.int64) * n_units + second, _numbers(row, "often", "<i8"))


def train(docs: DataFrame, *, classes: int = 48, unit_words: int = 1000, suffixes: int = 256, common: int = 131_072, add: float = 0.1, add_transition: float = 0.5, tolerance: float = 5e-4, folds: int = 10):
    """(model, table of word, n, class) of docs (doc, text).

    classes and unit_words are the least: there are as many classes as the vocabulary to the power of 0.3, and as many
    units of the exchange as its square root, MOST_UNITS at most.  tolerance is the share of the likelihood by which a sweep must raise it
    for another to follow.
    """
    model, named, kinds, _ = _trained(docs, classes=classes, unit_words=unit_words, suffixes=suffixes, common=common, add=add, add_transition=add_transition, tolerance=tolerance, folds=folds)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _unpacked(batches):
            yield pa.RecordBatch.from_arrays([_words(row).cast(pa.binary()), pa.array(_numbers(row, "n", "<i8")), pa.array(kinds[_numbers(row, "places", "<u4")])], names=["word", "n", "class"])

    return model, named.select("words", "sizes", "n", "places").mapInArrow(listed, "word binary, n long, class long")


def _trained(docs: DataFrame, *, classes: int = 48, unit_words: int = 1000, suffixes: int = 256, common: int = 131_072, add: float = 0.1, add_transition: float = 0.5, tolerance: float = 5e-4, folds: int = 10) -> tuple[Model, DataFrame, np.ndarray, int]:
    """(model, packed words with n and unit by part, class of each unit, number of parts)."""
    spark, parts = docs.sparkSession, _parts(docs)
    counts = written(_counted(docs, folds, parts), "lm-counts")
    found = counts.select("counts", "places").toArrow()
    sizes, totals = (np.sum([np.frombuffer(x, np.int64) for x in found.column(i).to_pylist()] or [np.zeros(k, np.int64)], axis=0) for i, k in ((0, 64), (1, 2)))
    enough = np.flatnonzero(np.cumsum(sizes[::-1]) >= common)
    least = 63 - int(enough[0]) if len(enough) else 0  # the counts that can be among the common ones: at least 2 ** least
    top = _most_frequent(counts, 2**least).orderBy(F.desc("n"), "word").limit(common).toArrow()
    words = [bytes(w) for w in top.column(0).to_pylist()]
    model = Model(words, top.column(1).to_numpy(), suffixes)
    model.tokens, model.vocabulary = int(totals[0]), int(totals[1])
    classes = max(classes, int(model.vocabulary**0.3))

    plain = spark.sparkContext.broadcast(model)
    together = counts.drop("counts", "places").unionByName(_contexts(docs, plain, folds, parts), allowMissingColumns=True).select(*_PACKED.names)
    merged = written(_merged(together.repartitionById(parts, F.col("part")), parts), "lm-contexts")
    discard(counts)
    met = written(_met(merged.where(F.col("kind") == SPLIT).select("part", "kind", "places", "counts", "extra").repartitionById(parts, F.col("part"))), "lm-common")
    of_place = ["places", "counts", "contexts"]
    of_common = merged.where(F.col("kind") == COMMON).select(of_place).union(met.select(of_place))
    known, table = _clustered(of_common, model, classes, min(max(unit_words, math.isqrt(model.vocabulary)), MOST_UNITS), add_transition, tolerance)

    # other words, and the pairs of two of them
    named = written(_assigned(merged.where(F.col("kind") == RARE).select("part", "words", "sizes", "n", "lengths", "values", "others", "other_sizes", "first", "second", "often"), plain, known, table, add_transition, parts), "lm-classes")
    keys, n = _sums(named.where(F.col("kind") == COUNTS).select("first", "often"), lambda batches: ((_numbers(r, "first", "<i8"), _numbers(r, "often", "<i8")) for r in _unpacked(batches)))
    what, key = keys >> 40, keys & ((1 << 40) - 1)
    of = lambda kind, size: np.bincount(key[what == kind], n[what == kind], size)
    units = classes + suffixes
    votes = of(0, suffixes * classes).reshape(suffixes, classes)

    # a word without a class has that of its bucket
    buckets = np.where(votes.any(1), votes.argmax(1), votes.sum(0).argmax())
    own = np.array([buckets[model.suffix(w) - len(words)] if known[i] < 0 else known[i] for i, w in enumerate(words)], np.int64)
    model.classes = np.concatenate([own, buckets])
    kinds = np.concatenate([np.arange(classes), buckets])

    # class bigrams of all pairs
    _, table = _swept(of_common, own, classes, None, add_transition)
    steps = of(1, units * units)
    asked = named.select("part", "kind", "words", "sizes", "places", "second", "often").repartitionById(parts, F.col("part"))
    at, often = _sums(asked, lambda batches: _steps_of_pairs(batches, units))
    np.add.at(steps, at, often)
    np.add.at(table, (kinds[np.arange(units * units) // units], kinds[np.arange(units * units) % units]), steps)
    discard(merged, met)
    model.transitions = np.log10((table + add_transition) / (table.sum(1, keepdims=True) + add_transition * classes))
    shares = np.bincount(kinds, of(2, units), classes) + add * (np.bincount(kinds, of(3, units), classes) + 1)
    model.shares = np.log10(shares)
    return model, named.where(F.col("kind") == COUNTS), kinds, parts


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", add: float = 0.1, folds: int = 10, **training) -> DataFrame:
    """Per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities),
    perplexity (by token, of score).

    The model learns from the rows whose crc32(id as text) mod folds is not 0; base_score is the unigram model with
    add-constant smoothing.
    """
    source = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    model, named, kinds, parts = _trained(source, add=add, folds=folds, **training)
    shared = source.sparkSession.sparkContext.broadcast(model)
    last = pa.schema([("doc", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("counted", pa.float64()), ("classed", pa.float64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """STATE of each chunk of texts (n: its rows with what common words give; lengths, first and second: pairs with
        another word, which stands by its number below zero), and the other words for their parts."""
        m = shared.value
        logs, n = np.log10(m.counts + add), len(m.shares)
        steps, task = m.transitions.ravel(), TaskContext.get().partitionId()
        for number, chunk in enumerate(_chunks(batches)):
            docs = chunk.column(0).to_pylist()
            words, sizes = tokens_of(chunk.column(1))
            distinct, codes = _distinct(words)
            own = _list(distinct)
            at = m.at(own)
            rare = np.flatnonzero(at < 0)
            kind = m.classes[at]
            kind[rare] = -1 - np.arange(len(rare))
            at, kind = at[codes], kind[codes]
            ends = np.cumsum(sizes)
            row = np.repeat(np.arange(len(sizes)), sizes)
            before = np.roll(kind, 1)
            before[ends - sizes] = kind[ends - 1]
            both = (before >= 0) & (kind >= 0)
            common = at >= 0
            total = lambda values, where: np.bincount(row[where], values, len(sizes))  # noqa: E731, B023
            counted = total(logs[at[common]], common)
            classed = total(steps[before[both] * n + kind[both]], both) - total(m.shares[kind[common]], common)
            state = batch_of(last, [docs, [held_out(d, folds) for d in docs], sizes, np.bincount(row[common], minlength=len(sizes)), counted, classed])
            home, name = (task * 5 + number) % parts, task << 32 | number
            rows = [{"part": home, "kind": STATE, "chunk": name, "n": state.serialize().to_pybytes(), "lengths": np.bincount(row[~both], minlength=len(sizes)).astype("<u4"), "first": before[~both].astype("<i4"), "second": kind[~both].astype("<i4")}]
            others = distinct.take(pa.array(rare))
            fallback = m.classes[np.fromiter((m.suffix(own[i]) for i in rare.tolist()), np.int64, len(rare))]
            order, found = _by_part(_part_of(_list(others), parts))
            for p, i, j in found:
                these = order[i:j]
                rows.append({"part": p, "kind": ASKED, "chunk": name, "places": these.astype("<u4"), "second": fallback[these].astype("<u4"), "extra": np.array([home], "<u4"), **_packed(others.take(pa.array(these)))})
            yield _rows(rows)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, of in _grouped(batches):
            asked = of[ASKED]
            if not asked:
                continue
            words, n = _all_words(of[COUNTS]), np.append(_joined(of[COUNTS], "n", "<i8"), 0)
            kind, at = np.append(kinds[_joined(of[COUNTS], "places", "<u4")], 0), _found(_all_words(asked), words)
            n, kind = n[at], np.where(at < 0, _joined(asked, "second", "<u4"), kind[at])
            j = 0
            rows = []
            for r in asked:
                i, j = j, j + len(_numbers(r, "places", "<u4"))
                rows.append({"part": int(_numbers(r, "extra", "<u4")[0]), "kind": ANSWER, "chunk": r["chunk"], "places": _numbers(r, "places", "<u4"), "n": n[i:j], "second": kind[i:j].astype("<u4")})
            for i in range(0, len(rows), 256):
                yield _rows(rows[i : i + 256])

    def finished(rows: list[dict]) -> pa.RecordBatch:
        m = shared.value
        (state,), answers = ([r for r in rows if r["kind"] == k] for k in (STATE, ANSWER))
        batch = pa.ipc.read_record_batch(state["n"], last)
        sums = [batch.column(c).to_numpy().copy() for c in ("known", "counted", "classed")]
        places = _joined(answers, "places", "<u4")
        n, kind = np.zeros(len(places), np.int64), np.zeros(len(places) + 1, np.int64)
        n[places], kind[places] = _joined(answers, "n", "<i8"), _joined(answers, "second", "<u4")
        lengths, first, second = _numbers(state, "lengths", "<u4"), _numbers(state, "first", "<i4"), _numbers(state, "second", "<i4")
        row = np.repeat(np.arange(len(lengths)), lengths)
        before, after = (np.where(x < 0, kind[np.where(x < 0, -1 - x, 0)], x) for x in (first, second))
        sums[2] += np.bincount(row, m.transitions[before, after], len(lengths))
        rare = second < 0
        row, often = row[rare], n[-1 - second[rare]]
        sums[0] += np.bincount(row[often > 0], minlength=len(lengths))
        sums[1] += np.bincount(row, np.log10(often + add), len(lengths))
        sums[2] -= np.bincount(row, m.shares[after[rare]], len(lengths))
        return batch_of(last, [*batch.columns[:3], *sums])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for row in _unpacked(batches):
            if held and held[0]["chunk"] != row["chunk"]:
                yield finished(held)
                held = []
            held.append(row)
        if held:
            yield finished(held)

    scanned = written(source.mapInArrow(scan, _KINDS), "lm-scan")
    of_words = ["part", "kind", "chunk", "words", "sizes", "n", "places", "second", "extra"]
    answers = named.select(of_words).union(scanned.where(F.col("kind") == ASKED).select(of_words)).repartitionById(parts, F.col("part")).mapInArrow(answer, _KINDS)
    of_chunk = ["part", "kind", "chunk", "n", "places", "lengths", "first", "second"]
    together = scanned.where(F.col("kind") == STATE).select(of_chunk).union(answers.select(of_chunk))
    out = together.repartitionById(parts, F.col("part")).sortWithinPartitions("chunk").mapInArrow(finish, "doc long, held_out boolean, n_tokens long, known long, counted double, classed double")
    score = F.col("counted") + F.col("classed")
    spread = math.log10(model.tokens + add * (model.vocabulary + 1))
    return out.select(
        F.col("doc").alias("doc_id"),
        "held_out",
        "n_tokens",
        F.col("known").alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("counted") - F.col("n_tokens") * F.lit(spread)).alias("base_score"),
        score.alias("score"),
        F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"),
    )
