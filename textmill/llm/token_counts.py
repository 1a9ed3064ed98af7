"""Token counts by a count-only Viterbi.

An Aho-Corasick automaton over the vocabulary lists, for every end in a chunk, the pieces that end there, longest
first; dynamic programming carries the best score and its number of tokens, nothing else.  Both run in step: matches
are used as they are found, and only as many places are held as the longest piece has characters, so a text without
any break needs no more memory than its characters.  See ``unigram`` for the tokenizer's rules.

Defined cases: null and empty texts have no tokens; a null id stays null; repeated rows count each; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textmill.llm.shared import as_texts, batch_of, bounded_batches
from textmill.llm.unigram import Chunks, Pieces, chunks_of

HELD_CHARS = 4096  # up to which a chunk's matches are listed first, which is quicker


class Counter:
    """(tokens, score) of texts."""

    def __init__(self, pieces: Pieces):
        import ahocorasick

        self.pieces = pieces
        self.longest = max(map(len, pieces.scores), default=1)
        self.automaton = ahocorasick.Automaton()
        for text, score in pieces.scores.items():
            self.automaton.add_word(text, (len(text), score))
        self.automaton.make_automaton()
        self.chunks = Chunks(self.solve)

    def ends(self, chunk: str) -> Iterable[tuple[int, list]]:
        """(end, pieces that end there) of every character, in order; of long chunks as they are found."""
        if len(chunk) <= HELD_CHARS:
            held: list[list] = [[] for _ in chunk]
            for end, match in self.automaton.iter(chunk):
                held[end].append(match)
            return enumerate(held)
        return self.streamed(chunk)

    def streamed(self, chunk: str) -> Iterator[tuple[int, list]]:
        done = 0
        for end, found in groupby(self.automaton.iter(chunk), itemgetter(0)):
            for skipped in range(done, end):
                yield skipped, []
            yield end, [match for _, match in found]
            done = end + 1
        for skipped in range(done, len(chunk)):
            yield skipped, []

    def solve(self, chunk: str) -> tuple[int, float]:
        n = len(chunk)
        width = min(n, self.longest) + 1  # a ring: place p is held at p % width
        best, count = [0.0] * width, [0] * width
        unknown = self.pieces.unknown
        for end, matches in self.ends(chunk):
            top, tokens = None, 0
            for length, score in sorted(matches, reverse=True):
                before = (end + 1 - length) % width
                total = best[before] + score
                if top is None or total > top:
                    top, tokens = total, count[before] + 1
            if not matches or min(matches)[0] > 1:  # no piece of this character alone
                before = end % width
                total = best[before] + unknown
                if top is None or total > top:
                    top, tokens = total, count[before] + len(chunk[end].encode())
            best[(end + 1) % width], count[(end + 1) % width] = top, tokens
        return count[n % width], best[n % width]

    def count(self, text: str) -> tuple[int, float]:
        found = list(map(self.chunks.__getitem__, chunks_of(text, self.pieces.chunked)))
        return sum(x[0] for x in found), sum(x[1] for x in found)


_made: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One counter a worker process and vocabulary."""
    if path not in _made:
        _made[path] = Counter(Pieces.load(path))
    return _made[path]


def token_counts(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_tokens, best_score (the best path's sum of scores)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("best_score", pa.float64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocabulary)
        for batch in batches:
            found = [own.count(t) for t in as_texts(batch.column(1))]
            yield batch_of(schema, [batch.column(0), [x[0] for x in found], [float(x[1]) for x in found]])

    rows = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scan, "doc_id long, n_tokens long, best_score double")
