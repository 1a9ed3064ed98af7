"""Substring dedup by de Bruijn compaction of token k-mers.

A window of 13 consecutive words is an edge of a de Bruijn graph whose nodes are its first and last 12 words.  A word
goes if a window over it also starts in a document with a smaller id.  Edges are not shuffled one by one:

1. Every edge names its minimizer, the least-hashed 6-word mer inside it.  Consecutive edges of a document with the
   same minimizer form a path piece of at most 8 edges (of 13 words); its first and last edge hold all its words.  Minimizers that
   one document alone has end there (most do); a Bloom filter of the others, of bounded size, spares the second scan
   most of its rows.
2. Pieces of the other minimizers, one row per document and piece with its place, are compacted by a join: equal pieces
   become one row that knows its source, the place in its least document.  Where a minimizer has a single piece, the
   path does not branch, and all but the least document lose the whole piece.
3. Where pieces branch (the ends of repeated spans, mostly), each distinct piece is opened into its edges, at the
   coordinates of its least document alone; equal edges meet, and the least document of each edge decides.
4. Decisions come back to the documents, which are read again: pieces and edges are found by their hashes in the text
   itself.  Those that follow one another both here and in the source are joined at their end nodes into one span.
5. The words of each span are compared with those at its source coordinates, in runs that end at fixed places of the
   source, so that a passage which many documents share is one row.  A span that differs (two hashes met) sends the
   windows claimed from that source back: they are decided anew by their words themselves.

The result is exact: hashes bring equal windows together, and words decide.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from textmill.llm.hashing import mix, signed, window_hashes
from textmill.llm.shared import NO_ID, as_bytes, batch_of, bounded_batches, discard, if_small, written

MER = 6
FLUSH = 1_000_000
PART = 2_000_000  # bytes of text whose hashes are made at once
RUN = 64  # words of the source that are compared in one row
MOST_BITS = 28  # of the Bloom filter: 32 MB


def _least_of(values: np.ndarray, k: int) -> np.ndarray:
    """The least of each k consecutive values, by doubling."""
    width = 1
    while 2 * width <= k:
        values = np.minimum(values[:-width], values[width:])
        width *= 2
    return values if width == k else np.minimum(values[: width - k], values[k - width :])


class Paths:
    """The edges of several texts and the pieces they form; row is a text's place among them, at an edge's place in it."""

    def __init__(self, texts: list[bytes], window: int, bits: int = 64):
        self.words = [t.split() for t in texts]
        counts = np.array([len(w) for w in self.words], np.int64)
        total = int(counts.sum())
        hashes = np.fromiter(map(xxh3_64_intdigest, chain.from_iterable(self.words)), np.uint64, total)
        row = np.repeat(np.arange(len(texts)), counts)
        whole = np.flatnonzero(row[: max(0, total - window + 1)] == row[window - 1 :])  # windows inside one text
        self.row = row[whole]
        self.at = whole - (np.cumsum(counts) - counts)[self.row]
        if not len(whole):
            self.edges = self.mers = self.pieces = np.empty(0, np.uint64)
            self.starts = self.lengths = np.empty(0, np.int64)
            return
        cut, mer = np.uint64(64 - bits), min(MER, window)
        k = window - mer + 1
        self.edges = window_hashes(hashes, window, 1)[whole] >> cut
        least = _least_of(window_hashes(hashes, mer, 2), k)[whole]
        heads = np.concatenate([[True], (np.diff(whole) != 1) | (np.diff(least) != 0)])
        place = np.arange(len(whole))
        self.starts = np.flatnonzero((place - place[heads][np.cumsum(heads) - 1]) % k == 0)
        ends = np.append(self.starts[1:], len(whole))
        self.lengths = ends - self.starts
        self.mers = least[self.starts]
        self.pieces = mix(mix(self.edges[self.starts]) + self.edges[ends - 1] * np.uint64(3) + self.lengths.astype(np.uint64)) >> cut

    def of(self, row: int) -> tuple[slice, slice]:
        """The edges of a text, and its pieces."""
        low, high = np.searchsorted(self.row, [row, row + 1]).tolist()
        first, last = np.searchsorted(self.starts, [low, high]).tolist()
        return slice(low, high), slice(first, last)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches cut to about PART bytes of text, with their texts."""
    for batch in batches:
        texts = as_bytes(batch.column(1))
        low, size = 0, 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= PART or i == len(texts) - 1:
                yield batch.slice(low, i + 1 - low), texts[low : i + 1]
                low, size = i + 1, 0


def _minimizers(window: int, bits: int):
    schema = pa.schema([("mer", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            mers, docs = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((docs, mers))
            mers, docs = mers[order], docs[order]
            first = np.flatnonzero(np.concatenate([[True], mers[1:] != mers[:-1]]))
            last = np.concatenate([first[1:], [len(mers)]]) - 1
            return batch_of(schema, [signed(mers[first]), docs[first], docs[last]])

        for batch, texts in _parts(batches):
            paths = Paths(texts, window, bits)
            held.append((paths.mers, batch.column(0).to_numpy()[paths.row[paths.starts]]))
            size += len(paths.mers)
            if size >= FLUSH:
                yield flush()
                held, size = [], 0
        if size:
            yield flush()

    return scan


def _bloom(mers: DataFrame) -> np.ndarray:
    """Bits of a Bloom filter of mers (which are hashes themselves): a dozen for each, 2 ** MOST_BITS at most."""
    bits = min(MOST_BITS, max(16, (12 * mers.count()).bit_length()))
    mask = F.lit((1 << bits) - 1).cast("long")
    at = F.explode(F.array(F.col("mer").bitwiseAND(mask), F.shiftrightunsigned("mer", 32).bitwiseAND(mask))).alias("at")
    words = mers.select(at).groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("bits")).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words.column(0).to_numpy()] = words.column(1).to_numpy()
    return out.view(np.uint64)


def _may_hold(bloom: np.ndarray, mers: np.ndarray) -> np.ndarray:
    mask = np.uint64(64 * len(bloom) - 1)
    found = np.ones(len(mers), bool)
    for at in (mers & mask, (mers >> np.uint64(32)) & mask):
        found &= (bloom[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return found


def _pieces(window: int, bits: int, bloom):
    schema = pa.schema([("mer", pa.int64()), ("piece", pa.int64()), ("doc", pa.int64()), ("start", pa.int32())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _parts(batches):
            paths = Paths(texts, window, bits)
            at = np.flatnonzero(_may_hold(bloom.value, paths.mers))
            if len(at):
                row = paths.row[paths.starts]
                at = at[np.lexsort((at, paths.pieces[at], paths.mers[at], row[at]))]
                again = (np.diff(row[at]) == 0) & (np.diff(paths.mers[at]) == 0) & (np.diff(paths.pieces[at]) == 0)
                at = at[np.concatenate([[True], ~again])]  # the first place of each in a text
                yield batch_of(schema, [signed(paths.mers[at]), signed(paths.pieces[at]), batch.column(0).to_numpy()[row[at]], paths.at[paths.starts[at]].astype(np.int32)])

    return scan


def _edges(window: int, bits: int):
    schema = pa.schema([("mer", pa.int64()), ("edge", pa.int64()), ("doc", pa.int64()), ("start", pa.int32())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _parts(batches):
            paths = Paths(texts, window, bits)
            wanted = np.zeros(len(paths.pieces), bool)
            for i, opened in enumerate(batch.column(2)):
                _, own = paths.of(i)
                wanted[own] = np.isin(signed(paths.pieces[own]), opened.values.to_numpy())
            at = np.flatnonzero(np.repeat(wanted, paths.lengths))
            if len(at):
                mers = np.repeat(paths.mers, paths.lengths)
                at = at[np.lexsort((at, paths.edges[at], paths.row[at]))]
                again = (np.diff(paths.row[at]) == 0) & (np.diff(paths.edges[at]) == 0) & (np.diff(mers[at]) == 0)
                at = at[np.concatenate([[True], ~again])]
                yield batch_of(schema, [signed(mers[at]), signed(paths.edges[at]), batch.column(0).to_numpy()[paths.row[at]], paths.at[at].astype(np.int32)])

    return scan


def covered_words(n_words: int, window: int, starts: np.ndarray) -> np.ndarray:
    """Which words the windows at the (distinct) starts cover."""
    steps = np.zeros(n_words + 1, np.int64)
    steps[starts] += 1
    steps[starts + window] -= 1
    return np.cumsum(steps)[:n_words] > 0


_CLAIM = "struct<source: long, run: int, low: int, high: int, words: string>"


def _looked_up(keys: np.ndarray, verdicts: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(found, source, at) of each key among the verdicts (key, source, at) of a document."""
    if not verdicts.is_valid or not len(verdicts.values):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    own, source, at = (verdicts.values.field(i).to_numpy(zero_copy_only=False) for i in range(3))
    order = np.argsort(own)
    place = order[np.minimum(np.searchsorted(own, keys, sorter=order), len(own) - 1)]
    return own[place] == keys, source[place], at[place].astype(np.int64)


def _claims(words: list[bytes], window: int, gone: np.ndarray, source: np.ndarray, at: np.ndarray) -> list[dict]:
    """The claimed spans: windows one after another here and in the source, joined and cut at every RUN words of it."""
    where = np.flatnonzero(gone)
    if not len(where):
        return []
    follows = (np.diff(where) == 1) & (np.diff(source[where]) == 0) & (np.diff(at[where]) == 1)
    heads = np.concatenate([[0], np.flatnonzero(~follows) + 1])
    tails = np.concatenate([heads[1:], [len(where)]]) - 1
    out = []
    for h, t in zip(where[heads].tolist(), where[tails].tolist(), strict=True):
        first, stop = int(at[h]), int(at[t]) + window
        for run in range(first // RUN, (stop - 1) // RUN + 1):
            low, high = max(first, run * RUN), min(stop, (run + 1) * RUN)
            said = words[h + low - first : h + high - first]
            out.append({"source": int(source[h]), "run": run, "low": low - run * RUN, "high": high - run * RUN, "words": b" ".join(said).decode()})
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(source, run, own) of texts: their words, RUN at a time."""
    schema = pa.schema([("source", pa.int64()), ("run", pa.int32()), ("own", pa.string())])
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
            words = text.split()
            parts = [b" ".join(words[i : i + RUN]).decode() for i in range(0, len(words), RUN)]
            yield batch_of(schema, [[doc] * len(parts), list(range(len(parts))), parts])


def _windows(window: int, bits: int):
    schema = pa.schema([("edge", pa.int64()), ("words", pa.string()), ("doc", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _parts(batches):
            paths = Paths(texts, window, bits)
            for at in range(0, len(paths.edges), 4096):
                row, start = paths.row[at : at + 4096], paths.at[at : at + 4096].tolist()
                words = [b" ".join(paths.words[r][i : i + window]).decode() for r, i in zip(row.tolist(), start, strict=True)]
                yield batch_of(schema, [signed(paths.edges[at : at + 4096]), words, batch.column(0).to_numpy()[row]])

    return scan


def _applied(window: int, bits: int):
    spans_kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    claim_kind = pa.list_(pa.struct([("source", pa.int64()), ("run", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), ("words", pa.string())]))
    kinds = [("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string()), ("spans", spans_kind), ("claims", claim_kind)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _parts(batches):
            rows: list[tuple] = []
            touched = np.logical_or.reduce([np.asarray(batch.column(i).is_valid()) for i in (2, 3, 4)])
            paths = Paths([t if x else b"" for t, x in zip(texts, touched.tolist(), strict=True)], window, bits)
            for i, (text, pieces, edges, suspects, exact) in enumerate(zip(texts, *(batch.column(c) for c in range(2, 6)), strict=True)):
                words = paths.words[i] if touched[i] else text.split()
                kept, spans, claims = words, [], []
                if touched[i]:
                    windows, own = paths.of(i)
                    lengths, hashed = paths.lengths[own], paths.edges[windows]
                    found, source, at = (np.repeat(x, lengths) for x in _looked_up(signed(paths.pieces[own]), pieces))
                    at = at + np.arange(len(at)) - np.repeat(paths.starts[own] - windows.start, lengths)
                    alone, alone_source, alone_at = _looked_up(signed(hashed), edges)
                    gone, source, at = found | alone, np.where(alone, alone_source, source), np.where(alone, alone_at, at)
                    if suspects.is_valid:  # decided by their words
                        again = np.flatnonzero(np.isin(signed(hashed), suspects.values.to_numpy()))
                        repeated = set(exact.as_py() or [])
                        gone[again] = [b" ".join(words[i : i + window]).decode() in repeated for i in again.tolist()]
                    else:
                        claims = _claims(words, window, gone, source, at)
                    cover = covered_words(len(words), window, np.flatnonzero(gone))
                    kept = [w for w, c in zip(words, cover.tolist(), strict=True) if not c]
                    turns = np.flatnonzero(np.diff(np.concatenate([[0], cover.astype(np.int8), [0]]))).tolist()
                    spans = [{"start": a, "length": b - a} for a, b in zip(turns[::2], turns[1::2], strict=True)]
                joined = b" ".join(kept)
                rows.append((len(words), len(words) - len(kept), sha256(joined).hexdigest(), joined.decode() if spans else None, spans, claims))
            if rows:
                schema = pa.schema([("doc", pa.int64()), *kinds, ("row", batch.schema.field(6).type)])
                yield batch_of(schema, [batch.column(0), *(list(c) for c in zip(*rows, strict=True)), batch.column(6)])

    return scan


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 13, bits: int = 64, carry: Sequence[str] = ()) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept_sha256, kept_text, spans.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged.  spans are the removed runs of words (start, length); kept_text is
    the kept words joined by one space, null where nothing is removed (the text stays as it is).  With carry, a
    column ``row`` holds a struct of those columns of the row.  bits is the width of the hashes of windows; the result
    doesn't depend on it.

    Defined cases: a null text has no words; texts shorter than a window lose nothing; a null id sorts after every
    id; rows that share an id never count against each other, and equal rows get equal results; other columns are
    ignored; an empty table gives no rows.
    """
    carried = F.struct(*(F.col(c) for c in carry)) if carry else F.struct(F.lit(True).alias("row"))
    source = bounded_batches(docs).select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.col(text_col).cast("string").alias("text"))

    seen = source.mapInArrow(_minimizers(window, bits), "mer long, low long, high long")
    shared = written(seen.groupBy("mer").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low != high").select("mer"), "dedup-minimizers")
    bloom = docs.sparkSession.sparkContext.broadcast(_bloom(shared))
    pieces = written(source.mapInArrow(_pieces(window, bits, bloom), "mer long, piece long, doc long, start int").join(shared, "mer", "left_semi"), "dedup-pieces")

    least = F.min(F.struct("doc", "start")).alias("first")
    paths = written(pieces.groupBy("mer", "piece").agg(least, F.max("doc").alias("most")), "dedup-paths")
    branching = paths.groupBy("mer").agg(F.count("*").alias("n")).where("n > 1").select("mer")
    whole = pieces.join(paths.where("first.doc != most"), ["mer", "piece"]).where("doc > first.doc").select("doc", F.struct(F.col("piece").alias("key"), F.col("first.doc").alias("source"), F.col("first.start").alias("at")).alias("piece"))
    opened = paths.join(branching, "mer", "left_semi").groupBy(F.col("first.doc").alias("doc")).agg(F.collect_set("piece").alias("opened"))
    edges = written(source.join(opened, "doc").select("doc", "text", "opened").mapInArrow(_edges(window, bits), "mer long, edge long, doc long, start int"), "dedup-edges")
    least_edges = edges.groupBy("mer", "edge").agg(least, F.max("doc").alias("most")).where("first.doc != most")
    single = edges.join(least_edges, ["mer", "edge"]).where("doc > first.doc").select("doc", F.struct(F.col("edge").alias("key"), F.col("first.doc").alias("source"), F.col("first.start").alias("at")).alias("edge"))

    none = F.lit(None).cast("struct<key: long, source: long, at: int>")
    verdicts = whole.select("doc", "piece", none.alias("edge")).union(single.select("doc", none, "edge"))
    verdicts = written(verdicts.groupBy("doc").agg(F.collect_list("piece").alias("pieces"), F.collect_list("edge").alias("edges")), "dedup-verdicts")
    discard(pieces, paths, edges)
    whole_rows = bounded_batches(docs).select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.col(text_col).cast("string").alias("text"), carried.alias("row"))
    kinds = f"doc long, n_words long, n_removed long, kept_sha256 string, kept_text string, spans array<struct<start: long, length: long>>, claims array<{_CLAIM}>, row {whole_rows.schema['row'].dataType.simpleString()}"

    def applied(again: DataFrame | None) -> DataFrame:
        given = whole_rows.join(verdicts, "doc", "left")
        if again is None:
            given = given.withColumns({"suspects": F.lit(None).cast("array<bigint>"), "exact": F.lit(None).cast("array<string>")})
        else:
            given = given.join(again, "doc", "left")
        return written(given.select("doc", "text", "pieces", "edges", "suspects", "exact", "row").mapInArrow(_applied(window, bits), kinds), "dedup-applied")

    out = applied(None)
    claims = out.select(F.explode("claims").alias("c")).select("c.*").distinct()
    claims = written(claims, "dedup-claims")
    sources = written(claims.select(F.col("source").alias("doc")).distinct(), "dedup-sources")
    own = source.join(if_small(sources), "doc", "left_semi").mapInArrow(_runs, "source long, run int, own string")
    same = F.array_join(F.slice(F.split("own", " "), F.col("low") + 1, F.col("high") - F.col("low")), " ") == F.col("words")
    claims, own = claims.alias("c"), own.alias("o")
    differing = claims.join(own, (F.col("c.source") == F.col("o.source")) & (F.col("c.run") == F.col("o.run")) & same, "left_anti")
    differing = written(differing.select("source").distinct(), "dedup-differing")
    if not differing.isEmpty():
        flat = verdicts.select("doc", F.explode(F.concat("pieces", "edges")).alias("v")).select("doc", "v.source")
        touched = flat.join(differing, "source", "left_semi").select("doc").distinct()
        windows = written(source.mapInArrow(_windows(window, bits), "edge long, words string, doc long"), "dedup-windows")
        suspects = windows.join(touched, "doc", "left_semi").select("edge").distinct()
        windows = written(windows.join(suspects, "edge", "left_semi"), "dedup-suspects")
        first = windows.groupBy("edge", "words").agg(F.min("doc").alias("first"))
        repeated = windows.join(first, ["edge", "words"]).select("doc", "edge", F.when(F.col("doc") > F.col("first"), F.col("words")).alias("words"))
        out = applied(repeated.groupBy("doc").agg(F.collect_set("edge").alias("suspects"), F.collect_set("words").alias("exact")))
    return out.select(F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "n_words", "n_removed", "kept_sha256", "kept_text", "spans", *(["row"] if carry else []))


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", window: int = 13) -> DataFrame:
    """docs, its columns unchanged, with the repeated words gone: a changed text is its kept words joined by one space,
    and the count of characters (where docs has one) follows.  Documents of which nothing is left go."""
    out = repeated_spans(docs, id_col=id_col, text_col=text_col, window=window, carry=docs.columns)
    changed = F.col("kept_text").isNotNull()

    def value(name: str):
        old = F.col("row").getField(name)
        if name == text_col:
            return F.when(changed, F.col("kept_text")).otherwise(old).alias(name)
        if name == chars_col:
            return F.when(changed, F.length("kept_text").cast(docs.schema[name].dataType)).otherwise(old).alias(name)
        return old.alias(name)

    return out.where(~changed | (F.col("kept_text") != "")).select(*map(value, docs.columns))
