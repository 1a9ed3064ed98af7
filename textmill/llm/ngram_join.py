"""N-gram Jaccard join by a token-group matrix.

Documents link when the Jaccard similarity of their sets of word shingles reaches a threshold.  Every link counts
towards the components, yet no group of copies is ever expanded into pairs:

1. Equal sets collapse into a class, named by its least document id.
2. Rows of the matrix.  A set is cut into parts by hash range, more parts than two linked sets can differ in, so some
   parts are equal in both (pigeonhole).  The hash of a part's tokens is the row that candidates share.  The number of
   parts depends on the size band; a set near its band's upper end is also entered in the next.
3. Prefixes.  With ``slack`` more parts than needed, linked sets have at least 1 + slack rows in common, so each set
   may leave out the first ``slack`` of its rows in any order that is the same for all: empty parts first, then the
   rows that most sets have.  A passage that many documents share is left out by all that have enough else, and a set
   with fewer shared rows than that links with nothing.
4. Groups of similar documents.  Every row has a leader, the least class that has it; a class visits the leaders of its
   rows.  Two classes are compared at the least leader that both visit, and visits where everybody has met before are
   left out.  Large gatherings are dealt into pairs of blocks of bounded size.
5. Inside a block, classes are put into small groups of similar sets (by their least token); a group stores the union
   of its members' tokens and which member has which.  A query's overlap with the union bounds that with any member;
   only where the bound qualifies is the group opened.

Every pair of classes that could link is compared exactly once.  A block writes the number of links of each of its
classes, and as links only what connects them: numbers and components are exact, up to equal 64-bit hashes of unequal
shingles.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textmill.llm.components import components
from textmill.llm.hashing import mix, sequence_hash, signed, window_hashes, word_hashes
from textmill.llm.shared import as_bytes, batch_of, bounded_batches, if_small, written

BLOCK = 512  # most classes of a block's side,
BLOCK_TOKENS = 1_000_000  # and about as many tokens
GROUP = 32
BAND = 1.5
SLACK = 4  # parts added, for so many that two linked sets can differ in
EMPTY = 1 << 40  # in a row's tag


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; with fewer words, of the whole sequence; empty without words."""
    words = word_hashes(text.lower())
    if len(words) >= size:
        return np.unique(window_hashes(words, size))
    return np.array([sequence_hash(words, len(words))], np.uint64) if len(words) else words


class Parts:
    """Rows of the matrix for a threshold of num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.tops = [4]  # largest size of each band
        while self.tops[-1] < 2**40:
            self.tops.append(max(self.tops[-1] + 1, int(self.tops[-1] * BAND)))

    def differ(self, top: int) -> int:
        """Most tokens that are in one only of two linked sets of at most top tokens each."""
        return 2 * top * (self.den - self.num) // (self.den + self.num)

    def rows(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, tag) of a set.  A tag holds the band, whether the part is empty, and the number of rows of its kind
        that the set may leave out besides those left out here."""
        n = len(tokens)
        band = int(np.searchsorted(self.tops, n))
        bands = [band, band + 1] if n * self.den >= self.num * (self.tops[band] + 1) else [band]
        mixed = mix(tokens + np.uint64(1))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
        high = tokens >> np.uint64(32)
        rows, tags = [], []
        for b in bands:
            differ = self.differ(self.tops[b])
            slack = -(-differ // SLACK)
            parts = differ + 1 + slack
            cuts = np.searchsorted((high * np.uint64(parts)) >> np.uint64(32), np.arange(parts + 1, dtype=np.uint64))
            own = mix(sums[cuts[1:]] - sums[cuts[:-1]] + np.arange(parts, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(b << 40))
            empty = cuts[1:] == cuts[:-1]
            n_empty = int(np.count_nonzero(empty))
            if n_empty <= slack:  # all empty parts are left out, and so may be the rest of the slack
                own, left = own[~empty], np.full(parts - n_empty, slack - n_empty)
            else:  # only empty parts may be left out
                left = np.where(empty, EMPTY + slack, 0)
            rows.append(own)
            tags.append(left + 2 * EMPTY * b)
        return np.concatenate(rows), np.concatenate(tags)


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """(doc, tokens as bytes) of docs (doc, text) that have tokens."""
    schema = pa.schema([("doc", pa.int64()), ("tokens", pa.binary())])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch_of(schema, [batch.column(0), [shingle_set(t, size).tobytes() for t in as_bytes(batch.column(1))]])

    return docs.mapInArrow(make, "doc long, tokens binary").where(F.octet_length("tokens") > 0)


class _Groups:
    """Sets in groups of similar ones, each with the union of its tokens and which member has which."""

    def __init__(self, sets: list[np.ndarray], members: Iterable[int]):
        order = sorted(members, key=lambda i: (int(sets[i][0]), len(sets[i]), i))
        self.members = [np.array(order[k : k + GROUP]) for k in range(0, len(order), GROUP)]
        self.sizes = [np.array([len(sets[i]) for i in g]) for g in self.members]
        self.unions, self.has = [], []
        for g in self.members:
            union, at = np.unique(np.concatenate([sets[i] for i in g]), return_inverse=True)
            has = np.zeros((len(union), len(g)), np.uint8)
            has[at, np.repeat(np.arange(len(g)), [len(sets[i]) for i in g])] = 1
            self.unions.append(union)
            self.has.append(has)

    def linked(self, tokens: np.ndarray, k: int, num: int, den: int) -> np.ndarray:
        """Members of group k whose similarity with a query is num / den or more."""
        n, sizes = len(tokens), self.sizes[k]
        fits = (num * sizes <= den * n) & (num * n <= den * sizes)
        if not fits.any():
            return self.members[k][:0]
        needed = (num * (n + sizes) + num + den - 1) // (num + den)
        union = self.unions[k]
        at = np.searchsorted(union, tokens)
        at[at == len(union)] = 0
        at = at[union[at] == tokens]
        if len(at) < needed[fits].min():  # the union leaves no room for such a member
            return self.members[k][:0]
        return self.members[k][fits & (self.has[k][at].sum(axis=0, dtype=np.int32) >= needed)]


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])
_LINKS = "a long, b long, n long"


def _compared(num: int, den: int):
    """The number of links of each class of a block, and links (a, b) that connect what can be connected.

    A block holds the classes of two sides that visit one leader, or of one side.  Two classes are compared here if
    this is the least leader that both visit.
    """

    def compare(block: pa.Table) -> pa.Table:
        leader, low, high = (block.column(c)[0].as_py() for c in ("leader", "low", "high"))
        names, sides = block.column("doc").to_pylist(), block.column("side").to_pylist()
        leaders = [frozenset(x) for x in block.column("leaders").to_pylist()]
        homes = np.array([min(x) for x in leaders])
        sets = [np.frombuffer(x, np.uint64) for x in block.column("tokens").to_pylist()]
        groups = _Groups(sets, [i for i, s in enumerate(sides) if s == low])
        met = [homes[g] if (homes[g] == homes[g[0]]).all() and homes[g[0]] < leader else None for g in groups.members]
        same: dict[int, list[int]] = {}  # sets of a class name: several where an id has several texts
        for i, s in enumerate(sides):
            if s == high:
                same.setdefault(names[i], []).append(i)
        root = list(range(len(names)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        found: list[tuple[int, int]] = []
        numbers: Counter = Counter()
        for name, own in same.items():
            partners: dict[int, int] = {}
            for i in own:
                for k in range(len(groups.members)):
                    if met[k] is not None and met[k][0] == homes[i]:
                        continue
                    for j in groups.linked(sets[i], k, num, den).tolist():
                        if (names[j] < name or low != high) and min(leaders[i] & leaders[j], default=None) == leader:
                            partners[names[j]] = j
            for other, j in partners.items():
                numbers[name] += 1
                numbers[other] += 1
                if find(own[0]) != find(j):
                    root[find(own[0])] = find(j)
                    found.append((name, other))
        n = len(found)
        return pa.Table.from_batches([batch_of(_LINK, [[x[0] for x in found] + list(numbers), [x[1] for x in found] + [None] * len(numbers), [None] * n + list(numbers.values())])])

    return compare


def jaccard_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, num: int = 9, den: int = 10) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, class_id (least id with the same set), n_links (other classes that the class
    links with), component_id.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; documents link at a Jaccard similarity of num / den.

    Defined cases: a text that is null, empty or without words has no shingles, links with nothing and is its own
    class and component; a row without id links with nothing and has null ids; rows that share an id are one document,
    whose links are those of all its rows; other columns are ignored; an empty table gives no rows.
    """
    parts = Parts(num, den)
    schema = pa.schema([("doc", pa.int64()), ("n", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64())])
    entry = pa.schema([("row", pa.int64()), ("c1", pa.int64()), ("tag", pa.int64())])

    def named_by(tokens: np.ndarray, seed: int) -> np.int64:
        return np.uint64(sequence_hash(tokens, seed)).astype(np.int64)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(text, shingle) for text in as_bytes(batch.column(1))]
            yield batch_of(schema, [batch.column(0), [len(t) for t in sets], [named_by(t, 1) for t in sets], [named_by(t, 2) for t in sets]])

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = {t.tobytes(): t for t in (shingle_set(text, shingle) for text in as_bytes(batch.column(1))) if len(t)}
            entered = [parts.rows(t) for t in sets.values()]
            if entered:
                names = np.repeat([named_by(t, 1) for t in sets.values()], [len(r) for r, _ in entered])
                yield batch_of(entry, [signed(np.concatenate([r for r, _ in entered])), names, np.concatenate([t for _, t in entered])])

    source = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    scanned = written(source.mapInArrow(scan, "doc long, n long, c1 long, c2 long"), "ngram-scan")

    # 1. classes of equal sets
    named = scanned.where("doc IS NOT NULL AND n > 0")
    reps = written(named.groupBy("c1", "c2").agg(F.min("doc").alias("rep"), F.first("n").alias("size")), "ngram-classes")
    reps_of_sizes = reps.groupBy(F.col("rep").alias("doc")).agg(F.max("size").alias("size"))
    repeated = named.groupBy("doc").count().where("count > 1").select("doc")
    again = not repeated.isEmpty()
    of_class = named.join(repeated, "doc").join(reps, ["c1", "c2"]).select("doc", "rep")
    shared_ids = of_class.groupBy("doc").agg(F.min("rep").alias("a"), F.collect_set("rep").alias("reps")).where(F.size("reps") > 1).select("a", F.explode("reps").alias("b"))

    # 2. the rows that several classes have
    # The texts are read twice rather than keeping all rows: few are shared, and those alone are kept.
    entries = source.where("doc IS NOT NULL").mapInArrow(enter, "row long, c1 long, tag long")
    crowded = written(entries.groupBy("row").agg(F.min("c1").alias("x"), F.max("c1").alias("y")).where("x != y").select("row"), "ngram-rows")
    shared = written(entries.join(if_small(crowded, 1_000_000), "row").distinct(), "ngram-shared")

    # 3. the prefix of each class, and the leader of each row
    empty, left = F.col("tag").bitwiseAND(F.lit(EMPTY)), F.col("tag").bitwiseAND(F.lit(EMPTY - 1))
    counted = shared.join(shared.groupBy("row").agg(F.count("*").alias("n")), "row").withColumn("empty", empty)
    place = F.row_number().over(Window.partitionBy("c1", F.col("tag").bitwiseAND(F.lit(-2 * EMPTY))).orderBy(F.desc("empty"), F.desc("n"), "row"))
    prefix = counted.withColumn("place", place).where(F.col("place") > left).select("row", "c1")
    prefix = written(prefix.join(reps.select("c1", F.col("rep").alias("doc")), "c1").select("row", "doc").distinct(), "ngram-prefixes")
    led = prefix.groupBy("row").agg(F.min("doc").alias("leader"), F.max("doc").alias("last")).where("leader != last").select("row", "leader")

    # 4. visits, but those where everybody has met at an earlier leader
    visits = prefix.join(led, "row").groupBy("doc").agg(F.array_sort(F.collect_set("leader")).alias("leaders"))
    visits = written(visits.join(reps_of_sizes, "doc"), "ngram-visits")
    each = visits.select("doc", F.col("leaders")[0].alias("home"), "size", F.explode("leaders").alias("leader"))
    gatherings = each.groupBy("leader").agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.min("home").alias("x"), F.max("home").alias("y"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK, F.col("size") / BLOCK_TOKENS)).cast("long")
    gatherings = written(gatherings.where("x != y OR x = leader").select("leader", blocks.alias("blocks")), "ngram-leaders")
    dealt = visits.withColumn("leader", F.explode("leaders")).join(if_small(gatherings), "leader")
    dealt = dealt.withColumn("side", F.pmod(F.xxhash64("doc"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("doc", "leaders", "leader", "side", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"))

    # 5. comparison
    sets = _sets(source.join(if_small(visits.select("doc")), "doc", "left_semi"), shingle)
    sets = written(sets.distinct() if again else sets, "ngram-sets")
    found = written(dealt.join(sets, "doc").groupBy("leader", "low", "high").applyInArrow(_compared(num, den), _LINKS), "ngram-links")
    links = found.where("n IS NULL").select("a", "b")
    joined = components(links.union(shared_ids) if again else links)

    of_rep = joined.select(F.col("node").alias("rep"), "component")
    numbers = found.where("n IS NOT NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n_links"))
    answer = reps.join(of_rep, "rep", "left").join(numbers, "rep", "left").select("c1", "c2", "rep", "n_links", F.coalesce("component", "rep").alias("component"))
    linked = scanned.where("doc IS NOT NULL AND n > 0").join(answer, ["c1", "c2"], "left")
    lone = scanned.where("doc IS NULL OR n = 0").select("doc", "n", F.col("doc").alias("rep"), F.lit(0).cast("long").alias("n_links"), F.col("doc").alias("component"))
    rows = linked.select("doc", "n", "rep", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component").union(lone)
    return rows.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("rep").alias("class_id"), "n_links", F.col("component").alias("component_id"))
