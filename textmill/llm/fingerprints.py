"""Document fingerprints: a canonical exact digest.

A text is normalised (NFKC), case-folded, and its runs of white space become one space; the fingerprint is the 128-bit
xxHash of the UTF-8 of that canonical text, in hex.  Equal fingerprints are a bucket; inside one, canonical texts are
compared byte by byte, so groups are exact whatever the hash does.

Defined cases: a null text is empty; an empty text has the fingerprint of the empty string; a null id sorts after
every id in descending order; rows with equal ids follow each other in text order; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_128_hexdigest

from textmill.llm.shared import as_texts, batch_of, bounded_batches, if_small, written

LEAST = -(2**63)
RANGE_BYTES = 64 * 2**20  # of texts, in a range of ids


def canonical(text: str) -> bytes:
    """NFKC, case folding (and NFKC again, which folding can undo), white space to single spaces.

    >>> canonical("  Ｆｉｎｅ\\n STRASSE ") == canonical("fine straße")
    True
    """
    folded = text.casefold() if text.isascii() else unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode()


def fingerprint(text: str) -> str:
    return xxh3_128_hexdigest(canonical(text))


def edited(text: str, following: str) -> str:
    """The last third of text replaced by as much of the beginning of the following text."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def exact_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, group_id) for the documents whose canonical text another document has: the least id of the group.

    Fingerprints are grouped first; only texts in buckets of several are shuffled, and compared with the text of the
    bucket's least document.  Those that differ (a collision of the hash) group by their bytes among themselves.
    """
    schema = pa.schema([("fingerprint", pa.string()), ("doc", pa.int64()), ("bytes", pa.binary())])

    def scan(with_bytes: bool):
        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = [canonical(t) for t in as_texts(batch.column(1))]
                yield batch_of(schema, [[xxh3_128_hexdigest(t) for t in texts], batch.column(0), texts if with_bytes else [None] * len(texts)])

        return f

    source = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text")).where("doc IS NOT NULL")
    kind = "fingerprint string, doc long, bytes binary"
    counted = source.mapInArrow(scan(False), kind).groupBy("fingerprint").agg(F.min("doc").alias("least"), F.max("doc").alias("most"))
    buckets = written(counted.where("least != most").select("fingerprint", "least"), "fingerprint-counts")
    rows = written(source.mapInArrow(scan(True), kind).join(if_small(buckets), "fingerprint"), "fingerprint-buckets")
    heads = rows.where("doc = least").groupBy("fingerprint").agg(F.min("bytes").alias("head"))
    compared = rows.join(heads, "fingerprint").select("fingerprint", "doc", "least", (F.col("bytes") == F.col("head")).alias("same"), F.when(F.col("bytes") != F.col("head"), F.col("bytes")).alias("other"))
    differ = compared.where("NOT same").select("fingerprint", "other", "doc")
    strays = differ.join(differ.groupBy("fingerprint", "other").agg(F.min("doc").alias("group_id")), ["fingerprint", "other"]).select("doc", "group_id")
    return compared.where("same").select("doc", F.col("least").alias("group_id")).union(strays).distinct()


def _ranges(keys: DataFrame, parts: int) -> tuple[np.ndarray, dict[int, int]]:
    """Bounds of ranges of about equal size, and for the largest key of each range the range just above it.

    The least range follows the greatest one in a circle.  What comes to the driver is one row a range.
    """
    cuts = keys.approxQuantile("key", [i / parts for i in range(1, parts)], 0.25 / parts) if parts > 1 else []
    bounds = np.unique(np.array([int(max(min(c, 2**62), -(2**62))) for c in cuts], np.int64))
    bucket = _bucket(bounds)
    heads = sorted((r["b"], r["k"]) for r in keys.groupBy(bucket("key").alias("b")).agg(F.max("key").alias("k")).collect())
    return bounds, {k: heads[(i + 1) % len(heads)][0] for i, (_, k) in enumerate(heads)}


def _bucket(bounds: np.ndarray):
    @F.pandas_udf("long")
    def bucket(key: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, key.to_numpy(), side="right").astype(np.int64))

    return bucket


def fingerprint_pairs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, fingerprint, and how its edited text and the next document compare.

    The next document is the one of the next smaller id (of the least: the greatest).  Ids alone give ranges of equal
    size; texts are dealt by range once and sorted, and the first row of each range is sent to the range before it as
    well, so every task streams its rows with the one that follows.  edited_sha256 is of the edited text's UTF-8;
    near_edited and near_next are 1.0 where the canonical texts are equal, byte by byte, else 0.0.
    """
    spark = docs.sparkSession
    rows = bounded_batches(docs).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("key", F.coalesce("doc", F.lit(LEAST)))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    bounds, above = _ranges(rows.select("key"), parts)
    heads = np.array(sorted(above), np.int64)
    targets = np.array([above[int(k)] for k in heads], np.int64)

    @F.pandas_udf("array<long>")
    def places(key: pd.Series) -> pd.Series:
        k = key.to_numpy()
        own = 2 * np.searchsorted(bounds, k, side="right")
        at = np.minimum(np.searchsorted(heads, k), max(len(heads) - 1, 0))
        ghost = heads[at] == k if len(heads) else np.zeros(len(k), bool)
        return pd.Series([[o, 2 * targets[a] + 1] if g else [o] for o, a, g in zip(own, at, ghost, strict=True)])

    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = None, None  # held: id, text and canonical text of the row whose next row is to come

        for batch in batches:
            out = []
            for doc, text, at in zip(batch.column(0).to_pylist(), as_texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                own = canonical(text)
                if held is not None and at >> 1 == place:
                    change = edited(held[1], text)
                    after = canonical(change)
                    out.append((held[0], len(held[1]), sha256(change.encode()).hexdigest(), xxh3_128_hexdigest(held[2]), xxh3_128_hexdigest(after), float(after == held[2]), float(own == held[2])))
                place, held = at >> 1, None if at & 1 else (doc, text, own)
            if out:
                yield batch_of(schema, [list(c) for c in zip(*out, strict=True)])

    dealt = rows.withColumn("place", F.explode(places("key"))).repartitionById(parts, F.shiftright("place", 1).cast("int"))
    sorted_rows = dealt.sortWithinPartitions(F.shiftright("place", 1), F.col("place").bitwiseAND(1), F.col("key").desc(), "text")
    return sorted_rows.select("doc", "text", "place").mapInArrow(stream, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """fingerprint_pairs with ``group_id``, the least id with the same canonical text (null for a row without id)."""
    pairs = written(fingerprint_pairs(docs, id_col=id_col, text_col=text_col), "fingerprint-pairs")
    groups = exact_groups(docs, id_col=id_col, text_col=text_col).groupBy("doc").agg(F.min("group_id").alias("group_id"))
    return pairs.join(groups, pairs["doc_id"] == groups["doc"], "left").select(*pairs.columns, F.coalesce("group_id", "doc_id").alias("group_id"))
