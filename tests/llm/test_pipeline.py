"""The pipeline's stages against a brute-force version over whole small tables, and on odd rows."""

import re
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from textmill.llm import shared
from textmill.llm.queries import vocabulary

STAGES = dict(corpus_pipeline.STAGES)
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def kept_by_rules(text):
    words = WORD.findall(text or "")
    starts = {}
    for i in range(len(words) - 2):
        starts.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeated = {i + k for places in starts.values() if len(places) > 1 for i in places for k in range(3)}
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words) >= 50 and 100 * len(repeated) <= 50 * len(words) and 10 * symbols <= len(words)


def components(texts):
    sets = {}
    for d, t in texts.items():
        w = t.translate({c: c + 32 for c in range(65, 91)}).encode().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both and 5 * both >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in ids}


def without_repeats(texts, window=13):
    first, out = {}, {}
    for d in sorted(texts):
        w = texts[d].split()
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), d)
    for d, t in texts.items():
        w = WORD.findall(t)
        gone = {i + k for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < d for k in range(window)}
        left = " ".join(x for i, x in enumerate(w) if i not in gone) if gone else t
        if left or not gone:
            out[d] = left
    return out


def test_stages_and_run(spark, sf_dir):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}

    texts = {d: t for d, t in texts.items() if kept_by_rules(t)}
    a = shared.written(STAGES["quality_rules"](spark, docs, sf_dir), "t1")
    assert a.dtypes == docs.dtypes and {r["doc_id"]: r["text"] for r in a.collect()} == texts

    texts = {d: texts[d] for d, c in components(texts).items() if c == d}
    b = shared.written(STAGES["ngram_jaccard_join"](spark, a, sf_dir), "t2")
    assert b.dtypes == docs.dtypes and {r["doc_id"]: r["text"] for r in b.collect()} == texts

    texts = without_repeats(texts)
    c = shared.written(STAGES["substring_dedup"](spark, b, sf_dir), "t3")
    assert c.dtypes == docs.dtypes and {r["doc_id"]: r["text"] for r in c.collect()} == texts
    assert all(r["n_chars"] == len(r["text"]) for r in c.collect())

    tokenizer = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    wanted = set()
    for d, t in texts.items():
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4")
        wanted.add((d, len(ids), zlib.crc32(ids[:1].tobytes()) if len(ids) == 1 else None))
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {(r["doc_id"], r["doc_tokens"]) for r in got} == {(d, n) for d, n, _ in wanted}
    assert len({r["sequence_id"] for r in got}) == len(got)


def test_odd_rows(spark, sf_dir):
    words = " ".join(f"w{i}" for i in range(80))
    rows = [(1, words, "en", "s", 1), (1, words, "en", "s", 1), (2, words + " x", "en", "s", 1), (None, words, None, None, None), (3, None, "en", "s", None), (4, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"row": F.lit(1), "place": F.lit("p")})
    got = []
    for name, stage in corpus_pipeline.STAGES:
        docs = shared.written(stage(spark, docs, sf_dir), "odd")
        got.append(sorted((r["doc_id"] or 0) for r in docs.collect()))
    assert got[0] == [0, 1, 1, 2] and got[1] == [0, 1] and got[2] == [1]  # the row without id comes last and repeats 1
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).collect() == []
