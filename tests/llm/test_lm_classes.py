"""Classes of words by their own contexts."""

import random

import numpy as np
import pyarrow as pa

from textmill.llm import lm_scoring


def test_words_of_one_ending_part_by_their_contexts(spark):
    rng = random.Random(1)
    nouns, verbs = ([f"{kind}{i}zz" for i in range(40)] for kind in "nv")
    rows = [(d, " ".join(f"the {rng.choice(nouns)} will {rng.choice(verbs)} ." for _ in range(20))) for d in range(100)]
    model, counts = lm_scoring.train(spark.createDataFrame(rows, "doc long, text string"), classes=4, unit_words=4, common=8)
    kind = {bytes(r["word"]).decode(): r["class"] for r in counts.collect()}
    assert len({kind[w] for w in nouns if w in kind}) == 1 and len({kind[w] for w in verbs if w in kind}) == 1
    assert kind[nouns[0]] != kind[verbs[0]]


def test_exchange_ends_where_no_move_raises_the_likelihood():
    rng = np.random.default_rng(0)
    count = int(lm_scoring.COUNT)
    for _ in range(50):
        n = int(rng.integers(2, 8))
        pairs = rng.integers(0, 4, (n, n)) * rng.integers(0, 2, (n, n))
        contexts = [np.array([2 * b * count + pairs[u, b] for b in range(n) if pairs[u, b]] + [(2 * b + 1) * count + pairs[b, u] for b in range(n) if pairs[b, u]], np.int64) for u in range(n)]
        classes = lm_scoring.exchange(contexts, 3)

        def reached(these, pairs=pairs):
            hot = np.eye(3)[these]
            return lm_scoring._likelihood(hot.T @ pairs @ hot)

        for u in range(n):
            for k in range(3):
                other = classes.copy()
                other[u] = k
                assert reached(other) <= reached(classes) + 1e-6


def test_words_of_many_texts_are_those_of_each():
    rng = random.Random(2)
    texts = [None if rng.random() < 0.1 else "".join(rng.choice("aBZ[@`{é\x1f\x85\u2003 \t\n\v\f\r ") for _ in range(rng.randrange(12))) for _ in range(2000)]
    for kind in (pa.string(), pa.large_string()):
        words, sizes = lm_scoring.tokens_of(pa.array(["x y", *texts, "z"], kind)[1:-1])
        own = [[*(t or "").encode().lower().split(), b""] for t in texts]
        assert sizes.tolist() == [len(w) for w in own] and words.to_pylist() == [x for w in own for x in w]
    assert [len(x) for x in lm_scoring.tokens_of(pa.array([], pa.string()))] == [0, 0]


def test_tables_between_steps_hold_packed_rows(spark, monkeypatch):
    """Not a row for each word, pair or text, whose handling was most of the time; and every word is in them."""
    rows_of, kept = {}, lm_scoring.written

    def counted(df, name):
        table = kept(df, name)
        rows_of[name] = table.count()
        return table

    monkeypatch.setattr(lm_scoring, "written", counted)
    rng = random.Random(3)
    docs = spark.createDataFrame([(d, " ".join(f"w{rng.randrange(20_000)}" for _ in range(60))) for d in range(1000)], "doc_id long, text string").repartition(2)
    out = lm_scoring.score(docs, common=500, unit_words=20).collect()
    assert len(out) == 1000 and {r["n_tokens"] for r in out} == {61} and all(r["n_known"] == 61 for r in out if not r["held_out"])
    assert rows_of and max(rows_of.values()) < 500
