"""Numbers of links between classes."""

import random
from collections import Counter

from textmill.llm import ngram_join


def brute_links(texts):
    sets = {d: frozenset(ngram_join.shingle_set(t.encode(), 3).tolist()) for d, t in texts.items()}
    rep = {}
    for d in sorted(sets):
        rep.setdefault(sets[d], d)
    classes = sorted(rep.values())
    n = Counter()
    for i, a in enumerate(classes):
        for b in classes[:i]:
            if 10 * len(sets[a] & sets[b]) >= 9 * len(sets[a] | sets[b]) > 0:
                n.update((a, b))
    return {d: (rep[s], n[rep[s]]) if s else (d, 0) for d, s in sets.items()}


def test_every_link_of_near_copies_counts(spark, monkeypatch):
    rng = random.Random(3)
    texts, d = {}, 0
    for group in range(3):
        base = [f"g{group}w{i}" for i in range(200)]
        for _ in range(25):
            words = base[:]
            for _ in range(rng.choice([0, 1, 2, 3, 4])):
                words[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
            texts[d := d + 1] = " ".join(words)
    texts[d + 1] = ""
    wanted = brute_links(texts)
    for block in (512, 8):  # in one block, and across blocks
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        rows = ngram_join.jaccard_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
        assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in rows} == wanted
    assert max(n for _, n in wanted.values()) > 2


def test_an_id_with_and_without_words(spark):
    words = " ".join(f"w{i}" for i in range(100))
    rows = [(1, None), (1, words), (1, ""), (2, words + " more"), (3, "other words here")]
    found = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["n_links"], r["component_id"]) for r in found) == [(1, 0, 0, 1), (1, 0, 0, 1), (1, 98, 1, 1), (2, 99, 1, 1), (3, 1, 0, 3)]
