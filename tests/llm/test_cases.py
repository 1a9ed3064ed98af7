"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textmill.llm import byte_bpe, chat_format, components, fingerprints, lm_scoring, ngram_join, packing, quality_rules, sentencepiece_codec, shared, substring_dedup, token_counts, warc
from textmill.llm.queries import vocabulary

BPE, PIECES = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
KIND = "doc_id long, text string, n_words string, doc string, row int, _tm_text string"
LONG = " ".join(f"w{i}" for i in range(60_000))


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", "y", 1, "z") for d, t in rows], KIND)


ROWS = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two"), (5, "one two"), (None, "one two three four"), (None, None), (6, LONG), (7, LONG), (8, "a  b\n\n c "), (9, "日本 x▁y 😀\x00\x1c z"), (10, "<|endoftext|> </s>")]

OPERATORS = {
    "token_counts": lambda d: token_counts.token_counts(d, PIECES),
    "ngram_join": lambda d: ngram_join.jaccard_components(d),
    "fingerprints": lambda d: fingerprints.fingerprints(d),
    "substring_dedup": lambda d: substring_dedup.repeated_spans(d),
    "without_repeats": lambda d: substring_dedup.without_repeats(d),
    "quality_rules": lambda d: quality_rules.ledger(d),
    "lm_scoring": lambda d: lm_scoring.score(d, common=4, unit_words=2, suffixes=4, classes=3),
    "sentencepiece": lambda d: sentencepiece_codec.encode(d, PIECES),
    "packing": lambda d: packing.pack(d, BPE, with_ids=True),
    "warc": lambda d: warc.write_archives(d.withColumn("url", F.lit(None).cast("string")), shared.new_folder(d.sparkSession, "t"), id_col="doc_id", payload_col="text"),
    "chat_format": lambda d: chat_format.format_windows(d.selectExpr("doc_id AS conv_id", "n_words AS role", "row AS turn", "text", "doc"), BPE),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_odd_rows_and_empty_tables(spark, name):
    got = OPERATORS[name](frame(spark, ROWS)).collect()
    if name == "packing":
        ids = [(r["doc_id"], r["start"]) for r in got]
        assert ids.count((5, 0)) == 2 and ids.count((1, 0)) == 1
        assert all(len(r["ids"]) == r["length"] for r in got)
    elif name == "chat_format":
        assert sum(r["n_turns"] for r in got) == len(ROWS)
    elif name == "without_repeats":
        assert sorted(r["doc_id"] for r in got if r["doc_id"]) == [1, 2, 3, 4, 5, 5, 6, 8, 9, 10]
    else:
        assert len(got) == len(ROWS)
    assert OPERATORS[name](frame(spark, [])).collect() == []


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(16)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    random.seed(2)
    random.shuffle(edges)
    found = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(17)} | {i: 100 for i in range(100, 160)}


def brute_components(texts, size, num, den):
    sets = {}
    for d, t in texts.items():
        w = t.translate({c: c + 32 for c in range(65, 91)}).encode().split()
        sets[d] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and den * both >= num * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in texts}


@pytest.mark.parametrize("size,num,den,block", [(3, 9, 10, 512), (5, 4, 5, 512), (3, 9, 10, 4), (2, 1, 2, 8)])
def test_ngram_join_brute_force(spark, monkeypatch, size, num, den, block):
    """Families of edited copies, exact copies, a passage in every second text; small blocks make several meet."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "GROUP", 3)
    r = random.Random(size * num)
    word = lambda: f"w{r.randrange(400)}"
    passage = [word() for _ in range(30)]
    texts = {}
    for f in range(6):
        base = [word() for _ in range(r.choice([4, 20, 60, 200]))]
        for _ in range(30):
            own = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 5])):
                own[r.randrange(len(own))] = word()
            if r.random() < 0.2:
                own = own[: r.randrange(1, len(own) + 1)]
            texts[len(texts) * 7 % 1009] = " ".join(own + passage * (r.random() < 0.3)).title()
    got = ngram_join.jaccard_components(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), shingle=size, num=num, den=den).collect()
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got} == brute_components(texts, size, num, den)


@pytest.mark.parametrize("window, bits", [(2, 64), (5, 64), (13, 64), (5, 8), (13, 5)])
def test_substring_dedup_brute_force(spark, window, bits):  # few bits: hashes of unequal windows meet
    r = random.Random(window)
    bank = [f"w{r.randrange(60)}" for _ in range(400)]
    texts = {}
    for d in range(120):
        own = []
        for _ in range(r.randrange(0, 6)):
            at = r.randrange(len(bank))
            own += bank[at : at + r.randrange(0, 40)] if r.random() < 0.6 else [f"x{r.randrange(10)}" for _ in range(r.randrange(20))]
        texts[d * 13 % 127] = " ".join(own)
    first = {}
    for d in sorted(texts):
        w = texts[d].split()
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), d)
    for row in substring_dedup.repeated_spans(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), window=window, bits=bits).collect():
        w = texts[row["doc_id"]].split()
        gone = {i + k for i in range(len(w) - window + 1) if first[tuple(w[i : i + window])] < row["doc_id"] for k in range(window)}
        assert row["n_removed"] == len(gone)
        assert {s["start"] + k for s in row["spans"] for k in range(s["length"])} == gone
        if gone:
            assert row["kept_text"] == " ".join(x for i, x in enumerate(w) if i not in gone)


def test_fast_ids_are_the_library(spark):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(BPE), byte_bpe.ByteBpe(BPE)
    r = random.Random(5)
    alphabet = ["a", "the", " ", " ", "  ", "\n", "\t", "\r\n", "1", "é", "日", "'s", "😀", " ", "　", "\x85", ".", "<|endoftext|>", "word"]
    for _ in range(1500):
        text = "".join(r.choice(alphabet) for _ in range(r.randrange(25)))
        assert np.frombuffer(own.ids(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_unigram_ties_and_fallback():
    """Small vocabularies with equal scores, against the library."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    from textmill.llm.unigram import Pieces

    r = random.Random(3)
    for _ in range(20):
        words = sorted({"".join(r.choice("abc") for _ in range(r.randrange(1, 5))) for _ in range(14)} | {"▁", "▁a", "▁ab"})
        spec = pb.ModelProto()
        for text, kind in [("<unk>", 2), ("<s>", 3), ("</s>", 3), *((f"<0x{b:02X}>", 6) for b in range(256))]:
            spec.pieces.add(piece=text, score=0, type=kind)
        scores = {w: float(-r.randrange(1, 4)) for w in words}
        for w in words:
            spec.pieces.add(piece=w, score=scores[w], type=1)
        spec.trainer_spec.model_type, spec.trainer_spec.byte_fallback = 1, True
        spec.normalizer_spec.name, spec.normalizer_spec.add_dummy_prefix, spec.normalizer_spec.remove_extra_whitespaces = "identity", True, False
        library = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
        own = Pieces({w: 259 + i for i, w in enumerate(words)}, scores, list(range(3, 259)), ["", "", "", *(f"<0x{b:02X}>" for b in range(256)), *words], min(scores.values()) - 10)
        codec, counter = sentencepiece_codec.Codec(own), token_counts.Counter(own)
        for _ in range(60):
            text = "".join(r.choice("aabbcc d\né") for _ in range(r.randrange(16)))
            wanted = library.encode(text)
            assert np.frombuffer(codec.encode(text), "<i4").tolist() == wanted, repr(text)
            assert counter.count(text)[0] == len(wanted)
            assert codec.decode(codec.encode(text)) == text


def test_groups_of_equal_canonical_texts(spark):
    rows = [(1, "A b"), (2, "a  B"), (3, "other"), (4, "OTHER")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc"]: r["group_id"] for r in fingerprints.exact_groups(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 3}


def test_warc_revisits_ties_and_ranges(spark):
    rows = [(2, "u2", "same"), (1, "u1", "same"), (3, "u\n3", None), (4, None, ""), (None, "n", "same"), (5, "u5", "é" * 100_000), (1, "again", "same")]
    folder = shared.new_folder(spark, "warc-test")
    index = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), folder)
    back = warc.read_records(index, folder).collect()
    assert sorted((r["page_id"] or 0, r["record_type"], r["refers_to"] or 0, r["payload_bytes"]) for r in back) == [(0, "revisit", 1, 4), (1, "response", 0, 4), (1, "response", 0, 4), (2, "revisit", 1, 4), (3, "response", 0, 0), (4, "revisit", 3, 0), (5, "response", 0, 200_000)]
    one = warc.read_records(index.where("page_id = 5"), folder).collect()
    assert bytes(one[0]["payload"]).decode() == "é" * 100_000


def test_long_conversation_windows(spark):
    rows = [(1, 0, "system", "be brief")] + [(1, i, "user" if i % 2 else "assistant", f"turn {i} " + "word " * (i % 40)) for i in range(1, 300)]
    windows = chat_format.format_windows(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), BPE, budget=200, history=60).collect()
    assert len(windows) > 10 and all(w["n_tokens"] <= 200 for w in windows)
    assert [t for w in windows for t in chat_format.parse_turns(w["text"])[w["n_context"] :]] == [(r[2], r[3]) for r in rows]
    assert all(chat_format.parse_turns(w["text"])[0] == ("system", "be brief") for w in windows)
    assert any(w["n_context"] > 1 for w in windows)


def test_ablation_counts(spark):
    texts = [(1, "word " * 60), (2, "few"), (3, " ".join(f"w{i}" for i in range(60))), (4, " ".join(f"#{i}" for i in range(60)))]
    book = quality_rules.ledger(spark.createDataFrame(texts, "doc_id long, text string"))
    policy = quality_rules.POLICIES["v1"]
    found = {r["rule"]: (r["n_failed"], r["n_failed_alone"], r["n_kept_without"]) for r in quality_rules.ablation(book, policy).collect()}
    assert found == {"few_words": (1, 1, 2), "repeated_windows": (1, 1, 2), "many_symbols": (1, 1, 2)}
    assert [r["doc_id"] for r in book.where(quality_rules.passes(policy)).collect()] == [3]


def test_unbroken_text_is_counted_with_the_memory_of_its_characters():
    import tracemalloc

    own = token_counts.Counter(token_counts.counter(PIECES).pieces)
    rng = random.Random(4)
    text = "".join(rng.choice("abcde\u00e9\u65e5") for _ in range(100_000))
    short = text[:300]
    assert own.count(short)[0] == len(sentencepiece_codec.Codec(own.pieces).encode(short)) // 4
    tracemalloc.start()
    own.count(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * len(text)


def test_system_turns_up_to_and_beyond_the_budget(spark):
    kind = "conv_id long, turn long, role string, text string"
    rows = [(c, 0, "system", "law " * size) for c, size in ((1, 10), (2, 60), (3, 97), (4, 400))]
    rows += [(c, i, "user" if i % 2 else "assistant", f"turn {i} " + "word " * 20) for c in (1, 2, 3, 4) for i in range(1, 30)]
    windows = chat_format.format_windows(spark.createDataFrame(rows, kind), BPE, budget=100, history=30).cache()
    for conv in (1, 2, 3, 4):
        own = sorted((w for w in windows.collect() if w["conv_id"] == conv), key=lambda w: w["window"])
        size = lambda role, text: len(byte_bpe.byte_bpe(BPE).ids(chat_format.render(role, text)[0])) // 4
        system = size("system", next(r[3] for r in rows if r[0] == conv))
        assert own[0]["has_system"]
        assert all(w["n_tokens"] <= 100 for w in own[system > 100 :])  # a first turn alone beyond the budget is a longer window
        for w in own[1:]:
            turns = chat_format.parse_turns(w["text"])
            assert w["has_system"] == (turns[0][0] == "system") == (system + size(*turns[w["n_context"]]) <= 100)
        assert [t for w in own for t in chat_format.parse_turns(w["text"])[w["n_context"] :]] == [(r[2], r[3]) for r in rows if r[0] == conv]
    plain = chat_format.read_back(windows.orderBy("window").repartition(5))
    assert sorted(plain.collect()) == sorted(chat_format.read_back(chat_format.format_windows(spark.createDataFrame(rows, kind), BPE, budget=100, history=30), in_order=True).collect())
