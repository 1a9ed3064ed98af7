"""Each query against its SQL or a brute-force version, over whole small tables."""

import zlib
from base64 import b32encode
from collections import Counter
from hashlib import sha1, sha256

import numpy as np
import pytest

from textmill.llm import chat_format, fingerprints, lm_scoring, packing, queries
from textmill.llm.queries import vocabulary

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(name, same_as_sql):
    same_as_sql(queries.queries()[name], SQL[name])


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


def result(spark, sf_dir, name):
    return queries.queries()[name](spark, sf_dir).collect()


def unigram_library(path):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    spec = pb.ModelProto()
    with open(path, "rb") as f:
        spec.ParseFromString(f.read())
    spec.trainer_spec.model_type = 1
    floor = min(p.score for p in spec.pieces if p.type == 1 and p.score > -1e8) - 1
    for p in spec.pieces:
        if p.type == 1:
            p.score = max(p.score, floor)
    return sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())


def test_op1_and_op9_are_the_library(spark, sf_dir, docs):
    library = unigram_library(vocabulary("piece_bpe_32k.model"))
    wanted = {d: library.encode(t) for d, t in docs}
    assert {r["doc_id"]: r["n_tokens"] for r in result(spark, sf_dir, "op1_token_counts")} == {d: len(x) for d, x in wanted.items()}
    found = result(spark, sf_dir, "op9_sentencepiece")
    assert {r["doc_id"]: r["ids_crc32"] for r in found} == {d: zlib.crc32(np.array(x, "<i4").tobytes()) for d, x in wanted.items()}
    text = dict(docs)
    assert all(r["round_trip"] and r["decoded_sha256"] == sha256(text[r["doc_id"]].encode()).hexdigest() for r in found)


def test_op2_digests(spark, sf_dir):
    pages = {r["page_id"]: (r["html"] or "").encode() for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    first = {}
    for page in sorted(pages):
        first.setdefault(pages[page], page)
    for r in result(spark, sf_dir, "op2_warc"):
        html = pages[r["page_id"]]
        assert r["payload_bytes"] == len(html) and r["payload_digest"] == b32encode(sha1(html).digest()).decode()
        assert r["refers_to"] == (None if first[html] == r["page_id"] else first[html])
        assert r["record_type"] == ("response" if r["refers_to"] is None else "revisit")


def test_op4_brute_force(spark, sf_dir, docs):
    order = sorted(docs, reverse=True)
    groups = {}
    for d, t in sorted(docs):
        groups.setdefault(fingerprints.canonical(t), d)
    found = {r["doc_id"]: r for r in result(spark, sf_dir, "op4_fingerprints")}
    assert len(found) == len(docs)
    for (d, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        cut = len(text) // 3
        change = text[: len(text) - cut] + after[:cut]
        r = found[d]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), sha256(change.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (fingerprints.fingerprint(text), fingerprints.fingerprint(change))
        assert r["near_edited"] == float(fingerprints.canonical(text) == fingerprints.canonical(change))
        assert r["near_next"] == float(fingerprints.canonical(text) == fingerprints.canonical(after))
        assert r["group_id"] == groups[fingerprints.canonical(text)]


def test_op6_brute_force(spark, sf_dir):
    talks = {-1: [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        talks.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"] or ""))
    found = {r["conv_id"]: r for r in result(spark, sf_dir, "op6_chat_format")}
    assert set(found) == set(talks)
    for conv, turns in talks.items():
        turns.sort()
        said = "".join(t for _, role, t in turns if role == "assistant")
        r = found[conv]
        assert r["n_turns"] == len(turns)
        assert r["turns_sha256"] == sha256("".join(f"{role}\n{t}\n" for _, role, t in turns).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(said), sha256(said.encode()).hexdigest())
        assert r["formatted_chars"] > sum(len(t) for _, _, t in turns)


def test_op8_brute_force(spark, sf_dir, docs):
    source = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id AS doc", "text")
    model, _ = lm_scoring.train(source)
    train = [(d, t) for d, t in docs if zlib.crc32(str(d).encode()) % 10]
    tokens = lambda t: [*t.translate({c: c + 32 for c in range(65, 91)}).encode().split(), b""]
    counts = Counter(w for _, t in train for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    kind = {w: int(model.classes[model.units([w])[1][0]]) for w in {x for _, t in docs for x in tokens(t)}}
    sizes, kinds = Counter(), Counter()
    for w, c in counts.items():
        sizes[kind[w]] += c
        kinds[kind[w]] += 1
    steps = np.zeros((48, 48))
    for _, t in train:
        own = [kind[w] for w in tokens(t)]
        for a, b in zip([own[-1], *own], own, strict=False):
            steps[a, b] += 1
    steps = (steps + 0.5) / (steps.sum(1, keepdims=True) + 0.5 * 48)
    gain = [0.0, 0.0]
    for r in result(spark, sf_dir, "op8_lm_scoring"):
        own = tokens(dict(docs)[r["doc_id"]])
        base = sum(np.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        chain = [kind[w] for w in own]
        score = sum(np.log10(steps[a, b] * (counts[w] + 0.1) / (sizes[b] + 0.1 * (kinds[b] + 1))) for a, b, w in zip([chain[-1], *chain], chain, own, strict=False))
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(counts[w] > 0 for w in own), n)
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0)
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(score)
        if r["held_out"]:
            gain[0] += r["base_score"]
            gain[1] += r["score"]
    assert gain[1] > gain[0]  # held-out text is likelier under the class model


def test_op10_brute_force(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    pieces, sequences = {}, {}
    for r in result(spark, sf_dir, "op10_packing"):
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    assert set(pieces) == {d for d, _ in docs}
    for d, text in docs:
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(pieces[d], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for rows in sequences.values():
        assert len(rows) == 1 and rows[0]["offset"] == 0  # a power of two: no padding
        assert rows[0]["length"] in {2**k for k in range(12)}


def test_decompose():
    for longest in (1, 8, 2048):
        for n in (1, 2, 7, 8, 9, 2047, 2048, 5000):
            at = 0
            for start, length in packing.decompose(n, longest):
                assert start == at and length <= longest and length & (length - 1) == 0
                at += length
            assert at == n


def test_escape_round_trip():
    for text in ["", "\\", "a\\b <s>", "</s>[INST] ok [/INST]", "<\\s>", "<<SYS>><s>", "<<s>\\\\n", "<s<s>>"]:
        hidden = chat_format.escape(text)
        assert chat_format.unescape(hidden) == text
        assert not any(c in hidden for c in chat_format.CONTROL)
        assert chat_format.parse_turns(chat_format.render("us\ner<s>", text)[0]) == [("us\ner<s>", text)]
