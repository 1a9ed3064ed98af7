"""Operators without SQL, errors, sinks and streams."""

import json

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from textmill.functions import noise
from textmill.functions.calculator import calculate
from textmill.operators import conversations, curriculum, evaluation, runs, sampling, tokens
from textmill.plans.tokens import MARKS, vocabulary
from textmill.sources import files, scratch, sinks
from textmill.streaming import ingest


def test_rendered_conversations(spark):
    t = tokens.tokenizer(vocabulary())
    ids = lambda s: t.encode(s, add_special_tokens=False).ids
    part = lambda kind, text: {"type": kind, "text": text}
    talk = [
        {"role": "system", "parts": [part("text", "Be brief.")]},
        {"role": "user", "parts": [part("text", "2 and 3?")]},
        {"role": "assistant", "parts": [part("text", "That is "), part("python", "2+3"), part("python_output", "5")]},
    ]
    rows = spark.createDataFrame([(1, talk)], f"conv_id long, messages {tokens.MESSAGES}")
    asked = [MARKS.begin, MARKS.user, *ids("Be brief.\n\n2 and 3?"), MARKS.user_end]
    said = [*ids("That is "), *ids("<<2+3="), *ids("5>>"), MARKS.assistant_end]
    found = tokens.rendered(rows, vocabulary(), MARKS).first()
    assert found["ids"] == [*asked, MARKS.assistant, *said]
    assert found["mask"] == [0] * (len(asked) + 1) + [1] * len(said)
    assert tokens.rendered(rows, vocabulary(), MARKS, most=5).first()["ids"] == asked[:5]
    assert tokens.rendered(rows, vocabulary(), MARKS, completion=True).first()["ids"] == [*asked, MARKS.assistant]
    for bad in ([], talk[:1], talk[2:], [talk[1], talk[1]]):
        with pytest.raises(ValueError):
            tokens.turns_of(bad)
    assert "\033[92m" in tokens.visible(found["ids"][-3:-1], [1, 0], vocabulary(), with_ids=True)


def test_token_bytes_and_metrics(spark):
    t = tokens.tokenizer(vocabulary())
    lengths = {r["token"]: r["n_bytes"] for r in tokens.byte_lengths(spark, vocabulary()).collect()}
    assert len(lengths) == t.get_vocab_size() and lengths[t.token_to_id("<|endoftext|>")] == 0
    text = "hello wide world"
    assert sum(lengths[i] for i in t.encode(text).ids) == len(text)
    row = tokens.metrics(spark.createDataFrame([(text,), (None,), ("",)], "text string"), vocabulary(), opening=5).first()
    n = len(t.encode("hello").ids) + len(t.encode(" wide world").ids)
    assert row["bytes_per_token"] == round(16 / n, 4) and row["fertility"] == round(n / 3, 4)


def test_slips(spark):
    rows = spark.createDataFrame([(i, t, role, f"Did you see the needle, {i} times? ") for i in range(60) for t, role in ((0, "user"), (1, "assistant"))], "conv_id long, turn int, role string, text string")
    get = lambda df: {(r["conv_id"], r["turn"]): r["text"] for r in df.collect()}
    before, none, all_, ends = get(rows), get(noise.noised(rows, 0.0)), get(noise.noised(rows, 1.0)), get(noise.noised(rows, 0.0, end_rate=1.0))
    assert none == {k: v.strip() if k[1] == 0 else v for k, v in before.items()}
    assert all(all_[i, 1] == before[i, 1] for i in range(60)) and sum(all_[i, 0] != none[i, 0] for i in range(60)) > 50
    assert all(ends[i, 0] == none[i, 0].rstrip("?") for i in range(60))
    assert all_ == get(noise.noised(rows.repartition(7), 1.0)) and all_ != get(noise.noised(rows, 1.0, seed=1))
    one = spark.createDataFrame([("Needle",)], "text string").select(noise.neighbour_key(F.col("text"), F.lit("k")).alias("x")).first()["x"]
    (at,) = [i for i, (a, b) in enumerate(zip("Needle", one, strict=True)) if a != b]
    assert one[at].lower() in noise.NEIGHBOURS["needle"[at]] and one[at].isupper() == (at == 0)


@pytest.mark.parametrize("text, value", [("2+3*4", 14), ("(1 + 2) / 4", 0.75), ("1,000 - 1", 999), ("7 // 2", 3), ("-2 * -.5", 1.0), ("2**3", None), ("1/0", None), ("(1", None), ("'strawberry'.count('r')", 3), ("__import__('os')", None), ("", None), (None, None)])
def test_calculator(text, value):
    assert calculate(text) == value


def test_priming():
    turns = [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]
    assert conversations.priming(" ", {}) == [] and conversations.priming("x", {"x": turns}) == turns
    assert conversations.priming(json.dumps({"messages": turns}), {}) == turns
    with pytest.raises(ValueError):
        conversations.priming(json.dumps(turns[:1]), {})


def test_strict_readers(spark):
    rows = spark.createDataFrame([(1, "m", "a"), (1, "m", "b"), (2, "n", "b")], "key long, model_id string, prompt string")
    with pytest.raises(ValueError, match="rows: 3; duplicate key: 1; duplicate prompt: 1"):
        files.strict(rows, 4, ["key", "prompt"])
    assert files.strict(rows.where("key = 2"), 1, ["key"]).count() == 1
    with pytest.raises(ValueError, match="1 rows of other models, 1 repeated keys"):
        files.completed(rows, "m")
    assert files.completed(rows.where("key = 2"), "n").count() == 1
    assert files.jsonl_conversations(spark, "/nowhere/x.jsonl").count() == 0
    with pytest.raises(ValueError, match="unknown source"):
        files.load(spark, "x", "y")


def test_retries():
    calls, slept = [], []

    def call():
        calls.append(1)
        if len(calls) < 4:
            raise OSError("5" if len(calls) == 2 else "")
        return "done"

    assert files.retried(call, wait=lambda e: float(str(e)) if str(e) else None, sleep=slept.append) == "done" and slept == [1.0, 5.0, 4.0]
    with pytest.raises(ZeroDivisionError):
        files.retried(lambda: 1 / 0, attempts=2, sleep=slept.append)


def test_shards_and_commits(spark):
    at = scratch.folder(spark, "t").removeprefix("file://")
    docs = spark.range(200).select(F.concat(F.lit("text "), "id").alias("text"), F.lit(1).alias("other")).coalesce(1)
    sinks.write_text_shards(docs, f"{at}/shards")
    (name,) = files.parquet_files(spark, f"{at}/shards")
    meta = pq.ParquetFile(f"{at}/shards/{name}").metadata
    assert [meta.row_group(i).num_rows for i in range(meta.num_row_groups)] == [64, 64, 64, 8] and meta.num_columns == 1
    column = meta.row_group(0).column(0)
    assert column.compression == "ZSTD" and not column.is_stats_set and not column.has_dictionary_page
    sinks.write_atomic(docs, f"{at}/json")
    assert spark.read.json(f"{at}/json").count() == 200
    with pytest.raises(FileExistsError):
        sinks.write_atomic(docs, f"{at}/json")
    counts = spark.createDataFrame([("a", 3), ("b", 5)], "name string, n long")
    card = sinks.card("Books", 10, 2, counts.withColumnRenamed("name", "reason"), counts.withColumnRenamed("name", "topic"))
    sinks.write_string(spark, card, f"{at}/card.md")
    assert open(f"{at}/card.md").read() == card and "| b | 5 | 62.50% |\n| a | 3 | 37.50% |" in card and "2 of 10 rows passed (20.00 %)" in card
    shards = spark.createDataFrame([("s0", 10), ("s0", 5), ("s1", 1)], "shard string, n_chars long")
    assert json.loads(sinks.manifest_json(shards, {"least": 1})) == {"filters": {"least": 1}, "shards": [{"shard": "s0", "documents": 2, "chars": 15}, {"shard": "s1", "documents": 1, "chars": 1}], "totals": {"documents": 3, "chars": 16}}
    values = spark.createDataFrame([("base", "CORE", 1.0), ("sft", "ChatCORE", 2.0), ("sft", "B", 3.0)], "stage string, metric string, value double")
    lines = sinks.report([("One", "x")], values, ["base", "sft"]).splitlines()
    assert lines[-3:] == ["| CORE | 1.0 | - |", "| B | - | 3.0 |", "| ChatCORE | - | 2.0 |"]
    open(f"{at}/t.bin", "wb").write(np.array([1, 65535, 7], "<u2").tobytes())
    assert files.token_file(spark, f"{at}/t.bin").first()["tokens"] == [1, 65535, 7]


def test_unique_ingest(spark):
    at = scratch.folder(spark, "stream")
    kind = "id long, key string"
    spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], kind).coalesce(1).write.parquet(f"{at}/in/p=1")
    ingest.ingest_unique(spark, f"{at}/in/*", kind, f"{at}/out", key="key")
    spark.createDataFrame([(5, "b"), (6, "c"), (7, None)], kind).coalesce(1).write.parquet(f"{at}/in/p=2")
    ingest.ingest_unique(spark, f"{at}/in/*", kind, f"{at}/out", key="key")
    assert sorted((r["id"], r["key"]) for r in ingest.read(spark, f"{at}/out").collect()) == [(1, "a"), (3, "b"), (4, None), (6, "c"), (7, None)]
    row = ingest.progress(spark, f"{at}/out").first()
    assert (row["batches"], row["rows"], row["closed"]) == (2, 5, False) and ingest.stop(spark) == []


def test_ridge_and_smoothing(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(40, 2))
    y = 1 + x @ [2.0, -3.0] + rng.normal(size=40) / 10
    found = runs.ridge(spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y, strict=True)], "p double, q double, y double"), ["p", "q"], "y", 0.5)
    full = np.column_stack([np.ones(40), x])
    assert np.allclose(found, np.linalg.solve(full.T @ full + np.diag([0, 0.5, 0.5]), full.T @ y))
    losses = [3.0, 1.0, 2.0, 5.0]
    mean, wanted = 0.0, []
    for i, v in enumerate(losses):
        mean = 0.9 * mean + 0.1 * v
        wanted.append(mean / (1 - 0.9 ** (i + 1)))
    rows = evaluation.debiased_average(spark.createDataFrame(list(enumerate(losses)), "step long, loss double"), "step", "loss", 0.9).orderBy("step").collect()
    assert np.allclose([r["smooth"] for r in rows], wanted)


def test_capped_mixture_refuses(spark):
    mixture = spark.createDataFrame([(0, "a", 1, 0)], "task_index int, task string, local long, position long")
    with pytest.raises(ValueError):
        curriculum.capped(mixture, 2)
    assert sampling.share_of(spark.range(10), "id", 0.01, seed=1).count() == 1
