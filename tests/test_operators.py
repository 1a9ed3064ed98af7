"""Operators against sequential restatements of their rules, and their edge cases."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from textmill.functions import ordering, text
from textmill.operators import conversations, dedup, evaluation, quality, schedule, sharding
from textmill.streaming import ingest


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column).first()[0]


@pytest.mark.parametrize("seed", range(3))
def test_claim_dedup(spark, seed):
    r = random.Random(seed)
    rows = [(i, r.choice([None, f"k{r.randrange(40)}", f"k{i}"]), [f"k{r.randrange(60)}" for _ in range(r.randrange(3))]) for i in range(60)]
    claimed, wanted = set(), {}
    for i, key, others in rows:
        wanted[i] = key is not None and key in claimed
        if not wanted[i]:
            claimed |= {key, *others} - {None}
    df = spark.createDataFrame(rows, "i long, key string, others array<string>")
    assert {x["i"]: x["is_duplicate"] for x in dedup.claim_dedup(df, order="i", key="key", duplicates="others").collect()} == wanted


def test_claim_chain(spark):
    """a claims b, b claims c: b is dropped, so c stays."""
    df = spark.createDataFrame([(1, "a", ["b"]), (2, "b", ["c"]), (3, "c", None)], "i long, key string, others array<string>")
    assert [x["i"] for x in dedup.claim_dedup(df, order="i", key="key", duplicates="others").where("is_duplicate").collect()] == [2]


@pytest.mark.parametrize("multiple,drop", [(1, False), (4, False), (4, True)])
def test_greedy_shards(spark, multiple, drop):
    r = random.Random(multiple)
    sizes = [r.choice([0, 5, 30, 100, 400]) for _ in range(97)]
    wanted, shard, filled, rows, done = [], 0, 0, 0, 0
    for i, n in enumerate(sizes):
        wanted.append((i, shard))
        filled, rows = filled + n, rows + 1
        if filled >= 250 and rows % multiple == 0:
            shard, filled, rows = shard + 1, 0, 0
            done = shard
    if drop:
        wanted = [w for w in wanted if w[1] < done]
    df = spark.createDataFrame(list(enumerate(sizes)), "id long, n long")
    got = sharding.greedy_shards(df, "id", "n", 250, multiple=multiple, drop_tail=drop)
    assert sorted((x["id"], x["shard"]) for x in got.collect()) == wanted


def test_running_total_of_strings_and_ties(spark):
    df = spark.createDataFrame([(f"k{i:03d}", i % 7, i) for i in range(500)], "k string, n long, i long").repartition(9)
    got = {x["i"]: x["running"] for x in sharding.running_total(df, "k", "n").collect()}
    total = 0
    for i in range(500):
        total += i % 7
        assert got[i] == total


@pytest.mark.parametrize("crop", [True, False])
def test_best_fit(spark, crop):
    r = random.Random(crop)
    sizes = [r.randrange(1, 70) for _ in range(300)]
    capacity, buffer = 64, 10
    wanted, waiting, row, slot, room = [], [], 0, 0, capacity

    def fill(least):
        nonlocal row, slot, room
        while len(waiting) > least:
            fits = [w for w in waiting if w[1] <= room]
            if fits:
                best = max(fits, key=lambda w: w[1])
                waiting.remove(best)
                wanted.append((row, slot, best[0], best[1]))
                slot, room = slot + 1, room - best[1]
            elif crop:
                best = min(waiting, key=lambda w: w[1])
                waiting.remove(best)
                wanted.append((row, slot, best[0], room))
                room = 0
            else:
                room = 0
            if room == 0:
                row, slot, room = row + 1, 0, capacity

    for doc, n in enumerate(sizes):
        if n > capacity and not crop:
            continue
        waiting.append((doc, n))
        fill(buffer - 1)
    fill(0)
    got = schedule.pack_best_fit(spark.createDataFrame(list(enumerate(sizes)), "d long, n long"), "d", "n", capacity=capacity, buffer=buffer, crop=crop).collect()
    assert sorted((x["row"], x["slot"], x["doc"], x["take"]) for x in got if x["row"] >= 0) == sorted(wanted)
    assert {x["doc"] for x in got} == set(range(300))
    if crop:
        rows = {}
        for x in got:
            rows[x["row"]] = rows.get(x["row"], 0) + x["take"]
        assert all(v == capacity for k, v in rows.items() if k < max(rows))


def test_stages_that_snap_together(spark):
    got = schedule.stages(spark, [("a", "x", 0), ("b", "y", 900), ("c", "x", 1100)], 5000, 1000).orderBy("start_step").collect()
    assert [(s["start_step"], s["end_step"]) for s in got] == [(0, 1), (1, 2), (2, 5)]
    with pytest.raises(ValueError):
        schedule.stages(spark, [("a", "x", 5)], 10, 1)


def test_years(spark):
    cases = {None: None, "": None, "    ": None, "18uu": None, "9999": None, "c1898": 1898, "1898-1902": 1898, "0999 1901": None, "1930": 1930}
    for value, year in cases.items():
        assert one(spark, text.parse_year(F.col("d")), d=value) == year


def test_language_share(spark):
    kind = "distribution struct<language: array<string>, proportion: array<double>>"
    cases = [(None, None), (([], []), None), ((["fra"], [1.0]), 0.0), ((["fra", "eng"], [5.0, 95.0]), 0.95), ((["eng", "eng"], [0.9, 0.1]), 0.9), ((["eng"], [None]), None)]
    for value, share in cases:
        got = spark.createDataFrame([(value,)], kind).select(quality.language_share(F.col("distribution"), "eng")).first()[0]
        assert got == (None if share is None else pytest.approx(share))


def test_waterfall_edges(spark):
    base = {"doc_id": 1, "barcode": "B1", "language": "eng", "date1": "1900", "date2": None, "date_type": "s", "ocr_src": 90, "ocr_gen": 90, "share": 0.9, "tokenizability": 95.0, "tokens": 2000, "chars": 2000, "pages": 3, "sentences": 19, "topic": "t", "text": "x"}
    kind = "doc_id long, barcode string, language string, date1 string, date2 string, date_type string, ocr_src int, ocr_gen int, share double, tokenizability double, tokens long, chars long, pages long, sentences long, topic string, text string"
    cases = [({}, None), ({"language": None}, "language"), ({"share": None}, "language_distribution_missing"), ({"share": 0.89}, "language_low_english_proportion"), ({"date_type": " Continuing resource"}, "date_type_invalid"), ({"date_type": None}, None), ({"date1": "1930"}, "year_too_recent"), ({"date1": "x", "date2": "1929"}, None), ({"date1": None}, "year_unparseable"), ({"ocr_src": None}, "ocr_missing"), ({"ocr_gen": 79}, "ocr_low"), ({"ocr_src": 100, "ocr_gen": 90}, None), ({"ocr_src": 101}, "ocr_disagree"), ({"tokenizability": None}, "tokenizability_missing"), ({"tokenizability": 94.9}, "tokenizability_low"), ({"tokens": 499}, "too_few_tokens"), ({"chars": None}, "too_few_chars"), ({"pages": 2}, "too_few_pages"), ({"tokens": 1999}, "too_few_sentences"), ({"sentences": None}, "too_few_sentences"), ({"text": ""}, "empty_text"), ({"barcode": None}, "no_barcode")]
    rows = [tuple({**base, **change}.values()) for change, _ in cases]
    got = quality.classified(spark.createDataFrame(rows, kind).coalesce(1), quality.Profile()).select("reject_reason").collect()
    assert [x[0] for x in got] == [reason for _, reason in cases]


def test_terminal_marks(spark):
    cases = {"hello": "hello.", "hello.": "hello.", "hello \n": "hello. \n", 'he said "yes"': 'he said "yes".', "list:": "list:", "```\ncode": "```\ncode", "hi 😀": "hi 😀.", "": "", '"")': '"")', "(really?)": "(really?)"}
    for said, wanted in cases.items():
        assert one(spark, text.add_terminal_mark(F.col("t")), t=said) == wanted


def test_answers_programs_and_calls(spark):
    for said, wanted in {"#### 1,234": "1234", "so\n#### -5": "-5", "#### 10.": "10.", "none": None}.items():
        assert one(spark, text.final_number(F.col("t")), t=said) == wanted
    assert one(spark, text.program(F.col("t")), t="x\n```python\na = 1\n```\n```\nb\n```") == "a = 1"
    assert one(spark, text.program(F.col("t")), t="  plain ") == "plain"
    assert one(spark, text.leading_imports(F.col("t")), t="# c\nimport a\n\nfrom b import c\ndef f():\nimport d") == "import a\nfrom b import c"
    parts = one(spark, text.tool_parts(F.col("t")), t="is <<2*3=6>>6 and <<a==b=1>>")
    assert [(p["type"], p["text"]) for p in parts] == [("text", "is "), ("python", "2*3"), ("python_output", "6"), ("text", "6 and "), ("python", "a==b"), ("python_output", "1"), *([("text", "")] if parts[-1]["type"] == "text" else [])]


def test_pre_tokens_are_those_of_the_regex_module(spark):
    import regex

    pattern = text.PRE_TOKEN.removeprefix("(?U)")
    r = random.Random(4)
    said = ["".join(r.choice(["a", "É", " ", "  ", "\n", "\r\n", "12", "345", "'s", "'LL", "!", "日本", " ", "　", "_", "😀"]) for _ in range(30)) for _ in range(200)]
    got = spark.createDataFrame([(t,) for t in said], "t string").select("t", text.pre_tokens(F.col("t")).alias("p")).collect()
    for x in got:
        assert x["p"] == regex.findall(pattern, x["t"]), repr(x["t"])


def test_prefixes_and_padding(spark):
    df = spark.createDataFrame([([1, 2, 3], [1, 2, 4, 5]), ([], [1]), ([1, 2], [1, 2]), ([9, 2], [1, 2])], "a array<int>, b array<int>").coalesce(1)
    assert [tuple(x) for x in df.select(text.common_prefix(F.col("a"), F.col("b")), text.common_suffix(F.col("a"), F.col("b"))).collect()] == [(2, 0), (0, 0), (2, 2), (0, 1)]
    assert df.select(text.pad_right(F.col("a"), 3, -1)).collect()[1][0] == [-1, -1, -1]


def test_crc_split_and_order(spark):
    rows = spark.createDataFrame([("B12",), ("é",), ("",)], "k string").select("k", ordering.in_crc_split("k", 3).alias("v")).collect()
    assert all(x["v"] == (zlib.crc32(x["k"].encode()) % 3 == 0) for x in rows)
    assert ordering.split_divisor(370_000, 100) == 3700 and ordering.split_divisor(10, 0) == 1


def test_alternation(spark):
    kind = "messages array<struct<role: string, content: string>>"
    m = lambda roles: [({"s": "system", "u": "user", "a": "assistant"}[x], "t") for x in roles]
    cases = {"ua": True, "sua": True, "s": False, "uu": False, "uau": True, "au": False, "": False, "usa": False, "u": False}
    got = spark.createDataFrame([(m(k),) for k in cases], kind).coalesce(1).select(conversations.alternates(F.col("messages"))).collect()
    assert [x[0] for x in got] == list(cases.values())


def test_auc_and_percentile_edges(spark):
    score = lambda rows: evaluation.auc(spark.createDataFrame(rows, "s double, p boolean"), "s", "p").first()["auc"]
    assert score([(1.0, True), (1.0, False), (1.0, False)]) == 0.5
    assert score([(2.0, True), (1.0, False)]) == 1.0
    assert score([(2.0, True)]) is None
    for n in (1, 2, 5, 40):
        for q in (0.0, 0.5, 0.95, 1.0):
            df = spark.createDataFrame([(float(i),) for i in range(n)], "v double")
            assert evaluation.nearest_rank(df, "v", q).first()[0] == float(round(q * (n - 1)))


def test_parabola(spark):
    rows = [("a", x / 2, 3 * (x / 2 - 4) ** 2 + 1) for x in range(20)] + [("b", float(x), -float(x) ** 2) for x in range(5)]
    got = {r["g"]: r for r in evaluation.parabola(spark.createDataFrame(rows, "g string, x double, y double"), "x", "y", ["g"]).collect()}
    assert got["a"]["a"] == pytest.approx(3) and got["a"]["vertex"] == pytest.approx(4) and got["b"]["vertex"] == 4.0


def test_ingest_takes_each_file_once(spark, tmp_path, sf_dir):
    source, target = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id")
    events.where("event_id < 500").coalesce(1).write.parquet(source)
    ingest.ingest(spark, source, "event_id long, user_id long", target)
    ingest.ingest(spark, source, "event_id long, user_id long", target)
    assert ingest.read(spark, target).count() == 500
    events.where("event_id >= 500").coalesce(1).write.mode("append").parquet(source)
    ingest.ingest(spark, source, "event_id long, user_id long", target)
    assert ingest.read(spark, target).select("event_id").distinct().count() == 1000
    ingest.close(spark, target)
    with pytest.raises(RuntimeError):
        ingest.ingest(spark, source, "event_id long, user_id long", target)
