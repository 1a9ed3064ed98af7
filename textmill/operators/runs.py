"""Records of runs: caches, checkpoints, configurations, summaries and exports, as tables and their violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.operators.schedule import stage_at
from textmill.operators.sharding import ranked

# --- token caches -----------------------------------------------------------------------------------------------


def cache_satisfies(metas: DataFrame, listed: DataFrame, files: DataFrame, *, fingerprint: str, train: int, validation: int) -> DataFrame:
    """metas (cache, dtype, fingerprint, train_tokens, val_tokens, exhausted) with satisfies: 16-bit tokens of the same
    tokenizer, enough of them (or all there are), and every listed file (cache, file) among files (cache, file)."""
    gone = listed.join(files, ["cache", "file"], "left_anti").select("cache").distinct().withColumn("_gone", F.lit(True))
    enough = (F.lit(train) <= 0) | (F.coalesce("train_tokens", F.lit(0)) >= train) | F.coalesce("exhausted", F.lit(False))
    fine = F.col("dtype").eqNullSafe("uint16") & F.col("fingerprint").eqNullSafe(fingerprint) & enough & ((F.lit(validation) <= 0) | (F.coalesce("val_tokens", F.lit(0)) >= validation))
    return metas.join(gone, "cache", "left").withColumn("satisfies", fine & F.col("_gone").isNull()).drop("_gone")


def cache_violations(metas: DataFrame, listed: DataFrame, files: DataFrame, expected: dict[str, object]) -> DataFrame:
    """(cache, violation) of metas (cache, train_tokens, val_tokens and the expected columns), listed (cache, split, file,
    tokens) and files (cache, file, size): other values than expected, no files of a split, repeated or unnamed files, bad
    counts, sizes other than two bytes a token, totals that differ."""
    rules = [metas.where(~F.col(c).eqNullSafe(F.lit(v))).select("cache", F.lit(c).alias("violation")) for c, v in expected.items()]
    per = listed.groupBy("cache", "split").agg(F.sum("tokens").alias("total"), F.count_if(~F.coalesce(F.col("tokens") > 0, F.lit(False))).alias("bad"))
    splits = metas.select("cache", F.explode(F.array(F.struct(F.lit("train").alias("split"), F.col("train_tokens").alias("recorded")), F.struct(F.lit("val").alias("split"), F.col("val_tokens").alias("recorded")))).alias("s")).select("cache", "s.*")
    totals = splits.join(per, ["cache", "split"], "left")
    rules.append(totals.where("total IS NULL").select("cache", F.concat(F.lit("no files: "), "split").alias("violation")))
    rules.append(totals.where("bad > 0").select("cache", F.concat(F.lit("token count: "), "split").alias("violation")))
    rules.append(totals.where(F.col("total").isNotNull() & ~F.col("total").eqNullSafe(F.col("recorded"))).select("cache", F.concat(F.lit("total: "), "split").alias("violation")))
    rules.append(listed.groupBy("cache", "file").agg(F.count("*").alias("n")).where("n > 1 OR file IS NULL OR file = '' OR contains(file, '/')").select("cache", F.concat(F.lit("file name: "), F.coalesce("file", F.lit(""))).alias("violation")))
    sized = listed.join(files, ["cache", "file"], "left").where(~F.col("size").eqNullSafe(2 * F.col("tokens")))
    rules.append(sized.select("cache", F.concat(F.lit("file size: "), "file").alias("violation")).distinct())
    out = rules[0]
    for r in rules[1:]:
        out = out.unionByName(r)
    return out


def resumed_start(saved: Column, rank: Column, ranks: int, window: int) -> Column:
    """Where a rank goes on from the saved place of rank 0."""
    return saved + (ranks - 1 + rank) * window


def planned_by_stage(schedule: DataFrame, batch: int) -> DataFrame:
    return schedule.select("name", "source", ((F.col("end_step") - F.col("start_step")) * batch).alias("planned"))


def stage_reads(draws: DataFrame, schedule: DataFrame, per_draw: int) -> DataFrame:
    """draws (draw) with the stage at their first token, and cursor: the tokens that its source has given before, in
    whatever stage."""
    at = stage_at(draws.withColumn("_at", F.col("draw") * per_draw), schedule, "_at").drop("_at")
    return ranked(at, ["source"], ["draw"], "_n").withColumn("cursor", (F.col("_n") - 1) * per_draw).drop("_n")


# --- checkpoints and lineage --------------------------------------------------------------------------------------


def latest_steps(files: DataFrame) -> DataFrame:
    """(run, step): the newest step of each run with a model and a meta file, of files (run, path)."""
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.select("run", F.regexp_extract(name, "^(model|meta)_([0-9]+)", 1).alias("kind"), F.regexp_extract(name, "^(model|meta)_([0-9]+)", 2).try_cast("long").alias("step")).where("kind != ''")
    whole = rows.groupBy("run", "step").agg(F.count_distinct("kind").alias("n")).where("n = 2")
    return whole.groupBy("run").agg(F.max("step").alias("step"))


def largest_tag(tags: Column) -> Column:
    """Aggregate: the tag with the largest number behind "d"; others only if none has one."""
    size = F.regexp_extract(tags, "^d([0-9]+)$", 1).try_cast("long")
    return F.max_by(tags, F.struct(F.coalesce(size, F.lit(-1).cast("long")), tags))


def resume_violations(files: DataFrame, ranks: list[int]) -> DataFrame:
    """(step, violation): a missing model or meta file, or other optimizer ranks than exactly those."""
    name = F.element_at(F.split("path", "/"), -1)
    step = F.regexp_extract(name, "_([0-9]+)", 1).try_cast("long")
    rank = F.regexp_extract(name, "^optim_[0-9]+_rank([0-9]+)", 1).try_cast("int")
    per = files.select(step.alias("step"), name.startswith("model_").alias("model"), name.startswith("meta_").alias("meta"), rank.alias("rank")).where("step IS NOT NULL")
    per = per.groupBy("step").agg(F.bool_or("model").alias("model"), F.bool_or("meta").alias("meta"), F.array_sort(F.collect_set("rank")).alias("found"))
    wanted = F.array(*map(F.lit, sorted(set(ranks)))).cast("array<int>")
    broken = F.array_compact(F.array(F.when(~F.col("model"), "model"), F.when(~F.col("meta"), "meta"), F.when(F.col("found") != wanted, "ranks")))
    return per.select("step", F.explode(broken).alias("violation"))


def parent_step(configured: Column, recorded: Column, newest: Column) -> Column:
    """As configured, else as recorded when the run began, else the newest complete step."""
    return F.coalesce(configured, recorded, newest)


def restored(current: Column, recorded: Column) -> Column:
    """Maps of a run's record: recorded values replace current ones, and no current key is dropped."""
    kept = F.map_filter(current, lambda k, v: ~F.map_contains_key(recorded, k))
    return F.map_concat(kept, recorded)


def reusable(results: DataFrame, other: DataFrame) -> DataFrame:
    """(run, step) whose two result files carry the same step."""
    return results.select("run", "step").join(other.select("run", "step"), ["run", "step"])


def resumable(progress: DataFrame, wanted: DataFrame, provenance: list[str]) -> DataFrame:
    """(task, resume): whether a task's saved progress has the provenance that is wanted now, field by field."""
    now = wanted.select("task", *(F.col(c).alias(f"_{c}") for c in provenance))
    same = F.lit(True)
    for c in provenance:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return now.join(progress.withColumn("_there", F.lit(True)), "task", "left").select("task", (F.coalesce("_there", F.lit(False)) & same).alias("resume"))


def config_violations(configs: DataFrame) -> DataFrame:
    """(run, violation) of configurations (run, stage, schema_version, tokenizer_mode, tokenizer_source, has_tokenizer,
    has_training, has_dataset, has_mixture, is_branch, momentum, parent_step)."""
    c = F.col
    base = c("stage") == "base"
    mode = F.coalesce("tokenizer_mode", F.lit("train"))
    rules = F.array(
        F.when(F.coalesce("schema_version", F.lit(1)) != 1, "schema version"),
        F.when(~c("has_training"), "no training"),
        F.when(base & ~c("is_branch") & ~c("has_tokenizer"), "no tokenizer"),
        F.when(base & ~c("has_mixture") & ~c("has_dataset"), "no dataset"),
        F.when(base & ~mode.isin("train", "reuse"), "tokenizer mode"),
        F.when(base & (mode == "reuse") & (F.coalesce("tokenizer_source", F.lit("")).isin("") | c("tokenizer_source").eqNullSafe(c("run"))), "tokenizer source"),
        F.when(base & c("momentum").isNotNull() & ~((c("momentum") >= 0) & (c("momentum") < 1)), "momentum"),
        F.when(~base & (c("parent_step") < 0), "parent step"),
    )
    return configs.select("run", F.explode(F.array_compact(rules)).alias("violation"))


def branch_violations(branches: DataFrame, parents: DataFrame, same: list[str]) -> DataFrame:
    """(run, violation) of branches (run, parent and the fields of same): no such parent, or a field that is given and
    differs from the parent's."""
    p = parents.select(F.col("run").alias("parent"), F.lit(True).alias("_there"), *(F.col(c).alias(f"_{c}") for c in same))
    rows = branches.join(p, "parent", "left")
    rules = [F.when(F.col("_there").isNull(), "no parent"), *(F.when(F.col("_there") & F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col(f"_{c}")), c) for c in same)]
    return rows.select("run", F.explode(F.array_compact(F.array(*rules))).alias("violation"))


def missing_sources(stages: DataFrame, datasets: DataFrame) -> DataFrame:
    """(run, source) of stages whose source has no dataset block."""
    return stages.select("run", "source").distinct().join(datasets, ["run", "source"], "left_anti")


def identity_violations(runs: DataFrame, recorded: DataFrame, *, digest: str = "fingerprint") -> DataFrame:
    """(run, verdict): training under an id whose fingerprint was another is refused, inference only warned about."""
    old = recorded.select("run", F.col(digest).alias("_old"))
    verdict = F.when(F.col("mode") == "inference", "warn").otherwise("refuse")
    return runs.join(old, "run").where(~F.col(digest).eqNullSafe(F.col("_old"))).select("run", verdict.alias("verdict"))


def json_fingerprint(*fields: Column) -> Column:
    """The first 16 hex digits of the SHA-256 of a struct as JSON: keys in order, no spaces, nulls as null.  Fields are
    given with their names in order."""
    return F.substring(F.sha2(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}), 256), 1, 16)


def folder_fingerprint(files: DataFrame, *, order: str = "name", first: int = 1 << 20) -> DataFrame:
    """(folder, fingerprint) over files (folder, name, content): name, size and the first bytes of each in order of name,
    or of another column (numbers in names have an order of their own beyond their padding); unfinished ones (.tmp) don't
    count."""
    part = F.concat(F.encode("name", "UTF-8"), F.encode(F.octet_length("content").cast("string"), "UTF-8"), F.substring("content", 1, first))
    each = F.struct(F.col(order).alias("at"), F.col("name"), F.hex(part).alias("part"))
    rows = files.where(~F.col("name").endswith(".tmp")).groupBy("folder").agg(F.array_sort(F.collect_list(each)).alias("all"))
    whole = F.unhex(F.array_join(F.transform("all", lambda x: x["part"]), ""))
    return rows.select("folder", F.substring(F.sha2(whole, 256), 1, 16).alias("fingerprint"))


# --- summaries, exports, fits ---------------------------------------------------------------------------------------


def summary(now: DataFrame, before: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row a run: each field as measured now, else as the summary before had it."""
    old = before.select(key, *(F.col(f).alias(f"_{f}") for f in fields))
    return now.join(old, key, "left").select(key, *(F.coalesce(f, f"_{f}").alias(f) for f in fields))


def ratio_records(steps: DataFrame, *, batch: int, parameters: int, per_token: float, inherited: float = 0.0) -> DataFrame:
    """Per step: tokens, tokens a parameter, and compute with and without what was inherited."""
    tokens = F.col("step") * batch
    return steps.select("step", tokens.alias("tokens"), (tokens / parameters).alias("ratio"), (tokens * per_token).alias("stage_flops"), (tokens * per_token + inherited).alias("cumulative_flops"))


def score_export(questions: DataFrame, scores: DataFrame) -> DataFrame:
    """Long rows (question, key, model, strict_correct, loose_correct, strict_failed, loose_failed) of questions (question,
    key, instructions) and scores (question, model, mode, passes)."""
    failed = F.transform(F.filter(F.arrays_zip("instructions", "passes"), lambda x: ~x["passes"]), lambda x: x["instructions"])
    per = questions.join(scores, "question").withColumns({"_failed": failed, "_all": F.forall("passes", lambda x: x)})
    pick = lambda mode, c: F.max(F.when(F.col("mode") == mode, F.col(c)))
    return per.groupBy("question", "key", "model").agg(
        pick("strict", "_all").alias("strict_correct"), pick("loose", "_all").alias("loose_correct"), pick("strict", "_failed").alias("strict_failed"), pick("loose", "_failed").alias("loose_failed")
    )


def wide_export(long: DataFrame) -> DataFrame:
    """One row a question: models, from the model's name to its scores."""
    return long.groupBy("question", "key").agg(F.map_from_entries(F.collect_list(F.struct("model", F.struct("strict_correct", "loose_correct", "strict_failed", "loose_failed").alias("scores")))).alias("models"))


def export_manifest(long: DataFrame, n_questions: int, models: list[str]) -> DataFrame:
    """questions_with_scores, long_rows, expected_long_rows, complete."""
    expected = n_questions * len(models)
    return long.agg(F.count_distinct("question").alias("questions_with_scores"), F.count("*").alias("long_rows")).withColumns({"expected_long_rows": F.lit(expected).cast("long"), "complete": F.col("long_rows") == expected})


def instruction_accuracy(rows: DataFrame) -> DataFrame:
    """(level, name, correct, total) of rows (key, instructions, passes): by prompt (all of its instructions followed), by
    instruction, by family (before the colon) and by kind."""
    each = rows.select("key", F.explode(F.arrays_zip("instructions", "passes")).alias("x")).select("key", F.col("x.instructions").alias("kind"), F.col("x.passes").cast("long").alias("hit"))
    each = each.withColumn("family", F.split_part("kind", F.lit(":"), F.lit(1)))
    count = [F.sum("hit").alias("correct"), F.count("*").alias("total")]
    prompts = rows.agg(F.sum(F.forall("passes", lambda x: x).cast("long")).alias("correct"), F.count("*").alias("total")).select(F.lit("prompt").alias("level"), F.lit("").alias("name"), "correct", "total")
    per = each.cube("family", "kind").agg(F.grouping_id().alias("g"), *count).where("g IN (0, 1, 3)")
    level = F.when(F.col("g") == 3, "instruction").when(F.col("g") == 1, "tier0").otherwise("tier1")
    return prompts.unionByName(per.select(level.alias("level"), F.coalesce("kind", "family", F.lit("")).alias("name"), "correct", "total"))


def joined_once(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """(key, violation) of what keeps a and b from joining one to one: unmatched on a side, or repeated there."""
    n = lambda df, name: df.groupBy(on).agg(F.count("*").alias(name))
    rows = n(a, "x").join(n(b, "y"), on, "full")
    violation = F.when(F.col("x").isNull(), "not on the left").when(F.col("y").isNull(), "not on the right").when(F.col("x") > 1, "repeated on the left").when(F.col("y") > 1, "repeated on the right")
    return rows.select(F.col(on).alias("key"), violation.alias("violation")).where("violation IS NOT NULL")


def line_fit_quality(rows: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """slope, intercept and r2 (1 - residual over total squares) of a line by least squares."""
    sxx, syy, sxy = (F.covar_pop(a, b) * F.count("*") for a, b in ((x, x), (y, y), (x, y)))
    return rows.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), (sxy * sxy / (sxx * syy)).alias("r2"))


def ridge(rows: DataFrame, features: list[str], target: str, alpha: float = 0.1) -> list[float]:
    """Intercept and weights of a ridge regression whose intercept isn't penalised; the sums of products come from one
    aggregate, and a system of as many equations as features is solved."""
    import numpy as np

    columns = [F.lit(1.0), *(F.col(f).cast("double") for f in features)]
    n = len(columns)
    sums = [F.sum(columns[i] * columns[j]) for i in range(n) for j in range(n)] + [F.sum(c * F.col(target).cast("double")) for c in columns]
    found = np.array(rows.agg(*(s.alias(f"s{i}") for i, s in enumerate(sums))).first(), float)
    penalty = alpha * np.eye(n)
    penalty[0, 0] = 0
    return np.linalg.solve(found[: n * n].reshape(n, n) + penalty, found[n * n :]).tolist()


def plan_lines(schedule: DataFrame, batch: int) -> DataFrame:
    """(start_step, line) of a planner's printout."""
    line = F.format_string("%-12s %-12s steps %d..%d, %s tokens", "name", "source", "start_step", "end_step", F.format_number((F.col("end_step") - F.col("start_step")) * batch, 0))
    return schedule.select("start_step", line.alias("line"))


def row_cap(rows: DataFrame, key: str, most: int) -> DataFrame:
    """The first rows in order of key."""
    return rows.orderBy(key).limit(most)


def active_sources(schedule: DataFrame, offset: int) -> DataFrame:
    """(source, first) of stages that end beyond an offset, in the order in which they come."""
    return schedule.where(F.col("end_tokens") > offset).groupBy("source").agg(F.min("start_tokens").alias("first"))

