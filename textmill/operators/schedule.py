"""Token-range schedules, cursors and packing over token lengths, as interval arithmetic and streamed kernels."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def stages(spark: SparkSession, rows: list[tuple[str, str, int]], total: int, batch: int) -> DataFrame:
    """name, source, start_tokens, end_tokens, start_step, end_step of stages given by their first token.

    Starts are validated (the first 0, strictly rising, below the total) and snapped to steps of batch tokens, half to
    even; where two snap to one step the later moves on, which is a running maximum of step - rank.
    """
    starts = [r[2] for r in rows]
    if not rows or starts[0] != 0 or any(b <= a for a, b in zip(starts, starts[1:], strict=False)) or starts[-1] >= total:
        raise ValueError("stages must start at 0, rise and stay below the total")
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i long, name string, source string, start_tokens long")
    w = Window.orderBy("i")
    snapped = F.bround(F.col("start_tokens") / batch).cast("long")
    df = df.withColumn("start_step", F.max(snapped - F.col("i")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("i"))
    return df.withColumns({"end_tokens": F.lead("start_tokens", 1, total).over(w), "end_step": F.lead("start_step", 1, -(-total // batch)).over(w)}).drop("i")


def stage_at(points: DataFrame, schedule: DataFrame, at: str, *, steps: bool = False) -> DataFrame:
    """points with the stage active at a token (or step): a range join with the small schedule."""
    unit = "step" if steps else "tokens"
    s = F.broadcast(schedule.select("name", "source", F.col(f"start_{unit}").alias("_a"), F.col(f"end_{unit}").alias("_b")))
    return points.join(s, (F.col(at) >= F.col("_a")) & (F.col(at) < F.col("_b"))).drop("_a", "_b")


def planned_tokens(schedule: DataFrame, batch: int, offset: int = 0) -> DataFrame:
    """Tokens that each source gives from a continuation offset on."""
    left = F.greatest(F.lit(0), F.col("end_step") * batch - F.greatest(F.col("start_step") * batch, F.lit(offset)))
    return schedule.groupBy("source").agg(F.sum(left).cast("long").alias("planned"))


def epoch_violations(planned: DataFrame, unique: DataFrame, cap: float) -> DataFrame:
    """source, epochs, violation: an empty cache, or more epochs than cap (with a slack of 1e-9); undrawn is fine."""
    rows = planned.join(unique, "source", "left").withColumn("epochs", F.when(F.coalesce("unique_tokens", F.lit(0)) > 0, F.col("planned") / F.col("unique_tokens")))
    return rows.select("source", "planned", "epochs", F.when(F.col("planned") == 0, None).when(F.col("epochs").isNull(), "empty cache").when(F.col("epochs") > cap + 1e-9, "over the cap").alias("violation"))


def ring(positions: DataFrame, at: str, files: DataFrame) -> DataFrame:
    """positions with epoch (from 1), file and offset in the circular concatenation of files (file, n_tokens)."""
    w = Window.orderBy("file")
    ends = files.select("file", F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_e"), "n_tokens").withColumn("_s", F.col("_e") - F.col("n_tokens"))
    total = files.agg(F.sum("n_tokens").alias("_t"))
    rows = positions.crossJoin(F.broadcast(total)).withColumn("epoch", F.floor(F.col(at) / F.col("_t")) + 1).withColumn("_p", F.col(at) % F.col("_t"))
    return rows.join(F.broadcast(ends), (F.col("_p") >= F.col("_s")) & (F.col("_p") < F.col("_e"))).withColumn("offset", F.col("_p") - F.col("_s")).drop("_t", "_p", "_s", "_e", "n_tokens")


def rank_windows(spark: SparkSession, ranks: int, draws: int, window: int) -> DataFrame:
    """Where the k-th window of each rank starts: rank * window + k * (ranks * window + 1); a draw reads window + 1."""
    rows = spark.range(draws).withColumnRenamed("id", "draw").crossJoin(spark.range(ranks).withColumnRenamed("id", "rank"))
    return rows.withColumn("start", F.col("rank") * window + F.col("draw") * (ranks * window + 1))


def take_budget(docs: DataFrame, order: str, tokens: str, budget: int) -> DataFrame:
    """Documents under a token budget with column take; the crossing one is cut; a budget <= 0 is unlimited."""
    from textmill.operators.sharding import running_total

    if budget <= 0:
        return docs.withColumn("take", F.col(tokens))
    rows = running_total(docs, order, tokens, "_run").withColumn("_before", F.col("_run") - F.col(tokens))
    return rows.where(F.col("_before") < budget).withColumn("take", F.least(F.col(tokens), F.lit(budget) - F.col("_before"))).drop("_run", "_before")


PACKED = "packer int, row long, slot int, doc long, take long, cropped long"
_PACKED = pa.schema([("packer", pa.int32()), ("row", pa.int64()), ("slot", pa.int32()), ("doc", pa.int64()), ("take", pa.int64()), ("cropped", pa.int64())])


class _Buffer:
    """Lengths waiting to be packed: the largest that fits, the shortest, first come first among equals."""

    def __init__(self):
        self.by: dict[int, deque] = {}
        self.sizes: list[int] = []
        self.n = 0

    def add(self, doc: int, size: int) -> None:
        from bisect import insort

        if size not in self.by:
            self.by[size] = deque()
            insort(self.sizes, size)
        self.by[size].append(doc)
        self.n += 1

    def pop(self, place: int) -> tuple[int, int]:
        size = self.sizes[place]
        doc = self.by[size].popleft()
        self.n -= 1
        if not self.by[size]:
            del self.by[size], self.sizes[place]
        return doc, size

    def largest(self, room: int) -> tuple[int, int] | None:
        from bisect import bisect_right

        place = bisect_right(self.sizes, room) - 1
        return self.pop(place) if place >= 0 else None

    def shortest(self) -> tuple[int, int]:
        return self.pop(0)


def pack_best_fit(docs: DataFrame, key: str, tokens: str, *, capacity: int, buffer: int, crop: bool, packers: int = 1) -> DataFrame:
    """Best-fit packing of lengths into rows of capacity tokens: packer, row, slot, doc, take, cropped.

    From a buffer of waiting documents the largest that fits goes in.  If none fits, crop=True cuts the shortest to
    fill the row exactly and drops its rest, crop=False pads (the row ends).  With crop=False a document longer than
    the capacity would never leave the buffer; it is put out with take 0 and all its tokens as cropped.  packers are
    independent, as ranks are: documents are dealt by their order number.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict[int, tuple] = {}
        out: list[tuple] = []

        def fill(p: int, waiting: _Buffer, least: int) -> None:
            row, slot, room = state[p][1:]
            while waiting.n > least:
                hit = waiting.largest(room)
                if hit:
                    out.append((p, row, slot, hit[0], hit[1], 0))
                    slot, room = slot + 1, room - hit[1]
                elif crop:
                    doc, size = waiting.shortest()
                    out.append((p, row, slot, doc, room, size - room))
                    room = 0
                else:
                    room = 0
                if room == 0:
                    row, slot, room = row + 1, 0, capacity
            state[p] = (waiting, row, slot, room)

        def flushed() -> Iterator[pa.RecordBatch]:
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out, strict=True), _PACKED, strict=True)], schema=_PACKED)
                out.clear()

        for batch in batches:
            for p, doc, size in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if p not in state:
                    state[p] = (_Buffer(), 0, 0, capacity)
                if size > capacity and not crop:
                    out.append((p, -1, 0, doc, 0, size))
                    continue
                state[p][0].add(doc, size)
                fill(p, state[p][0], buffer - 1)
            yield from flushed()
        for p in list(state):
            fill(p, state[p][0], 0)
        yield from flushed()

    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(tokens).cast("long").alias("n")).where("n > 0")
    rows = rows.withColumn("packer", F.pmod("doc", F.lit(packers)).cast("int")).repartition(packers, "packer").sortWithinPartitions("packer", "doc")
    return rows.select("packer", "doc", "n").mapInArrow(scan, PACKED)


def one_per_row(docs: DataFrame, key: str, tokens: str, batch: int, capacity: int) -> DataFrame:
    """One document a row, padded to the longest of its batch; longer than capacity is an error."""
    from textmill.operators.sharding import numbered

    rows = numbered(docs, [key], "_n").withColumn("batch", F.floor(F.col("_n") / batch))
    width = F.max(tokens).over(Window.partitionBy("batch"))
    return rows.withColumn("width", width).withColumn("padding", F.col("width") - F.col(tokens)).withColumn("width", F.when(F.col(tokens) > capacity, F.raise_error(F.lit("document longer than the capacity")).cast("long")).otherwise(F.col("width"))).drop("_n")
