"""Exact percentiles of large groups by distributed multi-select, and summaries that can be combined (problem 1).

Every partition sorts its values of a group once into a block. Then, for all wanted ranks
of all groups at once: blocks propose the median of what is still possible, the weighted
median of the proposals is the pivot, blocks count what is less, equal and greater, and
the ranges that can't hold the rank are discarded, until few values are left. A block
proposes medians for both outcomes while it counts, so that a round is one job.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from karst.sources.staging import release, stage

#: Rows that a task sorts into one block at most.
BLOCK_ROWS = 500_000
#: A group, or what is left of one for one rank, is finished by sorting when it has no more values.
FINISH = 32
#: The same for summaries, which ask for so many ranks of a part that sorting it once is less work.
SUMMARY_FINISH = 2048
#: Rounds after which blocks are cut down to what is left for each rank.
COMPACT = 4


def _blocks(by: list[str], metrics: list[str]):
    names = [*by, "metric", "vals"]

    def flush(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches)
        code = np.zeros(len(table), dtype=np.int64)
        for c in by:
            one = table.column(c).combine_chunks()
            one = one.chunk(0) if isinstance(one, pa.ChunkedArray) else one
            one = one.dictionary_encode(null_encoding="encode")
            code = code * (len(one.dictionary) + 1) + one.indices.to_numpy(zero_copy_only=False)
            code = np.unique(code, return_inverse=True)[1]
        groups, first = np.unique(code, return_index=True)
        keys = [table.column(c).take(pa.array(first)) for c in by]
        for m in metrics:
            x = table.column(m).to_numpy()
            ok = np.isfinite(x)
            order = np.lexsort((x[ok], code[ok]))
            ends = np.searchsorted(code[ok][order], groups, "right")
            vals = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(x[ok][order]))
            yield pa.RecordBatch.from_arrays([*(pa.concat_arrays(k.chunks) if isinstance(k, pa.ChunkedArray) else k for k in keys), pa.array([m] * len(groups)), vals], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= BLOCK_ROWS:
                yield from flush(held)
                held, rows = [], 0
        if rows:
            yield from flush(held)

    return run


_ROUND = "g string, t int, less bigint, eq bigint, lm double, lw bigint, rm double, rw bigint"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block and target: counts below and at the pivot, and medians of what lies on either side."""
    for batch in batches:
        out: list[list] = [[] for _ in range(8)]
        flat = batch.column(1).flatten().to_numpy()
        ends = np.r_[0, np.cumsum(pc.list_value_length(batch.column(1)).to_numpy())]
        for k, (g, targets) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
            v = flat[ends[k] : ends[k + 1]]
            for s in targets:
                a, b = int(np.searchsorted(v, s["lo"], "right")), int(np.searchsorted(v, s["hi"], "left"))
                if a >= b:
                    continue
                p, q = (int(np.clip(np.searchsorted(v, s["pivot"], side), a, b)) for side in ("left", "right"))
                row = (g, s["t"], p - a, q - p, v[(a + p - 1) // 2] if p > a else None, p - a, v[(q + b - 1) // 2] if b > q else None, b - q)
                for c, x in zip(out, row):
                    c.append(x)
        kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["g", "t", "less", "eq", "lm", "lw", "rm", "rw"])


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each block for each target."""
    for batch in batches:
        gs, ts, vals = [], [], []
        flat = batch.column(1).flatten().to_numpy()
        ends = np.r_[0, np.cumsum(pc.list_value_length(batch.column(1)).to_numpy())]
        for k, (g, targets) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())):
            v = flat[ends[k] : ends[k + 1]]
            for s in targets:
                a, b = int(np.searchsorted(v, s["lo"], "right")), int(np.searchsorted(v, s["hi"], "left"))
                if a < b:
                    gs.append(g)
                    ts.append(s["t"])
                    vals.append(v[a:b])
        sizes = np.cumsum([0, *map(len, vals)]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(gs, pa.string()), pa.array(ts, pa.int32()), pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate(vals) if vals else np.empty(0)))], ["g", "t", "vals"])


def _weighted_median(value: str, weight: str) -> Column:
    return F.expr(f"percentile({value}, 0.5D, {weight}) FILTER (WHERE {weight} > 0)")


def select_ranks(values: DataFrame, by: list[str], metrics: list[str], parts: list[int], whole: int, finish: int | None = None) -> DataFrame:
    """(by.., metric, part, n, rank, value): for each part p the value of rank ceil(n * p / whole), at least 1.

    Values are doubles; null, NaN and infinite ones don't count. Ties and repeated rows
    count each. A group without values, and a null group, has its rows, with null value. The
    result is exact: its rank error is 0, whatever ``finish``. Columns of ``by`` come out as strings.
    """
    finish = FINISH if finish is None else finish
    rows = values.select(*(F.col(c).cast("string").alias(c) for c in by), *(F.col(m).cast("double").alias(m) for m in metrics))
    schema = ", ".join([*(f"`{c}` string" for c in by), "metric string", "vals array<double>"])
    blocks = stage(rows.mapInArrow(_blocks(by, metrics), schema).withColumn("g", F.to_json(F.struct(*by, "metric"))), "blocks")
    groups = stage(blocks.groupBy("g", *by, "metric").agg(F.sum(F.size("vals")).alias("n")), "groups")
    want = F.array(*(F.lit(int(p)) for p in sorted(set(parts))))
    targets = groups.withColumn("part", F.explode(want)).withColumn("rank", F.expr(f"greatest(1L, (n * part + {whole - 1}) div {whole})"))

    small = blocks.join(groups.where(F.col("n").between(1, finish)).select("g"), "g").groupBy("g").agg(F.array_sort(F.flatten(F.collect_list("vals"))).alias("sorted"))
    direct = targets.where(F.col("n") <= finish).join(small, "g", "left").select(*by, "metric", "part", "n", "rank", F.try_element_at("sorted", F.col("rank").cast("int")).alias("value"))

    if not groups.where(F.col("n") > finish).limit(1).count():
        return direct

    # equal ranks of a group are searched once
    large = targets.where(F.col("n") > finish)
    searched = large.select("g", "n", "rank").distinct().withColumn("t", F.row_number().over(Window.partitionBy("g").orderBy("rank")))
    searched = stage(searched, "targets")
    left = stage(blocks.select("g", "vals").join(searched.select("g").distinct(), "g"), "large")
    pivot = left.where(F.size("vals") > 0).groupBy("g").agg(F.expr("percentile(vals[int((size(vals) - 1) div 2)], 0.5D, size(vals))").alias("pivot"))
    state = stage(searched.join(pivot, "g").select("g", "t", F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"), F.col("rank").alias("need"), F.col("n").alias("size"), "pivot", F.lit(None).cast("double").alias("value")), "state")
    keyed, rounds = ["g"], 0
    busy = F.col("value").isNull() & (F.col("size") > finish)
    while state.where(busy).limit(1).count():
        asked = state.where(busy).groupBy(*keyed).agg(F.collect_list(F.struct("t", "lo", "hi", "pivot")).alias("targets"))
        found = left.join(asked, keyed).select("g", "vals", "targets").mapInArrow(_count, _ROUND)
        counted = found.groupBy("g", "t").agg(F.sum("less").alias("less"), F.sum("eq").alias("eq"), _weighted_median("lm", "lw").alias("lm"), _weighted_median("rm", "rw").alias("rm"))
        joined = state.join(counted, ["g", "t"], "left")
        down, hit = F.col("need") <= F.col("less"), F.col("need") <= F.col("less") + F.col("eq")
        idle = F.col("less").isNull()
        after = joined.select(
            "g",
            "t",
            F.when(idle | hit, F.col("lo")).otherwise(F.col("pivot")).alias("lo"),
            F.when(idle | ~down, F.col("hi")).otherwise(F.col("pivot")).alias("hi"),
            F.when(idle | hit, F.col("need")).otherwise(F.col("need") - F.col("less") - F.col("eq")).alias("need"),
            F.when(idle, F.col("size")).when(down, F.col("less")).when(hit, F.col("eq")).otherwise(F.col("size") - F.col("less") - F.col("eq")).alias("size"),
            F.when(idle, F.col("pivot")).when(down, F.col("lm")).otherwise(F.col("rm")).alias("pivot"),
            F.when(~idle & hit & ~down, F.col("pivot")).otherwise(F.col("value")).alias("value"),
        )
        step = stage(after, "state")
        release(state)
        state, rounds = step, rounds + 1
        if rounds % COMPACT == 0:
            open_ = state.where("value is null").groupBy(*keyed).agg(F.collect_list(F.struct("t", "lo", "hi")).alias("targets"))
            step = stage(left.join(open_, keyed).select("g", "vals", "targets").mapInArrow(_slices, "g string, t int, vals array<double>"), "left")
            release(left)
            left, keyed = step, ["g", "t"]
    open_ = state.where("value is null").groupBy(*keyed).agg(F.collect_list(F.struct("t", "lo", "hi")).alias("targets"))
    rest = left.join(open_, keyed).select("g", "vals", "targets").mapInArrow(_slices, "g string, t int, vals array<double>").groupBy("g", "t").agg(F.array_sort(F.flatten(F.collect_list("vals"))).alias("sorted"))
    done = state.join(rest, ["g", "t"], "left").select("g", "t", F.coalesce("value", F.try_element_at("sorted", F.col("need").cast("int"))).alias("value"))
    by_rank = searched.select("g", "rank", "t").join(done, ["g", "t"]).select("g", "rank", "value")
    return direct.unionByName(large.join(by_rank, ["g", "rank"]).select(*by, "metric", "part", "n", "rank", "value"))


METRICS = ["first_ns", "finished_ns", "queue_seconds"]
PERMILLE = [500, 900, 950, 990, 999]
GRID = 64


def waits(traces: DataFrame) -> DataFrame:
    """pod, run, log_day and the three measures; times are less sent_ns (exact below 2^53 ns, 104 days)."""
    return traces.select("pod", "run", "log_day", *((F.col(c) - F.col("sent_ns")).cast("double").alias(c) for c in METRICS[:2]), F.col("queue_seconds"))


def pod_percentiles(traces: DataFrame, permille: list[int] = PERMILLE) -> DataFrame:
    """(pod, metric, permille, n, value, rank_error) over all rows; rank_error is 0."""
    found = select_ranks(waits(traces), ["pod"], METRICS, permille, 1000)
    return found.select("pod", "metric", F.col("part").alias("permille"), "n", "value", F.lit(0).cast("bigint").alias("rank_error"))


def part_summaries(traces: DataFrame, part: str = "log_day", grid: int = GRID) -> DataFrame:
    """Mergeable summary of each pod, metric and log day (or run): values at the ranks ceil(n * j / grid), j = 0 .. grid.

    Equal ranks stand once. Summaries of different days can be united as they are.
    """
    found = select_ranks(waits(traces), ["pod", part], METRICS, list(range(grid + 1)), grid, SUMMARY_FINISH)
    return found.where("n > 0").select("pod", part, "metric", "n", "rank", "value").distinct()


def combine_summaries(summaries: DataFrame, part: str = "log_day", permille: list[int] = PERMILLE) -> DataFrame:
    """(pod, metric, permille, n, value, rank_error) from the summaries of any set of days or runs.

    The value's rank among all rows is off by no more than rank_error: the sum over the
    parts of their widest gap between two summary ranks, less one, which is at most a
    share of 1 / grid of all rows.
    """
    own = Window.partitionBy("pod", part, "metric").orderBy("rank")
    points = summaries.withColumn("weight", F.col("rank") - F.coalesce(F.lag("rank").over(own), F.lit(0)))
    sizes = points.groupBy("pod", part, "metric").agg(F.max("n").alias("n"), (F.max("weight") - 1).alias("gap")).groupBy("pod", "metric").agg(F.sum("n").alias("n"), F.sum("gap").alias("rank_error"))
    steps = points.groupBy("pod", "metric", "value").agg(F.sum("weight").alias("weight"))
    upto = F.sum("weight").over(Window.partitionBy("pod", "metric").orderBy("value"))
    steps = steps.withColumn("upto", upto).withColumn("below", F.col("upto") - F.col("weight"))
    wanted = sizes.withColumn("permille", F.explode(F.array(*map(F.lit, permille)))).withColumn("need", F.expr("greatest(1L, (n * permille + 999) div 1000)"))
    s = steps.withColumnsRenamed({"pod": "p", "metric": "m"})
    found = wanted.join(s, wanted["pod"].eqNullSafe(s["p"]) & (wanted["metric"] == s["m"]) & (F.col("below") < F.col("need")) & (F.col("need") <= F.col("upto")))
    return found.select("pod", "metric", "permille", "n", "value", "rank_error")
