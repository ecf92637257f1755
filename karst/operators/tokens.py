"""Token arrays of chat records: lengths, truncation, padding, batches and packing."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from karst.functions import arrays
from karst.operators.sampling import global_rank


def describe(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean to one digit, linear percentiles cut to whole numbers, and most."""
    p = lambda q: F.expr(f"int(percentile({value}, {q}D))")
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.round(F.avg(value), 1).alias("mean"), p(0.5).alias("p50"), p(0.9).alias("p90"), p(0.99).alias("p99"), F.max(value).alias("most"))


def truncation(df: DataFrame, by: list[str], length: str, most: int, warn: float) -> DataFrame:
    """Rows longer than ``most``, their share to six digits, and whether it exceeds ``warn``. Null lengths aren't cut."""
    cut = F.count_if(F.col(length) > most)
    return df.groupBy(*by).agg(F.count("*").alias("n"), cut.alias("truncated"), F.round(cut / F.count("*"), 6).alias("truncated_share"), (cut / F.count("*") > warn).alias("above"))


def budget(df: DataFrame, split: str, length: str, candidates: list[int], share: float) -> DataFrame:
    """Smallest candidate budget with no more than ``share`` cut in any split; one row, null if none fits."""
    rows = df.where(F.col(length).isNotNull()).groupBy(split).agg(*(F.avg((F.col(length) > c).cast("int")).alias(f"c{c}") for c in candidates))
    worst = rows.agg(*(F.max(f"c{c}").alias(f"c{c}") for c in candidates))
    fits = F.array(*(F.when(F.col(f"c{c}") <= share, F.lit(c)) for c in candidates))
    return worst.select(F.array_min(F.array_compact(fits)).alias("budget"))


def batches(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """df with batch (from 0) and slot in it, along the order."""
    from karst.operators.sampling import global_rank

    return global_rank(df, order, "_r").withColumns({"batch": F.expr(f"(_r - 1) div {size}"), "slot": F.expr(f"int((_r - 1) % {size})")}).drop("_r")


def padded(df: DataFrame, batch: str, ids: str, labels: str, pad_id: int, left: bool = False) -> DataFrame:
    """df with ids, labels and attention filled up to the longest array of the batch; null arrays count as empty."""
    empty = F.array().cast("array<int>")
    whole = df.withColumns({ids: F.coalesce(ids, empty), labels: F.coalesce(labels, empty)}).withColumn("width", F.max(F.size(ids)).over(Window.partitionBy(batch)))
    return whole.withColumns({"attention": arrays.pad(arrays.attention(F.col(ids)), F.col("width"), 0, left), ids: arrays.pad(F.col(ids), F.col("width"), pad_id, left), labels: arrays.pad(F.col(labels), F.col("width"), arrays.PAD_LABEL, left)})


def first_fit_runs(counts: list[tuple[int, int]], capacity: int) -> list[tuple[int, int, int]]:
    """(place, arrays a bin, first bin) of first-fit decreasing over counts of lengths, given as (length, count), longest first.

    Arrays from a place on, in order of length, go that many to a bin. Equal arrays fill one bin
    after the other, so bins are kept as runs of equal room, a few for each length.
    """
    bins: list[list[int]] = []  # first bin, number of bins, room in each
    out, place, used = [], 0, 0
    for length, need in counts:
        after = []
        for first, n, room in bins:
            each = room // length
            if need and each:
                full = min(n, need // each)
                rest = need - full * each if full < n else 0
                for k, times in ((each, full), (rest, 1 if rest else 0)):
                    if times:
                        out.append((place, k, first))
                        after.append([first, times, room - k * length])
                        place, need, first, n = place + k * times, need - k * times, first + times, n - times
            if n:
                after.append([first, n, room])
        each = max(capacity // length, 1)
        full, rest = divmod(need, each)
        for k, times in ((each, full), (rest, 1 if rest else 0)):
            if times:
                out.append((place, k, used))
                after.append([used, times, max(capacity, length) - k * length])
                place, used = place + k * times, used + times
        bins = [b for b in after if b[2]]
    return out


def first_fit(df: DataFrame, key: str, length: str, capacity: int, shards: int) -> DataFrame:
    """(key, length, shard, bin): first-fit decreasing within shards by hash of the key; ties by key.

    An array longer than the capacity has a bin of its own. Null and zero lengths have none.
    One shard gives the sequential result over all rows, of any number: bins follow from the
    counts of the lengths, which are collected, and from each row's rank.
    """
    kind = {f.name: f.dataType.simpleString() for f in df.schema}
    sharded = df.where(F.col(length) > 0).select(key, length, F.pmod(F.xxhash64(key), F.lit(shards)).cast("int").alias("shard"))

    def pack(rows: DataFrame) -> DataFrame:
        # arrays from the capacity on have a bin each, so they count as one length
        size = F.least(F.col(length), F.lit(capacity)).cast("int").alias("size")
        counts = sorted(((r["size"], r["count"]) for r in rows.groupBy(size).count().collect()), reverse=True)
        begin, each, first = (np.array(c, dtype=np.int64) for c in zip(*first_fit_runs(counts, capacity) or [(0, 1, 0)]))

        @F.pandas_udf("int")
        def place(rank: pd.Series) -> pd.Series:
            at = rank.to_numpy() - 1
            run = np.searchsorted(begin, at, "right") - 1
            return pd.Series((first[run] + (at - begin[run]) // each[run]).astype(np.int32))

        ranked = global_rank(rows, [F.col(length).desc(), F.col(key).asc_nulls_last()], "rank")
        return ranked.select(key, length, "shard", place("rank").alias("bin"))

    parts = [pack(sharded.where(F.col("shard") == s)) for s in range(shards)]
    return reduce(DataFrame.unionAll, parts).select(F.col(key).cast(kind[key]), F.col(length).cast(kind[length]), "shard", "bin")


def packing_report(packed: DataFrame, length: str, capacity: int, batch: int) -> DataFrame:
    """Sequences and optimizer steps before and after, fill and most arrays in a bin."""
    bins = packed.groupBy("shard", "bin").agg(F.count("*").alias("k"), F.sum(length).alias("used"))
    one = bins.agg(F.sum("k").alias("before"), F.count("*").alias("after"), F.sum("used").alias("used"), F.max("k").alias("most_in_bin"))
    steps = one.withColumns({"steps_before": F.ceil(F.col("before") / batch), "steps_after": F.ceil(F.col("after") / batch)})
    return steps.select("before", "after", "steps_before", "steps_after", F.round(1 - F.try_divide(F.col("steps_after"), F.col("steps_before")), 4).alias("steps_saved"), F.round(F.try_divide(F.col("used"), F.col("after") * capacity), 4).alias("fill"), "most_in_bin")


