"""Filling sequences of fixed capacity with whole token arrays (problem 4).

Only the counts of the lengths decide which lengths go together, and there are no more of
them than the capacity, so a plan over counts is made on the driver: combinations that
exactly fill the gap of a length are looked up by their sum (one, two or three more
arrays) and consumed as often as their counts allow; what is left is packed by best fit,
equal cases at once. Arrays then find their sequence by their rank among those of their
length, counted in salted strips, so that no length, however frequent, is one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from karst.sources.staging import stage

#: Rows of one length that are ranked in one strip, on average.
STRIP = 200_000


@dataclass(frozen=True)
class Pattern:
    """``times`` equal sequences that hold arrays of these lengths."""

    lengths: tuple[int, ...]
    times: int


def plan(counts: np.ndarray, capacity: int) -> list[Pattern]:
    """Patterns that use counts[length] arrays of each length from 1 to capacity, each exactly once."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    left[: len(counts)] = counts[: capacity + 1]
    left[0] = 0
    out: list[Pattern] = []

    def use(lengths: tuple[int, ...]) -> bool:
        kinds, each = np.unique(np.array(lengths), return_counts=True)
        times = int((left[kinds] // each).min())
        if times:
            left[kinds] -= each * times
            out.append(Pattern(lengths, times))
        return times > 0

    use((capacity,))
    for size in (1, 2, 3):  # partners that together fill the gap
        for length in range(capacity - 1, 0, -1):
            gap = capacity - length
            if size == 1:
                if left[length]:
                    use((length, gap))
            elif size == 2:
                b = np.arange(1, gap // 2 + 1)
                for k in b[(left[b] > 0) & (left[gap - b] > 0)]:
                    if not left[length]:
                        break
                    use((length, int(gap - k), int(k)))
            else:
                for c in np.flatnonzero(left[: gap // 3 + 1] > 0):
                    if not left[length]:
                        break
                    rest = gap - int(c)
                    b = np.arange(int(c), rest // 2 + 1)
                    for k in b[(left[b] > 0) & (left[rest - b] > 0)]:
                        if not (left[length] and left[c]):
                            break
                        use((length, int(rest - k), int(k), int(c)))

    open_: list[dict[tuple[int, ...], int]] = [{} for _ in range(capacity + 1)]  # by gap: contents and how many such sequences
    for length in range(capacity, 0, -1):
        need = int(left[length])
        while need:
            gap = next((g for g in range(length, capacity + 1) if open_[g]), None)
            if gap is None:
                per = capacity // length
                full, rest = divmod(need, per)
                for k, times in ((per, full), (rest, 1 if rest else 0)):
                    if times:
                        _add(open_, capacity - k * length, (length,) * k, times)
                need = 0
                continue
            held, times = next(iter(open_[gap].items()))
            fit = gap // length
            take = min(times, need // fit) or 1
            k = fit if need >= fit else need
            _add(open_, gap, held, -take)
            _add(open_, gap - k * length, (*held, *(length,) * k), take)
            need -= take * k
    out.extend(Pattern(held, times) for at in open_ for held, times in at.items())
    return out


def _add(open_: list[dict[tuple[int, ...], int]], gap: int, held: tuple[int, ...], times: int) -> None:
    now = open_[gap].get(held, 0) + times
    if now:
        open_[gap][held] = now
    else:
        del open_[gap][held]


@dataclass
class Slots:
    """By length, which ranks go to which sequences: the rank's run, copies per sequence and first sequence."""

    runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    sequences: int

    @staticmethod
    def of(patterns: list[Pattern]) -> Slots:
        rows: dict[int, list[tuple[int, int, int, int]]] = {}
        used: dict[int, int] = {}
        first = 0
        for p in patterns:
            for length in dict.fromkeys(p.lengths):
                copies = p.lengths.count(length)
                rows.setdefault(length, []).append((used.get(length, 0), copies, first, sum(x for x in p.lengths if x > length)))
                used[length] = used.get(length, 0) + copies * p.times
            first += p.times
        return Slots({k: tuple(np.array(c, dtype=np.int64) for c in zip(*v)) for k, v in rows.items()}, first)

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and place of the first id in it."""
        seq, start = np.zeros(len(length), dtype=np.int64), np.zeros(len(length), dtype=np.int64)
        for one in np.unique(length):
            at = np.flatnonzero(length == one)
            begin, copies, first, before = self.runs[int(one)]
            run = np.searchsorted(begin, rank[at], "right") - 1
            k = rank[at] - begin[run]
            seq[at] = first[run] + k // copies[run]
            start[at] = before[run] + (k % copies[run]) * one
        return seq, start


def pack(rows: DataFrame, capacity: int = 384, key: str = "seq_no", ids: str = "input_ids") -> DataFrame:
    """(key, piece, n_ids, sequence_id, start): where each array goes.

    An array stays whole (piece 0) unless it alone is longer than the capacity; then it is
    cut into full pieces and a rest, numbered from 0. Null and empty arrays go nowhere.
    Repeated rows are packed each. ``start`` is the place in the sequence, from 0.
    """
    sized = rows.select(F.col(key).alias("seq_no"), F.size(ids).alias("n")).where("n > 0")
    count = F.expr(f"int((n + {capacity - 1}) div {capacity})")
    pieces = stage(
        sized.select("seq_no", F.explode(F.transform(F.sequence(F.lit(0), count - 1), lambda k: F.struct(k.alias("piece"), F.least(F.lit(capacity), F.col("n") - k * capacity).alias("n_ids")))).alias("p")).select("seq_no", "p.*"),
        "pieces",
    )
    counted = {r["n_ids"]: r["count"] for r in pieces.groupBy("n_ids").count().collect()}  # at most ``capacity`` rows
    counts = np.zeros(capacity + 1, dtype=np.int64)
    for length, c in counted.items():
        counts[length] = c
    slots = rows.sparkSession.sparkContext.broadcast(Slots.of(plan(counts, capacity)))
    strips = int(max(counts.max(initial=0) // STRIP, 0)) + 1
    salted = pieces.withColumn("strip", F.pmod(F.xxhash64("seq_no", "piece"), F.lit(strips)).cast("int"))
    if strips > 1:
        # lengths times strips; a strip stands for STRIP rows of the most frequent length
        spread = salted.groupBy("n_ids", "strip").count()
        offsets = spread.select("n_ids", "strip", (F.sum("count").over(Window.partitionBy("n_ids").orderBy("strip")) - F.col("count")).alias("offset"))
        salted = salted.join(offsets, ["n_ids", "strip"])
    else:
        salted = salted.withColumn("offset", F.lit(0).cast("bigint"))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("n_ids", "strip").orderBy("seq_no", "piece")) - 1 + F.col("offset"))

    @F.pandas_udf("sequence_id bigint, start int")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        seq, start = slots.value.find(length.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": seq, "start": start.astype(np.int32)})

    return ranked.withColumn("at", place("n_ids", "rank")).select(F.col("seq_no").alias(key), "piece", "n_ids", "at.sequence_id", "at.start")


def sequences(rows: DataFrame, capacity: int = 384, key: str = "seq_no", ids: str = "input_ids") -> DataFrame:
    """(sequence_id, input_ids, parts): the sequences themselves, with keys and lengths of their parts in order."""
    placed = pack(rows, capacity, key, ids)
    parts = placed.join(rows.select(key, F.col(ids).alias("ids")), key).select("sequence_id", F.struct("start", "n_ids", key, F.slice("ids", F.col("piece") * capacity + 1, F.col("n_ids")).alias("ids")).alias("part"))
    grouped = parts.groupBy("sequence_id").agg(F.array_sort(F.collect_list("part")).alias("p"))  # a sequence holds ``capacity`` ids at most
    return grouped.select("sequence_id", F.flatten("p.ids").alias("input_ids"), F.transform("p", lambda x: F.struct(x[key].alias(key), x["n_ids"].alias("n_ids"))).alias("parts"))


def fill(placed: DataFrame, capacity: int = 384) -> DataFrame:
    """One row: arrays (pieces), sequences, ids, least possible sequences, and share of unused room."""
    return placed.agg(
        F.count("*").alias("n_pieces"),
        F.countDistinct("sequence_id").alias("n_sequences"),
        F.coalesce(F.sum("n_ids"), F.lit(0)).alias("n_ids"),
    ).withColumns({"least_sequences": F.ceil(F.col("n_ids") / capacity), "unused": 1 - F.try_divide(F.col("n_ids"), F.col("n_sequences") * capacity)})
