"""Token arrays and sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAD_LABEL = -100


def mask_prompt(ids: Column, n_prompt: Column) -> Column:
    """Labels: the first n_prompt ids become -100. A negative or null count gives null."""
    return F.when(n_prompt >= 0, F.transform(ids, lambda x, i: F.when(i < n_prompt, PAD_LABEL).otherwise(x)))


def truncate(ids: Column, most: int) -> Column:
    return F.slice(ids, 1, most)


def attention(ids: Column) -> Column:
    return F.transform(ids, lambda _: F.lit(1))


def supervised(labels: Column, skip_first: bool = False) -> Column:
    """Number of labels that count for the loss; training skips the first label. Null arrays have none."""
    kept = F.filter(labels, lambda x, i: (x != PAD_LABEL) & (i > 0 if skip_first else F.lit(True)))
    return F.when(labels.isNull(), 0).otherwise(F.size(kept))


def pad(ids: Column, width: Column, fill: int, left: bool = False) -> Column:
    room = F.array_repeat(F.lit(fill), F.greatest(width - F.size(ids), F.lit(0)).cast("int"))
    return F.concat(room, ids) if left else F.concat(ids, room)


def prompt_boundary(full: Column, prompt: Column, starts: Column, boundary: Column) -> Column:
    """Tokens of the prompt: its own count where full begins with it, else the tokens that start before boundary; null if all do."""
    n = F.size(prompt)
    at = F.array_position(F.transform(starts, lambda s: s >= boundary), F.lit(True))
    return F.when(F.slice(full, 1, n) == prompt, n).when(at > 0, (at - 1).cast("int"))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    one = F.size(F.array_union(a, b))
    return F.when(one == 0, 1.0).otherwise(both / one)


def l2_norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def gaps(times: Column) -> Column:
    """Differences of neighbours."""
    return F.when(F.size(times) > 1, F.transform(F.sequence(F.lit(1), F.size(times) - 1), lambda i: F.get(times, i) - F.get(times, i - 1))).otherwise(F.array().cast("array<bigint>"))
