"""Aggregates: three kinds of percentiles, spread, weighted mean.

percentile_ceil and percentile_linear are Spark's own aggregates, which keep the distinct
values of a group in memory: for lengths, codes and small groups. percentiles() is exact
for groups of any size: values are counted, sorted over range partitions and picked by rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from karst.sources.staging import stage


def percentile_ceil(value: str, p: float) -> Column:
    """sorted[ceil(n p) - 1]; null for no values."""
    return F.expr(f"percentile_disc({p}D) WITHIN GROUP (ORDER BY {value})")


def percentile_linear(value: str, p: float) -> Column:
    """Linear between neighbours."""
    return F.expr(f"percentile({value}, {p}D)")


def percentile_floor(df: DataFrame, by: list[str], value: str, ps: dict[str, float]) -> DataFrame:
    """sorted[min(n - 1, floor(n p))] for each group, without holding a group: counts of values are ranked.

    Null values don't count; groups without values are left out.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    whole = Window.partitionBy(*by)
    upto = F.sum("_c").over(whole.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counted.withColumns({"_upto": upto, "_n": F.sum("_c").over(whole)})
    at = {k: F.least(F.col("_n") - 1, F.floor(F.col("_n") * F.lit(float(p)))) for k, p in ps.items()}
    return ranked.groupBy(*by).agg(*(F.min(F.when(F.col("_upto") > a, F.col(value))).alias(k) for k, a in at.items()), F.max("_n").alias("n"))


def spread(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, p10, p50, p90, their ratio, coefficient of variation, least and most."""
    quantiles = percentile_floor(df, by, value, {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    rest = df.where(F.col(value).isNotNull()).groupBy(*by).agg(half_even(F.try_divide(F.stddev_pop(value), F.avg(value)), 3).alias("cv"), F.min(value).alias("least"), F.max(value).alias("most"))
    if by:
        q = quantiles.withColumnsRenamed({c: f"_{c}" for c in by})
        on = [rest[c].eqNullSafe(q[f"_{c}"]) for c in by]
        joined = rest.join(q, on).drop(*(f"_{c}" for c in by))
    else:
        joined = rest.crossJoin(quantiles)  # one row each
    return joined.withColumn("ratio", half_even(F.col("p90") / F.greatest("p10", F.lit(1)), 2))


def weighted_mean(value: str, weight: str) -> Column:
    """Sum of value * weight by weight; rows of zero weight don't count, nor does a group of them."""
    return F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(F.when(F.col(value).isNotNull(), F.col(weight))))


def half_even(value: Column, digits: int) -> Column:
    """value rounded to digits, halves to even, by its exact binary value: the error of value * 10^digits, found by splitting both factors, decides near a half."""
    x, scale = value.cast("double"), F.lit(float(10**digits))

    def halves(v: Column) -> tuple[Column, Column]:
        high = v * F.lit(134217729.0) - (v * F.lit(134217729.0) - v)  # 2^27 + 1
        return high, v - high

    product = x * scale
    (a, b), (c, d) = halves(x), halves(scale)
    error = b * d - (product - a * c - b * c - a * d)
    low = F.floor(product).cast("double")
    near = F.when(product - low != 0.5, F.rint(product)).when(error > 0, low + 1).when(error < 0, low).otherwise(F.rint(product))
    return F.when(F.abs(product) < 4e15, near / scale).otherwise(x)


def _ranks(kind: str, p: float, n: Column) -> tuple[Column, Column]:
    """First and last rank (from 1) that a percentile needs."""
    if kind == "ceil":
        one = F.greatest(F.lit(1), F.ceil(n * F.lit(p)))
        return one, one
    if kind == "floor":
        one = F.least(n, F.floor(n * F.lit(p)) + 1)
        return one, one
    if kind == "linear":
        return F.floor((n - 1) * F.lit(p)) + 1, F.ceil((n - 1) * F.lit(p)) + 1
    raise ValueError(f"no such kind of percentile: {kind}")


def percentiles(df: DataFrame, by: list[str], values: dict[str, Column], wanted: dict[str, tuple[str, str, float]]) -> DataFrame:
    """(by.., wanted..): exact percentiles of any number of values; wanted: name to (value, kind, p).

    Kinds are ceil, floor and linear. Null values don't count; a group without values has
    nulls. Null groups are groups. A hot group is spread over range partitions like the rest.
    """
    keys = [*by, "_v"]
    entries = F.array(*(F.struct(F.lit(k).alias("_v"), c.cast("double").alias("_x")) for k, c in values.items()))
    counted = df.select(*by, F.explode(entries).alias("_e")).select(*by, "_e.*").where("_x is not null").groupBy(*keys, "_x").agg(F.count("*").alias("_c"))
    parts = stage(counted.repartitionByRange(*keys, "_x").withColumn("_p", F.spark_partition_id()), "ranges")
    sums = parts.groupBy(*keys, "_p").agg(F.sum("_c").alias("_s"))
    whole = Window.partitionBy(*keys)  # a row per partition that holds the group
    offsets = sums.select(*(F.col(k).alias(f"o{k}") for k in keys), F.col("_p").alias("o_p"), (F.sum("_s").over(whole.orderBy("_p")) - F.col("_s")).alias("_before"), F.sum("_s").over(whole).alias("_n"))
    local = F.sum("_c").over(Window.partitionBy(*keys, "_p").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0))
    ranked = parts.withColumn("_local", local).join(offsets, [F.col(k).eqNullSafe(F.col(f"o{k}")) for k in keys] + [F.col("_p") == F.col("o_p")]).withColumn("_upto", F.col("_local") + F.col("_before"))
    picks = {}
    for name, (value, kind, p) in wanted.items():
        for end, rank in zip("ab", _ranks(kind, p, F.col("_n"))):
            picks[f"{name}_{end}"] = F.min(F.when((F.col("_v") == value) & (F.col("_upto") >= rank), F.col("_x")))
        picks[f"{name}_n"] = F.max(F.when(F.col("_v") == value, F.col("_n")))
    found = ranked.groupBy(*by).agg(*(c.alias(k) for k, c in picks.items()))

    def value_of(name: str) -> Column:
        kind, p = wanted[name][1:]
        a, b, n = (F.col(f"{name}_{x}") for x in "abn")
        place = (n - 1) * F.lit(p)
        return (a + (b - a) * (place - F.floor(place)) if kind == "linear" else a).alias(name)

    out = found.select(*by, *map(value_of, wanted))
    if not by:
        return out
    groups = df.select(*(F.col(c).alias(f"g_{c}") for c in by)).distinct()
    return groups.join(out, [F.col(f"g_{c}").eqNullSafe(F.col(c)) for c in by], "left").select(*(F.col(f"g_{c}").alias(c) for c in by), *wanted)
