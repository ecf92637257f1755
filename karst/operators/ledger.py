"""Append-only ledgers: identities, recovery of an intent, membership, stale bindings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HEX64 = "^[0-9a-f]{64}$"


def is_digest(value: Column) -> Column:
    return F.coalesce(value.rlike(HEX64), F.lit(False))


def is_share(value: Column) -> Column:
    """A number from 0 to 1; null, NaN and infinities aren't."""
    return F.coalesce(~F.isnan(value) & value.between(0, 1), F.lit(False))


def identity(*parts: Column) -> Column:
    """Digest of the digests of the parts, in order."""
    return F.sha2(F.concat_ws("\n", *(F.sha2(F.coalesce(p.cast("string"), F.lit("")), 256) for p in parts)), 256)


def members(requests: DataFrame, ledger: DataFrame, key: str) -> DataFrame:
    """Requests whose key stands in the ledger."""
    return requests.join(ledger.select(F.col(key).alias("_k")), F.col(key) == F.col("_k"), "left_semi")


def append(ledger: DataFrame, events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Ledger with the first event of each new key; keys that it holds add nothing."""
    first = events.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")
    new = first.join(ledger.select(F.col(key).alias("_k")), F.col(key) == F.col("_k"), "left_anti")
    return ledger.unionByName(new, allowMissingColumns=True)


def recover(ledger: DataFrame, pending: DataFrame, pointer: str | None, key: str) -> DataFrame:
    """Ledger after a crash: a pending event counts if the pointer shows its digest (column pointer_sha256)."""
    done = pending.where(F.col("pointer_sha256") == F.lit(pointer)).drop("pointer_sha256")
    return append(ledger, done, key, [key])


def stale(stored: DataFrame, current: DataFrame, key: str, digest: str) -> DataFrame:
    """(key, stored, current) whose digests differ or of which one side is missing."""
    a, b = stored.select(key, F.col(digest).alias("stored")), current.select(F.col(key).alias("_k"), F.col(digest).alias("current"))
    return a.join(b, F.col(key) == F.col("_k"), "full_outer").where(~F.col("stored").eqNullSafe(F.col("current"))).select(F.coalesce(key, "_k").alias(key), "stored", "current")


def latest(df: DataFrame, by: str, order: list[str]) -> DataFrame:
    """The row of the greatest order of each key, by partial aggregation."""
    rest = [c for c in df.columns if c != by]
    return df.groupBy(by).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_x")).select(by, "_x.*")
