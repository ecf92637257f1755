"""Structured Streaming over traces and samples: windows, alerts, fragment checks, idempotent sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def files(spark: SparkSession, path: str, schema: str, kind: str = "json", per_trigger: int | None = None) -> DataFrame:
    """Files that appear in a folder, as a stream."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", per_trigger) if per_trigger else reader).format(kind).load(path)


def tumbling(stream: DataFrame, time: str, by: list[str], width: str = "1 second", late: str = "30 seconds") -> DataFrame:
    """Counts in windows; rows later than ``late`` behind the newest are left out."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def sliding_rate(stream: DataFrame, time: str, by: list[str], width: str = "30 seconds", step: str = "5 seconds", seconds: int = 30, late: str = "30 seconds") -> DataFrame:
    """Rows per second in sliding windows."""
    windows = stream.withWatermark(time, late).groupBy(F.window(time, width, step), *by).agg(F.count("*").alias("n"))
    return windows.select(F.col("window.end").alias("at"), *by, "n", (F.col("n") / seconds).alias("rate"))


def once(stream: DataFrame, key: str, time: str, late: str = "1 day") -> DataFrame:
    """The first row of each key; keys are forgotten ``late`` behind the newest row."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def alerts(stream: DataFrame, name: str, time: str, condition: str, hold: float) -> DataFrame:
    """(name, epoch, state) at each change of state of a named alert. stream: name, time in seconds, boolean condition.

    Rows of a batch are taken in order of time; a null condition is false.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, since = state.get if state.exists else ("inactive", float("nan"))
        out = []
        rows = pd.concat(list(frames)).sort_values(time, kind="stable")
        for at, on in zip(rows[time], rows[condition]):
            if on is None or on is pd.NA or not bool(on):
                new, since = "inactive", float("nan")
            else:
                since = at if since != since else since
                new = "firing" if at - since >= hold else "pending"
            if new != now:
                out.append((key[0], float(at), new))
                now = new
        state.update((now, float(since)))
        yield pd.DataFrame(out, columns=["name", "epoch", "state"])

    grouped = stream.select(F.col(name).alias("name"), F.col(time).cast("double").alias(time), F.coalesce(condition, F.lit(False)).alias(condition)).groupBy("name")
    return grouped.applyInPandasWithState(step, "name string, epoch double, state string", "state string, since double", "append", GroupStateTimeout.NoTimeout)


def fragments(stream: DataFrame) -> DataFrame:
    """(request_id, seq, fault) of fragments out of order, and of what comes behind the last one. stream: request_id, seq, last, at.

    seq counts from 0 within a request; rows of a batch are taken in order of at, their arrival.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        expected, closed = state.get if state.exists else (0, False)
        out = []
        rows = pd.concat(list(frames)).sort_values("at", kind="stable")
        for seq, last in zip(rows["seq"], rows["last"]):
            if closed:
                out.append((key[0], int(seq), "after_last"))
            elif int(seq) != expected:
                out.append((key[0], int(seq), "order"))
            expected, closed = int(seq) + 1, closed or bool(last)
        state.update((expected, closed))
        yield pd.DataFrame(out, columns=["request_id", "seq", "fault"])

    return stream.groupBy("request_id").applyInPandasWithState(step, "request_id string, seq long, fault string", "expected long, closed boolean", "append", GroupStateTimeout.NoTimeout)


def idempotent(stream: DataFrame, path: str, key: str, checkpoint: str):
    """Writer that appends each key once to a Parquet ledger, also when a batch is replayed after a crash."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        try:
            held = spark.read.parquet(path).select(F.col(key).alias("_k"))
            fresh = fresh.join(held, F.col(key) == F.col("_k"), "left_anti")
        except Exception as e:  # noqa: BLE001 - the first batch finds no ledger yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        fresh.write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
