"""Request traces, metric series, joins over time and alert states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from karst.functions import arrays, stats

NO_ANSWER = "(без ответа)"


def with_waits(traces: DataFrame) -> DataFrame:
    """Traces with times in ms, for completed attempts only, and the lag of sending for all."""
    done = F.col("outcome") == "completed"
    ms = lambda a, b: (F.col(b) - F.col(a)) / 1e6
    return traces.withColumns({
        "ttfc": F.when(done, ms("sent_ns", "first_ns")), "full": F.when(done, ms("sent_ns", "finished_ns")), "queue": F.when(done, F.col("queue_seconds") * 1000), "lag": ms("planned_ns", "sent_ns"),
    })


def outcomes(traces: DataFrame, by: list[str]) -> DataFrame:
    """Counts by outcome and waits of each group; an interrupted answer of status 200 counts as aborted, other aborts as transport errors."""
    done, cut = F.col("outcome") == "completed", F.col("outcome") == "aborted"
    half = F.coalesce(cut & (F.col("status") == 200), F.lit(False))
    rows = with_waits(traces)
    counts = rows.groupBy(*by).agg(
        F.count("planned_ns").alias("scheduled"), F.count("*").alias("sent"), F.count_if(done).alias("completed"), F.count_if(F.col("outcome") == "rejected").alias("rejected"),
        F.count_if(half).alias("aborted"), F.count_if(cut & ~half).alias("transport_errors"), F.count_if(F.col("outcome") == "timed_out").alias("timed_out"), F.count_if(F.col("status").between(500, 599)).alias("http_5xx"),
        F.max("lag").alias("lag_max"), F.try_divide(F.count_if(done & (F.col("cache_hit") == "true")), F.count_if(done)).alias("hit_rate"),
    )
    wanted = {"ttfc_p50": ("ttfc", 0.5), "ttfc_p95": ("ttfc", 0.95), "full_p50": ("full", 0.5), "full_p95": ("full", 0.95), "queue_p95": ("queue", 0.95), "lag_p95": ("lag", 0.95)}
    found = stats.percentiles(rows, by, {v: F.col(v) for v in ("ttfc", "full", "queue", "lag")}, {k: (v, "ceil", p) for k, (v, p) in wanted.items()})
    if not by:
        return counts.crossJoin(found)  # one row each
    found = found.withColumnsRenamed({c: f"_{c}" for c in by})
    return counts.join(found, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]).drop(*(f"_{c}" for c in by))


def fragment_gaps(traces: DataFrame) -> DataFrame:
    """Traces with gap in ms, one row for each pair of neighbouring fragments."""
    return traces.withColumn("gap", F.explode(arrays.gaps(F.col("fragment_ns")))).withColumn("gap", F.col("gap") / 1e6)


def fragment_faults(traces: DataFrame) -> DataFrame:
    """Traces with fault: why the fragments of an attempt aren't what its row says, or null."""
    from karst.operators.quality import first_reason

    n = F.coalesce(F.size("fragment_ns"), F.lit(0))
    return traces.withColumn("fault", first_reason([
        ("missing", F.col("fragment_ns").isNull()), ("count", n != F.col("parts")), ("first", (n > 0) & ~F.col("first_ns").eqNullSafe(F.get("fragment_ns", F.lit(0)))),
        ("order", F.exists(arrays.gaps(F.col("fragment_ns")), lambda g: g < 0)), ("incomplete", (F.col("outcome") == "completed") & (n != F.col("payload.chunks"))),
    ]))


def _slotted(rows: DataFrame, time: str, width: int) -> DataFrame:
    """rows with _slot, each in the slot of its time and in the next one: a look back of ``width`` from any time of a slot stays inside it."""
    slot = F.floor(F.col(time) / F.lit(width)).cast("bigint")
    return rows.withColumn("_slot", F.explode(F.array(slot, slot + 1)))


def rate(samples: DataFrame, by: list[str], time: str, value: str, window: int) -> DataFrame:
    """samples with increase and rate of a counter over the ``window`` seconds up to each of them, the oldest second left out.

    Only samples inside the window count, and a drop between two of them is a reset. The increase is
    extrapolated to each edge of the window: all the way if the edge is nearer than 1.1 mean
    distances of samples, else by half such a distance, to the old edge no further than where the
    counter would be zero. A window of fewer than two samples gives no row. Series are cut into
    slots of time, so that one with a third of all samples is many tasks.
    """
    series = Window.partitionBy(*by, "_slot").orderBy(time)
    inside = series.rangeBetween(-window + 1, 0)
    before = F.lag(value).over(series)
    cut = _slotted(samples, time, window).withColumn("_drop", F.when(F.col(value) < before, before).otherwise(0.0))
    seen = cut.withColumns({
        "_n": F.count(value).over(inside), "_t": F.first(time).over(inside), "_v": F.first(value).over(inside), "_lost": F.sum("_drop").over(inside) - F.first("_drop").over(inside),
    }).where((F.col("_slot") == F.floor(F.col(time) / F.lit(window))) & (F.col("_n") > 1))
    seen = seen.withColumn("_grown", F.col(value) - F.col("_v") + F.col("_lost")).withColumn("_span", (F.col(time) - F.col("_t")).cast("double"))
    mean = F.col("_span") / (F.col("_n") - 1)
    start = F.col("_t") - (F.col(time) - F.lit(window))
    start = F.when(start >= mean * 1.1, mean / 2).otherwise(start.cast("double"))
    zero = F.when((F.col("_grown") > 0) & (F.col("_v") >= 0), F.col("_span") * (F.col("_v") / F.col("_grown"))).otherwise(start)
    factor = (F.col("_span") + F.least(start, zero)) / F.col("_span")  # a window ends at a sample, so nothing is added there
    return seen.withColumn("increase", F.col("_grown") * factor).withColumn("rate", F.col("increase") / window).drop("_drop", "_n", "_t", "_v", "_lost", "_grown", "_span", "_slot")


def instant(times: DataFrame, samples: DataFrame, by: list[str], at: str, time: str, value: str, lookback: int = 300) -> DataFrame:
    """times with the value of the last sample of their series in the ``lookback`` seconds up to ``at``, the oldest second left out; times without one give no row."""
    asked = times.withColumn("_slot", F.floor(F.col(at) / F.lit(lookback)).cast("bigint"))
    held = _slotted(samples.select(*by, F.col(time).alias("_time"), F.col(value).alias("_value")), "_time", lookback)
    found = as_of(asked, held, [*by, "_slot"], at, "_time", ["_time", "_value"])
    return found.where(F.col("_time") > F.col(at) - F.lit(lookback)).withColumn(value, F.col("_value")).drop("_slot", "_time", "_value")


def histogram(values: DataFrame, by: list[str], value: str, bounds: list[float]) -> DataFrame:
    """(by.., le, n): cumulative counts; the last bound is infinity. Null values don't count."""
    rows = values.where(F.col(value).isNotNull()).groupBy(*by).agg(*(F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)), F.count("*").alias("all"))
    entries = F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)), F.struct(F.lit(float("inf")).alias("le"), F.col("all").alias("n")))
    return rows.select(*by, F.explode(entries).alias("e")).select(*by, "e.*")


def histogram_quantile(buckets: DataFrame, by: list[str], q: float) -> DataFrame:
    """(by.., value): linear inside the bucket of rank q * count; the highest finite bound if that is the infinite one; null for no counts."""
    series = Window.partitionBy(*by).orderBy("le")
    total = F.max("n").over(Window.partitionBy(*by))
    lower, under = F.coalesce(F.lag("le").over(series), F.lit(0.0)), F.coalesce(F.lag("n").over(series), F.lit(0))
    rows = buckets.select(*by, "le", "n", lower.alias("lo"), under.alias("under"), (total * F.lit(q)).alias("rank"))
    hit = rows.where((F.col("n") >= F.col("rank")) & (F.col("n") > F.col("under")))
    first = hit.groupBy(*by).agg(F.min(F.struct("le", "lo", "n", "under", "rank")).alias("x"))
    inside = F.col("x.lo") + (F.col("x.le") - F.col("x.lo")) * (F.col("x.rank") - F.col("x.under")) / (F.col("x.n") - F.col("x.under"))
    return first.select(*by, F.when(F.col("x.le") == float("inf"), F.col("x.lo")).otherwise(inside).alias("value"))


def as_of(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, columns: list[str]) -> DataFrame:
    """left with the columns of the last right row at or before its time (null without one), by union and one sort.

    Right rows of one time: the greatest columns win. Keys of ``by`` may be null and then match null.
    """
    mine = left.withColumns({"_t": F.col(left_time), "_side": F.lit(1), "_row": F.struct(*left.columns), "_hit": F.lit(None).cast(right.select(F.struct(*columns).alias("s")).schema["s"].dataType)})
    theirs = right.select(*by, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(mine.schema["_row"].dataType).alias("_row"), F.struct(*columns).alias("_hit"))
    both = mine.select(*by, "_t", "_side", "_row", "_hit").unionByName(theirs)
    order = Window.partitionBy(*by).orderBy("_t", "_side", "_hit").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_last", F.last("_hit", ignorenulls=True).over(order)).where("_side = 1").select("_row.*", *(F.col("_last")[c].alias(c) for c in columns))


def first_after(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, name: str) -> DataFrame:
    """left with the first right time at or after its own."""
    mine = left.withColumns({"_t": F.col(left_time), "_side": F.lit(0), "_row": F.struct(*left.columns)})
    kind = mine.schema["_row"].dataType
    theirs = right.select(*by, F.col(right_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(kind).alias("_row"))
    both = mine.select(*by, "_t", "_side", "_row").unionByName(theirs).withColumn("_r", F.when(F.col("_side") == 1, F.col("_t")))
    order = Window.partitionBy(*by).orderBy("_t", "_side").rowsBetween(0, Window.unboundedFollowing)
    return both.withColumn(name, F.first("_r", ignorenulls=True).over(order)).where("_side = 0").select("_row.*", name)


def inside_interval(rows: DataFrame, bounds: DataFrame, by: str, time: str) -> DataFrame:
    """Rows with bounds.start < time <= bounds.end of their key; bounds: (by, start, end)."""
    return rows.join(bounds.withColumnRenamed(by, "_b"), (F.col(by) == F.col("_b")) & (F.col("start") < F.col(time)) & (F.col(time) <= F.col("end"))).drop("_b", "start", "end")


def transitions(states: DataFrame, by: list[str], time: str, state: str) -> DataFrame:
    """Rows at which the state differs from the one before; a first row counts."""
    before = F.lag(state).over(Window.partitionBy(*by).orderBy(time))
    return states.withColumn("before", before).where(~F.col(state).eqNullSafe(F.col("before")))


def alert_states(points: DataFrame, by: list[str], time: str, condition: Column, hold: float) -> DataFrame:
    """points with state: firing once the condition has held for ``hold`` seconds, pending before, else inactive."""
    series = Window.partitionBy(*by).orderBy(time)
    on = points.withColumn("_on", F.coalesce(condition, F.lit(False)))
    island = on.withColumn("_isle", F.sum(F.when(F.col("_on"), 0).otherwise(1)).over(series.rowsBetween(Window.unboundedPreceding, 0)))
    since = F.min(F.when(F.col("_on"), F.col(time))).over(Window.partitionBy(*by, "_isle"))
    return island.withColumn("state", F.when(~F.col("_on"), "inactive").when(F.col(time) - since >= hold, "firing").otherwise("pending")).drop("_on", "_isle")


def sequence_gaps(rows: DataFrame, by: str, seq: str, expected: DataFrame) -> DataFrame:
    """(by, seq, side): numbers of 0 .. count - 1 that are missing, and such that are beyond; expected: (by, count)."""
    wanted = expected.where("count > 0").select(by, F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias(seq))
    seen = rows.select(F.col(by).alias("_b"), F.col(seq).alias("_s")).distinct()
    joined = wanted.join(seen, (F.col(by) == F.col("_b")) & (F.col(seq) == F.col("_s")), "full_outer").where(F.col(seq).isNull() | F.col("_s").isNull())
    return joined.select(F.coalesce(by, "_b").alias(by), F.coalesce(seq, "_s").alias(seq), F.when(F.col("_s").isNull(), "missing").otherwise("unexpected").alias("side"))


def schedule(runs: DataFrame) -> DataFrame:
    """(run, seq, planned, owner): open-loop requests of each run; owner by the run's traffic."""
    rows = runs.select("run", "traffic", "start_epoch", "rate", F.explode(F.sequence(F.lit(0), F.greatest(F.col("duration") * F.col("rate"), F.lit(1)) - 1)).alias("seq")).where("rate > 0")
    turn = F.col("seq") % 15
    owner = F.when(F.col("traffic") == "solo", 0).when(F.col("traffic") == "skew", F.when(turn < 12, 0).otherwise(turn - 11)).otherwise(F.col("seq") % 4)
    return rows.select("run", "seq", (F.col("start_epoch") + F.col("seq") / F.col("rate")).alias("planned"), owner.cast("int").alias("owner"))


def ready_pods(snapshots: DataFrame, version: str | None = None) -> DataFrame:
    """Snapshots with ready: pods (map of name to struct of ready, deletion, version) that serve and aren't being deleted."""
    serving = F.filter(F.map_values("pods"), lambda p: F.coalesce(p["ready"], F.lit(False)) & p["deletion"].isNull() & (F.lit(True) if version is None else F.coalesce(p["version"] == version, F.lit(False))))
    return snapshots.withColumn("ready", F.when(F.col("pods").isNotNull(), F.size(serving)).otherwise(0))


def endpoint_pods(snapshots: DataFrame, service: str) -> DataFrame:
    """(epoch, target, pod): targets of a service's slices with the pod of that name, null for one that is gone."""
    targets = F.flatten(F.transform(F.coalesce(F.try_element_at("slices", F.lit(service)), F.array()), lambda s: s["targets"]))
    return snapshots.select("epoch", "pods", F.explode(targets).alias("target")).select("epoch", "target", F.try_element_at("pods", F.col("target")).alias("pod"))


def alert_marks(states: DataFrame, by: list[str], time: str) -> DataFrame:
    """First pending, first firing and first inactive behind the last firing time of each alert."""
    at = lambda s: F.min(F.when(F.col("state") == s, F.col(time)))
    last = F.max(F.when(F.col("state") == "firing", F.col(time))).over(Window.partitionBy(*by))
    return states.withColumn("_last", last).groupBy(*by).agg(at("pending").alias("pending"), at("firing").alias("firing"), F.min(F.when((F.col("state") == "inactive") & (F.col(time) > F.col("_last")), F.col(time))).alias("inactive"))
