"""Queries over request traces and event series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from karst.functions import stats
from karst.operators import evaluate, telemetry
from karst.plans.catalog import Tables, query

def _p(x: str, p: float) -> str:
    return f"quantile_disc({x}, {p})"


_WAITS = """(SELECT *, CASE WHEN outcome = 'completed' THEN (first_ns - sent_ns) / 1e6 END AS ttfc, CASE WHEN outcome = 'completed' THEN (finished_ns - sent_ns) / 1e6 END AS full_ms,
  CASE WHEN outcome = 'completed' THEN queue_seconds * 1000 END AS queue, (sent_ns - planned_ns) / 1e6 AS lag FROM warmup_fixed)"""
_OUTCOMES = f"""count(planned_ns) AS scheduled, count(*) AS sent, count(*) FILTER (WHERE outcome = 'completed') AS completed, count(*) FILTER (WHERE outcome = 'rejected') AS rejected,
  count(*) FILTER (WHERE outcome = 'aborted' AND status = 200) AS aborted, count(*) FILTER (WHERE outcome = 'aborted' AND status IS DISTINCT FROM 200) AS transport_errors, count(*) FILTER (WHERE outcome = 'timed_out') AS timed_out, count(*) FILTER (WHERE status BETWEEN 500 AND 599) AS http_5xx,
  {_p('ttfc', 0.5)} AS ttfc_p50, {_p('ttfc', 0.95)} AS ttfc_p95, {_p('full_ms', 0.5)} AS full_p50, {_p('full_ms', 0.95)} AS full_p95, {_p('queue', 0.95)} AS queue_p95, {_p('lag', 0.95)} AS lag_p95, max(lag) AS lag_max,
  count(*) FILTER (WHERE outcome = 'completed' AND cache_hit = 'true') / nullif(count(*) FILTER (WHERE outcome = 'completed'), 0) AS hit_rate"""


@query("outcome_summary", f"SELECT {_OUTCOMES} FROM {_WAITS}")
def _(t: Tables) -> DataFrame:
    return telemetry.outcomes(t.warmup_fixed, [])


@query("summary_by_key", f"SELECT pod, {_OUTCOMES} FROM {_WAITS} GROUP BY pod")
def _(t: Tables) -> DataFrame:
    return telemetry.outcomes(t.warmup_fixed, ["pod"])


@query("coalesce_label_count", f"SELECT coalesce(nullif(pod, ''), '{telemetry.NO_ANSWER}') AS label, count(*) AS n FROM warmup_fixed GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.warmup_fixed.groupBy(F.coalesce(F.nullif("pod", F.lit("")), F.lit(telemetry.NO_ANSWER)).alias("label")).agg(F.count("*").alias("n"))


@query("percentile_ceil", f"SELECT event_type, {_p('value', 0.5)} AS p50, {_p('value', 0.95)} AS p95 FROM events GROUP BY event_type")
def _(t: Tables) -> DataFrame:
    return stats.percentiles(t.events, ["event_type"], {"v": F.col("value")}, {"p50": ("v", "ceil", 0.5), "p95": ("v", "ceil", 0.95)})


@query("median_speed", "SELECT traffic, quantile_cont(queue_seconds, 0.5) AS median FROM warmup_fixed GROUP BY traffic")
def _(t: Tables) -> DataFrame:
    return stats.percentiles(t.warmup_fixed, ["traffic"], {"q": F.col("queue_seconds")}, {"median": ("q", "linear", 0.5)})


@query("latency_ms", "SELECT request_id, seq, (first_ns - sent_ns) / 1e6 AS ttfc, (finished_ns - sent_ns) / 1e6 AS full_ms FROM warmup_fixed")
def _(t: Tables) -> DataFrame:
    return t.warmup_fixed.select("request_id", "seq", ((F.col("first_ns") - F.col("sent_ns")) / 1e6).alias("ttfc"), ((F.col("finished_ns") - F.col("sent_ns")) / 1e6).alias("full_ms"))


@query("latency_benchmark", """
SELECT run, count(*) AS n, count(*) FILTER (WHERE ok) AS successes, count(*) FILTER (WHERE NOT ok) AS errors, round(avg(s) FILTER (WHERE ok), 6) AS mean_success, max(s) FILTER (WHERE ok) AS max_success, round(avg(s) FILTER (WHERE NOT ok), 6) AS mean_error, max(s) FILTER (WHERE NOT ok) AS max_error,
  round(count(*) FILTER (WHERE ok) / nullif((max(finished_ns) - min(sent_ns)) / 1e9, 0), 6) AS per_second FROM (SELECT *, coalesce(status = 200 AND outcome = 'completed', false) AS ok, (finished_ns - sent_ns) / 1e9 AS s FROM warmup_fixed) GROUP BY run""")
def _(t: Tables) -> DataFrame:
    ok = F.coalesce((F.col("status") == 200) & (F.col("outcome") == "completed"), F.lit(False))
    rows = t.warmup_fixed.withColumns({"ok": ok, "s": (F.col("finished_ns") - F.col("sent_ns")) / 1e9})
    good, bad = F.when(F.col("ok"), F.col("s")), F.when(~F.col("ok"), F.col("s"))
    return rows.groupBy("run").agg(
        F.count("*").alias("n"), F.count_if("ok").alias("successes"), F.count_if(~F.col("ok")).alias("errors"), F.round(F.avg(good), 6).alias("mean_success"), F.max(good).alias("max_success"), F.round(F.avg(bad), 6).alias("mean_error"), F.max(bad).alias("max_error"),
        F.round(F.try_divide(F.count_if("ok"), (F.max("finished_ns") - F.min("sent_ns")) / 1e9), 6).alias("per_second"),
    )


@query("inter_event_gap", """
SELECT event_type, count(gap) AS n, round(avg(gap), 6) AS mean FROM (SELECT event_type, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events) GROUP BY event_type""")
def _(t: Tables) -> DataFrame:
    gap = F.col("value") - F.lag("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t.events.select("event_type", gap.alias("gap")).groupBy("event_type").agg(F.count("gap").alias("n"), F.round(F.avg("gap"), 6).alias("mean"))


@query("fragment_gap", f"""
WITH g AS (SELECT run, (fragment_ns[i + 1] - fragment_ns[i]) / 1e6 AS gap FROM (SELECT run, fragment_ns, unnest(range(1, len(fragment_ns))) AS i FROM warmup_fixed WHERE outcome = 'completed'))
SELECT run, count(*) AS n, {_p('gap', 0.5)} AS gap_p50, {_p('gap', 0.95)} AS gap_p95 FROM g GROUP BY run""")
def _(t: Tables) -> DataFrame:
    gaps = telemetry.fragment_gaps(t.warmup_fixed.where("outcome = 'completed'"))
    found = stats.percentiles(gaps, ["run"], {"g": F.col("gap")}, {"gap_p50": ("g", "ceil", 0.5), "gap_p95": ("g", "ceil", 0.95)})
    return gaps.groupBy("run").agg(F.count("*").alias("n")).join(found, "run")


@query("fragment_order_check", """
SELECT request_id, seq, CASE WHEN fragment_ns IS NULL THEN 'missing' WHEN len(fragment_ns) <> parts THEN 'count' WHEN len(fragment_ns) > 0 AND first_ns IS DISTINCT FROM fragment_ns[1] THEN 'first'
  WHEN len([i for i in range(1, len(fragment_ns)) if fragment_ns[i + 1] < fragment_ns[i]]) > 0 THEN 'order' WHEN outcome = 'completed' AND len(fragment_ns) <> payload.chunks THEN 'incomplete' END AS fault FROM warmup_fixed""")
def _(t: Tables) -> DataFrame:
    return telemetry.fragment_faults(t.warmup_fixed).select("request_id", "seq", "fault")


_SECOND = "floor(epoch(ts))::BIGINT"


def _epoch(time: str) -> Column:
    """Whole seconds of a time without zone; the session's zone plays no part."""
    return F.datediff(F.col(time).cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint") * 86400 + F.hour(time) * 3600 + F.minute(time) * 60 + F.second(time)


def _seconds(t: Tables) -> DataFrame:
    return t.events.withColumn("s", _epoch("ts"))


@query("tumbling_counts", f"SELECT {_SECOND} // 3600 AS slot, count(*) AS n FROM events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return _seconds(t).groupBy(F.expr("s div 3600").alias("slot")).agg(F.count("*").alias("n"))


@query("tumbling_counts_filled", f"""
WITH c AS (SELECT {_SECOND} // 600 AS slot, count(*) AS n FROM events GROUP BY 1), b AS (SELECT min(slot) AS a, max(slot) AS z FROM c)
SELECT g.slot, coalesce(n, 0) AS n FROM (SELECT unnest(range(a, z + 1)) AS slot FROM b) g LEFT JOIN c ON g.slot = c.slot""")
def _(t: Tables) -> DataFrame:
    counts = _seconds(t).groupBy(F.expr("s div 600").alias("slot")).agg(F.count("*").alias("n"))
    grid = counts.agg(F.sequence(F.min("slot"), F.max("slot")).alias("g")).select(F.explode("g").alias("slot"))
    return grid.join(counts, "slot", "left").select("slot", F.coalesce("n", F.lit(0)).alias("n"))


@query("sliding_rate", f"""
WITH w AS (SELECT event_type, ({_SECOND} // 900 + k) * 900 + 900 AS until FROM events, range(0, 4) t(k)) SELECT event_type, until, count(*) AS n, count(*) / 3600 AS rate FROM w GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    windows = t.events.groupBy(F.window("ts", "3600 seconds", "900 seconds"), "event_type").agg(F.count("*").alias("n"))
    return windows.select("event_type", _epoch("window.end").alias("until"), "n", (F.col("n") / 3600).alias("rate"))


# A counter for each event type that starts again each day, and its samples in the 1,800 seconds up to each of them.
_COUNTER = f"""s AS (SELECT event_type, {_SECOND} AS s, count(*) AS k FROM events GROUP BY 1, 2), c AS (SELECT event_type, s, sum(k) OVER (PARTITION BY event_type, s // 86400 ORDER BY s)::DOUBLE AS v FROM s)"""


def _rates(series: str, by: str, window: int) -> str:
    """SQL of rates over lists of the samples in each window; series: a table of (by, s, v)."""
    return f"""l AS (SELECT a.{by}, a.s, list(b.v ORDER BY b.s) AS v, list(b.s ORDER BY b.s) AS t FROM {series} a JOIN {series} b ON a.{by} = b.{by} AND b.s <= a.s AND b.s > a.s - {window} GROUP BY ALL HAVING count(*) > 1),
g AS (SELECT {by}, s, v[1] AS first, (t[-1] - t[1])::DOUBLE AS span, len(t) - 1 AS steps, (t[1] - s + {window})::DOUBLE AS gap, list_sum(list_transform(range(2, len(v) + 1), lambda i: CASE WHEN v[i] < v[i - 1] THEN v[i] ELSE v[i] - v[i - 1] END)) AS grown FROM l),
e AS (SELECT *, CASE WHEN gap >= span / steps * 1.1 THEN span / steps / 2 ELSE gap END AS edge FROM g),
r AS (SELECT {by}, s, grown * ((span + least(edge, CASE WHEN grown > 0 AND first >= 0 THEN span * (first / grown) ELSE edge END)) / span) AS increase FROM e)"""


def _counter(t: Tables) -> DataFrame:
    per = _seconds(t).groupBy("event_type", "s").agg(F.count("*").alias("k"))
    return per.select("event_type", "s", F.sum("k").over(Window.partitionBy("event_type", F.expr("s div 86400")).orderBy("s")).cast("double").alias("v"))


@query("promql_rate", f"WITH {_COUNTER}, {_rates('c', 'event_type', 1800)} SELECT event_type, s, round(increase, 6) AS increase, round(increase / 1800, 9) AS rate FROM r")
def _(t: Tables) -> DataFrame:
    return telemetry.rate(_counter(t), ["event_type"], "s", "v", 1800).select("event_type", "s", F.round("increase", 6).alias("increase"), F.round("rate", 9).alias("rate"))


@query("promql_sum_by", f"WITH {_COUNTER}, {_rates('c', 'event_type', 1800)} SELECT s // 3600 AS slot, round(sum(increase), 4) AS total FROM r GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return telemetry.rate(_counter(t), ["event_type"], "s", "v", 1800).groupBy(F.expr("s div 3600").alias("slot")).agg(F.round(F.sum("increase"), 4).alias("total"))


_BOUNDS = [0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 1.0, 5.0]
_BUCKETS = " UNION ALL ".join([*(f"SELECT pod, {b}::DOUBLE AS le, count(*) FILTER (WHERE queue_seconds <= {b}) AS n FROM warmup_fixed WHERE queue_seconds IS NOT NULL GROUP BY pod" for b in _BOUNDS), "SELECT pod, 'inf'::DOUBLE, count(*) FROM warmup_fixed WHERE queue_seconds IS NOT NULL GROUP BY pod"])


@query("histogram_buckets", f"SELECT pod, CASE WHEN isinf(le) THEN -1 ELSE le END AS le, n FROM ({_BUCKETS})")
def _(t: Tables) -> DataFrame:
    rows = telemetry.histogram(t.warmup_fixed, ["pod"], "queue_seconds", _BOUNDS)
    return rows.select("pod", F.when(F.col("le") == float("inf"), -1.0).otherwise(F.col("le")).alias("le"), "n")


@query("histogram_quantile", f"""
WITH b AS ({_BUCKETS}), w AS (SELECT pod, le, n, coalesce(lag(le) OVER s, 0) AS lo, coalesce(lag(n) OVER s, 0) AS under, 0.95 * max(n) OVER (PARTITION BY pod) AS rank FROM b WINDOW s AS (PARTITION BY pod ORDER BY le))
SELECT pod, round(CASE WHEN isinf(le) THEN lo ELSE lo + (le - lo) * (rank - under) / (n - under) END, 9) AS value FROM w WHERE n >= rank AND n > under QUALIFY row_number() OVER (PARTITION BY pod ORDER BY le) = 1""")
def _(t: Tables) -> DataFrame:
    rows = telemetry.histogram_quantile(telemetry.histogram(t.warmup_fixed, ["pod"], "queue_seconds", _BOUNDS), ["pod"], 0.95)
    return rows.withColumn("value", F.round("value", 9))


# Counters of first fragments by bound of their wait, per run and second of sending.
_WAIT_BOUNDS = [0.02, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5]
_WAITED = "(SELECT run, floor(sent_epoch)::BIGINT AS s, (first_ns - sent_ns) / 1e9 AS wait FROM warmup_fixed WHERE outcome = 'completed' AND first_ns IS NOT NULL AND sent_ns IS NOT NULL AND sent_epoch IS NOT NULL AND run IS NOT NULL)"


@query("promql_quantile_of_rates", f"""
WITH b AS (SELECT unnest([{', '.join(f'{b}::DOUBLE' for b in _WAIT_BOUNDS)}, 'inf'::DOUBLE]) AS le), w AS {_WAITED},
k AS (SELECT run || '/' || CASE WHEN isinf(le) THEN 'inf' ELSE le::VARCHAR END AS key, run, le, s, count(*) FILTER (WHERE wait <= le) AS k FROM w, b GROUP BY ALL),
c AS (SELECT key, run, le, s, sum(k) OVER (PARTITION BY key ORDER BY s)::DOUBLE AS v FROM k), {_rates('c', 'key', 30)},
h AS (SELECT c.run, c.s, c.le, r.increase / 30 AS n FROM r JOIN c ON c.key = r.key AND c.s = r.s),
q AS (SELECT run, s, le, n, coalesce(lag(le) OVER x, 0) AS lo, coalesce(lag(n) OVER x, 0) AS under, 0.95 * max(n) OVER (PARTITION BY run, s) AS rank FROM h WINDOW x AS (PARTITION BY run, s ORDER BY le))
SELECT run, s, round(CASE WHEN isinf(le) THEN lo ELSE lo + (le - lo) * (rank - under) / (n - under) END, 6) AS value FROM q WHERE n >= rank AND n > under QUALIFY row_number() OVER (PARTITION BY run, s ORDER BY le) = 1""")
def _(t: Tables) -> DataFrame:
    waits = t.warmup_fixed.where("outcome = 'completed' and first_ns is not null and sent_ns is not null and sent_epoch is not null and run is not null")
    waits = waits.select("run", F.floor("sent_epoch").cast("bigint").alias("s"), ((F.col("first_ns") - F.col("sent_ns")) / 1e9).alias("wait"))
    counts = telemetry.histogram(waits, ["run", "s"], "wait", _WAIT_BOUNDS)
    counters = counts.select("run", "s", "le", F.sum("n").over(Window.partitionBy("run", "le").orderBy("s")).cast("double").alias("v"))
    rates = telemetry.rate(counters, ["run", "le"], "s", "v", 30).select("run", "s", "le", F.col("rate").alias("n"))
    return telemetry.histogram_quantile(rates, ["run", "s"], 0.95).select("run", "s", F.round("value", 6).alias("value"))


@query("promql_offset_delta", f"""
WITH {_COUNTER} SELECT a.event_type, a.s, a.v - b.v AS delta FROM c a ASOF JOIN c b ON a.event_type = b.event_type AND a.s - 600 >= b.s WHERE b.s > a.s - 900""")
def _(t: Tables) -> DataFrame:
    counter = _counter(t)
    now = counter.withColumn("then", F.col("s") - 600)
    joined = telemetry.instant(now, counter.withColumnRenamed("v", "before"), ["event_type"], "then", "s", "before")
    return joined.select("event_type", "s", (F.col("v") - F.col("before")).alias("delta"))


@query("promql_range_grid", f"""
WITH {_COUNTER}, b AS (SELECT min(s) // 3600 * 3600 AS a, max(s) AS z FROM c), g AS (SELECT event_type, unnest(range(a, z + 1, 3600)) AS at FROM b, (SELECT DISTINCT event_type FROM c))
SELECT g.event_type, g.at, c.v AS value FROM g ASOF JOIN c ON g.event_type = c.event_type AND g.at >= c.s WHERE c.s > g.at - 300""")
def _(t: Tables) -> DataFrame:
    counter = _counter(t)
    span = counter.agg(F.sequence(F.expr("min(s) div 3600 * 3600"), F.max("s"), F.lit(3600).cast("bigint")).alias("g"))
    grid = counter.select("event_type").distinct().crossJoin(F.broadcast(span)).select("event_type", F.explode("g").alias("at"))  # one row of bounds
    return telemetry.instant(grid, counter.withColumnRenamed("v", "value"), ["event_type"], "at", "s", "value").select("event_type", "at", "value")


@query("promql_label_match", "SELECT outcome, count(*) AS n FROM warmup_fixed WHERE regexp_full_match(outcome, 'aborted|rejected') AND pod LIKE 'api-%' GROUP BY outcome")
def _(t: Tables) -> DataFrame:
    return t.warmup_fixed.where(F.col("outcome").rlike("^(?:aborted|rejected)$") & F.col("pod").rlike("^(?:api-.*)$")).groupBy("outcome").agg(F.count("*").alias("n"))


_PER_RUN = "SELECT run, count(*) AS n, count(*) FILTER (WHERE outcome = 'rejected') AS bad FROM warmup_fixed GROUP BY run"


@query("promql_alert_expr", f"SELECT run, bad / n AS share FROM ({_PER_RUN}) WHERE bad / n > 0.03 AND n >= 10")
def _(t: Tables) -> DataFrame:
    bad = t.warmup_fixed.where("outcome = 'rejected'").groupBy("run").agg(F.count("*").alias("bad"))
    all_ = t.warmup_fixed.groupBy("run").agg(F.count("*").alias("n"))
    ratio = bad.join(all_, "run").select("run", (F.col("bad") / F.col("n")).alias("share")).where("share > 0.03")
    return ratio.join(all_.where("n >= 10"), "run", "left_semi")


@query("asof_first_after", """
WITH e AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'error'), p AS (SELECT user_id, ts AS pts FROM events WHERE event_type = 'purchase')
SELECT e.event_id, epoch_us(min(pts)) AS first_us FROM e LEFT JOIN p ON e.user_id = p.user_id AND p.pts >= e.ts GROUP BY e.event_id""")
def _(t: Tables) -> DataFrame:
    errors = t.events.where("event_type = 'error'").select("user_id", "event_id", "ts")
    buys = t.events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("pts"))
    return telemetry.first_after(errors, buys, ["user_id"], "ts", "pts", "first").select("event_id", (_epoch("first") * 1000000 + F.expr("cast(extract(SECOND FROM first) * 1000000 as bigint) % 1000000")).alias("first_us"))


@query("interval_between_events", """
WITH b AS (SELECT min(ts) FILTER (WHERE event_type = 'error') AS a, max(ts) FILTER (WHERE event_type = 'error') AS z FROM events)
SELECT event_type, count(*) AS n FROM events, b WHERE ts BETWEEN a AND z GROUP BY event_type""")
def _(t: Tables) -> DataFrame:
    error = F.when(F.col("event_type") == "error", F.col("ts"))
    bounds = t.events.agg(F.min(error).alias("a"), F.max(error).alias("z"))
    return t.events.crossJoin(F.broadcast(bounds)).where("ts between a and z").groupBy("event_type").agg(F.count("*").alias("n"))  # one row of bounds


@query("interval_join_per_key", """
SELECT w.run, count(*) AS n FROM warmup_fixed w JOIN (SELECT run, start_epoch, start_epoch + duration AS end_epoch FROM runs) r ON w.run = r.run AND r.start_epoch < w.finished_epoch AND w.finished_epoch <= r.end_epoch GROUP BY w.run""")
def _(t: Tables) -> DataFrame:
    bounds = t.runs.select("run", F.col("start_epoch").alias("start"), (F.col("start_epoch") + F.col("duration")).alias("end"))
    return telemetry.inside_interval(t.warmup_fixed.select("run", "finished_epoch"), bounds, "run", "finished_epoch").groupBy("run").agg(F.count("*").alias("n"))


@query("state_transitions", "SELECT user_id, event_id, event_type, before FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE event_type IS DISTINCT FROM before")
def _(t: Tables) -> DataFrame:
    rows = t.events.select("user_id", "event_id", "event_type", F.struct("ts", "event_id").alias("at"))
    return telemetry.transitions(rows, ["user_id"], "at", "event_type").select("user_id", "event_id", "event_type", "before")


@query("alert_states", f"""
WITH p AS (SELECT event_type, {_SECOND} // 600 * 600 AS slot, avg(value) AS v FROM events GROUP BY 1, 2), o AS (SELECT *, v > 25 AS on_ FROM p),
i AS (SELECT *, sum(CASE WHEN on_ THEN 0 ELSE 1 END) OVER (PARTITION BY event_type ORDER BY slot ROWS UNBOUNDED PRECEDING) AS isle FROM o),
s AS (SELECT *, min(CASE WHEN on_ THEN slot END) OVER (PARTITION BY event_type, isle) AS since FROM i)
SELECT event_type, slot, CASE WHEN NOT on_ THEN 'inactive' WHEN slot - since >= 1200 THEN 'firing' ELSE 'pending' END AS state FROM s""")
def _(t: Tables) -> DataFrame:
    points = _seconds(t).groupBy("event_type", F.expr("s div 600 * 600").alias("slot")).agg(F.avg("value").alias("v"))
    return telemetry.alert_states(points, ["event_type"], "slot", F.col("v") > 25, 1200).select("event_type", "slot", "state")


@query("bool_every_any", "SELECT run, bool_and(coalesce(ready = 'true', false)) AS every_ready, bool_or(coalesce(outcome = 'rejected', false)) AS any_rejected FROM warmup_fixed GROUP BY run")
def _(t: Tables) -> DataFrame:
    return t.warmup_fixed.groupBy("run").agg(F.bool_and(F.coalesce(F.col("ready") == "true", F.lit(False))).alias("every_ready"), F.bool_or(F.coalesce(F.col("outcome") == "rejected", F.lit(False))).alias("any_rejected"))


@query("distinct_per_key", "SELECT run, client, count(DISTINCT pod) AS pods FROM warmup_fixed GROUP BY run, client")
def _(t: Tables) -> DataFrame:
    return t.warmup_fixed.groupBy("run", "client").agg(F.countDistinct("pod").alias("pods"))


@query("sequence_gaps", """
WITH e AS (SELECT run, unnest(range(0, duration * rate))::INT AS seq FROM runs), s AS (SELECT DISTINCT run, seq FROM warmup_fixed)
SELECT coalesce(e.run, s.run) AS run, coalesce(e.seq, s.seq) AS seq, CASE WHEN s.seq IS NULL THEN 'missing' ELSE 'unexpected' END AS side FROM e FULL JOIN s ON e.run = s.run AND e.seq = s.seq WHERE e.seq IS NULL OR s.seq IS NULL""")
def _(t: Tables) -> DataFrame:
    expected = t.runs.select("run", (F.col("duration") * F.col("rate")).alias("count"))
    return telemetry.sequence_gaps(t.warmup_fixed.select("run", "seq"), "run", "seq", expected)


@query("trace_equal", """
WITH f AS (SELECT traffic, seq % 15 AS turn, client FROM warmup_fixed WHERE traffic IN ('even', 'skew'))
SELECT turn, client, 'left' AS side FROM (SELECT turn, client FROM f WHERE traffic = 'even' EXCEPT ALL SELECT turn, client FROM f WHERE traffic = 'skew')
UNION ALL SELECT turn, client, 'right' FROM (SELECT turn, client FROM f WHERE traffic = 'skew' EXCEPT ALL SELECT turn, client FROM f WHERE traffic = 'even')""")
def _(t: Tables) -> DataFrame:
    rows = t.warmup_fixed.select("traffic", (F.col("seq") % 15).alias("turn"), "client")
    return evaluate.different(rows.where("traffic = 'even'").drop("traffic"), rows.where("traffic = 'skew'").drop("traffic"))


@query("json_extract_prop", "SELECT event_type, sum((props->>'$.k')::BIGINT)::BIGINT AS total FROM events GROUP BY event_type")
def _(t: Tables) -> DataFrame:
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return t.events.groupBy("event_type").agg(F.sum(k).alias("total"))


@query("schedule_generator", """
SELECT run, seq::INT AS seq, start_epoch + seq / rate AS planned, (CASE traffic WHEN 'solo' THEN 0 WHEN 'skew' THEN CASE WHEN seq % 15 < 12 THEN 0 ELSE seq % 15 - 11 END ELSE seq % 4 END)::INT AS owner
FROM (SELECT *, unnest(range(0, duration * rate)) AS seq FROM runs)""")
def _(t: Tables) -> DataFrame:
    return telemetry.schedule(t.runs)


@query("map_tag_filter", "SELECT run, start_epoch FROM runs WHERE traffic = 'even' AND rate::VARCHAR = '8' ORDER BY run LIMIT 1000")
def _(t: Tables) -> DataFrame:
    tagged = t.runs.withColumn("tags", F.create_map(F.lit("traffic"), F.col("traffic"), F.lit("rate"), F.col("rate").cast("string")))
    return tagged.where((F.col("tags")["traffic"] == "even") & (F.col("tags")["rate"] == "8")).select("run", "start_epoch").orderBy("run").limit(1000)


@query("planned_fingerprint", "SELECT w.run, seq, client, round(planned_epoch - start_epoch, 5) AS offset_s, payload.prompt AS prompt, payload.chunks AS chunks FROM warmup_fixed w JOIN runs r ON w.run = r.run")
def _(t: Tables) -> DataFrame:
    slim = t.warmup_fixed.withColumn("p", F.col("payload").dropFields("prefix"))
    joined = slim.select("run", "seq", "client", "planned_epoch", "p").join(t.runs.select("run", "start_epoch"), "run")
    return joined.select("run", "seq", "client", F.round(F.col("planned_epoch") - F.col("start_epoch"), 5).alias("offset_s"), F.col("p.prompt").alias("prompt"), F.col("p.chunks").alias("chunks"))


@query("peak_trailing_window", f"""
WITH c AS (SELECT {_SECOND} AS s, count(*) AS n FROM events GROUP BY 1) SELECT s, max(n) OVER (ORDER BY s RANGE BETWEEN 2699 PRECEDING AND CURRENT ROW) AS peak FROM c""")
def _(t: Tables) -> DataFrame:
    counts = _seconds(t).groupBy("s").agg(F.count("*").alias("n"))
    # a window looks back 2699 s, so each slot of that width needs itself and the one before
    slots = counts.withColumn("slot", F.explode(F.array(F.expr("s div 2700"), F.expr("s div 2700 + 1"))))
    peak = slots.withColumn("peak", F.max("n").over(Window.partitionBy("slot").orderBy("s").rangeBetween(-2699, 0)))
    return peak.where(F.col("slot") == F.expr("s div 2700")).select("s", "peak")


@query("zoned_time", "SELECT request_id, seq, strftime(make_timestamp((sent_epoch * 1000000)::BIGINT) + INTERVAL 3 HOUR, '%H:%M:%S.%g') AS at FROM warmup_fixed")
def _(t: Tables) -> DataFrame:
    stamp = F.timestamp_micros((F.col("sent_epoch") * 1000000).cast("bigint"))
    return t.warmup_fixed.select("request_id", "seq", F.date_format(F.from_utc_timestamp(stamp, "+03:00"), "HH:mm:ss.SSS").alias("at"))


@query("combined_lineage", "SELECT traffic AS origin, count(*) AS n, count(pod) AS answered FROM warmup_fixed GROUP BY traffic")
def _(t: Tables) -> DataFrame:
    from karst.sources.sinks import with_lineage

    parts = {k: t.warmup_fixed.where(F.col("traffic") == k).select("seq", "pod") for k in ("even", "skew", "solo")}
    return with_lineage(parts).groupBy("origin").agg(F.count("*").alias("n"), F.count("pod").alias("answered"))


@query("hit_rate_by_prefix", "SELECT payload.prefix AS prefix, count(*) AS n, count(*) FILTER (WHERE cache_hit = 'true') AS hits FROM warmup_fixed WHERE outcome = 'completed' GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return t.warmup_fixed.where("outcome = 'completed'").groupBy(F.col("payload.prefix").alias("prefix")).agg(F.count("*").alias("n"), F.count_if(F.col("cache_hit") == "true").alias("hits"))
