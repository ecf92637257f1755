"""Queries of the training-data problems and, where SQL can say them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from karst.llm import leaks, multiselect, neardup, overlap, packing, pii, repetition, splits, tokens

Query = Callable[[SparkSession, str], DataFrame]


def _on(*tables: str):
    """Query over whole tables of a data folder."""

    def wrap(f: Callable[..., DataFrame]) -> Query:
        return lambda spark, folder: f(*(spark.read.parquet(f"{folder}/{t}.parquet") for t in tables))

    return wrap


def queries() -> dict[str, Query]:
    return {
        "p1_percentiles": _on("warmup_fixed")(multiselect.pod_percentiles),
        "p1_day_summaries": _on("warmup_fixed")(multiselect.part_summaries),
        "p1_from_days": _on("warmup_fixed")(lambda t: multiselect.combine_summaries(multiselect.part_summaries(t))),
        "p1_from_runs": _on("warmup_fixed")(lambda t: multiselect.combine_summaries(multiselect.part_summaries(t, "run"), "run")),
        "p2_found": _on("examples")(neardup.question_pairs),
        "p2_classes": _on("examples")(neardup.question_classes),
        "p3_found": _on("split_examples")(overlap.overlap_pairs),
        "p3_report": _on("split_examples")(overlap.overlap_report),
        "p4_pack": _on("encode_example")(packing.pack),
        "p4_fill": _on("encode_example")(lambda t: packing.fill(packing.pack(t))),
        "p5_found": _on("examples")(pii.found_kinds),
        "p5_scrubbed": _on("examples")(pii.scrubbed),
        "p6_found": _on("examples")(splits.mixed_groups),
        "p6_splits": _on("examples", "split_spec")(splits.assign_splits),
        "p7_ids": _on("documents")(tokens.encode_texts),
        "p8_found": _on("documents", "benchmark")(leaks.leaked_items),
        "p8_near": _on("documents", "benchmark")(lambda d, b: leaks.leaked_items(d, b, edits=1, exhaustive=True)),
        "p8_report": _on("documents", "benchmark")(lambda d, b: leaks.leak_report(leaks.leaked_items(d, b))),
        "p9_found": _on("documents")(repetition.repetitive),
        "p9_share": _on("documents")(repetition.repetition),
    }


_WAITS = """
    SELECT pod, log_day, run, 'first_ns' AS metric, (first_ns - sent_ns)::DOUBLE AS x FROM warmup_fixed
    UNION ALL SELECT pod, log_day, run, 'finished_ns', (finished_ns - sent_ns)::DOUBLE FROM warmup_fixed
    UNION ALL SELECT pod, log_day, run, 'queue_seconds', queue_seconds FROM warmup_fixed"""


def _summary(part: str) -> str:
    return f"""v AS ({_WAITS}),
g AS (SELECT pod, {part} AS part, metric, count(x) FILTER (WHERE isfinite(x)) AS n, list_sort(list(x) FILTER (WHERE isfinite(x))) AS l FROM v GROUP BY pod, {part}, metric),
r AS (SELECT DISTINCT pod, part, metric, n, l, greatest(1, (n * j + {multiselect.GRID - 1}) // {multiselect.GRID}) AS "rank" FROM g CROSS JOIN range(0, {multiselect.GRID + 1}) t(j) WHERE n > 0)"""


def _combined(part: str) -> str:
    return f"""
WITH {_summary(part)},
w AS (SELECT pod, part, metric, n, l["rank"] AS value, "rank" - coalesce(lag("rank") OVER (PARTITION BY pod, part, metric ORDER BY "rank"), 0) AS weight FROM r),
e AS (SELECT pod, metric, sum(n)::BIGINT AS n, sum(gap)::BIGINT AS rank_error FROM (SELECT pod, part, metric, max(n) AS n, max(weight) - 1 AS gap FROM w GROUP BY ALL) GROUP BY pod, metric),
s AS (SELECT pod, metric, value, sum(sum(weight)) OVER (PARTITION BY pod, metric ORDER BY value) AS upto FROM w GROUP BY pod, metric, value)
SELECT e.pod, e.metric, p.permille, e.n, min(s.value) AS value, e.rank_error
FROM e CROSS JOIN (VALUES (500), (900), (950), (990), (999)) p(permille) JOIN s ON s.pod IS NOT DISTINCT FROM e.pod AND s.metric = e.metric AND s.upto >= greatest(1, (e.n * p.permille + 999) // 1000)
GROUP BY e.pod, e.metric, p.permille, e.n, e.rank_error"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_percentiles": f"""
WITH v AS ({_WAITS}),
g AS (SELECT pod, metric, count(x) FILTER (WHERE isfinite(x)) AS n, list_sort(list(x) FILTER (WHERE isfinite(x))) AS l FROM v GROUP BY pod, metric)
SELECT pod, metric, p.permille, n, l[greatest(1, (n * p.permille + 999) // 1000)] AS value, 0::BIGINT AS rank_error
FROM g CROSS JOIN (VALUES (500), (900), (950), (990), (999)) p(permille)""",
        "p1_day_summaries": f"""
WITH {_summary("log_day")}
SELECT pod, part::VARCHAR AS log_day, metric, n, "rank", l["rank"] AS value FROM r""",
        "p1_from_days": _combined("log_day"),
        "p1_from_runs": _combined("run"),
    }
