"""Strict scoring of model answers, gates and comparisons of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karst.functions import text


def key_mismatch(tasks: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """(key, n_tasks, n_outputs) of keys that don't stand exactly once on either side."""
    a = tasks.groupBy(key).agg(F.count("*").alias("n_tasks"))
    b = outputs.groupBy(F.col(key).alias("_k")).agg(F.count("*").alias("n_outputs"))
    joined = a.join(b, F.col(key).eqNullSafe(F.col("_k")), "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return joined.select(F.coalesce(key, "_k").alias(key), zero("n_tasks"), zero("n_outputs")).where("n_tasks <> 1 or n_outputs <> 1")


def parsed_answer(raw: Column, choices: Column, error: Column) -> Column:
    """The answer of JSON with the one string field answer out of choices, and no error; else null. Repeated keys are broken."""
    value = F.try_parse_json(raw)
    answer = F.try_variant_get(value, "$.answer", "string")
    strict = (F.schema_of_variant(value) == "OBJECT<answer: STRING>") & F.array_contains(choices, answer) & error.isNull()
    return F.when(F.coalesce(strict, F.lit(False)), answer)


def scored(tasks: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """Per item: parsed, valid, correct. tasks: key, expected, choices, slices; outputs: key, raw, error."""
    both = tasks.select(key, "expected", "choices", "slices").join(outputs.select(key, "raw", "error"), key)
    parsed = parsed_answer(F.col("raw"), F.col("choices"), F.col("error"))
    return both.withColumn("parsed", parsed).withColumns({"valid": F.col("parsed").isNotNull(), "correct": F.coalesce(F.col("parsed") == F.col("expected"), F.lit(False))})


def summary(items: DataFrame, by: list[str]) -> DataFrame:
    """n, correct, valid, errors and both rates of each group."""
    return items.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if("correct").alias("correct"), F.count_if("valid").alias("valid"), F.count_if(F.col("error").isNotNull()).alias("errors"),
        F.avg(F.col("correct").cast("double")).alias("accuracy"), F.avg(F.col("valid").cast("double")).alias("format_rate"),
    )


def by_slice(items: DataFrame) -> DataFrame:
    """Summary of each slice; an item counts in each of its slices, once."""
    return summary(items.withColumn("slice", F.explode(F.array_distinct("slices"))), ["slice"])


def changes(baseline: DataFrame, candidate: DataFrame, key: str) -> DataFrame:
    """(key, change): improved or regressed items."""
    both = baseline.select(key, F.col("correct").alias("a")).join(candidate.select(key, F.col("correct").alias("b")), key).where("a <> b")
    return both.select(key, F.when(F.col("b"), "improved").otherwise("regressed").alias("change"))


def gate(baseline: DataFrame, candidate: DataFrame, critical: list[str]) -> DataFrame:
    """Rules that a candidate breaks (rule, name): rates overall and accuracy of critical slices must not fall, errors must be none.

    baseline and candidate are scored items.
    """
    a, b = summary(baseline, []), summary(candidate, [])
    rename = lambda df, s: df.withColumnsRenamed({c: f"{c}_{s}" for c in df.columns if c != "slice"})
    whole = rename(a, "a").crossJoin(rename(b, "b"))  # one row each
    rules = F.array_compact(F.array(
        F.when(F.col("n_a") != F.col("n_b"), F.lit("ids")), F.when(F.col("accuracy_b") < F.col("accuracy_a"), F.lit("accuracy")),
        F.when(F.col("format_rate_b") < F.col("format_rate_a"), F.lit("format_rate")), F.when((F.col("errors_a") > 0) | (F.col("errors_b") > 0), F.lit("errors")),
    ))
    overall = whole.select(F.explode(rules).alias("rule"), F.lit("overall").alias("name"))
    slices = rename(by_slice(baseline), "a").join(rename(by_slice(candidate), "b"), "slice", "full_outer")
    fallen = slices.where(F.col("slice").isin(critical) & F.coalesce(F.col("accuracy_b") < F.col("accuracy_a"), F.lit(True)))
    return overall.unionAll(fallen.select(F.lit("critical_slice").alias("rule"), F.col("slice").alias("name")))


def golden_reason() -> Column:
    """Why a golden item (group_id, item_input, expected, choices, slices, source) breaks its contract, or null."""
    from karst.operators.quality import first_reason

    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    unique = lambda c: F.size(F.array_distinct(c)) == F.size(c)
    filled = lambda c: F.forall(c, lambda x: F.coalesce(x != "", F.lit(False)))
    good = lambda c: some(c) & unique(c) & filled(c)
    return first_reason([
        ("input", text.is_blank(F.col("item_input"))), ("group", F.coalesce(F.col("group_id") == "", F.lit(True))), ("slices", ~good("slices")), ("choices", ~good("choices")),
        ("expected", ~F.coalesce(F.array_contains("choices", F.col("expected")), F.lit(False))), ("source", F.coalesce(F.col("source") == "", F.lit(True))),
    ])


def leaked(golden: DataFrame, training: DataFrame, ident: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """Distinct idents of golden rows that meet training in any of the (golden, training) columns: one semi-join each."""
    found = None
    for mine, theirs in pairs:
        keys = training.select(F.col(theirs).alias("_t")).where("_t is not null").distinct()
        hit = golden.join(keys, F.col(mine) == F.col("_t"), "left_semi").select(ident)
        found = hit if found is None else found.unionAll(hit)
    return found.distinct()


def nearest(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(id, best, similarity): the corpus row of the highest Jaccard index of each query, ties to the smallest id.

    Both: (id, tokens), tokens a set. Rows that share no token score 0 and take the smallest
    corpus id. Only shared tokens are joined.
    """
    q = queries.select("id", F.size("tokens").alias("n"), F.explode_outer("tokens").alias("t"))
    c = corpus.select(F.col("id").alias("best"), F.size("tokens").alias("m"), F.explode("tokens").alias("t"))
    shared = q.join(c, "t").groupBy("id", "n", "best", "m").agg(F.count("*").alias("k"))
    score = shared.withColumn("similarity", F.col("k") / (F.col("n") + F.col("m") - F.col("k")))
    top = score.groupBy("id").agg(F.min_by(F.struct("best", "similarity"), F.struct(-F.col("similarity"), F.col("best"))).alias("x")).select("id", "x.*")
    none = corpus.agg(F.min("id").alias("_least"))
    return queries.select("id").join(top, "id", "left").crossJoin(none).select("id", F.coalesce("best", "_least").alias("best"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


def recomputed(stored: DataFrame, fresh: DataFrame, key: str, values: list[str], tolerance: float = 1e-12) -> DataFrame:
    """(key, measure, stored, fresh) where a stored value isn't what comes out again; a missing or non-finite one differs."""
    a = stored.select(key, *(F.col(v).cast("double").alias(f"a_{v}") for v in values))
    b = fresh.select(F.col(key).alias("_k"), *(F.col(v).cast("double").alias(f"b_{v}") for v in values))
    joined = a.join(b, F.col(key).eqNullSafe(F.col("_k")), "full_outer")
    rows = F.array(*(F.struct(F.lit(v).alias("measure"), F.col(f"a_{v}").alias("stored"), F.col(f"b_{v}").alias("fresh")) for v in values))
    same = lambda r: F.coalesce(F.abs(r["stored"] - r["fresh"]) <= tolerance, F.lit(False))
    return joined.select(F.coalesce(key, "_k").alias(key), F.explode(F.filter(rows, lambda r: ~same(r))).alias("r")).select(key, "r.*")


def different(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one bag that the other lacks, with side 'left' or 'right'; empty if both are equal."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionAll(b.exceptAll(a).withColumn("side", F.lit("right")))


def split_overlap(rows: DataFrame, split: str, keys: list[str], pairs: list[tuple[str, str]]) -> DataFrame:
    """(one, two, kind, n_keys, rows_one, rows_two, clean) for each pair of splits and each key column: keys that both hold, and their rows.

    Null keys and rows of null split are in no overlap; a pair without one has a row of zeros. Keys are
    counted by split first, so that a hot key is one row where splits meet.
    """
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).cast("string").alias("key")) for k in keys)))
    counts = rows.select(F.col(split).alias("s"), each.alias("e")).where("e.key is not null").groupBy("e.kind", "e.key").pivot("s", sorted({s for p in pairs for s in p})).count()
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    entries = F.explode(F.array(*(F.struct(F.lit(a).alias("one"), F.lit(b).alias("two"), both(a, b).alias("hit"), F.col(a).alias("na"), F.col(b).alias("nb")) for a, b in pairs)))
    found = counts.select("kind", entries.alias("e")).where("e.hit").groupBy("e.one", "e.two", "kind").agg(F.count("*").alias("n_keys"), F.sum("e.na").alias("rows_one"), F.sum("e.nb").alias("rows_two"))
    wanted = rows.sparkSession.createDataFrame([(a, b, k) for a, b in pairs for k in keys], "one string, two string, kind string")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return wanted.join(found, ["one", "two", "kind"], "left").select("one", "two", "kind", *(zero(c) for c in ("n_keys", "rows_one", "rows_two"))).withColumn("clean", F.col("n_keys") == 0)
