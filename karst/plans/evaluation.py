"""Queries of scoring, gates, leakage, ledgers and token arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karst.functions import arrays, stats, text
from karst.operators import dedup, evaluate, ledger, sampling, tokens
from karst.plans.catalog import Tables, query
from karst.plans.curation import _W, _norm, _said, _strip, user

# Model answers are derived from the golden items by one rule for both engines; shift 0 is the baseline, 1 the candidate.
_RAW = """CASE WHEN item_no % 17 = {s} THEN 'answer: A' WHEN item_no % 19 = 2 THEN '{{"answer": 1}}' WHEN item_no % 23 = 3 THEN '{{"answer": "A", "answer": "B"}}'
 WHEN item_no % 29 = 4 THEN '{{"answer": "A", "why": "x"}}' WHEN item_no % 31 = 5 THEN NULL WHEN item_no % 3 = {s} THEN '{{"answer": "' || expected || '"}}' ELSE '{{"answer": "B"}}' END"""
_ERROR = "CASE WHEN item_no % 37 = 6 THEN 'timeout' END"


def _answers(t: Tables, shift: int) -> DataFrame:
    return t.benchmark.select("id", F.expr(_RAW.format(s=shift)).alias("raw"), F.expr(_ERROR).alias("error"))


def _items(t: Tables, shift: int = 0) -> DataFrame:
    return evaluate.scored(t.benchmark.select("id", "expected", "choices", "slices"), _answers(t, shift), "id")


def _scored_sql(shift: int) -> str:
    # Repeated keys, other keys and other kinds than text are no valid answers.
    return f"""(SELECT *, valid AND parsed = expected AS correct FROM (SELECT *, parsed IS NOT NULL AS valid FROM (SELECT id, expected, choices, slices, error,
      CASE WHEN error IS NULL AND json_valid(raw) AND len(json_keys(raw)) = 1 AND json_keys(raw)[1] = 'answer' AND json_type(raw, '$.answer') = 'VARCHAR' AND list_contains(choices, json_extract_string(raw, '$.answer')) THEN json_extract_string(raw, '$.answer') END AS parsed
      FROM (SELECT *, {_RAW.format(s=shift)} AS raw, {_ERROR} AS error FROM benchmark))))"""


_SUM = "count(*) AS n, count(*) FILTER (WHERE correct) AS correct, count(*) FILTER (WHERE valid) AS valid, count(error) AS errors, avg(correct::INT) AS accuracy, avg(valid::INT) AS format_rate"


@query("score_per_item", f"SELECT id, parsed, valid, correct FROM {_scored_sql(0)}")
def _(t: Tables) -> DataFrame:
    return _items(t).select("id", "parsed", "valid", "correct")


@query("score_overall", f"SELECT {_SUM} FROM {_scored_sql(0)}")
def _(t: Tables) -> DataFrame:
    return evaluate.summary(_items(t), [])


@query("score_by_slice", f"SELECT slice, {_SUM} FROM (SELECT *, unnest(list_distinct(slices)) AS slice FROM {_scored_sql(0)}) GROUP BY slice")
def _(t: Tables) -> DataFrame:
    return evaluate.by_slice(_items(t))


@query("join_key_mismatch", "SELECT coalesce(a.id, b.id) AS id, coalesce(n_tasks, 0) AS n_tasks, coalesce(n_outputs, 0) AS n_outputs FROM (SELECT id, count(*) AS n_tasks FROM split_examples GROUP BY id) a FULL JOIN (SELECT id, count(*) AS n_outputs FROM encode_example GROUP BY id) b ON a.id = b.id WHERE coalesce(n_tasks, 0) <> 1 OR coalesce(n_outputs, 0) <> 1")
def _(t: Tables) -> DataFrame:
    return evaluate.key_mismatch(t.split_examples.select("id"), t.encode_example.select("id"), "id")


@query("eval_diff", f"SELECT a.id, CASE WHEN b.correct THEN 'improved' ELSE 'regressed' END AS change FROM {_scored_sql(0)} a JOIN {_scored_sql(1)} b ON a.id = b.id WHERE a.correct <> b.correct")
def _(t: Tables) -> DataFrame:
    return evaluate.changes(_items(t, 0), _items(t, 1), "id")


_SLICED = "(SELECT slice, avg(correct::INT) AS acc FROM (SELECT *, unnest(list_distinct(slices)) AS slice FROM {}) GROUP BY slice)"


@query("quality_gate", f"""
WITH a AS (SELECT {_SUM} FROM {_scored_sql(0)}), b AS (SELECT {_SUM} FROM {_scored_sql(1)})
SELECT 'accuracy' AS rule, 'overall' AS name FROM a, b WHERE b.accuracy < a.accuracy UNION ALL SELECT 'format_rate', 'overall' FROM a, b WHERE b.format_rate < a.format_rate
UNION ALL SELECT 'ids', 'overall' FROM a, b WHERE a.n <> b.n UNION ALL SELECT 'errors', 'overall' FROM a, b WHERE a.errors > 0 OR b.errors > 0
UNION ALL SELECT 'critical_slice', x.slice FROM {_SLICED.format(_scored_sql(0))} x FULL JOIN {_SLICED.format(_scored_sql(1))} y ON x.slice = y.slice WHERE x.slice IN ('geography', 'history', 'nature') AND coalesce(y.acc < x.acc, true)""")
def _(t: Tables) -> DataFrame:
    return evaluate.gate(_items(t, 0), _items(t, 1), ["geography", "history", "nature"])


@query("recompute_check", f"""
WITH f AS (SELECT slice, count(*)::DOUBLE AS n, avg(correct::INT)::DOUBLE AS accuracy FROM (SELECT *, unnest(list_distinct(slices)) AS slice FROM {_scored_sql(0)}) GROUP BY slice),
s AS (SELECT slice, count(*)::DOUBLE AS n, avg(correct::INT)::DOUBLE AS accuracy FROM (SELECT *, unnest(list_distinct(slices)) AS slice FROM {_scored_sql(1)}) GROUP BY slice)
SELECT coalesce(s.slice, f.slice) AS slice, 'n' AS measure, s.n AS stored, f.n AS fresh FROM s FULL JOIN f ON s.slice = f.slice WHERE NOT coalesce(abs(s.n - f.n) <= 1e-12, false)
UNION ALL SELECT coalesce(s.slice, f.slice), 'accuracy', s.accuracy, f.accuracy FROM s FULL JOIN f ON s.slice = f.slice WHERE NOT coalesce(abs(s.accuracy - f.accuracy) <= 1e-12, false)""")
def _(t: Tables) -> DataFrame:
    return evaluate.recomputed(evaluate.by_slice(_items(t, 1)), evaluate.by_slice(_items(t, 0)), "slice", ["n", "accuracy"])


@query("report_compat", "SELECT a.item_no, list_sort(a.slices) = list_sort(b.slices) AS same FROM benchmark a JOIN benchmark b ON a.item_no = b.item_no - 1")
def _(t: Tables) -> DataFrame:
    b = t.benchmark.select((F.col("item_no") - 1).alias("item_no"), F.array_sort("slices").alias("other"))
    return t.benchmark.select("item_no", F.array_sort("slices").alias("mine")).join(b, "item_no").select("item_no", (F.col("mine") == F.col("other")).alias("same"))


_GOLD = f"""CASE WHEN item_input IS NULL OR {_strip('item_input')} = '' THEN 'input' WHEN group_id IS NULL OR group_id = '' THEN 'group'
 WHEN slices IS NULL OR len(slices) = 0 OR len(list_distinct(slices)) <> len(slices) OR list_contains(slices, '') THEN 'slices' WHEN choices IS NULL OR len(choices) = 0 OR len(list_distinct(choices)) <> len(choices) OR list_contains(choices, '') THEN 'choices'
 WHEN expected IS NULL OR NOT list_contains(choices, expected) THEN 'expected' WHEN source IS NULL OR source = '' THEN 'source' END"""


@query("golden_contract_violations", f"SELECT item_no, {_GOLD} AS reason FROM benchmark WHERE {_GOLD} IS NOT NULL")
def _(t: Tables) -> DataFrame:
    return t.benchmark.select("item_no", evaluate.golden_reason().alias("reason")).where("reason is not null")


_QKEY = f"{_norm(_said('user'))}"


@query("leakage_semi_join", f"""
SELECT DISTINCT line_no FROM split_examples s WHERE split IN ('val', 'test') AND ({_QKEY} IN (SELECT {_QKEY} FROM split_examples WHERE split = 'train' AND {_QKEY} IS NOT NULL) OR topic IN (SELECT topic FROM split_examples WHERE split = 'train' AND topic IS NOT NULL))""")
def _(t: Tables) -> DataFrame:
    rows = t.split_examples.select("line_no", "split", "topic", text.casefold(text.normalize_text(user(), False)).alias("q"))
    train = rows.where("split = 'train'")
    return evaluate.leaked(rows.where("split in ('val', 'test')"), train, "line_no", [("q", "q"), ("topic", "topic")])


_GROUP = _norm("split_part(topic, chr(124), 1)")


@query("cross_split_overlap", f"""
WITH s AS (SELECT split, id AS key, 'id' AS kind FROM split_examples UNION ALL SELECT split, {_GROUP}, 'group' FROM split_examples),
d AS (SELECT split, kind, key, count(*) AS n FROM s WHERE key IS NOT NULL GROUP BY ALL), p AS (SELECT * FROM (VALUES ('train', 'val'), ('val', 'test'), ('train', 'test')) t(one, two)),
k AS (SELECT * FROM (VALUES ('id'), ('group')) t(kind))
SELECT p.one, p.two, k.kind, count(y.key) AS n_keys, coalesce(sum(CASE WHEN y.key IS NOT NULL THEN x.n END), 0)::BIGINT AS rows_one, coalesce(sum(y.n), 0)::BIGINT AS rows_two, count(y.key) = 0 AS clean
FROM p CROSS JOIN k LEFT JOIN d x ON x.split = p.one AND x.kind = k.kind LEFT JOIN d y ON y.split = p.two AND y.kind = k.kind AND y.key = x.key GROUP BY p.one, p.two, k.kind""")
def _(t: Tables) -> DataFrame:
    s = t.split_examples.select("split", F.col("id").alias("id"), text.normalize_group(F.col("topic"), False).alias("group"))
    return evaluate.split_overlap(s, "split", ["id", "group"], [("train", "val"), ("val", "test"), ("train", "test")])


@query("contamination_overlap", f"""
WITH s AS (SELECT id, split, {_QKEY} AS q, {_GROUP} AS g FROM split_examples),
a AS (SELECT * FROM s WHERE split = 'train'), b AS (SELECT * FROM s WHERE split = 'test')
SELECT 'id' AS kind, count(*) AS n, coalesce(array_to_string(list_sort(list(id))[1:3], ';'), '') AS first_three FROM (SELECT id FROM a INTERSECT SELECT id FROM b)
UNION ALL SELECT 'text', count(*), NULL FROM (SELECT q FROM a INTERSECT SELECT q FROM b)
UNION ALL SELECT 'group', count(*), coalesce(array_to_string(list_sort(list(g) FILTER (WHERE g IS NOT NULL))[1:3], ';'), '') FROM (SELECT g FROM a INTERSECT SELECT g FROM b)""")
def _(t: Tables) -> DataFrame:
    s = t.split_examples.select("id", "split", text.question_key(user(), False).alias("q"), text.normalize_group(F.col("topic"), False).alias("g"))
    a, b = s.where("split = 'train'"), s.where("split = 'test'")

    def overlap(column: str, kind: str, names: bool) -> DataFrame:
        both = a.select(column).intersect(b.select(column))
        if not names:
            return both.agg(F.lit(kind).alias("kind"), F.count("*").alias("n"), F.lit(None).cast("string").alias("first_three"))
        top = both.where(F.col(column).isNotNull()).orderBy(column).limit(3).agg(F.array_join(F.array_sort(F.collect_list(column)), ";").alias("first_three"))
        return both.agg(F.lit(kind).alias("kind"), F.count("*").alias("n")).crossJoin(top)  # one row each

    return overlap("id", "id", True).unionAll(overlap("q", "text", False)).unionAll(overlap("g", "group", True))


@query("near_dup_cross_pairs", f"""
WITH w AS (SELECT line_no AS id, split, regexp_extract_all({_QKEY}, '{_W}') AS w FROM split_examples WHERE split IN ('train', 'test')),
s AS (SELECT DISTINCT id, split, unnest([array_to_string(w[i:i + 3], ' ') for i in range(1, greatest(len(w) - 2, 2))]) AS s FROM w WHERE len(w) > 0),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
c AS (SELECT a.id AS a, b.id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.split = 'train' AND b.split = 'test' GROUP BY a.id, b.id)
SELECT a, b, round(k / (na.n + nb.n - k), 9) AS similarity FROM c JOIN n na ON na.id = a JOIN n nb ON nb.id = b WHERE k / (na.n + nb.n - k) >= 0.85""")
def _(t: Tables) -> DataFrame:
    rows = t.split_examples.select(F.col("line_no").alias("id"), "split", user().alias("u"))
    side = lambda s: dedup.shingled(rows.where(F.col("split") == s), "id", text.question_key(F.col("u"), False), 4)
    return dedup.overlap_pairs(side("train"), side("test"), 0.85, False).withColumn("similarity", F.round("similarity", 9))


_STOP = ["какой", "какая", "какие", "каких", "какую", "каково", "является", "имеет", "находится", "только", "которой"]  # fixed values
_STEMS = "list_distinct([x[1:5] for x in regexp_extract_all(lower({0}), '[а-яёa-z]{{4,}}') if x NOT IN (" + ", ".join(f"'{w}'" for w in _STOP) + ")])"


def _stems(column):
    found = F.regexp_extract_all(F.lower(column), F.lit("[а-яёa-z]{4,}"), F.lit(0))
    return F.array_distinct(F.transform(F.filter(found, lambda w: ~w.isin(_STOP)), lambda w: F.substring(w, 1, 5)))


@query("nearest_train_by_jaccard", f"""
WITH q AS (SELECT item_no AS id, {_STEMS.format("item_input")} AS w FROM benchmark), c AS (SELECT line_no AS best, {_STEMS.format(_said('user'))} AS w FROM split_examples WHERE split = 'train'),
qx AS (SELECT id, len(w) AS n, unnest(w) AS t FROM q), cx AS (SELECT best, len(w) AS m, unnest(w) AS t FROM c),
p AS (SELECT id, best, count(*) / (any_value(n) + any_value(m) - count(*)) AS s FROM qx JOIN cx ON qx.t = cx.t GROUP BY id, best)
SELECT id, best, round(s, 9) AS similarity FROM p QUALIFY row_number() OVER (PARTITION BY id ORDER BY s DESC, best) = 1
UNION ALL SELECT id, (SELECT min(best) FROM c), 0 FROM q WHERE id NOT IN (SELECT id FROM p)""")
def _(t: Tables) -> DataFrame:
    corpus = t.split_examples.where("split = 'train'").select(F.col("line_no").alias("id"), user().alias("u")).select("id", _stems(F.col("u")).alias("tokens"))
    queries = t.benchmark.select(F.col("item_no").alias("id"), _stems(F.col("item_input")).alias("tokens"))
    return evaluate.nearest(queries, corpus).withColumn("similarity", F.round("similarity", 9))


@query("set_intersect", "SELECT id FROM encode_example INTERSECT SELECT id FROM split_examples")
def _(t: Tables) -> DataFrame:
    return t.encode_example.select("id").intersect(t.split_examples.select("id"))


@query("set_except", "SELECT id FROM split_examples EXCEPT SELECT id FROM encode_example")
def _(t: Tables) -> DataFrame:
    return t.split_examples.select("id").subtract(t.encode_example.select("id"))


@query("union_all_sources", "SELECT origin, count(*) AS n, count(source) AS n_source FROM (SELECT 'examples' AS origin, id, source FROM examples UNION ALL SELECT 'split' AS origin, id, source FROM split_examples UNION ALL SELECT 'encoded', id, NULL FROM encode_example) GROUP BY origin")
def _(t: Tables) -> DataFrame:
    from karst.sources.sinks import with_lineage

    parts = {"examples": t.examples.select("id", "source"), "split": t.split_examples.select("id", "source"), "encoded": t.encode_example.select("id")}
    return with_lineage(parts).groupBy("origin").agg(F.count("*").alias("n"), F.count("source").alias("n_source"))


@query("stale_binding", "SELECT coalesce(a.id, b.id) AS id, stored, current FROM (SELECT id, sha256(expected) AS stored FROM benchmark) a FULL JOIN (SELECT id, sha256(CASE WHEN item_no % 7 = 0 THEN 'x' ELSE expected END) AS current FROM benchmark WHERE item_no % 50 <> 0) b ON a.id = b.id WHERE stored IS DISTINCT FROM current")
def _(t: Tables) -> DataFrame:
    stored = t.benchmark.select("id", F.sha2("expected", 256).alias("d"))
    current = t.benchmark.where("item_no % 50 <> 0").select("id", F.sha2(F.when(F.col("item_no") % 7 == 0, "x").otherwise(F.col("expected")), 256).alias("d"))
    return ledger.stale(stored, current, "id", "d")


@query("ledger_membership", "SELECT seq_no FROM encode_example WHERE id IN (SELECT id FROM split_examples WHERE split = 'val')")
def _(t: Tables) -> DataFrame:
    return ledger.members(t.encode_example.select("seq_no", "id"), t.split_examples.where("split = 'val'").select("id"), "id").select("seq_no")


@query("weighted_mean", "SELECT split, sum(answer_len::DOUBLE * supervised) / nullif(sum(CASE WHEN answer_len IS NOT NULL THEN supervised END), 0) AS mean FROM encode_example GROUP BY split")
def _(t: Tables) -> DataFrame:
    return t.encode_example.groupBy("split").agg(stats.weighted_mean("answer_len", "supervised").cast("double").alias("mean"))


@query("metric_range_check", "SELECT event_id FROM events WHERE value IS NULL OR isnan(value) OR value NOT BETWEEN 0 AND 1")
def _(t: Tables) -> DataFrame:
    return t.events.where(~ledger.is_share(F.col("value"))).select("event_id")


@query("ratio_gate", "SELECT run, duration / rate AS ratio FROM runs WHERE rate > 0 AND duration / rate <= 25")
def _(t: Tables) -> DataFrame:
    return t.runs.where("rate > 0").select("run", (F.col("duration") / F.col("rate")).alias("ratio")).where(~F.isnan("ratio") & (F.col("ratio") <= 25))


@query("head_tail_mean", """
WITH r AS (SELECT value, row_number() OVER (ORDER BY ts, event_id) AS r, greatest(count(*) OVER () // 5, 1) AS k, count(*) OVER () AS n FROM events)
SELECT round(avg(value) FILTER (WHERE r <= k), 6) AS head, round(avg(value) FILTER (WHERE r > n - k), 6) AS tail FROM r""")
def _(t: Tables) -> DataFrame:
    ranked = sampling.global_rank(t.events.select("ts", "event_id", "value"), ["ts", "event_id"], "r")
    n = t.events.agg(F.count("*").alias("n")).withColumn("k", F.greatest(F.expr("n div 5"), F.lit(1)))
    rows = ranked.crossJoin(F.broadcast(n))  # one row
    return rows.agg(F.round(F.avg(F.when(F.col("r") <= F.col("k"), F.col("value"))), 6).alias("head"), F.round(F.avg(F.when(F.col("r") > F.col("n") - F.col("k"), F.col("value"))), 6).alias("tail"))


@query("argmin_tiebreak", "SELECT o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) = 1")
def _(t: Tables) -> DataFrame:
    return t.orders.groupBy("o_orderpriority").agg(F.min_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("o_orderkey"))


@query("argmax_by", "SELECT c_nationkey, c_custkey FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey DESC) = 1")
def _(t: Tables) -> DataFrame:
    return t.customer.groupBy("c_nationkey").agg(F.max_by("c_custkey", F.struct("c_acctbal", "c_custkey")).alias("c_custkey"))


@query("leaderboard", "SELECT n_name, round(sum(c_acctbal), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def _(t: Tables) -> DataFrame:
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.round(F.sum("c_acctbal"), 2).alias("total")).orderBy("total")


@query("config_coverage", "SELECT coalesce(a.run, b.run) AS run, a.run IS NOT NULL AS configured, b.run IS NOT NULL AS ran FROM runs a FULL JOIN (SELECT DISTINCT run FROM warmup_fixed) b ON a.run = b.run")
def _(t: Tables) -> DataFrame:
    ran = t.warmup_fixed.select(F.col("run").alias("r")).distinct()
    return t.runs.join(ran, F.col("run") == F.col("r"), "full_outer").select(F.coalesce("run", "r").alias("run"), F.col("run").isNotNull().alias("configured"), F.col("r").isNotNull().alias("ran"))


@query("mask_prompt", "SELECT seq_no, list_sum([CASE WHEN i <= prompt_len THEN -100 ELSE input_ids[i] END for i in range(1, len(input_ids) + 1)])::BIGINT AS s FROM encode_example WHERE prompt_len >= 0")
def _(t: Tables) -> DataFrame:
    masked = arrays.mask_prompt(F.col("input_ids"), F.col("prompt_len"))
    total = F.aggregate(masked, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return t.encode_example.where("prompt_len >= 0").select("seq_no", F.when(F.size("input_ids") > 0, total).alias("s"))


@query("truncate_tokens", "SELECT seq_no, len(input_ids[1:128]) AS n, list_sum(input_ids[1:128])::BIGINT AS s FROM encode_example")
def _(t: Tables) -> DataFrame:
    cut = t.encode_example.select("seq_no", arrays.truncate(F.col("input_ids"), 128).alias("c"))
    return cut.select("seq_no", F.when(F.col("c").isNotNull(), F.size("c")).cast("bigint").alias("n"), F.when(F.size("c") > 0, F.aggregate("c", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("s"))


@query("supervised_count", "SELECT seq_no, coalesce(len([x for x in labels if x <> -100]), 0) AS n, coalesce(len([x for x in labels[2:] if x <> -100]), 0) AS n_train FROM encode_example")
def _(t: Tables) -> DataFrame:
    return t.encode_example.select("seq_no", arrays.supervised(F.col("labels")).cast("bigint").alias("n"), arrays.supervised(F.col("labels"), True).cast("bigint").alias("n_train"))


@query("drop_no_supervision", "SELECT split, count(*) AS seen, count(*) FILTER (WHERE coalesce(len([x for x in labels if x <> -100]), 0) > 0) AS kept FROM encode_example GROUP BY split")
def _(t: Tables) -> DataFrame:
    n = arrays.supervised(F.col("labels"))
    return t.encode_example.groupBy("split").agg(F.count("*").alias("seen"), F.count_if(n > 0).alias("kept"))


@query("length_describe", "SELECT split, count(full_len) AS n, round(avg(full_len), 1) AS mean, trunc(quantile_cont(full_len, 0.5))::INT AS p50, trunc(quantile_cont(full_len, 0.9))::INT AS p90, trunc(quantile_cont(full_len, 0.99))::INT AS p99, max(full_len) AS most FROM encode_example GROUP BY split")
def _(t: Tables) -> DataFrame:
    return tokens.describe(t.encode_example, ["split"], "full_len")


@query("truncation_stats", "SELECT split, count(*) AS n, count(*) FILTER (WHERE full_len > 384) AS truncated, round(count(*) FILTER (WHERE full_len > 384) / count(*), 6) AS truncated_share, count(*) FILTER (WHERE full_len > 384) / count(*) > 0.01 AS above FROM encode_example GROUP BY split")
def _(t: Tables) -> DataFrame:
    return tokens.truncation(t.encode_example, ["split"], "full_len", 384, 0.01)


_CANDIDATES = [128, 192, 256, 384, 512, 1024, 4096]


@query("calibrate_budget", f"SELECT min(c) AS budget FROM (SELECT c, max(s) AS worst FROM (SELECT c, split, avg((full_len > c)::INT) AS s FROM encode_example, (VALUES {', '.join(f'({c})' for c in _CANDIDATES)}) v(c) WHERE full_len IS NOT NULL GROUP BY c, split) GROUP BY c) WHERE worst <= 0.02")
def _(t: Tables) -> DataFrame:
    return tokens.budget(t.encode_example, "split", "full_len", _CANDIDATES, 0.02)


@query("token_totals", "SELECT split, sum(coalesce(len(input_ids), 0))::BIGINT AS tokens, sum(supervised)::BIGINT AS supervised, round(sum(supervised) / nullif(sum(coalesce(len(input_ids), 0)), 0), 6) AS share, count(*) FILTER (WHERE bpe_fallback) AS fallbacks FROM encode_example GROUP BY split")
def _(t: Tables) -> DataFrame:
    size = F.when(F.col("input_ids").isNull(), 0).otherwise(F.size("input_ids"))
    return t.encode_example.groupBy("split").agg(F.sum(size).alias("tokens"), F.sum("supervised").alias("supervised"), F.round(F.try_divide(F.sum("supervised"), F.sum(size)), 6).alias("share"), F.count_if("bpe_fallback").alias("fallbacks"))


@query("pad_batch", """
WITH b AS (SELECT seq_no, (row_number() OVER (ORDER BY seq_no) - 1) // 16 AS batch, coalesce(len(input_ids), 0) AS n, coalesce(list_sum(input_ids), 0)::BIGINT AS s FROM encode_example)
SELECT seq_no, batch, max(n) OVER (PARTITION BY batch) AS width, n AS attended, s + 7 * (max(n) OVER (PARTITION BY batch) - n) AS total FROM b""")
def _(t: Tables) -> DataFrame:
    made = tokens.padded(tokens.batches(t.encode_example.select("seq_no", "input_ids", "labels"), ["seq_no"], 16), "batch", "input_ids", "labels", 7)
    add = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return made.select("seq_no", "batch", F.col("width").cast("bigint").alias("width"), add("attention").alias("attended"), add("input_ids").alias("total"))


@query("batch_assignment", "SELECT seq_no, (r - 1) // 32 AS batch, ((r - 1) % 32)::INT AS slot FROM (SELECT seq_no, row_number() OVER (ORDER BY sha256('7:' || seq_no::VARCHAR), seq_no) AS r FROM encode_example)")
def _(t: Tables) -> DataFrame:
    from karst.functions.hashing import priority

    rows = t.encode_example.select("seq_no", priority(7, F.col("seq_no").cast("string")).alias("p"))
    return tokens.batches(rows, ["p", "seq_no"], 32).select("seq_no", "batch", "slot")


def _packed(t: Tables) -> DataFrame:
    sized = t.encode_example.select("seq_no", F.size("input_ids").alias("n"))
    return tokens.first_fit(sized, "seq_no", "n", 384, 1)


@query("pack_first_fit")
def _(t: Tables) -> DataFrame:
    return _packed(t)


@query("packing_report")
def _(t: Tables) -> DataFrame:
    return tokens.packing_report(_packed(t), "n", 384, 8)


@query("prompt_boundary", "SELECT seq_no, prompt_len AS boundary FROM encode_example WHERE len(input_ids) > prompt_len AND prompt_len >= 0")
def _(t: Tables) -> DataFrame:
    rows = t.encode_example.where((F.size("input_ids") > F.col("prompt_len")) & (F.col("prompt_len") >= 0))
    starts = F.transform("input_ids", lambda _, i: i)
    return rows.select("seq_no", arrays.prompt_boundary(F.col("input_ids"), F.slice("input_ids", F.lit(1), F.col("prompt_len")), starts, F.col("prompt_len")).alias("boundary"))


@query("prefix_check", "SELECT line_no, starts_with(messages[2].content, 'Контекст:') AS has_context FROM split_examples")
def _(t: Tables) -> DataFrame:
    return t.split_examples.select("line_no", F.startswith(F.get("messages", F.lit(1))["content"], F.lit("Контекст:")).alias("has_context"))


@query("train_time_estimate", "SELECT split, sum(full_len)::BIGINT AS tokens, round(sum(full_len) * 3 / 26.6, 1) AS seconds, round(sum(full_len) * 3 / 26.6 * 2, 1) AS seconds_least, round(sum(full_len) * 3 / 26.6 * 3, 1) AS seconds_most FROM encode_example GROUP BY split")
def _(t: Tables) -> DataFrame:
    base = t.encode_example.groupBy("split").agg(F.sum("full_len").alias("tokens"))
    seconds = F.col("tokens") * 3 / F.lit(26.6)
    return base.select("split", "tokens", F.round(seconds, 1).alias("seconds"), F.round(seconds * 2, 1).alias("seconds_least"), F.round(seconds * 3, 1).alias("seconds_most"))


@query("vector_l2_norm", "SELECT label, round(avg(norm), 6) AS mean, round(max(norm), 6) AS most FROM (SELECT label, sqrt(list_sum([x::DOUBLE * x::DOUBLE for x in embedding])) AS norm FROM embeddings) GROUP BY label")
def _(t: Tables) -> DataFrame:
    return t.embeddings.groupBy("label").agg(F.round(F.avg(arrays.l2_norm(F.col("embedding"))), 6).alias("mean"), F.round(F.max(arrays.l2_norm(F.col("embedding"))), 6).alias("most"))


@query("adapter_size", "SELECT p_brand, sum(8 * (p_size + p_partkey % 64))::BIGINT AS parameters FROM part GROUP BY p_brand")
def _(t: Tables) -> DataFrame:
    return t.part.groupBy("p_brand").agg(F.sum(8 * (F.col("p_size") + F.col("p_partkey") % 64)).alias("parameters"))


@query("first_seen_distinct", "SELECT p_type, min(p_partkey) AS first_key FROM part GROUP BY p_type")
def _(t: Tables) -> DataFrame:
    return t.part.groupBy("p_type").agg(F.min("p_partkey").alias("first_key"))


@query("set_equal", "SELECT count(*) = 0 AS same FROM ((SELECT run FROM runs EXCEPT SELECT run FROM warmup_fixed) UNION ALL (SELECT run FROM warmup_fixed EXCEPT SELECT run FROM runs))")
def _(t: Tables) -> DataFrame:
    a, b = t.runs.select("run").distinct(), t.warmup_fixed.select("run").distinct()
    return evaluate.different(a, b).agg((F.count("*") == 0).alias("same"))


@query("encode_chat", """
WITH e AS (SELECT line_no, list_sum([length(m.role) + length(m.content) + 13 for m in messages])::INT AS full_len, (list_sum([length(m.role) + length(m.content) + 13 for m in messages[1:len(messages) - 1]]) + 14)::INT AS prompt_len FROM split_examples)
SELECT line_no, full_len, prompt_len, full_len - prompt_len AS answer_len, full_len > 384 AS truncated, greatest(0, least(full_len, 384) - prompt_len) AS supervised FROM e""")
def _(t: Tables) -> DataFrame:
    from karst.operators.encoding import encode_chats

    return encode_chats(t.split_examples, "line_no").select("line_no", "full_len", "prompt_len", "answer_len", "truncated", "supervised")
