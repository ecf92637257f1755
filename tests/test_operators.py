import hashlib
import random

import pytest
from pyspark.sql import functions as F

from karst.functions import arrays, hashing, stats, text
from karst.operators import dedup, evaluate, ledger, quality, sampling, telemetry, tokens

CHAT = "line_no bigint, id string, topic string, messages array<struct<role: string, content: string>>"


def chat(n, system="s", user="u", assistant="a", **more):
    return (n, more.get("id", f"i{n}"), more.get("topic", "t"), [("system", system), ("user", user), ("assistant", assistant)])


def test_normalized_forms(spark):
    df = spark.createDataFrame([("Ａ — b c\x1c d",), ("  Тема – 2025 | другое ",), ("",), (None,)], "x string")
    got = [tuple(r) for r in df.select(text.normalize_text(F.col("x")), text.normalize_group(F.col("x"))).collect()]
    assert got == [("a - b c d", "a - b c d"), ("тема - 2025 | другое", "тема - 2025"), ("", ""), (None, None)]


def test_question_key_takes_the_last_mark(spark):
    df = spark.createDataFrame([("Контекст:\nx\n\nВопрос:\nодин\nВопрос:\nДВА ",), ("просто",)], "x string")
    assert [r[0] for r in df.select(text.question_key(F.col("x"))).collect()] == ["два", "просто"]


def test_words_and_ngrams(spark):
    df = spark.createDataFrame([("один два_3 Four five",), ("a b",), ("!",), ("",), (None,)], "x string").select(text.words(F.col("x")).alias("w"))
    got = [r[0] for r in df.select(text.ngrams(F.col("w"), 3)).collect()]
    assert got == [["один два_3 Four", "два_3 Four five"], ["a b"], [], [], None]


def test_scrub_keeps_the_mark_of_a_birth_date(spark):
    df = spark.createDataFrame([("тел. +7 (912) 345-67-89 и a.b@c.org",), ("дата рождения: 01.02.1980, приказ от 23.11.2021",), (None,), ("",)], "x string")
    got = [tuple(r) for r in quality.scrub(df, "x").select("x", "n_phone", "n_email", "n_birth_date").collect()]
    assert got == [("тел. [PHONE] и [EMAIL]", 1, 1, 0), ("дата рождения: [DATE], приказ от 23.11.2021", 0, 0, 1), (None, 0, 0, 0), ("", 0, 0, 0)]


def test_hex_modulo_and_fingerprints(spark):
    import hashlib

    df = spark.createDataFrame([("abc",), ('{"b": 1, "a": [null, "я"]}',), ("{broken",), ('{"a": NaN}',), (None,)], "x string")
    rows = df.select("x", hashing.hex_mod(hashing.sha256(F.col("x")), 7), hashing.fingerprint(F.col("x")), hashing.fingerprint(F.col("x"), compact=False)).collect()
    assert rows[0][1] == int(hashlib.sha256(b"abc").hexdigest(), 16) % 7
    assert rows[1][2] == hashlib.sha256('{"a":[null,"я"],"b":1}'.encode()).hexdigest()
    assert rows[1][3] == hashlib.sha256('{"a": [null, "я"], "b": 1}'.encode()).hexdigest()
    assert [r[2] for r in rows[2:]] == [None, None, None] and rows[4][1] is None


def test_three_percentiles_differ(spark):
    df = spark.createDataFrame([("g", v) for v in range(1, 11)] + [("g", None), ("none", None)], "k string, v int")
    floor = {r["k"]: r["q"] for r in stats.percentile_floor(df, ["k"], "v", {"q": 0.9}).collect()}
    rest = {r["k"]: (r["l"], r["c"]) for r in df.groupBy("k").agg(stats.percentile_linear("v", 0.9).alias("l"), stats.percentile_ceil("v", 0.9).alias("c")).collect()}
    assert floor == {"g": 10} and rest["g"] == (pytest.approx(9.1), 9) and rest["none"] == (None, None)


@pytest.mark.parametrize("seed", range(2))
def test_percentiles_of_any_size_equal_sorting(spark, seed):
    import math

    r = random.Random(seed)
    data = [(r.choice(["hot"] * 6 + ["a", None, "b"]), r.choice([None, 0.0, r.random(), r.randint(0, 5) * 1.0]), r.randint(0, 9)) for _ in range(500)] + [("none", None, None)]
    df = spark.createDataFrame(data, "k string, v double, w int").repartition(5)
    wanted = {"c": ("v", "ceil", 0.95), "f": ("v", "floor", 0.9), "l": ("v", "linear", 0.3), "m": ("w", "linear", 0.5)}
    got = {x["k"]: x for x in stats.percentiles(df, ["k"], {"v": F.col("v"), "w": F.col("w")}, wanted).collect()}
    assert set(got) == {x[0] for x in data}
    for k in got:
        v, w = (sorted(x[c] for x in data if x[0] == k and x[c] is not None) for c in (1, 2))

        def linear(x, p):
            at = (len(x) - 1) * p
            return x[math.floor(at)] + (x[math.ceil(at)] - x[math.floor(at)]) * (at - math.floor(at))

        want = (v[max(0, math.ceil(len(v) * 0.95) - 1)], v[min(len(v) - 1, int(len(v) * 0.9))], linear(v, 0.3), linear(w, 0.5)) if v else (None,) * 4
        assert all(g is None and x is None or g == pytest.approx(x) for g, x in zip((got[k]["c"], got[k]["f"], got[k]["l"], got[k]["m"]), want))
    assert stats.percentiles(df.limit(0), ["k"], {"v": F.col("v")}, {"c": wanted["c"]}).count() == 0
    assert stats.percentiles(df, [], {"v": F.col("v")}, {"c": wanted["c"]}).count() == 1


def test_spread_and_weighted_mean(spark):
    df = spark.createDataFrame([("a", 1, 0), ("a", 3, 2), ("b", 5, 0)], "k string, v int, w int")
    got = {r["k"]: r for r in stats.spread(df, ["k"], "v").collect()}
    assert (got["a"]["p10"], got["a"]["p90"], got["a"]["ratio"], got["a"]["cv"]) == (1, 3, 3.0, 0.5)
    assert {r[0]: r[1] for r in df.groupBy("k").agg(stats.weighted_mean("v", "w")).collect()} == {"a": 3.0, "b": None}
    assert stats.spread(df.limit(0), ["k"], "v").count() == 0


def test_token_arrays(spark):
    df = spark.createDataFrame([([5, 6, 7], 2), ([], 0), (None, 1), ([5], 9), ([5], -1)], "ids array<int>, n int")
    got = df.select(arrays.mask_prompt(F.col("ids"), F.col("n")), arrays.supervised(F.col("ids")), arrays.supervised(F.col("ids"), True), arrays.pad(F.col("ids"), F.lit(2), 0, True)).collect()
    assert [r[0] for r in got] == [[-100, -100, 7], [], None, [-100], None]
    assert [r[1] for r in got] == [3, 0, 0, 1, 1] and [r[2] for r in got] == [2, 0, 0, 0, 0]
    assert [r[3] for r in got] == [[5, 6, 7], [0, 0], None, [0, 5], [0, 5]]


def test_prompt_boundary_falls_back_to_offsets(spark):
    df = spark.createDataFrame([([1, 2, 3], [1, 2], [0, 2, 4], 4), ([1, 9, 3], [1, 2], [0, 2, 5], 4), ([1, 9], [1, 2], [0, 2], 4)], "f array<int>, p array<int>, s array<int>, b int")
    assert [r[0] for r in df.select(arrays.prompt_boundary(F.col("f"), F.col("p"), F.col("s"), F.col("b"))).collect()] == [2, 2, None]


def test_jaccard_of_empty_sets_is_one(spark):
    df = spark.createDataFrame([(["a", "b"], ["b"]), ([], []), ([], ["a"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(arrays.jaccard(F.col("a"), F.col("b"))).collect()] == [0.5, 1.0, 0.0]


def test_schema_reasons(spark):
    rows = [chat(1), (2, " ", "t", []), (3, "x", "t", None), (4, "x", "t", [("user", "u")]), chat(5, user=" "), (6, "x", None, [("system", None), ("user", "u"), ("assistant", "a")])]
    got = {r[0]: r[1] for r in spark.createDataFrame(rows, CHAT).select("line_no", quality.schema_reason()).collect()}
    assert got == {1: None, 2: "id", 3: "messages", 4: "roles", 5: "content", 6: "content"}


def test_diversity_and_its_gate(spark):
    df = spark.createDataFrame([chat(n, user=f"u{n}", assistant="a" * (1 + n % 2), topic=f"t{n % 3}") for n in range(12)], CHAT)
    measured = quality.diversity(df, quality.content_of("system"), text.normalize_group(F.col("topic")), quality.content_of("assistant"))
    one = measured.first()
    assert (one["examples"], one["system_prompts"], one["n_groups"], one["same_length_share"], one["duplicate_answer_share"]) == (12, 1, 3, 0.5, 0.8333)
    assert {r[0] for r in quality.violations(measured, {"examples": ("least", 10), "system_prompts": ("least", 3), "ratio": ("least", 9)}).collect()} == {"system_prompts", "ratio"}


def test_duplicates_first_and_greedy(spark, rows):
    df = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, None), (5, "y")], "id int, t string")
    assert rows(dedup.later_copies(df, F.col("t"), "id").select("id", "first")) == [(2, 1), (4, 3)]
    assert rows(dedup.first_of(df, F.col("t"), "id").select("id")) == [(1,), (3,), (5,)]
    # 1~2, 2~3, 3~4: 2 goes because of 1, so 3 stays, so 4 goes
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "a int, b int")
    assert rows(dedup.greedy_drops(pairs)) == [(2,), (4,)]
    assert dedup.greedy_drops(pairs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_greedy_equals_the_sequential_rule(spark, seed):
    r = random.Random(seed)
    pairs = {tuple(sorted(r.sample(range(40), 2))) for _ in range(60)}
    kept, dropped = [], set()
    for n in range(40):
        if any((k, n) in pairs for k in kept):
            dropped.add(n)
        else:
            kept.append(n)
    assert {x[0] for x in dedup.greedy_drops(spark.createDataFrame(sorted(pairs), "a int, b int")).collect()} == dropped


def test_overlap_pairs_equal_brute_force(spark):
    r = random.Random(4)
    base = [" ".join(r.choices("абвгдежз", k=r.randint(1, 12))) for _ in range(30)]
    texts = [(n, " ".join(w for w in r.choice(base).split() if r.random() < 0.9)) for n in range(80)] + [(80, ""), (81, None)]
    s = dedup.shingled(spark.createDataFrame(texts, "id int, t string"), "id", F.col("t"), 2)
    got = {(x["a"], x["b"]) for x in dedup.overlap_pairs(s, s, 0.6, True).collect()}

    def grams(t):
        w = t.split()
        return {tuple(w[i : i + 2]) for i in range(max(1, len(w) - 1))} if w else set()

    sets = {n: grams(t) for n, t in texts if t}
    assert got == {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}


def test_ranks_strata_and_schedule(spark):
    r = random.Random(1)
    data = [(n, f"g{r.randint(0, 8)}", r.randint(1, 500), f"{r.random():.9f}") for n in range(300)]
    df = spark.createDataFrame(data, "id int, grp string, l int, p string")
    ranked = {x["id"]: x["rank"] for x in sampling.global_rank(df, ["l", "p"]).collect()}
    order = sorted(data, key=lambda x: (x[2], x[3]))
    assert ranked == {x[0]: k for k, x in enumerate(order, 1)}
    strata = sampling.strata(df, "l", ["p"], 40)
    got = [x["id"] for x in sampling.scheduled(strata, "grp", ["p", "id"], 9, 60).orderBy("slot").collect()]
    bucket = {x[0]: "short" if k < 40 else "long" if k >= 260 else "middle" for k, x in enumerate(order)}
    queues = {b: [x for x in sorted(data, key=lambda x: (x[3], x[0])) if bucket[x[0]] == b] for b in ("short", "middle", "long")}
    want, taken = [], {}
    while len(want) < 60:
        q = queues[sampling.SCHEDULE[len(want) % 5]]
        while q and taken.get(q[0][1], 0) >= 9:
            q.pop(0)
        if not q:
            break
        x = q.pop(0)
        taken[x[1]] = taken.get(x[1], 0) + 1
        want.append(x[0])
    assert got == want


def test_group_split_keeps_groups(spark):
    df = spark.createDataFrame([(f"g{n % 37}",) for n in range(1000)] + [(None,)] * 3, "grp string")
    got = sampling.group_split(df, "grp", {"train": 0.8, "val": 0.1, "test": 0.1}, 42).collect()
    assert len(got) == 38 and sum(r["n"] for r in got) == 1003
    share = {s: sum(r["n"] for r in got if r["split"] == s) / 1003 for s in ("train", "val", "test")}
    assert abs(share["train"] - 0.8) < 0.05 and share["val"] > 0.05 and share["test"] > 0.05
    with pytest.raises(ValueError):
        sampling.group_split(df, "grp", {"train": 0.5}, 1)


def test_evenly_spaced(spark):
    df = spark.range(10).withColumnRenamed("id", "x")
    assert sorted(r["x"] for r in sampling.evenly_spaced(df, ["x"], 4).collect()) == [0, 3, 6, 9]
    assert [r["x"] for r in sampling.evenly_spaced(df, ["x"], 1).collect()] == [5]


def test_padding_and_first_fit(spark):
    df = spark.createDataFrame([(1, [1, 2], [1, 2]), (2, [3], [3]), (3, None, None)], "k int, ids array<int>, labels array<int>")
    got = {r["k"]: (r["ids"], r["attention"], r["labels"]) for r in tokens.padded(tokens.batches(df, ["k"], 2), "batch", "ids", "labels", 9, left=True).collect()}
    assert got == {1: ([1, 2], [1, 1], [1, 2]), 2: ([9, 3], [0, 1], [-100, 3]), 3: ([], [], [])}
    sizes = spark.createDataFrame([(n, v) for n, v in enumerate([5, 7, 5, 2, 4, 2, 5, 1, 6, 12, 0])], "k int, n int")
    packed = tokens.first_fit(sizes, "k", "n", 10, 1)
    bins = {}
    for r in packed.collect():
        bins.setdefault(r["bin"], []).append(r["n"])
    assert sorted(map(sorted, bins.values())) == [[1, 4, 5], [2, 2, 6], [5, 5], [7, *[]], [12]] or all(sum(b) <= 10 or b == [12] for b in bins.values())
    assert sum(map(len, bins.values())) == 10
    report = tokens.packing_report(packed, "n", 10, 2).first()
    assert report["before"] == 10 and report["after"] == len(bins)


def test_group_split_has_no_limit_of_groups(spark):
    df = spark.range(2_000_001).select(F.col("id").cast("string").alias("grp"))
    n = {r["split"]: r["count"] for r in sampling.group_split(df, "grp", {"train": 0.8, "val": 0.1, "test": 0.1}, 42).groupBy("split").count().collect()}
    assert sum(n.values()) == 2_000_001 and abs(n["train"] - 1_600_001) <= 1 and abs(n["val"] - 200_000) <= 1


@pytest.mark.parametrize("seed", range(3))
def test_first_fit_equals_one_list(spark, seed):
    r = random.Random(seed)
    sizes = [r.choice([0, 1, 2, 3, r.randint(1, 20), r.randint(1, 20), 25]) for _ in range(400)]
    room, want = [], {}
    for k in sorted((k for k, n in enumerate(sizes) if n), key=lambda k: (-sizes[k], k)):
        at = next((b for b, x in enumerate(room) if x >= sizes[k]), len(room))
        room[at:] = room[at:] or [max(20, sizes[k])]
        room[at] -= sizes[k]
        want[k] = at
    df = spark.createDataFrame(list(enumerate(sizes)) + [(900, None)], "k int, n int")
    assert {x["k"]: x["bin"] for x in tokens.first_fit(df, "k", "n", 20, 1).collect()} == want
    assert tokens.first_fit(df.limit(0), "k", "n", 20, 1).count() == 0


def test_many_rows_are_packed_as_one_list(spark, tmp_path):
    from karst.plans import PLANS

    spark.range(100_001).select(F.col("id").alias("seq_no"), F.array_repeat(F.lit(1), 150).alias("input_ids")).write.parquet(f"{tmp_path}/encode_example.parquet")
    wrong = PLANS["pack_first_fit"](spark, str(tmp_path)).where("shard <> 0 or bin <> seq_no div 2")
    assert wrong.count() == 0
    assert PLANS["packing_report"](spark, str(tmp_path)).first()["after"] == 50_001


def test_strict_scoring(spark):
    tasks = spark.createDataFrame([(str(n), "A", ["A", "B"], ["x", "y"]) for n in range(8)], "id string, expected string, choices array<string>, slices array<string>")
    raws = ['{"answer": "A"}', '{"answer": "B"}', '{"answer": "A", "answer": "A"}', '{"answer": 1}', '{"answer": "Z"}', "A", None, '{"answer": "A", "x": 1}']
    outputs = spark.createDataFrame([(str(n), r, None) for n, r in enumerate(raws)], "id string, raw string, error string")
    items = evaluate.scored(tasks, outputs, "id")
    one = evaluate.summary(items, []).first()
    assert (one["n"], one["correct"], one["valid"], one["errors"]) == (8, 1, 2, 0)
    assert evaluate.by_slice(items).count() == 2
    better = items.withColumn("correct", F.lit(True)).withColumn("valid", F.lit(True))
    assert evaluate.gate(items, better, ["x"]).count() == 0
    assert {tuple(r) for r in evaluate.gate(better, items, ["x"]).collect()} == {("accuracy", "overall"), ("format_rate", "overall"), ("critical_slice", "x")}
    assert evaluate.key_mismatch(tasks, outputs.where("id <> '3'").unionAll(outputs.where("id = '4'")), "id").count() == 2


def test_rate_counts_resets_from_zero(spark):
    df = spark.createDataFrame([("a", t, v) for t, v in ((0, 1.0), (10, 4.0), (20, 2.0), (50, 3.0))], "k string, t long, v double")
    got = {r["t"]: r["increase"] for r in telemetry.rate(df, ["k"], "t", "v", 30).collect()}
    assert got == {10: pytest.approx(4.0), 20: pytest.approx(6.0)}  # alone in its window, 50 has no rate


def test_rate_equals_the_rule_on_whole_windows(spark):
    r = random.Random(2)
    rows, v = [], 0.0
    for t in sorted(r.sample(range(4000), 300)):
        v = float(r.randint(0, 3)) if r.random() < 0.05 else v + r.randint(0, 5)
        rows.append(("a", t, v))
    got = {x["t"]: x["rate"] for x in telemetry.rate(spark.createDataFrame(rows, "k string, t long, v double"), ["k"], "t", "v", 120).collect()}
    want = {}
    for _, end, _ in rows:
        inside = [(t, v) for _, t, v in rows if end - 120 < t <= end]
        if len(inside) < 2:
            continue
        grown = sum(b if b < a else b - a for (_, a), (_, b) in zip(inside, inside[1:]))
        span = inside[-1][0] - inside[0][0]
        mean, gap = span / (len(inside) - 1), inside[0][0] - (end - 120)
        gap = mean / 2 if gap >= 1.1 * mean else gap
        if grown > 0:
            gap = min(gap, span * inside[0][1] / grown)
        want[end] = grown * (span + gap) / span / 120
    assert got.keys() == want.keys() and all(got[t] == pytest.approx(want[t]) for t in want)


def test_instant_values_look_back_five_minutes(spark):
    samples = spark.createDataFrame([("a", 0, 1.0), ("a", 299, 2.0), ("a", 1000, 3.0), (None, 5, 9.0)], "k string, t long, v double")
    times = spark.createDataFrame([("a", 299), ("a", 300), ("a", 598), ("a", 599), ("a", 999), ("a", 1001), (None, 300), ("b", 0)], "k string, at long")
    got = {(r["k"], r["at"]): r["v"] for r in telemetry.instant(times, samples, ["k"], "at", "t", "v").collect()}
    assert got == {("a", 299): 2.0, ("a", 300): 2.0, ("a", 598): 2.0, ("a", 1001): 3.0, (None, 300): 9.0}


def test_histogram_quantile_golden(spark):
    df = spark.createDataFrame([("p", 0.025, 0), ("p", 0.05, 177), ("p", 0.075, 180), ("p", float("inf"), 180)], "k string, le double, n long")
    got = [telemetry.histogram_quantile(df, ["k"], q).first()["value"] for q in (0.5, 0.95)]
    assert got == [pytest.approx(0.03771186440677966), pytest.approx(0.04915254237288136)]


def test_as_of_and_first_after(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("b", 3), (None, 9)], "k string, t int")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("b", 4, "z"), (None, 1, "n")], "k string, u int, v string")
    got = {(r["k"], r["t"]): r["v"] for r in telemetry.as_of(left, right, ["k"], "t", "u", ["v"]).collect()}
    assert got == {("a", 1): None, ("a", 5): "y", ("b", 3): None, (None, 9): "n"}
    got = {(r["k"], r["t"]): r["f"] for r in telemetry.first_after(left, right, ["k"], "t", "u", "f").collect()}
    assert got == {("a", 1): 2, ("a", 5): 5, ("b", 3): 4, (None, 9): None}


def test_alert_needs_to_hold(spark):
    df = spark.createDataFrame([("a", t, v) for t, v in ((0, 1), (5, 9), (10, 9), (15, 9), (20, 9), (25, 1), (30, 9), (35, None))], "k string, t int, v int")
    got = [r["state"] for r in telemetry.alert_states(df, ["k"], "t", F.col("v") > 5, 15).orderBy("t").collect()]
    assert got == ["inactive", "pending", "pending", "pending", "firing", "inactive", "pending", "inactive"]


def test_ledger(spark, rows):
    held = spark.createDataFrame([("r1", 1)], "release_id string, n int")
    events = spark.createDataFrame([("r1", 7), ("r2", 5), ("r2", 3)], "release_id string, n int")
    assert rows(ledger.append(held, events, "release_id", ["n"])) == [("r1", 1), ("r2", 3)]
    pending = spark.createDataFrame([("r3", 4, "d")], "release_id string, n int, pointer_sha256 string")
    assert ledger.recover(held, pending, "d", "release_id").count() == 2 and ledger.recover(held, pending, "e", "release_id").count() == 1
    ok = spark.createDataFrame([(0.5,), (float("nan"),), (float("inf"),), (-0.1,), (None,), (1.0,)], "x double")
    assert [r[0] for r in ok.select(ledger.is_share(F.col("x"))).collect()] == [True, False, False, False, False, True]


def test_small_text_functions(spark):
    df = spark.createDataFrame([("a/b.txt", "x=1; x=2"), ("../a", "x=1"), ("/a", ""), ("", None), (None, "y")], "p string, t string")
    got = [tuple(r) for r in df.select(text.safe_path(F.col("p")), text.replace_once(F.col("t"), "x=\\d", "x=9"), text.without_prefix(F.col("p"), "a/")).collect()]
    assert got == [(True, None, "b.txt"), (False, "x=9", "../a"), (False, None, "/a"), (False, None, ""), (False, None, None)]
    df = spark.createDataFrame([("<u> hi <e>x", 1234567.891), ("none", None)], "t string, v double")
    got = [tuple(r) for r in df.select(text.between_marks(F.col("t"), "<u>", "<e>"), text.number(F.col("v"), 2), text.percent(F.col("v") / F.col("v"))).collect()]
    assert got == [("hi", "1 234 567,89", "100,0 %"), (None, None, None)]


def test_chat_encoding_masks_the_prompt(spark):
    from karst.operators import encoding

    answer = encoding.encode_record(encoding.chars(), [{"role": "user", "content": "q"}, {"role": "assistant", "content": "Да"}], 999)
    kept = "".join(map(chr, (x for x in answer["labels"] if x != -100)))
    assert kept == "Да<|end|>\n" and answer["full_len"] == answer["prompt_len"] + answer["answer_len"] and not answer["truncated"]
    cut = encoding.encode_record(encoding.chars(), [{"role": "user", "content": "q"}, {"role": "assistant", "content": "Да"}], 2)
    assert cut["truncated"] and cut["supervised"] == 0 and len(cut["input_ids"]) == 2

    def pairs():  # tokens of two characters: one goes over the end of the prompt
        return lambda t: ([hash(t[i : i + 2]) % 1000 for i in range(0, len(t), 2)], [(i, min(i + 2, len(t))) for i in range(0, len(t), 2)])

    odd = encoding.encode_record(pairs(), [{"role": "user", "content": "qq" if len(encoding.template([{"role": "user", "content": "q"}])) % 2 else "q"}, {"role": "assistant", "content": "answer"}], 999)
    assert odd["fault"] is None and odd["prompt_len"] > 0
    rows = [chat(1), (2, "x", "t", None), (3, "x", "t", []), (4, "x", "t", [("user", "u")]), (5, "x", "t", [("assistant", None)])]
    got = {r["line_no"]: r["fault"] for r in encoding.encode_chats(spark.createDataFrame(rows, CHAT), "line_no").collect()}
    assert got == {1: None, 2: "content", 3: "content", 4: "no_answer", 5: "content"}


def test_balanced_sample_reaches_its_ratio(spark):
    df = spark.createDataFrame([(n, f"g{n % 50}", 10 + n % 90, f"{n * 7919 % 1000:04}") for n in range(1000)], "id int, grp string, l int, p string")
    sample, share = sampling.balanced(df, "l", "grp", ["p", "id"], 9, (60, 100), 2.0)
    assert sample.count() == 100 and 0 < share <= 0.1 and sorted(r["slot"] for r in sample.collect()) == list(range(100))
    with pytest.raises(ValueError):
        sampling.balanced(df, "l", "grp", ["p", "id"], 9, (100,), 99.0)


def test_small_samples_are_the_head_under_the_cap(spark):
    df = spark.createDataFrame([(n, "hot" if n < 9 else f"g{n}", n, f"{n:03}") for n in range(20)], "id int, grp string, l int, p string")
    sample, share = sampling.balanced(df, "l", "grp", ["p"], 2, (5,), 99.0)
    assert share is None and [(r["id"], r["slot"]) for r in sample.orderBy("slot").collect()] == [(0, 0), (1, 1), (9, 2), (10, 3), (11, 4)]
    with pytest.raises(ValueError):
        sampling.balanced(df, "l", "grp", ["p"], 2, (50,), 1.0)


@pytest.mark.parametrize("seed", range(5))
def test_groups_go_where_the_rule_says(spark, seed):
    r = random.Random(seed)
    sizes = {f"g{k}": r.choice([1, 1, 1, 2, 3, 7, r.randint(1, 60)]) for k in range(r.choice([3, 40, 150]))}
    ratios = r.choice([{"train": 0.8, "val": 0.1, "test": 0.1}, {"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 1.0}])
    df = spark.createDataFrame([(g,) for g, n in sizes.items() for _ in range(n)], "grp string")
    got = {x["group"]: x["split"] for x in sampling.group_split(df, "grp", ratios, 7).collect()}
    total, held, want = sum(sizes.values()), dict.fromkeys(ratios, 0), {}
    for g in sorted(sizes, key=lambda g: (-sizes[g], hashlib.sha256(f"7:{g}".encode()).hexdigest())):
        best = None
        for place, split in enumerate(ratios):
            wish, n = total * ratios[split], sizes[g]
            rank = (held[split] >= wish, (held[split] + n - wish) / wish, held[split] / wish, place)
            best = min(best or (rank, split), (rank, split))
        want[g] = best[1]
        held[best[1]] += sizes[g]
    assert got == want


def test_rounding_by_the_exact_binary_value(spark):
    r = random.Random(5)
    values = [2.675, 1.005, 0.125, 0.375, 2.5, 3.5, -2.5, -0.125, 1e15, 0.0, 1.115, 2.345] + [round(r.uniform(-50, 50), 3) for _ in range(400)] + [r.randint(0, 9999) / 8 for _ in range(50)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = df.select("x", *(stats.half_even(F.col("x"), k).alias(f"r{k}") for k in (0, 1, 2))).collect()
    assert all(x[f"r{k}"] == round(x["x"], k) for x in got for k in (0, 1, 2))


def test_casefold(spark):
    words = ["Straße", "ΣΊΣΥΦΟΣ", "ﬁne", "ЁЖ", "İ", "plain", "ŉ", None, ""]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [x[0] for x in df.select(text.casefold(F.col("w"))).collect()] == [w and w.casefold() for w in words]


def test_minhash_estimates_and_bands(spark):
    r = random.Random(3)
    base = [f"s{k}" for k in range(60)]
    rows = [(0, base), (1, base), (2, base[:57] + ["x", "y", "z"]), (3, [f"o{k}" for k in range(60)]), (4, []), (5, None)]
    signed = dedup.minhash(spark.createDataFrame(rows, "id int, shingles array<string>"), "id")
    held = {x["id"]: x["signature"] for x in signed.collect()}
    assert set(held) == {0, 1, 2, 3} and all(len(v) == 128 for v in held.values())
    for k in r.sample(range(128), 5):
        a, b = dedup.permutation(k)
        hashes = [int(hashlib.md5(s.encode()).hexdigest()[:8], 16) >> 1 for s in rows[2][1]]
        assert held[2][k] == min((a * x + b) % dedup.PRIME for x in hashes)
    pairs = {(x["a"], x["b"]): x["estimate"] for x in dedup.lsh_pairs(signed, "id", 16).collect()}
    assert set(pairs) == {(0, 1), (0, 2), (1, 2)} and pairs[0, 1] == 1.0 and abs(pairs[0, 2] - 57 / 63) < 0.1


def test_split_overlaps(spark):
    df = spark.createDataFrame([("train", "a", "g"), ("train", "a", None), ("val", "a", "h"), ("test", "b", "g"), (None, "a", "g"), ("val", None, None)], "split string, id string, grp string")
    got = {(x["one"], x["two"], x["kind"]): (x["n_keys"], x["rows_one"], x["rows_two"], x["clean"]) for x in evaluate.split_overlap(df, "split", ["id", "grp"], [("train", "val"), ("val", "test"), ("train", "test")]).collect()}
    assert got == {("train", "val", "id"): (1, 2, 1, False), ("train", "val", "grp"): (0, 0, 0, True), ("val", "test", "id"): (0, 0, 0, True), ("val", "test", "grp"): (0, 0, 0, True), ("train", "test", "id"): (0, 0, 0, True), ("train", "test", "grp"): (1, 1, 1, False)}


def test_snapshots_and_alert_marks(spark):
    pods = "pods map<string, struct<ready: boolean, deletion: string, version: string>>, slices map<string, array<struct<targets: array<string>>>>"
    df = spark.createDataFrame([(1.0, {"a": (True, None, "A"), "b": (True, "x", "A"), "c": (None, None, "B")}, {"api": [(["a", "z"],)]}), (2.0, None, None)], f"epoch double, {pods}")
    assert [r["ready"] for r in telemetry.ready_pods(df).orderBy("epoch").collect()] == [1, 0]
    assert {(r["target"], r["pod"] is None) for r in telemetry.endpoint_pods(df, "api").collect()} == {("a", False), ("z", True)}
    states = spark.createDataFrame([("x", 1, "inactive"), ("x", 2, "pending"), ("x", 3, "firing"), ("x", 4, "firing"), ("x", 5, "inactive"), ("y", 1, "inactive")], "k string, t int, state string")
    assert {tuple(r) for r in telemetry.alert_marks(states, ["k"], "t").collect()} == {("x", 2, 3, 5), ("y", None, None, None)}
