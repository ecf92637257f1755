"""Record checks, filters with reasons, scrubbing and diversity of chat datasets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karst.functions import stats, text

ROLES = ("system", "user", "assistant")


def content_of(role: str, messages: str = "messages") -> Column:
    """Content of the first message of a role; null without one."""
    return F.try_element_at(F.filter(F.col(messages), lambda m: m["role"] == role), F.lit(1))["content"]


def chat_record(question: Column, answer: Column, context: Column | None = None, system: Column | str = "") -> Column:
    """messages: system, user (with the context before the question, if there is one) and assistant."""
    user = question if context is None else F.when(context.isNull(), question).otherwise(F.concat(F.lit("Контекст:\n"), context, F.lit("\n\nВопрос:\n"), question))
    made = [(F.lit("system"), F.lit(system) if isinstance(system, str) else system), (F.lit("user"), user), (F.lit("assistant"), answer)]
    return F.array(*(F.struct(r.alias("role"), c.alias("content")) for r, c in made))


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule that holds, null if none does; a rule of null doesn't hold."""
    return reduce(lambda out, rule: F.when(F.coalesce(rule[1], F.lit(False)), F.lit(rule[0])).otherwise(out), reversed(rules), F.lit(None).cast("string"))


def schema_reason() -> Column:
    """Why a chat record (id, topic, messages) breaks the schema, or null."""
    roles = F.transform("messages", lambda m: m["role"])
    return first_reason([
        ("id", text.is_blank(F.col("id"))),
        ("messages", F.col("messages").isNull()),
        ("roles", ~F.coalesce(roles == F.array(*map(F.lit, ROLES)), F.lit(False))),
        ("content", F.exists("messages", lambda m: text.is_blank(m["content"]))),
    ])


def length_reason(user: Column, assistant: Column, least_user: int, most_user: int, least_assistant: int) -> Column:
    return first_reason([("user", ~F.length(user).between(least_user, most_user)), ("assistant", F.length(assistant) < least_assistant)])


def drop_counts(df: DataFrame, reason: Column) -> DataFrame:
    """Rows by reason; kept rows are under 'kept'."""
    return df.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def scrub(df: DataFrame, column: str) -> DataFrame:
    """column with placeholders, and hit counts n_phone, n_email, n_birth_date; null text stays null without hits."""
    clean, hits = text.pii_counts(F.col(column))
    return df.withColumns({**{f"n_{k}": c for k, c in hits.items()}, column: clean})


def diversity(df: DataFrame, system: Column, group: Column, answer: Column) -> DataFrame:
    """One row of measures of a set of records. Ties of the largest group go to the first name."""
    base = df.select(text.normalize_text(system, False).alias("s"), group.alias("g"), answer.alias("a"), F.length(answer).alias("l"), text.normalize_text(answer, False).alias("k"))
    whole = base.agg(F.count("*").alias("examples"), F.countDistinct("s").alias("system_prompts"), F.countDistinct("g").alias("n_groups"))
    groups = base.groupBy("g").count().agg(F.max(F.struct(F.col("count"), F.col("g"))).alias("_m"), F.max("count").alias("_top"))
    lengths = base.groupBy("l").count().agg(F.max("count").alias("_length"))
    repeats = base.groupBy("k").count().agg(F.sum(F.when(F.col("count") > 1, F.col("count") - 1).otherwise(0)).alias("_repeated"))
    spread = stats.spread(base, [], "l").select("p10", "p50", "p90", "ratio", "cv")
    joined = whole.crossJoin(groups.drop("_m")).crossJoin(lengths).crossJoin(repeats).crossJoin(spread)  # one row each
    share = lambda c: F.round(F.try_divide(F.col(c), F.col("examples")), 4)
    return joined.select("examples", "system_prompts", "n_groups", share("_top").alias("largest_group_share"), share("_length").alias("same_length_share"), share("_repeated").alias("duplicate_answer_share"), "p10", "p50", "p90", "ratio", "cv")


def violations(measures: DataFrame, limits: dict[str, tuple[str, float]]) -> DataFrame:
    """One row per broken limit: measure, value, sense and limit; sense is 'least' or 'most'. A null value is broken."""
    rows = F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value"), F.lit(sense).alias("sense"), F.lit(float(v)).alias("bound")) for m, (sense, v) in limits.items()))
    broken = lambda r: F.coalesce(F.when(r["sense"] == "least", r["value"] < r["bound"]).otherwise(r["value"] > r["bound"]), F.lit(True))
    return measures.select(F.explode(F.filter(rows, broken)).alias("r")).select("r.*")
