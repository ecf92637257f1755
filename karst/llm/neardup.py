"""Records that pose the same question with small edits (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karst.llm.simjoin import similar

MARK = "Вопрос:\n"


def questions(examples: DataFrame) -> DataFrame:
    """line_no and question: what follows the last mark in the first message of role user.

    Records without such a message, or of null line_no, are left out; a null content stays null.
    """
    first = F.expr("try_element_at(filter(messages, m -> m.role = 'user'), 1)")
    return (
        examples.where(F.col("line_no").isNotNull() & first.isNotNull())
        .select("line_no", F.substring_index(first["content"], MARK, -1).alias("question"))
    )


def question_pairs(examples: DataFrame, num: int = 3, den: int = 5) -> DataFrame:
    """All pairs line_a < line_b, each once, whose questions have a similarity of num / den at least.

    Null and empty questions and those without words make no pairs; equal questions do.
    A line_no that stands more than once counts as one record with several questions.
    """
    members, links = similar(questions(examples).select(F.col("line_no").alias("id"), F.lit(0).alias("flags"), F.col("question").alias("text")), num, den)
    a = members.select(F.col("k").alias("a"), F.col("id").alias("x"))
    b = members.select(F.col("k").alias("b"), F.col("id").alias("y"))
    across = links.join(a, "a").join(b, "b").select("x", "y")
    within = a.join(b, F.col("a") == F.col("b")).where("x < y").select("x", "y")
    pairs = across.unionByName(within).where("x <> y")
    return pairs.select(F.least("x", "y").alias("line_a"), F.greatest("x", "y").alias("line_b")).distinct()


def question_classes(examples: DataFrame, num: int = 3, den: int = 5) -> DataFrame:
    """One row per record with words in its question: class of equal questions and number of similar classes."""
    members, links = similar(questions(examples).select(F.col("line_no").alias("id"), F.lit(0).alias("flags"), F.col("question").alias("text")), num, den)
    ends = links.select(F.col("a").alias("k")).unionAll(links.select(F.col("b").alias("k")))
    degree = ends.groupBy("k").agg(F.count("*").alias("n_links"))
    return members.join(degree, "k", "left").select(F.col("id").alias("line_no"), F.col("k").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
