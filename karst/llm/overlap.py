"""Records of evaluation splits that also stand in the training split (problem 3).

Hashes of the canonicalised record (case, punctuation and white space normalised) join
evaluation with training. A single hash of the whole record finds only exact copies, so
the records are also hashed piecewise, by triples of words; see simjoin.py.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karst.llm.simjoin import similar

TRAIN, EVAL = 1, 2


def _sided(records: DataFrame) -> DataFrame:
    side = F.when(F.col("split") == "train", TRAIN).when(F.col("split").isin("val", "test"), EVAL)
    said = lambda role: F.expr(f"try_element_at(filter(messages, m -> m.role = '{role}'), 1).content")
    return records.where(F.col("line_no").isNotNull()).select(
        F.col("line_no").alias("id"),
        side.alias("flags"),
        F.lower(F.regexp_replace("id", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")).alias("name"),
        F.concat_ws("\n", said("user"), said("assistant")).alias("text"),
    ).where("flags is not null")


def overlap_pairs(records: DataFrame, num: int = 3, den: int = 5) -> DataFrame:
    """line_a < line_b, one of train and one of val or test, of equal trimmed and lower-cased id or similar texts.

    Records of null or unknown split and null ids make no pairs; missing contents count as
    absent from the text.
    """
    sided = _sided(records)
    members, links = similar(sided.select("id", "flags", "text"), num, den, sides=True)
    side = lambda f, k, i: members.where(f"flags = {f}").select(F.col("k").alias(k), F.col("id").alias(i))
    both_ways = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    across = both_ways.join(side(TRAIN, "a", "x"), "a").join(side(EVAL, "b", "y"), "b").select("x", "y")
    within = side(TRAIN, "a", "x").join(side(EVAL, "b", "y"), F.col("a") == F.col("b")).select("x", "y")
    train = sided.where(f"flags = {TRAIN}").select("name", F.col("id").alias("x"))
    held = sided.where(f"flags = {EVAL}").select("name", F.col("id").alias("y"))
    named = train.join(held, "name").select("x", "y")
    pairs = across.unionByName(within).unionByName(named).where("x <> y")
    return pairs.select(F.least("x", "y").alias("line_a"), F.greatest("x", "y").alias("line_b")).distinct()


def overlap_report(records: DataFrame, num: int = 3, den: int = 5) -> DataFrame:
    """Per split and source of the evaluation record: pairs, and distinct evaluation records that overlap training."""
    pairs = overlap_pairs(records, num, den)
    held = records.where(F.col("split").isin("val", "test")).select(F.col("line_no").alias("y"), "split", "source")
    ends = pairs.select(F.col("line_a").alias("y")).unionAll(pairs.select(F.col("line_b").alias("y")))
    per_record = ends.groupBy("y").agg(F.count("*").alias("c"))
    return per_record.join(held, "y").groupBy("split", "source").agg(F.count("*").alias("n_records"), F.sum("c").alias("n_pairs"))
