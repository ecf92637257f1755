"""Splits that keep related records together (problem 6).

Records that share an entity (id or topic alias) are connected. Components come from
alternating large-star and small-star steps over (larger, smaller) edges; each step is
min-aggregation and join, so a hot node is never gathered in one place. Components then
go to split ranges by hash; those too heavy for a hash to balance are placed first.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karst.sources.staging import release, stage

_DASHES = str.maketrans(dict.fromkeys("‐‑–—", "-"))
_SPACE = re.compile(r"\s+")
#: A component of more than this share of all rows is placed by weight; there are at most 1 / HEAVY.
HEAVY = 0.002


def alias_names(topic: str | None) -> list[str]:
    """Distinct non-empty parts of a topic between |, in one way of writing."""
    parts = (_SPACE.sub(" ", unicodedata.normalize("NFKC", p).translate(_DASHES)).strip().lower() for p in (topic or "").split("|"))
    return list(dict.fromkeys(filter(None, parts)))


def _aliases(topics: pd.Series) -> pd.Series:
    return topics.map(alias_names, na_action=None)


def entity_links(examples: DataFrame) -> DataFrame:
    """(line_no, entity), the entities being ids and aliases; null ids and empty aliases relate nothing, blank ids are equal."""
    base = examples.where("line_no is not null").select("line_no", F.lower(F.regexp_replace("id", r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")).alias("name"), "topic")
    aliases = F.transform(F.pandas_udf(_aliases, "array<string>")("topic"), lambda a: F.concat(F.lit("t:"), a))
    name = F.when(F.col("name").isNotNull(), F.array(F.concat(F.lit("i:"), "name"))).otherwise(F.array().cast("array<string>"))
    return base.select("line_no", F.explode(F.concat(aliases, name)).alias("entity"))


def _tally(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) with u > v, distinct; returns (node, root) of every node that has an edge, root the smallest node."""
    edges = stage(edges, "edges")
    before = None
    while (now := _tally(edges)) != before:
        before = now
        ends = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ends.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "v")
        large = edges.join(least, "v").select("u", F.col("m").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u > v").distinct()
        step = stage(small, "edges")
        release(edges)
        edges = step
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def related(examples: DataFrame) -> DataFrame:
    """(line_no, root) of each record that is related to another; root is the group's smallest line_no."""
    links = stage(entity_links(examples), "entities")
    hubs = links.groupBy("entity").agg(F.min("line_no").alias("v"))
    edges = links.join(hubs, "entity").where("line_no > v").select(F.col("line_no").alias("u"), "v").distinct()
    return components(edges).select(F.col("node").alias("line_no"), "root")


def mixed_groups(examples: DataFrame) -> DataFrame:
    """(line_a, line_b): records of related groups in which topic has two different non-null values as written."""
    groups = stage(related(examples), "groups")
    topics = examples.select("line_no", "topic").join(groups, "line_no").groupBy("root").agg(F.min("topic").alias("a"), F.max("topic").alias("b"))
    mixed = topics.where("a <> b").select("root")
    return groups.where("line_no <> root").join(mixed, "root").select(F.col("root").alias("line_a"), F.col("line_no").alias("line_b")).distinct()


def assign_splits(examples: DataFrame, spec: DataFrame, seed: str = "karst") -> DataFrame:
    """(line_no, root, split) of every record of non-null line_no, in the proportions of spec (split, ratio).

    Records of one related group get one split. spec is a fixed small table; rows of null
    split or without a positive ratio are ignored, and an empty spec gives null splits.
    """
    wanted = [(r["split"], float(r["ratio"])) for r in spec.where("split is not null and ratio > 0").orderBy("split").limit(1000).collect()]
    roots = examples.where("line_no is not null").select("line_no").distinct().join(related(examples), "line_no", "left").select("line_no", F.coalesce("root", "line_no").alias("root"))
    if not wanted:
        return roots.withColumn("split", F.lit(None).cast("string"))
    roots = stage(roots, "roots")
    n = roots.count()
    heavy = roots.groupBy("root").count().where(F.col("count") > max(1, HEAVY * n)).collect()  # at most 1 / HEAVY rows
    whole = sum(r for _, r in wanted)
    room = {s: r / whole * n for s, r in wanted}
    placed = {}
    for row in sorted(heavy, key=lambda r: (-r["count"], r["root"])):
        to = max(room, key=lambda s: (room[s], s))
        placed[row["root"]] = to
        room[to] -= row["count"]
    light = {s: max(0.0, r) for s, r in room.items()}
    total = sum(light.values()) or 1.0
    draw = F.pmod(F.xxhash64(F.concat(F.lit(seed + ":"), F.col("root").cast("string"))), F.lit(1_000_003)) / 1_000_003.0
    split, upto = F.lit(wanted[-1][0]), 1.0
    for s, _ in reversed(wanted):
        split = F.when(draw < upto, F.lit(s)).otherwise(split) if upto < 1.0 else F.lit(s)
        upto -= light[s] / total
    if placed:
        split = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in placed.items() for x in kv)), F.col("root")), split)
    return roots.withColumn("split", split)
