"""Exact and near duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from karst.functions import text
from karst.sources.staging import release, stage


def _keyed(df: DataFrame, key: Column) -> DataFrame:
    """Null keys are one key."""
    return df.withColumn("_key", F.coalesce(F.sha2(key, 256), F.lit("")))


def later_copies(df: DataFrame, key: Column, order: str) -> DataFrame:
    """Rows whose key an earlier row has, with first: that row's order value (unique). A hot key is no task of its own."""
    keyed = _keyed(df, key)
    firsts = keyed.groupBy("_key").agg(F.min(order).alias("first"))
    return keyed.join(firsts, "_key").where(F.col(order) > F.col("first")).drop("_key")


def first_of(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The row of the smallest (unique) order value of each key."""
    return df.join(_keyed(df, key).groupBy("_key").agg(F.min(order).alias(order)).drop("_key"), order, "left_semi")


def shingled(df: DataFrame, ident: str, source: Column, size: int) -> DataFrame:
    """(ident, n, shingles): the set of word n-grams of each row, hashed to 64 bits; null text gives no row.

    Tokens are materialized first, so that the regular expression runs once per text.
    """
    tokens = stage(df.select(ident, text.words(source).alias("_w")).where("_w is not null"), "words")
    sets = tokens.select(ident, F.array_distinct(F.transform(text.ngrams(F.col("_w"), size), lambda s: F.xxhash64(s))).alias("shingles"))
    out = stage(sets.select(ident, F.size("shingles").alias("n"), "shingles"), "shingles")
    release(tokens)
    return out


def overlap_pairs(left: DataFrame, right: DataFrame, least: float, ordered: bool) -> DataFrame:
    """(a, b, similarity) of rows whose shingle sets have a Jaccard index of ``least`` at least.

    left and right: (id, n, shingles); with ``ordered`` they are the same and a < b. Two sets of
    that similarity share one of the rarest shingles of each; those that only one row holds come
    first in that order and need not be joined. Candidates are then compared whole. Empty
    sets make no pairs.
    """
    both = left if ordered else left.unionByName(right)
    counts = both.select(F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("c")).where("c > 1")
    take = F.size("_x") - F.ceil(F.col("n") * least - 1e-9).cast("int") + 1

    def prefix(df: DataFrame, name: str) -> DataFrame:
        shared = df.select("id", "n", F.explode("shingles").alias("s")).join(counts, "s").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("c", "s"))).alias("_x"))
        return shared.where(take > 0).select(F.col("id").alias(name), F.col("n").alias(f"n{name}"), F.explode(F.slice("_x", F.lit(1), take)["s"]).alias("s"))

    candidates = prefix(left, "a").join(prefix(right, "b"), "s").where(F.least("na", "nb") >= F.greatest("na", "nb") * least - 1e-9)
    candidates = (candidates.where("a < b") if ordered else candidates).select("a", "b").distinct()
    whole = candidates.join(left.select(F.col("id").alias("a"), F.col("shingles").alias("_a")), "a").join(right.select(F.col("id").alias("b"), F.col("shingles").alias("_b")), "b")
    shared = F.size(F.array_intersect("_a", "_b"))
    scored = whole.select("a", "b", (shared / (F.size("_a") + F.size("_b") - shared)).alias("similarity"))
    return scored.where(F.col("similarity") >= least - 1e-12)


def greedy_drops(pairs: DataFrame) -> DataFrame:
    """(id) of rows that resemble an accepted earlier row; pairs: (a, b), a before b.

    The first set of accepted rows is found in rounds: a row whose earlier neighbours are
    all decided is decided too. Rounds are as many as the longest chain of pairs; only
    undecided pairs are carried on.
    """
    left = stage(pairs.select("a", "b").distinct(), "pairs")
    dropped = None
    while left.limit(1).count():
        undecided = left.select("b").distinct()
        free = left.select("a").distinct().join(undecided, F.col("a") == F.col("b"), "left_anti")  # no earlier undecided neighbour: accepted
        out = stage(left.join(free, "a", "left_semi").select(F.col("b").alias("id")).distinct(), "dropped")
        dropped = out if dropped is None else dropped.unionAll(out)
        gone = out.withColumnRenamed("id", "g")
        rest = left.join(gone, F.col("b") == F.col("g"), "left_anti").join(gone, F.col("a") == F.col("g"), "left_anti")
        step = stage(rest.join(free.withColumnRenamed("a", "f"), F.col("a") == F.col("f"), "left_anti"), "pairs")
        release(left)
        left = step
    return dropped if dropped is not None else pairs.select(F.col("b").alias("id")).limit(0)


#: Fixed values of the permutations (a x + b) mod 2^31 - 1 of 31-bit hashes: a and b follow from the number of the permutation.
PRIME = 2**31 - 1


def permutation(k: int) -> tuple[int, int]:
    return 1 + (k * 1_103_515_245 + 12_345) % (PRIME - 1), (k * 69_069 + 1) % PRIME


def minhash(shingles: DataFrame, ident: str, count: int = 128) -> DataFrame:
    """(ident, signature): the smallest value of the shingles under each of ``count`` permutations; rows without shingles are left out.

    shingles: (ident, shingles: array<string>). A shingle's hash is the first 31 bits of its MD5.
    """
    hashes = F.transform("shingles", lambda s: F.shiftright(F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint"), 1))
    # written once, or each permutation would hash all shingles again
    hashed = stage(shingles.where(F.size("shingles") > 0).select(ident, hashes.alias("_h")), "hashes")
    least = lambda k: F.array_min(F.transform("_h", lambda x: (x * F.lit(permutation(k)[0]) + F.lit(permutation(k)[1])) % F.lit(PRIME)))
    return hashed.select(ident, F.array(*(least(k) for k in range(count))).alias("signature"))


def lsh_pairs(signatures: DataFrame, ident: str, bands: int) -> DataFrame:
    """(a, b, estimate), a < b, of rows whose signatures agree in one of ``bands`` equal bands; estimate is the share of equal places.

    Equal signatures are one until the end, so that copies meet once and not in every band.
    """
    signatures = stage(signatures, "signed")
    classes = stage(signatures.groupBy("signature").agg(F.min(ident).alias("rep")), "signatures")
    size = F.expr(f"int(size(signature) div {bands})")
    banded = classes.select("rep", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.xxhash64(F.slice("signature", k * size + 1, size)))).alias("band", "key"))
    one, two = (banded.withColumnRenamed("rep", x) for x in "ab")
    near = one.join(two, ["band", "key"]).where("a < b").select("a", "b").distinct()
    sides = [classes.select(F.col("rep").alias(x), F.col("signature").alias(f"_{x}")) for x in "ab"]
    scored = near.join(sides[0], "a").join(sides[1], "b").select("a", "b", (F.size(F.filter(F.zip_with("_a", "_b", lambda x, y: x == y), lambda e: e)) / F.size("_a")).alias("estimate"))
    held = signatures.join(classes, "signature").select(F.col(ident).alias("id"), "rep")
    across = scored.join(held.select(F.col("id").alias("x"), F.col("rep").alias("a")), "a").join(held.select(F.col("id").alias("y"), F.col("rep").alias("b")), "b").select("x", "y", "estimate")
    copies = held.select(F.col("id").alias("x"), "rep").join(held.select(F.col("id").alias("y"), "rep"), "rep").where("x < y").select("x", "y", F.lit(1.0).alias("estimate"))
    return across.unionByName(copies).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "estimate")
