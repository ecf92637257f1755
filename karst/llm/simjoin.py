"""Exact set-similarity join of texts by their word triples.

1. Texts with the same set of triples become one class; only classes are compared.
2. Two classes of similarity t share a triple among the rarest of each (prefix filter over
   the counts of all classes). Triples that no other class holds are never shuffled again.
3. Inside the block of such a triple a binary trie self-join over parity sketches (trie.py)
   finds the pairs within the Hamming budget that similarity t allows. The sketch never
   differs in more bits than the sets in triples, so no pair is lost.
4. Candidates are verified on the triples themselves.

A block of more than BLOCK classes is cut into a grid of cells, so that no task holds
more than two strips of it; every pair still meets in exactly one cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from karst.llm import trie
from karst.llm.textwords import triples
from karst.sources.staging import release, stage

#: Classes of a block that are compared in one cell.
BLOCK = 1024
FEATURES = "id bigint, flags int, k bigint, n int, s0 bigint, s1 bigint, s2 bigint, s3 bigint, grams array<bigint>"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    for batch in batches:
        ids, flags, keys, rows, sets = [], [], [], [], []
        for i, flag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            found = triples(text)
            if len(found):
                ids.append(i)
                flags.append(flag)
                sets.append(found.view(np.int64))
                keys.append(xxhash.xxh3_64_intdigest(found.tobytes()))
                rows.append(trie.sketch(found))
        sizes = np.array([len(s) for s in sets], dtype=np.int32)
        bits = np.array(rows, dtype=np.uint64).reshape(-1, trie.WORDS).view(np.int64)
        values = np.concatenate(sets) if sets else np.empty(0, np.int64)
        grams = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(values))
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(flags, pa.int32()), pa.array(np.array(keys, dtype=np.uint64).view(np.int64)), pa.array(sizes), *(pa.array(np.ascontiguousarray(bits[:, w])) for w in range(trie.WORDS)), grams],
            ["id", "flags", "k", "n", "s0", "s1", "s2", "s3", "grams"],
        )


def _candidates(num: int, den: int, sides: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None

        def pairs(table: pa.Table) -> pa.RecordBatch:
            col = {c: table.column(c).to_numpy() for c in table.column_names}
            block = np.cumsum(np.r_[0, (np.diff(col["gram"]) != 0) | (np.diff(col["cell"]) != 0)])
            rows = np.stack([col[f"s{w}"] for w in range(trie.WORDS)], axis=1).view(np.uint64)
            i, j = trie.self_join(block, rows, col["n"], (den - num, den + num))
            a, b = col["k"][i], col["k"][j]
            ok = a != b
            ok &= (col["split"][i] != col["split"][j]) | (col["diagonal"][i])
            small, large = np.minimum(col["n"][i], col["n"][j]).astype(np.int64), np.maximum(col["n"][i], col["n"][j]).astype(np.int64)
            ok &= small * den >= large * num
            if sides:
                fi, fj = col["flags"][i], col["flags"][j]
                ok &= (((fi & 1) > 0) & ((fj & 2) > 0)) | (((fi & 2) > 0) & ((fj & 1) > 0))
            a, b = a[ok], b[ok]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            if kept is not None:
                table = pa.concat_tables([kept, table])
            if not len(table):
                continue
            gram, cell = table.column("gram").to_numpy(), table.column("cell").to_numpy()
            cut = np.flatnonzero((gram[1:] != gram[:-1]) | (cell[1:] != cell[:-1]))
            if not len(cut):
                kept = table
                continue
            end = int(cut[-1]) + 1  # the last block may go on in the next batch
            kept = table.slice(end)
            yield pairs(table.slice(0, end))
        if kept is not None and len(kept):
            yield pairs(kept)

    return run


def features(texts: DataFrame) -> DataFrame:
    """texts: id, flags, text. Rows without words are left out."""
    return texts.select("id", "flags", "text").mapInArrow(_features, FEATURES)


def similar(texts: DataFrame, num: int, den: int, sides: bool = False) -> tuple[DataFrame, DataFrame]:
    """Members (id, flags, k: class) and links (a, b: classes, a < b) of similarity num / den at least.

    ``flags`` of texts has bit 1 for one side and bit 2 for the other; with ``sides`` only
    links across the sides count.
    """
    feats = stage(features(texts), "features")
    members = stage(feats.select("id", "flags", "k").distinct(), "members")
    # rows of one class have the same triples, so any row stands for it
    one_row = ("n", "s0", "s1", "s2", "s3", "grams")
    reps = stage(feats.groupBy("k").agg(F.bit_or("flags").alias("flags"), F.any_value(F.struct(*one_row)).alias("r")).select("k", "flags", "r.*"), "classes")
    release(feats)

    each = reps.select("k", "flags", F.explode("grams").alias("gram"))
    least = F.expr(f"int((n * {num} + {den - 1}) div {den})")
    if sides:
        # only what stands on both sides can link; the larger side is shuffled once
        held = each.where("flags & 2 > 0").select("gram").distinct()
        one = stage(each.where("flags & 1 > 0").select("k", "gram").join(held, "gram", "left_semi"), "one")
        two = each.where("flags = 2").select("k", "gram").join(one.select("gram").distinct(), "gram", "left_semi")
        live = stage(one.unionByName(two), "live")
    else:
        live = each.select("k", "gram")
    counts = live.groupBy("gram").agg(F.count("*").alias("c"))
    counts = counts if sides else counts.where("c > 1")
    shared = live.join(counts, "gram").groupBy("k").agg(F.array_sort(F.collect_list(F.struct("c", "gram"))).alias("shared"))
    # grams that nobody else holds come first in the common order, so the prefix needs that many fewer of the others
    prefix = (
        shared.join(reps.drop("grams"), "k")
        .withColumn("take", F.size("shared") - least + 1)
        .where("take > 0")
        .select("k", "n", "flags", "s0", "s1", "s2", "s3", F.explode(F.slice("shared", 1, F.col("take"))).alias("p"))
    )
    strips = F.expr(f"int((p.c + {BLOCK - 1}) div {BLOCK})")
    split = F.expr("int(pmod(xxhash64(k), strips))")
    cells = F.expr("transform(sequence(0, strips - 1), j -> least(split, j) * strips + greatest(split, j))")
    blocks = (
        prefix.withColumn("strips", strips)
        .withColumn("split", split)
        .withColumn("cell", F.explode(cells))
        .select(F.col("p.gram").alias("gram"), "cell", "split", F.expr("cell div strips = cell % strips").alias("diagonal"), "k", "n", "flags", "s0", "s1", "s2", "s3")
        .repartition("gram", "cell")
        .sortWithinPartitions("gram", "cell")
    )
    found = blocks.mapInArrow(_candidates(num, den, sides), "a bigint, b bigint").distinct()
    links = (
        found.join(reps.select(F.col("k").alias("a"), F.col("grams").alias("ga")), "a")
        .join(reps.select(F.col("k").alias("b"), F.col("grams").alias("gb")), "b")
        .withColumn("both", F.size(F.array_intersect("ga", "gb")))
        .where(F.expr(f"both * {den} >= {num} * (size(ga) + size(gb) - both)"))
        .select("a", "b")
    )
    return members, links
