"""Connected components on edge tables.

Joins here and in the other modules are plain equality joins of a side with many rows for a key and a side with one. No
task gathers a hot key: Spark's adaptive execution splits the large partitions of the first side and gives each split the
few rows of the second. It does so where both sides are shuffled for the join itself. So the second side is a table from
``cut``, or its key is computed anew from the one it was aggregated by (``bitwise_not`` twice)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pentad.llm.common import cut, drop

#: Binary logarithm of a filter's bits: 64 of them are a row of what is broadcast, 262,144 rows at most.
FILTER = 24


def anew(df: DataFrame, key: str) -> DataFrame:
    """df, an aggregate by the column w = bitwise_not(key), with key instead of w."""
    return df.withColumn(key, F.bitwise_not("w")).drop("w")


def parted(df: DataFrame, key: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """df in two: all rows whose key (a long column) is among wanted's, with few others, and the rest. A filter of fixed
    size does it, so that df need not be shuffled; with n wanted keys, a share 1 - exp(-n / 2^FILTER) of the rest is in the
    first part, and a join must tell these apart. df has no columns named word and mask; null keys are in the rest."""
    at = F.shiftrightunsigned(F.xxhash64(key), 64 - FILTER)
    word, bit = F.shiftrightunsigned(at, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))
    bits = cut(wanted.select(word, bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("mask")))
    held = df.withColumn("word", word).join(F.broadcast(bits), "word", "left")
    met = F.coalesce(F.col("mask").bitwiseAND(bit) != 0, F.lit(False)) & F.col(key).isNotNull()
    return held.where(met).drop("word", "mask"), held.where(~met).drop("word", "mask")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step of the alternating star contraction on edges u > v: neighbours move to the least neighbour."""
    if large:
        way = F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
        edges = edges.select(way.alias("e")).select("e.u", "e.v")
    least = anew(edges.groupBy(F.bitwise_not("u").alias("w")).agg(F.min("v").alias("m")), "u")
    near = edges.join(least.withColumn("m", F.least("m", "u")), "u")
    if large:
        moved = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        way = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v"))))
        moved = near.select(way.alias("e")).select("e.u", "e.v")
    return moved.where("u > v").distinct()


def components(edges: DataFrame, a: Column, b: Column) -> DataFrame:
    """node, root: the least node of each connected component, for every node that has an edge to another. Nodes are long.

    Alternating large-star and small-star steps (Kiveris et al., 2014) until nothing moves: every round is a constant
    number of shuffles of the edges that are left, and the number of rounds grows with the logarithm of the input."""
    now, before = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col("u") > F.col("v")).distinct()), None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        wide = cut(_star(now, True))
        drop(now)
        now, before = cut(_star(wide, False)), state
        drop(wide)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
