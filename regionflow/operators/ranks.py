"""The first rows of each group by a hash of their key, without sorting a group.

Hashes fall in ranges.  Counts of ranges (a few thousand numbers a group) say in
which range a group's n-th smallest hash lies; rows of the ranges before it are
taken as they are read, and only that range's rows are sorted, by hash and key.
Nothing but counts and the rows of one range is shuffled, whatever a group's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Hashes are numbers below 2 ** 32; their ranges, which are a power of four; ranges of a block, by which offsets are added up.
HASHES, RANGES = 1 << 32, 4096
BLOCK = 64


def key_hash(key: str, seed: int = 0) -> Column:
    """A hash that both engines can state: arithmetic on a whole number of any size."""
    return F.pmod(F.pmod(F.col(key), F.lit(1 << 31)) * F.lit(2654435761) + F.lit(seed), F.lit(HASHES))


def offsets(counts: DataFrame, by: str) -> DataFrame:
    """by, range, n of counts, with before: the rows of the group's smaller ranges."""
    blocks = counts.groupBy(by).agg(F.array(*[F.coalesce(F.sum(F.when(F.col("range") < b * BLOCK, F.col("n"))), F.lit(0)) for b in range(RANGES // BLOCK)]).alias("_blocks"))
    block = F.expr(f"range div {BLOCK}")
    inside = F.sum("n").over(W.partitionBy(by, block).orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    rows = counts.withColumn("_inside", F.coalesce(inside, F.lit(0)))
    joined = rows.join(blocks.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by")))
    return joined.select(by, "range", "n", (F.get("_blocks", block.cast("int")) + F.col("_inside")).alias("before"))


def in_first(df: DataFrame, by: str, key: str, limits: DataFrame, seed: int = 0, out: str = "_first") -> DataFrame:
    """df with out: whether a row is among its group's first rows by (key_hash, key); limits has by and n_first.

    Rows of one key and group are equal here: either counts.  Null keys come first.  A group that isn't in limits has no first rows.
    """
    ranged = df.withColumn("_hash", F.coalesce(key_hash(key, seed), F.lit(0))).withColumn("_range", F.expr(f"_hash div {HASHES // RANGES}"))
    counts = offsets(ranged.groupBy(by, F.col("_range").alias("range")).agg(F.count("*").alias("n")), by)
    want = limits.select(F.col(by).alias("_by"), "n_first")
    ends = counts.join(want, F.col(by).eqNullSafe(F.col("_by"))).groupBy("_by", "n_first").agg(
        # the range that the last of the first rows lies in, and how many of its rows are taken; none: past the last range
        F.coalesce(F.min(F.when(F.col("before") + F.col("n") >= F.col("n_first"), F.struct("range", (F.col("n_first") - F.col("before")).alias("rest")))), F.struct(F.lit(RANGES).cast("long").alias("range"), F.lit(0).cast("long").alias("rest"))).alias("_end")
    )
    met = ranged.join(ends.drop("n_first"), F.col(by).eqNullSafe(F.col("_by")), "left")
    here = F.col("_end.range")
    apart = met.where(F.col("_range") == here)
    rank = F.row_number().over(W.partitionBy(by, "_range").orderBy("_hash", key))
    sorted_ = apart.withColumn("_rank", rank).withColumn(out, F.col("_rank") <= F.col("_end.rest"))
    plain = met.where(here.isNull() | F.col("_range").isNull() | (F.col("_range") != here)).withColumn(out, F.coalesce(F.col("_range") < here, F.lit(False)))
    return plain.select(*df.columns, out).unionByName(sorted_.select(*df.columns, out))
