"""Tiles of a genome, and joins of positions and intervals with them.

Tiles are regular, so a position's tile is arithmetic: range joins become joins
on (chr, first position of the tile).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def chr_offsets(lengths: DataFrame) -> DataFrame:
    """chr, chr_length, absolute_nucleotide_pos: the positions on all chromosomes before this one."""
    before = F.sum("chr_length").over(W.orderBy("chr").rowsBetween(W.unboundedPreceding, -1))
    return lengths.select("chr", "chr_length", F.coalesce(before, F.lit(0)).cast("long").alias("absolute_nucleotide_pos"))


def autosome_filter(df: DataFrame, col: str = "chr") -> DataFrame:
    """Rows whose chromosome is a number, as int."""
    return df.where(F.col(col).rlike(r"^\d+$")).withColumn(col, F.col(col).try_cast("int"))


def clustering_index(df: DataFrame, pos: str, block: int) -> DataFrame:
    """df, which has absolute_nucleotide_pos, with the genome-wide block number of a position."""
    return df.withColumn("clustering_index", F.floor((F.col("absolute_nucleotide_pos") + F.col(pos)) / F.lit(block)).cast("int"))


def join_chr_offset(df: DataFrame, offsets: DataFrame) -> DataFrame:
    """df with its chromosome's offset; Spark broadcasts the offsets if they're few."""
    return df.join(offsets.select("chr", "absolute_nucleotide_pos"), "chr")


def tile_genome(offsets: DataFrame, length: int, block: int) -> DataFrame:
    """Tiles of a fixed width, both ends inclusive from 1; the last of a chromosome is shorter."""
    tiles = offsets.select("chr", "chr_length", "absolute_nucleotide_pos", F.explode(F.sequence(F.lit(1).cast("long"), F.col("chr_length"), F.lit(length).cast("long"))).alias("region_inf"))
    tiles = tiles.withColumn("region_sup", F.least(F.col("region_inf") + (length - 1), F.col("chr_length")))
    tiles = tiles.withColumn("region_center", F.expr("(region_inf + region_sup) div 2"))
    return clustering_index(tiles, "region_center", block).select("chr", "region_inf", "region_sup", "region_center", "clustering_index")


def tile_start(pos: Column, length: int) -> Column:
    return F.floor((pos - 1) / F.lit(length)).cast("long") * length + 1


def range_join_count_cpg(tiles: DataFrame, cpg_pos: DataFrame, min_cpg: int, length: int) -> DataFrame:
    """tiles with region_nb_cpg, the sites inside; tiles with fewer than min_cpg go."""
    count = cpg_pos.select("chr", tile_start(F.col("pos"), length).alias("region_inf"), F.col("pos").alias("_pos"))
    count = count.groupBy("chr", "region_inf").agg(F.count("*").alias("region_nb_cpg")).where(F.col("region_nb_cpg") >= min_cpg)
    return tiles.join(count, ["chr", "region_inf"])


def point_in_region_join(calls: DataFrame, regions: DataFrame, length: int, half_open: bool = False, partitions: int | None = None) -> DataFrame:
    """calls with the region that holds their position; ``partitions`` deals the calls out by the join's keys, so that a task's share needn't grow with them."""
    keyed = calls.withColumn("region_inf", tile_start(F.col("pos"), length))
    kept = regions.select("chr", "region_inf", "region_sup", "region_nb_cpg", "clustering_index")
    if partitions:  # both sides, or Spark takes the number of the one that is dealt out already
        keyed, kept = (x.repartition(partitions, "chr", "region_inf") for x in (keyed, kept))
    inside = F.col("pos") < F.col("region_sup") if half_open else F.col("pos") <= F.col("region_sup")
    return keyed.drop("clustering_index", "region_sup", "region_nb_cpg").join(kept, ["chr", "region_inf"]).where(inside)


def _binned(intervals: DataFrame, length: int) -> DataFrame:
    """Intervals, once for each tile that they touch: the range join's equality key."""
    first, last = tile_start(F.col("chr_start"), length), tile_start(F.col("chr_end"), length)
    return intervals.where("chr_end >= chr_start").select("chr", F.explode(F.sequence(first, last, F.lit(length).cast("long"))).alias("region_inf"), "chr_start", "chr_end")


def _touching(regions: DataFrame, intervals: DataFrame, length: int, endpoint_only: bool, how: str) -> DataFrame:
    r, b = regions.alias("r"), _binned(intervals, length).alias("b")
    key = (F.col("r.chr") == F.col("b.chr")) & (F.col("r.region_inf") == F.col("b.region_inf"))
    if endpoint_only:
        touch = F.col("b.chr_start").between(F.col("r.region_inf"), F.col("r.region_sup")) | F.col("b.chr_end").between(F.col("r.region_inf"), F.col("r.region_sup"))
    else:
        touch = (F.col("b.chr_start") <= F.col("r.region_sup")) & (F.col("b.chr_end") >= F.col("r.region_inf"))
    return r.join(b, key & touch, how).select("r.*")


def interval_overlap_join(regions: DataFrame, intervals: DataFrame, length: int, endpoint_only: bool = False) -> DataFrame:
    """Regions that an interval overlaps (endpoint_only: that hold one of its ends), each once."""
    return _touching(regions, intervals, length, endpoint_only, "left_semi")


def anti_join_blacklist(regions: DataFrame, intervals: DataFrame, length: int, endpoint_only: bool = False) -> DataFrame:
    """Regions that no interval overlaps."""
    return _touching(regions, intervals, length, endpoint_only, "left_anti")


def locus_right_range_join(regions: DataFrame, loci: DataFrame, length: int) -> DataFrame:
    """For each locus: its region, the highest score and the highest label there (null outside all regions)."""
    keyed = loci.withColumn("_inf", tile_start(F.col("locus_pos"), length))
    r = regions.select(F.col("chr").alias("_chr"), F.col("region_inf").alias("r_inf"), F.col("region_sup").alias("r_sup"), "score", "label")
    on = (F.col("chr") == F.col("_chr")) & (F.col("_inf") == F.col("r_inf")) & (F.col("locus_pos") <= F.col("r_sup"))
    return keyed.join(r, on, "left").groupBy("locus").agg(F.min("r_inf").alias("region_inf"), F.min("r_sup").alias("region_sup"), F.max("score").alias("max_score"), F.max("label").alias("max_label"))


def semi_join_good_cpg(calls: DataFrame, good: DataFrame) -> DataFrame:
    return calls.join(good, ["sample", "chr", "pos"], "left_semi")
