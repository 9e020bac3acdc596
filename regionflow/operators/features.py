"""Features of regions from their nested sites and reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.exprs import array_mean, array_std, half_even, kernel_density, kernel_grid
from .regions import K
from .stats import approx_asm, cpg_group_counts, directional_fm_sequence

ARRAYS = ("cpg_cov", "cpg_fm", "read_fm", "cpg_dist")


def array_fields(regions: DataFrame) -> DataFrame:
    """regions with cpg_cov, cpg_fm, read_fm (arrays) and nb_reads."""
    return regions.withColumns(
        {
            "cpg_cov": F.transform("cpgs", lambda x: x["cov"].cast("double")),
            "cpg_fm": F.transform("cpgs", lambda x: x["fm"]),
            "read_fm": F.transform("reads", lambda x: x["fm"]),
            "nb_reads": F.size("reads"),
        }
    )


def cpg_distances(df: DataFrame) -> DataFrame:
    """df with cpg_dist: differences of successive positions."""
    pos = F.transform("cpgs", lambda x: x["pos"])
    return df.withColumn("cpg_dist", F.zip_with(F.slice(pos, 2, F.greatest(F.size(pos) - 1, F.lit(0))), F.slice(pos, 1, F.greatest(F.size(pos) - 1, F.lit(0))), lambda b, a: (b - a).cast("double")))


def array_mean_std(df: DataFrame, arr: str) -> DataFrame:
    return df.withColumn(f"mean_{arr}", half_even(array_mean(F.col(arr)), 4)).withColumn(f"std_{arr}", half_even(array_std(F.col(arr)), 4))


def with_density(df: DataFrame, arr: str, grid: list[float], h: float) -> DataFrame:
    return df.withColumn(f"{arr}_kd", kernel_density(F.col(arr), grid, h))


def expand_array_columns(df: DataFrame, arr: str, n: int) -> DataFrame:
    """df with arr_0 .. arr_{n-1} in place of arr; null beyond its length."""
    return df.withColumns({f"{arr}_{i}": F.get(arr, F.lit(i)) for i in range(n)}).drop(arr)


def one_hot_fixed_domain(df: DataFrame, col: str, domain: list) -> DataFrame:
    return df.withColumns({f"{col}_{v}": F.coalesce(F.col(col) == F.lit(v), F.lit(False)).cast("int") for v in domain})


def cast_nullable_ints(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("int") for c in cols})


def explode_reads(regions: DataFrame) -> DataFrame:
    """One row a read: keys, nb_cpg_found, read_id, fm, cpg_pos, cpg_meth."""
    return regions.select(*K, "nb_cpg_found", F.explode("reads").alias("r")).select(*K, "nb_cpg_found", F.col("r.id").alias("read_id"), "r.fm", "r.cpg_pos", "r.cpg_meth")


def read_extremes_topk(reads: DataFrame, min_frac: float, n: int, min_reads: int = 20) -> DataFrame:
    """The n most and n least methylated of a region's full reads; regions with fewer than min_reads full reads go.

    A read is full if it covers min_frac of the region's sites, rounded up.
    Ranks go by share, then id.
    """
    full = reads.where(F.size("cpg_pos") >= F.ceil(F.lit(min_frac) * F.col("nb_cpg_found")))
    w = W.partitionBy(*K)
    ranked = full.withColumn("rank_desc", F.row_number().over(w.orderBy(F.col("fm").desc(), "read_id"))).withColumn("n_ok", F.count("*").over(w))
    return ranked.where((F.col("n_ok") >= min_reads) & ((F.col("rank_desc") <= n) | (F.col("rank_desc") > F.col("n_ok") - n)))


def read_split_halves(reads: DataFrame) -> DataFrame:
    """reads (with rank_desc) with grp: the upper half, rounded up, is high."""
    n = F.count("*").over(W.partitionBy(*K))
    place = F.row_number().over(W.partitionBy(*K).orderBy("rank_desc"))
    return reads.withColumn("grp", F.when(place <= F.ceil(n / 2), "high").otherwise("low"))


def cpg_read_matrix(reads: DataFrame, n_cpg: int = 10, n_reads: int = 20) -> DataFrame:
    """Per region: matrix of sites by reads; 0 missing, 1 unmethylated, 2 methylated.

    Sites and reads beyond the size are dropped front first and then behind, in
    turn; missing ones are added in the same order.  Reads keep rank order.
    """
    one = F.struct("rank_desc", F.zip_with("cpg_pos", "cpg_meth", lambda p, m: F.struct(p.alias("p"), (m + 1).alias("m"))).alias("m"))
    dedup = reads.withColumn("z", F.arrays_zip("cpg_pos", "cpg_meth"))
    # a read that hits a site twice counts as methylated there if any hit was
    dedup = dedup.withColumn("cpg_meth", F.transform(F.array_distinct("cpg_pos"), lambda p: F.array_max(F.transform(F.filter("z", lambda s: s["cpg_pos"] == p), lambda s: s["cpg_meth"]))))
    dedup = dedup.withColumn("cpg_pos", F.array_distinct("cpg_pos"))
    rows = dedup.groupBy(*K).agg(F.array_sort(F.collect_list(one)).alias("r"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("cpg_pos")))).alias("sites"))

    def fitted(arr, want, empty):
        gap = F.size(arr) - F.lit(want)
        front = F.expr("0") + F.floor((F.abs(gap) + 1) / 2).cast("int")
        cut = F.slice(arr, front + 1, F.lit(want))
        padded = F.concat(F.array_repeat(empty, F.greatest(front, F.lit(0))), arr, F.array_repeat(empty, F.greatest(-gap - front, F.lit(0))))
        return F.when(gap >= 0, cut).otherwise(padded)

    rows = rows.withColumn("sites", fitted(F.col("sites"), n_cpg, F.lit(-1))).withColumn("r", F.transform("r", lambda x: F.map_from_entries(x["m"])))
    rows = rows.withColumn("r", fitted(F.col("r"), n_reads, F.map_from_arrays(F.array(F.lit(-2)), F.array(F.lit(0)))))
    cell = lambda p: F.transform("r", lambda m: F.coalesce(F.try_element_at(m, p), F.lit(0)))
    return rows.select(*K, F.transform("sites", cell).alias("cpgs_w_padding"))


def build_features(regions_w_labels: DataFrame, cfg: Config = DEFAULT, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """The feature table of nested regions, with labels if they're there.

    Three branches read the chosen reads; ``keep`` may write these to a table
    between the stages.  By default all is one lazy plan.
    """
    ratio, cov = kernel_grid(*cfg.ratio_grid), kernel_grid(*cfg.cov_grid)
    df = cpg_distances(array_fields(regions_w_labels))
    for a in ARRAYS:
        df = array_mean_std(df, a)
        grid, h = (ratio, cfg.ratio_bandwidth) if a.endswith("_fm") else (cov, cfg.cov_bandwidth)
        df = expand_array_columns(with_density(df, a, grid, h), f"{a}_kd", len(grid))
    halves = keep(read_split_halves(read_extremes_topk(explode_reads(regions_w_labels), cfg.read_share, cfg.extreme_reads, cfg.min_reads)))
    df = df.drop("cpgs", "reads")
    df = df.join(approx_asm(halves, cfg).drop("total_sig_cpgs", "consecutive_sig_cpgs"), K, "left")
    df = df.join(directional_fm_sequence(cpg_group_counts(halves)), K, "left")
    df = df.join(cpg_read_matrix(halves, cfg.matrix_cpg, 2 * cfg.extreme_reads), K, "left")
    return one_hot_fixed_domain(df, "chr", list(range(1, 23)))


def pad_sequences(df: DataFrame, arr: str, length: int, value: float = 0.0) -> DataFrame:
    """df with padded: arr cut or padded behind to one length."""
    tail = F.array_repeat(F.lit(value), F.greatest(F.lit(length) - F.size(arr), F.lit(0)))
    return df.withColumn("padded", F.slice(F.concat(F.col(arr), tail), 1, length))


def max_seq_len(df: DataFrame, arr: str, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.max(F.size(arr)).alias("max_len"))
