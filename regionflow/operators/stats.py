"""Rank-sum, exact and multiple tests, and the decision they lead to."""

from __future__ import annotations

import functools
import sys
from collections.abc import Callable

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.exprs import TAIL_BOTTOM, TAIL_TOP, fisher_p, half_away, half_even, let, longest_run, norm_sf
from .regions import LABELS, K, SNP

# Functions of this module travel to the executors with the job, so that these need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: An exact rank-sum distribution is used up to this size of the smaller group, if there are no ties.
EXACT = 8


def ways_of(a: int, b: int, m: int):
    """Among all orders of a and b values (a <= b), the numbers of those with a rank-sum statistic of 0 .. m.

    These are the coefficients of the product over i = 1 .. a of (1 - q^(b + i)) / (1 - q^i), one factor after another.
    """
    import numpy as np

    c = np.zeros(m + 1)
    c[0] = 1.0
    for i in range(1, a + 1):
        less = c.copy()
        less[b + i :] -= c[: max(m + 1 - b - i, 0)]
        # each one with those of i, 2 i, ... before it
        padded = np.zeros(-(-(m + 1) // i) * i)
        padded[: m + 1] = less
        c = padded.reshape(-1, i).cumsum(axis=0).ravel()[: m + 1]
    return c


def exact_tails(n1, n2, u):
    """Two-sided exact p of rank-sum statistics of groups without ties; the numbers of orders are computed once for each two sizes."""
    import numpy as np

    a, b, m = np.minimum(n1, n2), np.maximum(n1, n2), np.minimum(u, n1 * n2 - u).astype(np.int64)
    out = np.empty(len(a))
    order = np.lexsort((m, b, a))
    ends = np.flatnonzero((np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)) + 1
    for at in np.split(order, ends) if len(order) else []:
        small, large = int(a[at[0]]), int(b[at[0]])
        orders = 1.0
        for i in range(1, small + 1):
            orders = orders * (large + i) / i
        out[at] = np.minimum(1.0, ways_of(small, large, int(m[at[-1]])).cumsum()[m[at]] * 2 / orders)
    return out


def exact_p(n1: Column, n2: Column, u: Column) -> Column:
    """Two-sided p of the rank-sum statistic u of groups without ties, from the number of orders that have each statistic."""

    @F.arrow_udf("double")
    def p(n1: pa.Array, n2: pa.Array, u: pa.Array) -> pa.Array:
        return pa.array(exact_tails(*(x.to_numpy(zero_copy_only=False) for x in (n1, n2, u))))

    return p(n1, n2, u)


def rank_sums(group, value, first, n: int):
    """n1, n2, u (of the first side) and ties (sum of t^3 - t) of groups 0 .. n - 1, from their values and each value's side (1: the first)."""
    import numpy as np

    n1, n2 = (np.bincount(group, side, n) for side in (first, 1 - first))
    if not len(group):
        return n1, n2, np.zeros(n), np.zeros(n)
    order = np.lexsort((value, group))
    g, v = group[order], value[order]
    same = (g[1:] == g[:-1]) & ((v[1:] == v[:-1]) | (np.isnan(v[1:]) & np.isnan(v[:-1])))
    starts = np.flatnonzero(np.r_[True, ~same])
    t, run = np.diff(np.r_[starts, len(g)]), g[starts]
    a = np.add.reduceat(first[order], starts)
    b = t - a
    below = np.cumsum(b) - b - (np.cumsum(n2) - n2)[run]
    t = t.astype(float)
    return n1, n2, np.bincount(run, a * (below + b / 2), n), np.bincount(run, t * t * t - t, n)


def normal_tails(n1, n2, u, ties):
    """Two-sided p of groups that aren't empty by the normal approximation, as ``normal_p``."""
    import numpy as np

    n = n1 + n2
    spread = n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))
    apart = np.abs(u - n1 * n2 / 2) - 0.5
    z = np.maximum(apart / np.sqrt(np.maximum(spread, 1e-12)), 0.0)
    horner = lambda cs: functools.reduce(lambda s, c: s * z + c, cs[1:], cs[0])
    near = np.exp(-z * z / 2) * horner(TAIL_TOP) / horner(TAIL_BOTTOM)
    far = np.exp(-z * z / 2) / functools.reduce(lambda s, k: z + k / s, (4.0, 3.0, 2.0, 1.0), z + 0.65) / 2.506628274631
    tail = np.where(z < 7.07106781186547, near, np.where(z < 37, far, 0.0))
    return np.where(spread <= 1e-12, 1.0, np.minimum(1.0, tail * 2))


def rank_test(reads: pa.Array) -> pa.Array:
    """effect, p of lists of structs {ref, alt}: mean(alt) - mean(ref) and the two-sided rank-sum p, rounded; null if a side is empty.

    All lists of a batch are sorted and ranked at once.
    """
    import numpy as np
    import pyarrow.compute as pc

    n = len(reads)
    of = np.repeat(np.arange(n), pc.list_value_length(reads).fill_null(0).to_numpy(zero_copy_only=False))
    inner, sides = reads.flatten(), []
    for name in ("ref", "alt"):
        x = pc.struct_field(inner, name)
        sides.append((of[x.is_valid().to_numpy(zero_copy_only=False)], x.drop_null().to_numpy(zero_copy_only=False).astype(float)))
    group, value = (np.concatenate(x) for x in zip(*sides))
    first = np.repeat([1, 0], [len(g) for g, _ in sides])
    n1, n2, u, ties = rank_sums(group, value, first, n)
    both = (n1 > 0) & (n2 > 0)
    rounded = lambda x, digits: np.floor(np.abs(x) * 10.0**digits + 0.5) / 10.0**digits * np.sign(x)
    p, effect = np.zeros(n), np.zeros(n)
    # sums in the lists' order
    ref, alt = (np.bincount(g, v, n) for g, v in sides)
    effect[both] = rounded(rounded(alt[both] / n2[both] - ref[both] / n1[both], 9), 5)
    small = both & (ties == 0) & (np.minimum(n1, n2) <= EXACT)
    p[small] = exact_tails(n1[small], n2[small], u[small])
    large = both & ~small
    p[large] = normal_tails(n1[large], n2[large], u[large], ties[large])
    return pa.StructArray.from_arrays([pa.array(x, pa.float64(), mask=~both) for x in (effect, rounded(p, 5))], ["effect", "p"])


def normal_p(n1: Column, n2: Column, u: Column, ties: Column) -> Column:
    """Two-sided p by the normal approximation with tie and continuity correction; null for an empty group."""
    held = F.struct(n1.cast("double").alias("a"), n2.cast("double").alias("b"), u.cast("double").alias("u"), ties.cast("double").alias("t"))

    def p(s: Column) -> Column:
        n = s["a"] + s["b"]
        spread = s["a"] * s["b"] / 12 * (n + 1 - F.coalesce(F.try_divide(s["t"], n * (n - 1)), F.lit(2.0)))
        apart = F.abs(s["u"] - s["a"] * s["b"] / 2) - 0.5
        tested = let(spread, lambda v: F.when(v <= 1e-12, F.lit(1.0)).otherwise(F.least(F.lit(1.0), norm_sf(F.greatest(apart / F.sqrt(v), F.lit(0.0))) * 2)))
        return F.when((s["a"] > 0) & (s["b"] > 0), tested)

    return let(held, p)


def mann_whitney(df: DataFrame, arr: str = "reads_w_snp") -> DataFrame:
    """Per region and SNP: two-sided rank-sum p of the two alleles' reads, and mean(alt) - mean(ref); null if a side is empty.

    Groups without ties, of which the smaller has up to eight values, get the
    exact distribution whatever the size of the other.
    """
    return tested(df.select(*SNP, arr), arr).select(*SNP, "read_asm_effect", "wilcoxon_pvalue")


def tested(df: DataFrame, arr: str) -> DataFrame:
    """df with read_asm_effect and wilcoxon_pvalue, by an Arrow pass over arr alone."""
    test = F.arrow_udf(rank_test, "effect double, p double")(F.col(arr))
    rows = df.withColumn("_test", test)
    return rows.withColumn("read_asm_effect", F.col("_test.effect")).withColumn("wilcoxon_pvalue", F.col("_test.p")).drop("_test")


def bh_adjust(df: DataFrame, p: str, by: str = "sample", out: str = "corrected_wilcoxon_pvalue") -> DataFrame:
    """df with Benjamini-Hochberg values within ``by``.

    p has few distinct values (5 digits), so ranks come from counts of distinct
    values, never from one sorted partition of all rows.
    """
    counts = df.where(F.col(p).isNotNull()).groupBy(by, p).agg(F.count("*").alias("n"))
    up, down = W.partitionBy(by).orderBy(p), W.partitionBy(by).orderBy(F.col(p).desc())
    rank = F.sum("n").over(up.rowsBetween(W.unboundedPreceding, 0))
    total = F.sum("n").over(W.partitionBy(by))
    ranked = counts.withColumn("raw", total * F.col(p) / rank)
    adjusted = ranked.select(by, F.col(p).alias("_p"), half_away(F.least(F.lit(1.0), F.min("raw").over(down.rowsBetween(W.unboundedPreceding, 0))), 5).alias(out))
    return df.join(adjusted.withColumnRenamed(by, "_by"), (F.col(by) == F.col("_by")) & (F.col(p) == F.col("_p")), "left").drop("_by", "_p")


def significant(x: Column, effect: Column, max_p: float) -> Column:
    """A site of an array is significant and points as the reads do; an effect of zero counts as negative."""
    same = F.when(effect > 0, x["effect"] > 0).otherwise(x["effect"] < 0)
    return F.coalesce((x["fisher_pvalue"] < max_p) & same, F.lit(False))


def sig_cpg_count(df: DataFrame, arr: str, effect: str, max_p: float) -> DataFrame:
    return df.withColumn("total_sig_cpgs", F.size(F.filter(arr, lambda x: significant(x, F.col(effect), max_p))))


def max_consecutive_run(df: DataFrame, arr: str, effect: str, max_p: float) -> DataFrame:
    return df.withColumn("consecutive_sig_cpgs", longest_run(F.array_sort(F.col(arr)), lambda x: significant(x, F.col(effect), max_p)))


def asm_decision(df: DataFrame, p_col: str, cfg: Config = DEFAULT, out: str = "asm", effect: str = "read_asm_effect") -> DataFrame:
    """1 if p, effect, run and count all pass, else 0; null p never passes."""
    passed = (F.col(p_col) <= cfg.max_p) & (F.abs(F.col(effect)) >= cfg.min_effect) & (F.col("consecutive_sig_cpgs") >= cfg.min_consecutive) & (F.col("total_sig_cpgs") >= cfg.min_sig_cpg)
    return df.withColumn(out, F.coalesce(passed, F.lit(False)).cast("int"))


def evaluate_asm(regions_and_snps: DataFrame, cfg: Config = DEFAULT, keep: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Tests, correction within samples and both decisions for every region and SNP.

    The correction reads the tests twice, for counts of p and for its rows; ``keep`` may write them to a table
    before it, without their arrays.  By default all is one lazy plan.
    """
    rows = tested(regions_and_snps.select(*SNP, "cpg_w_snp", "reads_w_snp"), "reads_w_snp").drop("reads_w_snp")
    rows = max_consecutive_run(sig_cpg_count(rows, "cpg_w_snp", "read_asm_effect", cfg.max_p), "cpg_w_snp", "read_asm_effect", cfg.max_p)
    rows = bh_adjust(keep(asm_decision(rows, "wilcoxon_pvalue", cfg, "asm_not_corrected").drop("cpg_w_snp")), "wilcoxon_pvalue")
    return asm_decision(rows, "corrected_wilcoxon_pvalue", cfg).select(*SNP, *LABELS)


def fisher_exact(df: DataFrame, a: str, b: str, c: str, d: str) -> DataFrame:
    """df with fisher_pvalue of [[a, b], [c, d]] and effect, the difference of the shares a/(a+b) - c/(c+d)."""
    effect = F.try_divide(F.col(a), F.col(a) + F.col(b)) - F.try_divide(F.col(c), F.col(c) + F.col(d))
    return df.withColumn("fisher_pvalue", fisher_p(F.col(a), F.col(b), F.col(c), F.col(d))).withColumn("effect", half_even(effect, 3))


def cpg_group_counts(reads: DataFrame) -> DataFrame:
    """Per region and site: methylated and covered reads in the high and the low group.

    reads: region keys, grp, cpg_pos, cpg_meth.
    """
    site = F.explode(F.arrays_zip("cpg_pos", "cpg_meth")).alias("s")
    rows = reads.select(*K, "grp", site).select(*K, "grp", F.col("s.cpg_pos").alias("pos"), F.col("s.cpg_meth").alias("m"))
    high, low = F.col("grp") == "high", F.col("grp") == "low"
    return rows.groupBy(*K, "pos").agg(F.sum(F.when(high, F.col("m")).otherwise(0)).alias("high_meth"), F.count_if(high).alias("high_cov"), F.sum(F.when(low, F.col("m")).otherwise(0)).alias("low_meth"), F.count_if(low).alias("low_cov"))


def directional_fm_sequence(counts: DataFrame) -> DataFrame:
    """Per region, sites in order: share of the high group minus that of the low group, 0 if either is uncovered."""
    x = F.coalesce(half_even(F.try_divide("high_meth", "high_cov") - F.try_divide("low_meth", "low_cov"), 4), F.lit(0.0))
    rows = counts.groupBy(*K).agg(F.array_sort(F.collect_list(F.struct(F.col("pos"), x.alias("x")))).alias("s"))
    return rows.select(*K, F.col("s.x").alias("cpg_directional_fm"))


def approx_asm(reads: DataFrame, cfg: Config = DEFAULT) -> DataFrame:
    """The decision from the two halves of a region's reads, without genotypes.

    Pooled 0/1 calls have four counts, which give the rank-sum test in closed form.
    A site's p is rounded to nine digits before it is compared, so that a p of just
    max_p (2 of 4 against 0 of 12) doesn't hang on the order of a sum.
    """
    counts = cpg_group_counts(reads)
    sites = fisher_exact(counts.withColumns({"a": F.col("high_meth"), "b": F.col("high_cov") - F.col("high_meth"), "c": F.col("low_meth"), "d": F.col("low_cov") - F.col("low_meth")}), "a", "b", "c", "d")
    sites = sites.withColumn("fisher_pvalue", half_away(F.col("fisher_pvalue"), 9))
    one = F.array_sort(F.collect_list(F.struct("pos", F.coalesce("effect", F.lit(0.0)).alias("effect"), "fisher_pvalue")))
    rows = sites.groupBy(*K).agg(one.alias("cpgs"), *[F.sum(c).alias(c) for c in "abcd"])
    n1, n2, zeros, ones = F.col("a") + F.col("b"), F.col("c") + F.col("d"), F.col("b") + F.col("d"), F.col("a") + F.col("c")
    u = F.col("a") * F.col("d") + F.col("a") * F.col("c") / 2 + F.col("b") * F.col("d") / 2
    rows = rows.withColumns({"n1": n1, "n2": n2, "pvalue": let(normal_p(n1, n2, u, zeros * zeros * zeros - zeros + ones * ones * ones - ones), lambda p: half_away(p, 5))})
    rows = rows.withColumn("reads_asm_effect", half_even(F.try_divide("a", "n1") - F.try_divide("c", "n2"), 3))
    rows = max_consecutive_run(sig_cpg_count(rows, "cpgs", "reads_asm_effect", cfg.max_p), "cpgs", "reads_asm_effect", cfg.max_p)
    return asm_decision(rows, "pvalue", cfg, "approx_asm", "reads_asm_effect").select(*K, "approx_asm", "reads_asm_effect", "total_sig_cpgs", "consecutive_sig_cpgs")
