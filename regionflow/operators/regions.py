"""Nesting of calls into regions: per-read and per-site statistics as arrays of structs.

Every array is built from one struct and sorted by an explicit key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import allele_effect, half_away, safe_ratio

K = ["sample", "chr", "region_inf", "region_sup", "clustering_index"]
SNP = [*K, "snp_id", "snp_pos"]


def nested(**fields: Column) -> Column:
    """Structs of a group, sorted by their first field, then the next."""
    return F.array_sort(F.collect_list(F.struct(*[c.alias(k) for k, c in fields.items()])))


def cpg_coverage_having(calls: DataFrame, lo: int, hi: int) -> DataFrame:
    """Sites whose coverage lies between lo and hi, both included."""
    return calls.groupBy("sample", "chr", "pos").agg(F.sum("cov").alias("sum_cov")).where(F.col("sum_cov").between(lo, hi))


def read_methylation_arrays(calls: DataFrame) -> DataFrame:
    """Per region and read: methylated share, positions within the tile (from 1) and states in order of position."""
    site = nested(p=(F.col("pos") - F.col("region_inf") + 1).cast("int"), m=F.col("meth").cast("int"))
    rows = calls.groupBy(*K, "read_id").agg(half_away(F.try_divide(F.sum("meth"), F.sum("cov")), 3).alias("fm"), site.alias("s"))
    return rows.select(*K, "read_id", "fm", F.col("s.p").alias("cpg_pos"), F.col("s.m").alias("cpg_meth"))


def region_reads_nest(reads: DataFrame) -> DataFrame:
    one = nested(id=F.col("read_id"), fm=F.col("fm"), cpg_pos=F.col("cpg_pos"), cpg_meth=F.col("cpg_meth"))
    return reads.groupBy(*K).agg(one.alias("reads"))


def cpg_fm_cov(calls: DataFrame, lo: int, hi: int) -> DataFrame:
    """Per site: coverage and methylated share; coverage between lo and hi, both included."""
    rows = calls.groupBy(*K, "region_nb_cpg", "pos").agg(F.sum("cov").alias("cov"), F.sum("meth").alias("m"))
    return rows.where(F.col("cov").between(lo, hi)).withColumn("fm", half_away(F.col("m") / F.col("cov"), 3)).drop("m")


def region_cpgs_nest(cpgs: DataFrame, min_n: int) -> DataFrame:
    one = nested(pos=F.col("pos"), cov=F.col("cov"), fm=F.col("fm"))
    return cpgs.groupBy(*K, "region_nb_cpg").agg(F.count("*").alias("nb_cpg_found"), one.alias("cpgs")).where(F.col("nb_cpg_found") >= min_n)


def join_cpg_read_arrays(cpgs: DataFrame, reads: DataFrame) -> DataFrame:
    return cpgs.join(reads, K)


def coverage_filter(df: DataFrame, lo: int, hi: int) -> DataFrame:
    """Rows whose reference and alternative coverage are at least lo and below hi."""
    return df.where((F.col("ref_cov") >= lo) & (F.col("ref_cov") < hi) & (F.col("alt_cov") >= lo) & (F.col("alt_cov") < hi))


def region_snp_cpg_nest(snp_cpg: DataFrame, lo: int, hi: int, min_n: int) -> DataFrame:
    """Per region and SNP: sites with both alleles covered, as structs in order."""
    effect = allele_effect(F.col("ref_meth"), F.col("ref_cov"), F.col("alt_meth"), F.col("alt_cov"))
    one = nested(pos=F.col("pos"), ref_cov=F.col("ref_cov"), ref_meth=F.col("ref_meth"), alt_cov=F.col("alt_cov"), alt_meth=F.col("alt_meth"), effect=effect, fisher_pvalue=F.col("fisher_pvalue"))
    rows = coverage_filter(snp_cpg, lo, hi).groupBy(*SNP).agg(F.count("*").alias("nb_cpg_found_w_snp"), one.alias("cpg_w_snp"))
    return rows.where(F.col("nb_cpg_found_w_snp") >= min_n)


def read_allele_methylation(genotyped: DataFrame) -> DataFrame:
    return genotyped.groupBy(*SNP, "read_id", "allele").agg(safe_ratio(F.sum("meth"), F.sum("cov")).alias("methyl_perc"))


def reads_allele_pivot(reads: DataFrame) -> DataFrame:
    """Per region and SNP: the reads' shares as structs {ref, alt}, one of them null."""
    ref, alt = (F.when(F.col("allele") == a, F.col("methyl_perc")) for a in ("REF", "ALT"))
    one = F.array_sort(F.collect_list(F.struct(F.col("read_id").alias("id"), ref.alias("ref"), alt.alias("alt"))))
    rows = reads.groupBy(*SNP).agg(F.count("*").alias("nb_reads_found_w_snp"), one.alias("r"))
    return rows.withColumn("reads_w_snp", F.transform("r", lambda x: F.struct(x["ref"].alias("ref"), x["alt"].alias("alt")))).drop("r")


def join_snp_arrays(cpg_w_snp: DataFrame, reads_w_snp: DataFrame) -> DataFrame:
    return cpg_w_snp.join(reads_w_snp, SNP)


LABELS = ["read_asm_effect", "wilcoxon_pvalue", "corrected_wilcoxon_pvalue", "total_sig_cpgs", "consecutive_sig_cpgs", "asm", "asm_not_corrected"]


def unique_label_group(labels: DataFrame) -> DataFrame:
    """Labels of regions with exactly one row."""
    rows = labels.groupBy(*K).agg(F.count("*").alias("_n"), *[F.any_value(c).alias(c) for c in LABELS])
    return rows.where("_n = 1").drop("_n")


def any_label_group(labels: DataFrame) -> DataFrame:
    """Label 1 if any row of the region has it."""
    return labels.groupBy(*K).agg(F.max("asm").alias("asm"))


def label_left_join(regions: DataFrame, labels: DataFrame) -> DataFrame:
    return regions.join(labels.select(*K, *LABELS), K, "left")


def array_conditional_stats(df: DataFrame, arr: str, max_p: float) -> DataFrame:
    """Counts of significant sites by sign, and first and last positions of significant and of all sites."""
    sig = F.filter(arr, lambda x: x["fisher_pvalue"] < max_p)
    pos = lambda a: F.transform(a, lambda x: x["pos"])
    return df.withColumns(
        {
            "nb_sig_cpg": F.size(sig),
            "pos_sig_cpg": F.size(F.filter(sig, lambda x: x["effect"] > 0)),
            "neg_sig_cpg": F.size(F.filter(sig, lambda x: x["effect"] < 0)),
            "min_pos_sig_cpg": F.array_min(pos(sig)),
            "max_pos_sig_cpg": F.array_max(pos(sig)),
            "min_cpg_pos": F.array_min(pos(F.col(arr))),
            "max_cpg_pos": F.array_max(pos(F.col(arr))),
        }
    )


def sig_window_filter(df: DataFrame, pos: str, sig_lo: str, sig_hi: str, lo: str, hi: str) -> DataFrame:
    """Rows between the first and the last significant position, or all positions if there is none."""
    return df.where(F.col(pos).between(F.coalesce(sig_lo, lo), F.coalesce(sig_hi, hi)))


def read_window_join(genotyped: DataFrame, snp_stats: DataFrame) -> DataFrame:
    """Distinct calls of each SNP's reads inside its window of significant sites."""
    window = ["min_pos_sig_cpg", "max_pos_sig_cpg", "min_cpg_pos", "max_cpg_pos"]
    rows = genotyped.join(snp_stats.select(*SNP, *window), SNP)
    # a SNP's window is the same for all its calls, so it's no part of what is compared
    return sig_window_filter(rows, "pos", *window).select(*genotyped.columns).dropDuplicates()


def allele_read_effect(reads: DataFrame) -> DataFrame:
    """Per region and SNP: mean share of alternative minus reference reads, their numbers and sorted shares.

    The difference is rounded to nine digits first, so that ties don't hang on the order of a sum.
    """
    of = lambda a: F.when(F.col("allele") == a, F.col("methyl_perc"))
    mean = lambda a: F.sum(of(a)) / F.count(of(a))
    return reads.groupBy(*SNP).agg(
        half_away(half_away(mean("ALT") - mean("REF"), 9), 5).alias("asm_region_effect"),
        F.count(of("REF")).alias("ref_reads"),
        F.count(of("ALT")).alias("alt_reads"),
        F.array_sort(F.collect_list(of("REF"))).alias("ref"),
        F.array_sort(F.collect_list(of("ALT"))).alias("alt"),
    )


def ref_alt_array_join(reads: DataFrame) -> DataFrame:
    """Per region and SNP with reads of both alleles: their shares as two arrays, by one conditional aggregation."""
    return allele_read_effect(reads).where("ref_reads > 0 AND alt_reads > 0").select(*SNP, "ref", "alt")


def merge_cpg_read_tables(cpg_stats: DataFrame, read_stats: DataFrame) -> DataFrame:
    return cpg_stats.join(read_stats, SNP)
