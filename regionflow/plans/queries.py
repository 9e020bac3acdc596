"""One query an operator, over the given tables, with DuckDB SQL that states the same rows.

Nested results are flattened to texts of whole numbers or to one row an element.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import allele_effect, half_away, half_away_sql, half_even, kernel_grid, safe_ratio
from ..operators import features as fe
from ..operators import genome as ge
from ..operators import hmm, learn
from ..operators import regions as rg
from ..operators import reports as rp
from ..operators import stats as st
from ..sources import io
from . import adapter as ad
from .adapter import BLOCK, CFG, TILE, K, even_sql, fisher_sql, rank_p_sql, with_ctes
from .adapter import SNP as SNPS

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, *ctes: str):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = with_ctes(sql, *ctes) if ctes else sql
        return f

    return add


def R(x: str, d: int = 5) -> str:
    return half_away_sql(x, d)


def ints(arr: str, scale: int = 1):
    """An array as text: its elements, times scale, as whole numbers."""
    return F.array_join(F.transform(arr, lambda x: F.round(x * scale).cast("long").cast("string")), ",")


# --- sources and sinks

query("src_chr_offsets", "SELECT * FROM offsets", "offsets")(ad.offsets)

CALLS_T = T.StructType().add("sample", "string").add("chr", "integer").add("pos", "long").add("read_id", "long").add("cov", "integer").add("meth", "integer")
_CALLS = "SELECT sample, chr, pos, read_id, cov, meth FROM calls"


def plain_calls(spark, sf) -> DataFrame:
    return ad.calls(spark, sf).select(*CALLS_T.names)


@query("src_tsv_typed", _CALLS, "calls")
def _(spark, sf):
    path = io.scratch(spark)
    plain_calls(spark, sf).write.csv(path, sep="\t", header=True, compression="gzip")
    return io.tsv_typed(spark, path, CALLS_T)


@query("src_bed_intervals", "SELECT s_suppkey % 24 + 1 AS chr, s_suppkey * 7 AS chr_start, s_suppkey * 7 + 30 AS chr_end, 'r' || (s_suppkey % 3) AS reason FROM supplier WHERE s_suppkey % 24 < 22")
def _(spark, sf):
    path = io.scratch(spark)
    s = ad.table(spark, sf, "supplier")
    s.selectExpr("concat('chr', CASE WHEN s_suppkey % 24 < 22 THEN cast(s_suppkey % 24 + 1 AS string) ELSE 'X' END)", "s_suppkey * 7", "s_suppkey * 7 + 30", "concat('r', s_suppkey % 3)", "'a'", "'b'").write.csv(path, sep="\t")
    return io.bed_intervals(spark, path)


@query("src_sample_tables", "SELECT sample, chr, pos, read_id, cov, meth FROM calls WHERE sample IN ('S0', 'S2')", "calls")
def _(spark, sf):
    root = io.scratch(spark)
    plain_calls(spark, sf).write.partitionBy("sample").parquet(f"{root}/calls")
    return io.sample_tables(spark, root, "calls", ["S0", "S2"]).select(*CALLS_T.names)


def exported(spark, sf) -> str:
    """A folder of calls as an export writes them, whole numbers as text, and of lines that were cut off."""
    path, rows = io.scratch(spark), plain_calls(spark, sf)
    rows.select(*[F.col(c).cast("string").alias(c) for c in CALLS_T.names]).write.json(path)
    rows.where("read_id % 100 = 7").selectExpr("concat('{\"chr\":\"', chr, '\",\"pos\":\"', pos) AS value").write.mode("append").text(path)
    return path


@query("src_ndjson", _CALLS, "calls")
def _(spark, sf):
    return io.read_ndjson(spark, exported(spark, sf), CALLS_T)


@query("src_ndjson_broken", "SELECT '{\"chr\":\"' || chr || '\",\"pos\":\"' || pos AS line, count(*) AS n FROM calls WHERE read_id % 100 = 7 GROUP BY line", "calls")
def _(spark, sf):
    return io.broken_ndjson(spark, exported(spark, sf), CALLS_T).groupBy("line").agg(F.count("*").alias("n"))


@query("sink_ndjson", _CALLS, "calls")
def _(spark, sf):
    path = io.scratch(spark)
    io.write_ndjson(plain_calls(spark, sf), path)
    io.write_ndjson(plain_calls(spark, sf).limit(1), path)  # there already: skipped
    return io.read_ndjson(spark, path, CALLS_T)


@query("sink_table_replace", f"SELECT {K}, pos, read_id FROM rcalls", "rcalls")
def _(spark, sf):
    path = io.scratch(spark)
    rows = io.kept(ad.region_calls(spark, sf).select(*rg.K, "pos", "read_id"))
    for _ in range(2):
        io.replace_table(rows, path, "clustering_index", ["sample", "chr"])
    io.discard(rows)
    return spark.read.parquet(path).select(*rg.K, "pos", "read_id")


@query("sink_table_bucketed", f"SELECT {K}, count(*) AS n, sum(cov) AS cov, nr AS reads FROM rcalls JOIN (SELECT {K}, count(*) AS nr FROM reads GROUP BY {K}) USING ({K}) GROUP BY {K}, nr", "rcalls", "reads")
def _(spark, sf):
    rows = io.bucketed(ad.region_calls(spark, sf).select(*rg.K, "read_id", "cov"), rg.K)
    sums = rows.groupBy(*rg.K).agg(F.count("*").alias("n"), F.sum("cov").alias("cov"))
    return sums.join(rows.groupBy(*rg.K, "read_id").count().groupBy(*rg.K).agg(F.count("*").alias("reads")), rg.K)


@query("sink_table_append", "SELECT sample, count(*) AS n FROM calls GROUP BY sample", "calls")
def _(spark, sf):
    path = io.scratch(spark)
    for s in ("S0", "S1", "S1", "S2"):  # one run is tried again
        io.append_table(plain_calls(spark, sf).where(F.col("sample") == s), path, f"calls of {s}")
    return io.read_appended(spark, path).groupBy("sample").agg(F.count("*").alias("n"))


@query("array_text_column", f"SELECT {K}, count(*) AS n, {R('sum(fm)', 3)} AS total FROM kept_cpgs GROUP BY {K}", "kept_cpgs")
def _(spark, sf):
    native = fe.array_fields(ad.regions_w_arrays(spark, sf)).select(*rg.K, "cpg_fm")
    back = io.array_text(io.array_text(native, "cpg_fm", to="text"), "cpg_fm")
    return back.select(*rg.K, F.size("cpg_fm").alias("n"), half_away(F.aggregate("cpg_fm", F.lit(0.0), lambda s, x: s + x), 3).alias("total"))


# --- projections, filters, scalars


@query("autosome_filter", "SELECT o_orderkey, o_orderkey % 24 + 1 AS chr FROM orders WHERE o_orderkey % 24 < 22")
def _(spark, sf):
    df = ad.table(spark, sf, "orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 24 < 22 THEN cast(o_orderkey % 24 + 1 AS string) ELSE 'X' END AS chr")
    return ge.autosome_filter(df)


@query("clustering_index", f"SELECT chr, pos, read_id, CAST(floor((absolute_nucleotide_pos + pos) / {BLOCK}) AS INTEGER) AS clustering_index FROM calls JOIN offsets USING (chr)", "calls", "offsets")
def _(spark, sf):
    df = ge.join_chr_offset(plain_calls(spark, sf), ad.offsets(spark, sf))
    return ge.clustering_index(df, "pos", BLOCK).select("chr", "pos", "read_id", "clustering_index")


@query("project_except", "SELECT sample, chr, pos, read_id FROM calls", "calls")
def _(spark, sf):
    return rp.project_except(plain_calls(spark, sf), ["cov", "meth"])


@query("coverage_filter", f"SELECT {SNPS}, pos, ref_cov, alt_cov FROM snp_filled WHERE ref_cov >= 8 AND ref_cov < 20 AND alt_cov >= 8 AND alt_cov < 20", "snp_filled")
def _(spark, sf):
    return rg.coverage_filter(ad.snp_cpg(spark, sf), 8, 20).select(*rg.SNP, "pos", "ref_cov", "alt_cov")


@query("safe_ratio", f"SELECT {SNPS}, pos, {R('CASE WHEN alt_cov = 0 THEN NULL ELSE alt_meth / alt_cov END')} AS ratio FROM snp_filled", "snp_filled")
def _(spark, sf):
    return ad.snp_cpg(spark, sf).select(*rg.SNP, "pos", safe_ratio(F.col("alt_meth"), F.col("alt_cov")).alias("ratio"))


@query("allele_effect", f"SELECT {SNPS}, pos, {R('CASE WHEN alt_cov = 0 OR ref_cov = 0 THEN NULL ELSE alt_meth / alt_cov - ref_meth / ref_cov END')} AS effect FROM snp_filled", "snp_filled")
def _(spark, sf):
    return ad.snp_cpg(spark, sf).select(*rg.SNP, "pos", allele_effect(F.col("ref_meth"), F.col("ref_cov"), F.col("alt_meth"), F.col("alt_cov")).alias("effect"))


@query("not_null_in_list", "SELECT sample, read_id, allele, pos FROM calls WHERE allele IS NOT NULL AND sample IN ('S0', 'S1')", "calls")
def _(spark, sf):
    return rp.not_null_in_list(ad.calls(spark, sf), ["allele"], "sample", ["S0", "S1"]).select("sample", "read_id", "allele", "pos")


@query("hash_chunk", "SELECT o_orderkey FROM orders")
def _(spark, sf):
    df = ad.table(spark, sf, "orders").select("o_orderkey")
    parts = [rp.hash_chunk(df, "o_orderkey", 4, i) for i in range(4)]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@query("limit_testing", "SELECT read_id, pos, sample FROM calls ORDER BY read_id, pos, sample LIMIT 1000", "calls")
def _(spark, sf):
    return rp.limit_testing(ad.calls(spark, sf).select("read_id", "pos", "sample"), ["read_id", "pos", "sample"], 1000)


@query("one_hot_fixed_domain", "SELECT region_inf, chr, " + ", ".join(f"CASE WHEN chr = {i} THEN 1 ELSE 0 END AS chr_{i}" for i in range(1, 23)) + " FROM regions", "regions")
def _(spark, sf):
    return fe.one_hot_fixed_domain(ad.regions(spark, sf).select("region_inf", "chr"), "chr", list(range(1, 23)))


@query("cast_nullable_ints", "SELECT doc_id, CAST(quality AS INTEGER) AS quality, CAST(toxic AS INTEGER) AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def _(spark, sf):
    df = ad.table(spark, sf, "documents").select("doc_id").join(ad.table(spark, sf, "labels"), "doc_id", "left")
    return fe.cast_nullable_ints(df.withColumns({c: F.col(c).cast("double") for c in ("quality", "toxic")}), ["quality", "toxic"]).select("doc_id", "quality", "toxic")


_STATS = f"""SELECT {SNPS}, count(*) FILTER (WHERE fisher_pvalue < 0.05) AS nb_sig_cpg, count(*) FILTER (WHERE fisher_pvalue < 0.05 AND effect > 0) AS pos_sig_cpg, count(*) FILTER (WHERE fisher_pvalue < 0.05 AND effect < 0) AS neg_sig_cpg,
  min(pos) FILTER (WHERE fisher_pvalue < 0.05) AS min_pos_sig_cpg, max(pos) FILTER (WHERE fisher_pvalue < 0.05) AS max_pos_sig_cpg, min(pos) AS min_cpg_pos, max(pos) AS max_cpg_pos FROM cpg_w_snp GROUP BY {SNPS}"""


def snp_stats(spark, sf) -> DataFrame:
    return rg.array_conditional_stats(ad.cpg_w_snp(spark, sf), "cpg_w_snp", CFG.max_p).drop("cpg_w_snp", "nb_cpg_found_w_snp")


query("array_conditional_stats", _STATS, "cpg_w_snp")(snp_stats)


@query("sig_window_filter", f"SELECT {SNPS}, pos FROM cpg_w_snp JOIN ({_STATS}) USING ({SNPS}) WHERE pos BETWEEN coalesce(min_pos_sig_cpg, min_cpg_pos) AND coalesce(max_pos_sig_cpg, max_cpg_pos)", "cpg_w_snp")
def _(spark, sf):
    df = rg.array_conditional_stats(ad.cpg_w_snp(spark, sf), "cpg_w_snp", CFG.max_p).withColumn("pos", F.explode(F.transform("cpg_w_snp", lambda x: x["pos"])))
    return rg.sig_window_filter(df, "pos", "min_pos_sig_cpg", "max_pos_sig_cpg", "min_cpg_pos", "max_cpg_pos").select(*rg.SNP, "pos")


# --- generator and joins

query("tile_genome", "SELECT * FROM tiles", "tiles")(ad.tiles)


@query("join_chr_offset", "SELECT read_id, pos, chr, absolute_nucleotide_pos FROM calls JOIN offsets USING (chr)", "calls", "offsets")
def _(spark, sf):
    return ge.join_chr_offset(plain_calls(spark, sf), ad.offsets(spark, sf)).select("read_id", "pos", "chr", "absolute_nucleotide_pos")


query("range_join_count_cpg", "SELECT * FROM regions", "regions")(ad.regions)


@query("point_in_region_join", f"SELECT {K}, region_nb_cpg, pos, read_id, meth FROM rcalls", "rcalls")
def _(spark, sf):
    return ad.region_calls(spark, sf).select(*rg.K, "region_nb_cpg", "pos", "read_id", "meth")


_TOUCH = "EXISTS (SELECT 1 FROM blacklist b WHERE b.chr = r.chr AND b.chr_start <= r.region_sup AND b.chr_end >= r.region_inf)"


@query("interval_overlap_join", f"SELECT * FROM regions r WHERE {_TOUCH}", "regions", "blacklist")
def _(spark, sf):
    return ge.interval_overlap_join(ad.regions(spark, sf), ad.blacklist(spark, sf), TILE)


@query("anti_join_blacklist", f"SELECT * FROM regions r WHERE NOT {_TOUCH}", "regions", "blacklist")
def _(spark, sf):
    return ge.anti_join_blacklist(ad.regions(spark, sf), ad.blacklist(spark, sf), TILE)


@query("semi_join_good_cpg", "SELECT sample, chr, pos, read_id FROM calls WHERE (sample, chr, pos) IN (SELECT (sample, chr, pos) FROM calls GROUP BY sample, chr, pos HAVING sum(cov) BETWEEN 20 AND 35)", "calls")
def _(spark, sf):
    c = ad.calls(spark, sf)
    return ge.semi_join_good_cpg(c, rg.cpg_coverage_having(c, 20, 35)).select("sample", "chr", "pos", "read_id")


@query("join_cpg_read_arrays", f"SELECT {K}, region_nb_cpg, nb_cpg_found, nr AS nb_reads FROM regions_cpg JOIN (SELECT {K}, count(*) AS nr FROM reads GROUP BY {K}) USING ({K})", "regions_cpg", "reads")
def _(spark, sf):
    return ad.regions_w_arrays(spark, sf).select(*rg.K, "region_nb_cpg", "nb_cpg_found", F.size("reads").alias("nb_reads"))


@query("join_snp_arrays", f"SELECT {SNPS}, nb_cpg_found_w_snp, nr AS nb_reads_found_w_snp, nref FROM snp_regions JOIN (SELECT {SNPS}, count(*) AS nr, count(*) FILTER (WHERE allele = 'REF') AS nref FROM allele_reads GROUP BY {SNPS}) USING ({SNPS})", "snp_regions", "allele_reads")
def _(spark, sf):
    return ad.regions_and_snps(spark, sf).select(*rg.SNP, "nb_cpg_found_w_snp", "nb_reads_found_w_snp", F.size(F.filter("reads_w_snp", lambda r: r["ref"].isNotNull())).alias("nref"))


@query("label_left_join", f"SELECT {K}, nb_cpg_found, read_asm_effect, wilcoxon_pvalue, corrected_wilcoxon_pvalue, total_sig_cpgs, consecutive_sig_cpgs, asm, asm_not_corrected FROM regions_cpg LEFT JOIN unique_labels USING ({K})", "regions_cpg", "unique_labels")
def _(spark, sf):
    return ad.labelled_regions(spark, sf).select(*rg.K, "nb_cpg_found", *rg.LABELS)


@query("read_window_join", f"SELECT DISTINCT {SNPS}, read_id, allele, pos, meth FROM genotyped JOIN ({_STATS}) USING ({SNPS}) WHERE pos BETWEEN coalesce(min_pos_sig_cpg, min_cpg_pos) AND coalesce(max_pos_sig_cpg, max_cpg_pos)", "genotyped", "cpg_w_snp")
def _(spark, sf):
    g = ad.dealt_genotyped(spark, sf)
    sites = rg.region_snp_cpg_nest(ad.allele_counts(g), ad.LO, ad.HI, CFG.min_cpg)
    return rg.read_window_join(g.select(*rg.SNP, "read_id", "allele", "pos", "meth"), rg.array_conditional_stats(sites, "cpg_w_snp", CFG.max_p)).select(*rg.SNP, "read_id", "allele", "pos", "meth")


_PAIRS = f"""SELECT {SNPS}, string_agg(CAST(CAST(round(methyl_perc * 100000) AS BIGINT) AS VARCHAR), ',' ORDER BY methyl_perc) FILTER (WHERE allele = 'REF') AS ref_text,
  string_agg(CAST(CAST(round(methyl_perc * 100000) AS BIGINT) AS VARCHAR), ',' ORDER BY methyl_perc) FILTER (WHERE allele = 'ALT') AS alt_text FROM allele_reads GROUP BY {SNPS} HAVING count(DISTINCT allele) = 2"""


@query("ref_alt_array_join", _PAIRS, "allele_reads")
def _(spark, sf):
    return rg.ref_alt_array_join(ad.allele_reads(spark, sf)).select(*rg.SNP, ints("ref", 100000).alias("ref_text"), ints("alt", 100000).alias("alt_text"))


_EFFECT = f"""SELECT {SNPS}, {R(R("avg(methyl_perc) FILTER (WHERE allele = 'ALT') - avg(methyl_perc) FILTER (WHERE allele = 'REF')", 9))} AS asm_region_effect,
  count(*) FILTER (WHERE allele = 'REF') AS ref_reads, count(*) FILTER (WHERE allele = 'ALT') AS alt_reads FROM allele_reads GROUP BY {SNPS}"""


@query("allele_read_effect", _EFFECT, "allele_reads")
def _(spark, sf):
    return rg.allele_read_effect(ad.allele_reads(spark, sf)).drop("ref", "alt")


@query("merge_cpg_read_tables", f"SELECT * FROM ({_STATS}) JOIN ({_EFFECT}) USING ({SNPS})", "cpg_w_snp", "allele_reads")
def _(spark, sf):
    return rg.merge_cpg_read_tables(snp_stats(spark, sf), rg.allele_read_effect(ad.allele_reads(spark, sf)).drop("ref", "alt"))


_LOCI = "SELECT p_partkey AS locus, p_partkey % 22 + 1 AS chr, p_partkey % 2000 AS locus_pos FROM part"
_SCORED = "SELECT chr, region_inf, region_sup, nb_cpg_found + chr AS score, CAST((region_inf - 1) // 250 % 4 = 0 AS INTEGER) AS label FROM regions_cpg WHERE sample = 'S0'"


def loci(spark, sf) -> DataFrame:
    return ad.table(spark, sf, "part").selectExpr("p_partkey AS locus", "cast(p_partkey % 22 + 1 AS int) AS chr", "p_partkey % 2000 AS locus_pos")


def scored(spark, sf) -> DataFrame:
    return ad.nested_cpgs(spark, sf).where("sample = 'S0'").selectExpr("chr", "region_inf", "region_sup", "nb_cpg_found + chr AS score", "cast((region_inf - 1) div 250 % 4 = 0 AS int) AS label")


_LOCUS = f"SELECT locus, min(region_inf) AS region_inf, min(region_sup) AS region_sup, max(score) AS max_score, max(label) AS max_label FROM ({_LOCI}) l LEFT JOIN ({_SCORED}) r ON l.chr = r.chr AND l.locus_pos BETWEEN r.region_inf AND r.region_sup GROUP BY locus"


@query("locus_right_range_join", _LOCUS, "regions_cpg")
def _(spark, sf):
    return ge.locus_right_range_join(scored(spark, sf), loci(spark, sf), TILE)


# --- aggregations


@query("cpg_coverage_having", "SELECT sample, chr, pos, CAST(sum(cov) AS BIGINT) AS sum_cov FROM calls GROUP BY sample, chr, pos HAVING sum(cov) BETWEEN 20 AND 35", "calls")
def _(spark, sf):
    return rg.cpg_coverage_having(ad.calls(spark, sf), 20, 35)


_READS = f"SELECT {K}, read_id, {R('sum(meth) / sum(cov)', 3)} AS fm, string_agg(CAST(pos - region_inf + 1 AS VARCHAR), ',' ORDER BY pos, meth) AS cpg_pos, string_agg(CAST(meth AS VARCHAR), ',' ORDER BY pos, meth) AS cpg_meth FROM rcalls GROUP BY {K}, read_id"


@query("read_methylation_arrays", _READS, "rcalls")
def _(spark, sf):
    return ad.reads(spark, sf).select(*rg.K, "read_id", "fm", ints("cpg_pos").alias("cpg_pos"), ints("cpg_meth").alias("cpg_meth"))


@query("region_reads_nest", _READS, "rcalls")
def _(spark, sf):
    nest = rg.region_reads_nest(ad.reads(spark, sf)).select(*rg.K, F.explode("reads").alias("r"))
    return nest.select(*rg.K, F.col("r.id").alias("read_id"), "r.fm", ints("r.cpg_pos").alias("cpg_pos"), ints("r.cpg_meth").alias("cpg_meth"))


query("cpg_fm_cov", f"SELECT {K}, region_nb_cpg, pos, cov, fm FROM cpgs", "cpgs")(lambda spark, sf: ad.cpgs(spark, sf).select(*rg.K, "region_nb_cpg", "pos", "cov", "fm"))


@query("region_cpgs_nest", f"SELECT {K}, region_nb_cpg, nb_cpg_found, string_agg(pos || ':' || cov || ':' || CAST(round(fm * 1000) AS BIGINT), ',' ORDER BY pos) AS cpgs FROM kept_cpgs GROUP BY {K}, region_nb_cpg, nb_cpg_found", "kept_cpgs")
def _(spark, sf):
    text = F.array_join(F.transform("cpgs", lambda x: F.concat_ws(":", x["pos"].cast("string"), x["cov"].cast("string"), F.round(x["fm"] * 1000).cast("long").cast("string"))), ",")
    return ad.nested_cpgs(spark, sf).withColumn("cpgs", text)


@query("region_snp_cpg_nest", f"SELECT {SNPS}, nb AS nb_cpg_found_w_snp, pos, ref_cov, ref_meth, alt_cov, alt_meth, effect, fisher_pvalue FROM cpg_w_snp", "cpg_w_snp")
def _(spark, sf):
    return ad.cpg_w_snp(spark, sf).select(*rg.SNP, "nb_cpg_found_w_snp", F.explode("cpg_w_snp").alias("x")).select(*rg.SNP, "nb_cpg_found_w_snp", "x.*")


query("read_allele_methylation", f"SELECT {SNPS}, read_id, allele, methyl_perc FROM allele_reads", "allele_reads")(ad.allele_reads)


@query("reads_allele_pivot", f"SELECT {SNPS}, count(*) AS nb_reads_found_w_snp, count(*) FILTER (WHERE allele = 'REF') AS nref, {R('sum(methyl_perc)', 6)} AS total FROM allele_reads GROUP BY {SNPS}", "allele_reads")
def _(spark, sf):
    df = rg.reads_allele_pivot(ad.allele_reads(spark, sf))
    total = F.aggregate("reads_w_snp", F.lit(0.0), lambda s, r: s + F.coalesce(r["ref"], r["alt"]))
    return df.select(*rg.SNP, "nb_reads_found_w_snp", F.size(F.filter("reads_w_snp", lambda r: r["ref"].isNotNull())).alias("nref"), half_away(total, 6).alias("total"))


query("unique_label_group", f"SELECT {K}, read_asm_effect, wilcoxon_pvalue, corrected_wilcoxon_pvalue, total_sig_cpgs, consecutive_sig_cpgs, asm, asm_not_corrected FROM unique_labels", "unique_labels")(lambda spark, sf: rg.unique_label_group(ad.labels(spark, sf)))
query("any_label_group", f"SELECT {K}, max(asm) AS asm FROM evaluated GROUP BY {K}", "evaluated")(lambda spark, sf: rg.any_label_group(ad.labels(spark, sf)))


@query("qa_counts", "SELECT count(*) AS n_rows, CAST(sum(n_chars) AS BIGINT) AS total, count(DISTINCT doc_id) AS n_unique, count(*) FILTER (WHERE quality = 1) AS n_label_1, count(*) FILTER (WHERE quality = 0) AS n_label_0, count(*) FILTER (WHERE quality IS NULL) AS n_label_null FROM documents LEFT JOIN labels USING (doc_id)")
def _(spark, sf):
    df = ad.table(spark, sf, "documents").select("doc_id", "n_chars").join(ad.table(spark, sf, "labels"), "doc_id", "left")
    return rp.qa_counts(df, "n_chars", ["doc_id"], "quality")


@query("distinct_rows", "SELECT DISTINCT sample, chr, pos FROM calls", "calls")
def _(spark, sf):
    return rp.distinct_rows(ad.calls(spark, sf), ["sample", "chr", "pos"])


@query("label_counts_pct", f"SELECT value, count(quality) AS n, {R('count(quality) * 100.0 / (SELECT count(*) FROM labels WHERE quality IN (0, 1))', 2)} AS pct FROM (VALUES (0), (1)) v(value) LEFT JOIN labels ON quality = value GROUP BY value")
def _(spark, sf):
    return rp.label_counts_pct(ad.table(spark, sf, "labels"), "quality")


@query("class_weights", f"SELECT {R('(n0 + n1) / (n0 * 2.0)', 2)} AS w0, {R('(n0 + n1) / (n1 * 2.0)', 2)} AS w1, n0 / n1 AS scale_pos_weight FROM (SELECT count(*) FILTER (WHERE toxic = 0) AS n0, count(*) FILTER (WHERE toxic = 1) AS n1 FROM labels)")
def _(spark, sf):
    return rp.class_weights(ad.table(spark, sf, "labels"), "toxic")


_CROSS = "SELECT label, S0, S1, S2, S0 + S1 + S2 AS Total FROM (SELECT CASE WHEN g = 1 THEN 'Total' ELSE CAST(l AS VARCHAR) END AS label, count(*) FILTER (WHERE sample = 'S0') AS S0, count(*) FILTER (WHERE sample = 'S1') AS S1, count(*) FILTER (WHERE sample = 'S2') AS S2 FROM (SELECT sample, CASE WHEN tile % 4 = 0 THEN 1 ELSE 0 END AS l, unnest([0, 1]) AS g FROM calls) GROUP BY 1)"


@query("crosstab_margins", _CROSS, "calls")
def _(spark, sf):
    return rp.crosstab_margins(ad.calls(spark, sf).withColumn("label", (F.col("tile") % 4 == 0).cast("int")), "label", "sample", ["S0", "S1", "S2"])


@query("label_correlation_rank", "SELECT name, abs_corr FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS name, abs(corr(l_discount, {c})) AS abs_corr FROM lineitem" for c in ("l_extendedprice", "l_linenumber", "l_quantity", "l_tax")) + ") ORDER BY abs_corr DESC, name LIMIT 3")
def _(spark, sf):
    return rp.label_correlation_rank(ad.table(spark, sf, "lineitem"), "l_discount", ["l_extendedprice", "l_linenumber", "l_quantity", "l_tax"], 3)


_HIST = "SELECT b AS bin, 0.1 * b AS lo, 0.1 * (b + 1) AS hi, 0.1 * (b + 0.5) AS centre, coalesce(n, 0) AS n, coalesce(n, 0) / sum(coalesce(n, 0)) OVER () AS prob FROM (SELECT unnest(range(10)) AS b) LEFT JOIN (SELECT CAST(least(floor((fm - 0.0) / 1e-1), 9) AS BIGINT) AS b, count(*) AS n FROM kept_cpgs GROUP BY 1) USING (b)"


def cpg_hist(spark, sf) -> DataFrame:
    return rp.hist_fixed_bins(fe.array_fields(ad.regions_w_arrays(spark, sf)), "cpg_fm", 10, 0.0, 1.0)


@query("hist_fixed_bins", f"SELECT bin, {R('lo', 6)} AS lo, {R('hi', 6)} AS hi, {R('centre', 6)} AS centre, n, {R('prob', 9)} AS prob FROM ({_HIST})", "kept_cpgs")
def _(spark, sf):
    return cpg_hist(spark, sf).select("bin", *[half_away(F.col(c), 6).alias(c) for c in ("lo", "hi", "centre")], "n", half_away(F.col("prob"), 9).alias("prob"))


@query("hist_moments", f"SELECT {R('m', 8)} AS mean, {R('m2 - m * m', 8)} AS var, {R('sqrt(m2 - m * m)', 8)} AS sd FROM (SELECT sum(centre * prob) AS m, sum(centre * centre * prob) AS m2 FROM ({_HIST}))", "kept_cpgs")
def _(spark, sf):
    return rp.hist_moments(cpg_hist(spark, sf)).select(*[half_away(F.col(c), 8).alias(c) for c in ("mean", "var", "sd")])


@query("hist_2d", "SELECT l_returnflag, CAST(least(floor((l_quantity - 0) / 5.1), 9) AS BIGINT) AS bx, CAST(least(floor((l_extendedprice - 0) / 10000.0), 9) AS BIGINT) AS by_bin, count(*) AS n FROM lineitem WHERE l_quantity BETWEEN 0 AND 51 AND l_extendedprice BETWEEN 0 AND 100000 GROUP BY ALL")
def _(spark, sf):
    return rp.hist_2d(ad.table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", 10, (0, 51), (0, 100000), "l_returnflag")


@query("state_mean_by_label", f"SELECT label, {R('avg(m)', 6)} AS mean, {R('stddev_pop(m)', 6)} AS sd FROM (SELECT {K}, label, avg(s) AS m FROM states GROUP BY {K}, label) GROUP BY label", "states")
def _(spark, sf):
    return rp.state_mean_by_label(ad.states(spark, sf), "states", "label").select("label", half_away(F.col("mean"), 6).alias("mean"), half_away(F.col("sd"), 6).alias("sd"))


@query("max_seq_len", f"SELECT sample, max(n) AS max_len FROM (SELECT {K}, count(*) AS n FROM dir GROUP BY {K}) GROUP BY sample", "dir")
def _(spark, sf):
    return fe.max_seq_len(ad.sequences(spark, sf), "cpg_directional_fm", "sample")


# --- windows, sampling, sets


@query("ordered_export", f"SELECT {K}, nb_cpg_found FROM regions_cpg ORDER BY sample, chr, region_inf", "regions_cpg")
def _(spark, sf):
    return rp.ordered_export(ad.nested_cpgs(spark, sf).select(*rg.K, "nb_cpg_found"), ["sample", "chr", "region_inf"])


query("read_extremes_topk", f"SELECT {K}, read_id, fm, rank_desc, n_ok FROM ranked", "ranked")(lambda spark, sf: ad.extremes(spark, sf).select(*rg.K, "read_id", "fm", "rank_desc", "n_ok"))
query("read_split_halves", f"SELECT {K}, read_id, grp FROM halves", "halves")(lambda spark, sf: ad.halves(spark, sf).select(*rg.K, "read_id", "grp"))

_H = "((doc_id % 2147483648 + 2147483648) % 2147483648 * 2654435761 + {}) % 4294967296"


def labelled(spark, sf) -> DataFrame:
    return ad.table(spark, sf, "labels").where("quality IS NOT NULL").select("doc_id", "quality")


@query("balanced_downsample", f"SELECT doc_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY {_H.format(0)}, doc_id) AS r FROM labels) WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM labels GROUP BY quality))")
def _(spark, sf):
    return rp.balanced_downsample(labelled(spark, sf), "quality", "doc_id")


@query("sample_n_per_group", f"SELECT doc_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY {_H.format(7)}, doc_id) AS r FROM labels) WHERE r <= 25")
def _(spark, sf):
    return rp.sample_n_per_group(labelled(spark, sf), "quality", 25, "doc_id", 7)


@query("random_oversample", f"SELECT doc_id, quality, unnest(range(1, top // n + CASE WHEN r <= top % n THEN 1 ELSE 0 END + 1)) AS copy FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY {_H.format(0)}, doc_id) AS r, count(*) OVER (PARTITION BY quality) AS n FROM labels) JOIN (SELECT max(n) AS top FROM (SELECT count(*) AS n FROM labels GROUP BY quality)) ON true")
def _(spark, sf):
    return rp.random_oversample(labelled(spark, sf), "quality", "doc_id")


_BLOCKS = rp.chosen_blocks(12, 60, 1)


@query("sample_blocks", f"SELECT {K}, nb_cpg_found FROM regions_cpg WHERE clustering_index IN ({', '.join(map(str, _BLOCKS))})", "regions_cpg")
def _(spark, sf):
    return rp.sample_blocks(ad.nested_cpgs(spark, sf).select(*rg.K, "nb_cpg_found"), 12, 60, 1)


@query("union_datasets", "SELECT read_id, pos, sample FROM calls WHERE sample = 'S0' UNION ALL SELECT read_id, pos, sample FROM calls WHERE sample = 'S1'", "calls")
def _(spark, sf):
    c = ad.calls(spark, sf).select("read_id", "pos", "sample")
    return rp.union_datasets(c.where("sample = 'S0'"), c.where("sample = 'S1'"))


_DATASET = "CASE sample WHEN 'S0' THEN 'TRAINING' WHEN 'S1' THEN 'VALIDATION' WHEN 'S2' THEN 'TESTING' END"


@query("split_by_sample_list", f"SELECT {K}, {_DATASET} AS dataset FROM regions_cpg", "regions_cpg")
def _(spark, sf):
    return rp.split_by_sample_list(ad.nested_cpgs(spark, sf).select(*rg.K), CFG.datasets)


# --- statistics


query("mann_whitney", f"SELECT {SNPS}, read_asm_effect, wilcoxon_pvalue FROM mw", "mw")(lambda spark, sf: st.mann_whitney(ad.regions_and_snps(spark, sf)))

def small_groups(spark, sf) -> DataFrame:
    """Prices of the first orders of a run of orders against those of its others: few against many, mostly without ties."""
    lines = ad.table(spark, sf, "lineitem")
    parts = [lines.selectExpr(f"{n} AS run", f"l_orderkey div {n} AS grp", f"l_orderkey % {n} = 0 AS chosen", "l_extendedprice AS price") for n in (3, 12, 40)]
    price = lambda chosen: F.when(F.col("chosen") == chosen, F.col("price"))
    one = F.struct(price(True).alias("ref"), price(False).alias("alt"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("run", "grp").agg(F.collect_list(one).alias("reads"))


_SMALL = """SELECT run, grp, sum(a) AS n1, sum(b) AS n2, sum(a * (below + b / 2.0)) AS u, sum(pow(a + b, 3) - (a + b)) AS ties FROM (
  SELECT *, coalesce(sum(b) OVER (PARTITION BY run, grp ORDER BY price ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (
    SELECT run, l_orderkey // run AS grp, l_extendedprice AS price, count(*) FILTER (WHERE l_orderkey % run = 0) AS a, count(*) FILTER (WHERE l_orderkey % run <> 0) AS b
    FROM lineitem, (VALUES (3), (12), (40)) r(run) GROUP BY ALL)) GROUP BY run, grp"""


@query("mann_whitney_small", f"SELECT run, grp, {R('p')} AS p FROM ({rank_p_sql(f'({_SMALL}) s', 'n1', 'n2', 'u', 'ties')})")
def _(spark, sf):
    return st.tested(small_groups(spark, sf), "reads").select("run", "grp", F.col("wilcoxon_pvalue").alias("p"))


query("bh_adjust", f"SELECT {SNPS}, read_asm_effect, wilcoxon_pvalue, corrected_wilcoxon_pvalue FROM tested", "tested")(lambda spark, sf: st.bh_adjust(st.mann_whitney(ad.regions_and_snps(spark, sf)), "wilcoxon_pvalue"))


def with_effect(spark, sf) -> DataFrame:
    return ad.cpg_w_snp(spark, sf).join(st.mann_whitney(ad.regions_and_snps(spark, sf)), rg.SNP)


@query("sig_cpg_count", f"SELECT {SNPS}, CAST(total_sig_cpgs AS BIGINT) AS total_sig_cpgs FROM runs", "runs")
def _(spark, sf):
    return st.sig_cpg_count(with_effect(spark, sf), "cpg_w_snp", "read_asm_effect", CFG.max_p).select(*rg.SNP, "total_sig_cpgs")


@query("max_consecutive_run", f"SELECT {SNPS}, CAST(consecutive_sig_cpgs AS BIGINT) AS consecutive_sig_cpgs FROM runs", "runs")
def _(spark, sf):
    return st.max_consecutive_run(with_effect(spark, sf), "cpg_w_snp", "read_asm_effect", CFG.max_p).select(*rg.SNP, "consecutive_sig_cpgs")


@query("asm_decision", f"SELECT {SNPS}, asm_not_corrected FROM evaluated", "evaluated")
def _(spark, sf):
    df = st.max_consecutive_run(st.sig_cpg_count(with_effect(spark, sf), "cpg_w_snp", "read_asm_effect", CFG.max_p), "cpg_w_snp", "read_asm_effect", CFG.max_p)
    return st.asm_decision(df, "wilcoxon_pvalue", CFG, "asm_not_corrected").select(*rg.SNP, "asm_not_corrected")


query("evaluate_asm", f"SELECT {SNPS}, read_asm_effect, wilcoxon_pvalue, corrected_wilcoxon_pvalue, total_sig_cpgs, consecutive_sig_cpgs, asm, asm_not_corrected FROM evaluated", "evaluated")(ad.labels)

_GROUP_FISHER = fisher_sql("group_counts", "high_meth", "high_cov - high_meth", "low_meth", "low_cov - low_meth")
_GROUP_EFFECT = f"CASE WHEN high_cov = 0 OR low_cov = 0 THEN NULL ELSE {even_sql('(high_meth / high_cov - low_meth / low_cov)', 3)} END"


def group_counts(spark, sf) -> DataFrame:
    return st.cpg_group_counts(ad.halves(spark, sf))


@query("fisher_exact", f"SELECT {K}, pos, {R('p', 6)} AS fisher_pvalue, {_GROUP_EFFECT} AS effect FROM ({_GROUP_FISHER})", "group_counts")
def _(spark, sf):
    df = group_counts(spark, sf).withColumn("high_un", F.col("high_cov") - F.col("high_meth")).withColumn("low_un", F.col("low_cov") - F.col("low_meth"))
    return st.fisher_exact(df, "high_meth", "high_un", "low_meth", "low_un").select(*rg.K, "pos", half_away(F.col("fisher_pvalue"), 6).alias("fisher_pvalue"), "effect")


query("cpg_group_counts", f"SELECT {K}, pos, high_meth, high_cov, low_meth, low_cov FROM group_counts", "group_counts")(group_counts)


@query("directional_fm_sequence", f"SELECT {K}, string_agg(CAST(CAST(round(x * 10000) AS BIGINT) AS VARCHAR), ',' ORDER BY pos) AS seq FROM dir GROUP BY {K}", "dir")
def _(spark, sf):
    return ad.sequences(spark, sf).select(*rg.K, ints("cpg_directional_fm", 10000).alias("seq"))


_ASITES = f"SELECT * REPLACE ({R('p', 9)} AS p), coalesce({_GROUP_EFFECT}, 0) AS effect FROM ({_GROUP_FISHER})"
_APOOL = f"SELECT {K}, sum(high_meth)::DOUBLE AS a, sum(high_cov - high_meth)::DOUBLE AS b, sum(low_meth)::DOUBLE AS c, sum(low_cov - low_meth)::DOUBLE AS d FROM group_counts GROUP BY {K}"
_AU = f"(SELECT *, a + b AS n1, c + d AS n2, a * d + a * c / 2.0 + b * d / 2.0 AS u, pow(b + d, 3) - (b + d) + pow(a + c, 3) - (a + c) AS ties FROM ({_APOOL})) s"
_ATEST = f"SELECT {K}, {even_sql('(a / n1 - c / n2)', 3)} AS reads_asm_effect, {R('p')} AS pvalue FROM ({rank_p_sql(_AU, 'n1', 'n2', 'u', 'ties')})"
_ARUNS = f"""SELECT {K}, max(total) AS total, max(CASE WHEN good = 1 THEN n ELSE 0 END) AS longest FROM (SELECT {K}, good, g, count(*) AS n, sum(sum(good)) OVER (PARTITION BY {K}) AS total FROM (
  SELECT *, i - row_number() OVER (PARTITION BY {K}, good ORDER BY pos) AS g FROM (SELECT {K}, pos, CASE WHEN p < 0.05 AND CASE WHEN reads_asm_effect > 0 THEN effect > 0 ELSE effect < 0 END THEN 1 ELSE 0 END AS good,
    row_number() OVER (PARTITION BY {K} ORDER BY pos) AS i FROM ({_ASITES}) JOIN ({_ATEST}) USING ({K}))) GROUP BY {K}, good, g) GROUP BY {K}"""
_APPROX = f"SELECT {K}, CASE WHEN pvalue <= 0.05 AND abs(reads_asm_effect) >= 0.2 AND longest >= 2 AND total >= 3 THEN 1 ELSE 0 END AS approx_asm, reads_asm_effect, CAST(total AS BIGINT) AS total_sig_cpgs, CAST(longest AS BIGINT) AS consecutive_sig_cpgs FROM ({_ATEST}) JOIN ({_ARUNS}) USING ({K})"
query("approx_asm", _APPROX, "group_counts")(lambda spark, sf: st.approx_asm(ad.halves(spark, sf), CFG))

_MATRIX = f"""SELECT {K}, repeat('0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0;', CAST(greatest((11 - s) // 2, 0) AS BIGINT)) || string_agg(cells, ';' ORDER BY pos) || repeat(';0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0,0', CAST(greatest(10 - s - (11 - s) // 2, 0) AS BIGINT)) AS matrix FROM (
  SELECT {K}, pos, count(*) OVER (PARTITION BY {K}) AS s, cells FROM (
    SELECT {K}, pos, string_agg(CAST(coalesce(m, 0) AS VARCHAR), ',' ORDER BY rank_desc) AS cells FROM
      (SELECT {K}, read_id, rank_desc, pos FROM halves JOIN (SELECT {K}, pos FROM group_counts) USING ({K}))
      LEFT JOIN (SELECT {K}, read_id, pos - region_inf + 1 AS pos, max(meth) + 1 AS m FROM rcalls GROUP BY ALL) USING ({K}, read_id, pos) GROUP BY {K}, pos)) GROUP BY {K}, s"""


@query("cpg_read_matrix", _MATRIX, "halves", "group_counts", "rcalls")
def _(spark, sf):
    df = fe.cpg_read_matrix(ad.halves(spark, sf), CFG.matrix_cpg, 2 * CFG.extreme_reads)
    return df.select(*rg.K, F.array_join(F.transform("cpgs_w_padding", lambda r: F.array_join(F.transform(r, lambda x: x.cast("string")), ",")), ";").alias("matrix"))


@query("cpg_distances", f"SELECT {K}, string_agg(CAST(d AS VARCHAR), ',' ORDER BY pos) AS cpg_dist FROM (SELECT {K}, pos, pos - lag(pos) OVER (PARTITION BY {K} ORDER BY pos) AS d FROM kept_cpgs) WHERE d IS NOT NULL GROUP BY {K}", "kept_cpgs")
def _(spark, sf):
    return fe.cpg_distances(ad.nested_cpgs(spark, sf)).select(*rg.K, ints("cpg_dist").alias("cpg_dist"))


@query("array_fields", f"SELECT {K}, nb_reads, covs, fms, read_fms FROM (SELECT {K}, string_agg(CAST(cov AS VARCHAR), ',' ORDER BY pos) AS covs, string_agg(CAST(CAST(round(fm * 1000) AS BIGINT) AS VARCHAR), ',' ORDER BY pos) AS fms FROM kept_cpgs GROUP BY {K}) JOIN (SELECT {K}, count(*) AS nb_reads, string_agg(CAST(CAST(round(fm * 1000) AS BIGINT) AS VARCHAR), ',' ORDER BY read_id) AS read_fms FROM reads GROUP BY {K}) USING ({K})", "kept_cpgs", "reads")
def _(spark, sf):
    return fe.array_fields(ad.regions_w_arrays(spark, sf)).select(*rg.K, "nb_reads", ints("cpg_cov").alias("covs"), ints("cpg_fm", 1000).alias("fms"), ints("read_fm", 1000).alias("read_fms"))


#: The four arrays of a region, in the order of the library's.
_LISTS = f"""(SELECT {K}, region_nb_cpg, nb_cpg_found, nb_reads, cpg_cov, cpg_fm, read_fm, list_transform(range(2, len(ps) + 1), lambda i: CAST(ps[i] - ps[i - 1] AS DOUBLE)) AS cpg_dist
  FROM (SELECT {K}, region_nb_cpg, nb_cpg_found, list(CAST(cov AS DOUBLE) ORDER BY pos) AS cpg_cov, list(fm ORDER BY pos) AS cpg_fm, list(pos ORDER BY pos) AS ps FROM kept_cpgs GROUP BY {K}, region_nb_cpg, nb_cpg_found)
  JOIN (SELECT {K}, count(*) AS nb_reads, list(fm ORDER BY read_id) AS read_fm FROM reads GROUP BY {K}) USING ({K}))"""
_TOTAL = "list_reduce({}, lambda p, q: p + q)"
_MEANS = "(SELECT *, " + ", ".join(f"{_TOTAL.format(x)} / len({x}) AS m_{x}" for x in fe.ARRAYS) + f" FROM {_LISTS})"


def _std(x: str) -> str:
    squares = f"list_transform({x}, lambda v: (v - m_{x}) * (v - m_{x}))"
    return f"CASE WHEN len({x}) > 1 THEN sqrt({_TOTAL.format(squares)} / (len({x}) - 1)) END"


_MOMENTS = ", ".join(f"{even_sql(f'm_{x}', 4)} AS mean_{x}, {even_sql(f'({_std(x)})', 4)} AS std_{x}" for x in fe.ARRAYS)


@query("array_mean_std", f"SELECT {K}, {_MOMENTS} FROM {_MEANS}", "kept_cpgs", "reads")
def _(spark, sf):
    df = fe.cpg_distances(fe.array_fields(ad.regions_w_arrays(spark, sf)))
    for x in fe.ARRAYS:
        df = fe.array_mean_std(df, x)
    return df.select(*rg.K, *[f"{n}_{x}" for x in fe.ARRAYS for n in ("mean", "std")])


_RATIO, _COV = kernel_grid(*CFG.ratio_grid), kernel_grid(*CFG.cov_grid)


@query("kernel_grid", " UNION ALL ".join(f"SELECT '{x}' AS field, g, count(*) AS n FROM kept_cpgs JOIN (SELECT unnest([{', '.join(str(g) for g in grid)}])::DOUBLE AS g) ON abs({x} - g) < {near} GROUP BY g" for x, grid, near in (("fm", _RATIO, 0.0495), ("cov", _COV, 4.95))), "kept_cpgs")
def _(spark, sf):
    sites = ad.nested_cpgs(spark, sf).select(F.explode("cpgs").alias("c")).select("c.fm", F.col("c.cov").cast("double").alias("cov"))

    def near(x, grid, width):
        points = F.explode(F.array(*[F.lit(g) for g in kernel_grid(*grid)])).alias("g")
        return sites.select(F.lit(x).alias("field"), F.col(x).alias("x"), points).where(F.abs(F.col("x") - F.col("g")) < width)

    return near("fm", CFG.ratio_grid, 0.0495).unionByName(near("cov", CFG.cov_grid, 4.95)).groupBy("field", "g").agg(F.count("*").alias("n"))


def _density(x: str, g: str, grid: list[float], h: float) -> str:
    import math

    terms = f"list_transform({x}, lambda v: exp(-(({g} - v) / {h}) * (({g} - v) / {h}) / 2))"
    return even_sql(f"({_TOTAL.format(terms)} / (len({x}) * {h * math.sqrt(2 * math.pi)!r}))", 4)


_GRIDS = {x: (_RATIO, CFG.ratio_bandwidth) if x.endswith("_fm") else (_COV, CFG.cov_bandwidth) for x in fe.ARRAYS}


@query("kernel_density", " UNION ALL ".join(f"SELECT {K}, '{x}' AS field, i AS point, {_density(x, f'{grid}[i + 1]', grid, h)} AS density FROM {_LISTS}, (SELECT CAST(unnest(range({len(grid)})) AS INTEGER) AS i)" for x, (grid, h) in _GRIDS.items()), "kept_cpgs", "reads")
def _(spark, sf):
    df = fe.cpg_distances(fe.array_fields(ad.regions_w_arrays(spark, sf)))
    for x, (grid, h) in _GRIDS.items():
        df = fe.with_density(df, x, grid, h)
    each = F.explode(F.array(*[F.struct(F.lit(x).alias("field"), F.col(f"{x}_kd").alias("kd")) for x in fe.ARRAYS])).alias("d")
    return df.select(*rg.K, each).select(*rg.K, "d.field", F.posexplode("d.kd").alias("point", "density"))


_EXPANDED = ", ".join(f"max(CASE WHEN i = {i + 1} THEN pos END) AS pos_{i}" for i in range(9))


@query("expand_array_columns", f"SELECT {K}, {_EXPANDED} FROM (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY pos) AS i FROM kept_cpgs) GROUP BY {K}", "kept_cpgs")
def _(spark, sf):
    df = ad.nested_cpgs(spark, sf).select(*rg.K, F.transform("cpgs", lambda x: x["pos"]).alias("pos"))
    return fe.expand_array_columns(df, "pos", 9)


def features(spark, sf) -> DataFrame:
    return fe.build_features(ad.kept(ad.labelled_regions(spark, sf)), CFG, ad.kept)


def _features_sql() -> str:
    texts = ", ".join(f"array_to_string(list_transform({x}, lambda v: CAST(round(v * {scale}) AS BIGINT)), ',') AS {x}" for x, scale in (("cpg_cov", 1), ("cpg_fm", 1000), ("read_fm", 1000), ("cpg_dist", 1)))
    densities = ", ".join(f"{_density(x, str(g), grid, h)} AS {x}_kd_{i}" for x, (grid, h) in _GRIDS.items() for i, g in enumerate(grid))
    chromosomes = ", ".join(f"CASE WHEN chr = {i} THEN 1 ELSE 0 END AS chr_{i}" for i in range(1, 23))
    seq = f"SELECT {K}, string_agg(CAST(CAST(round(x * 10000) AS BIGINT) AS VARCHAR), ',' ORDER BY pos) AS cpg_directional_fm FROM dir GROUP BY {K}"
    return f"""SELECT * FROM (SELECT {K}, region_nb_cpg, nb_cpg_found, nb_reads, {texts}, {_MOMENTS}, {densities}, {chromosomes} FROM {_MEANS})
      LEFT JOIN (SELECT {K}, read_asm_effect, wilcoxon_pvalue, corrected_wilcoxon_pvalue, total_sig_cpgs, consecutive_sig_cpgs, asm, asm_not_corrected FROM unique_labels) USING ({K})
      LEFT JOIN (SELECT {K}, approx_asm, reads_asm_effect FROM ({_APPROX})) USING ({K}) LEFT JOIN ({seq}) USING ({K}) LEFT JOIN ({_MATRIX}) USING ({K})"""


def shown(df: DataFrame) -> DataFrame:
    """A feature table with its arrays as text."""
    matrix = F.array_join(F.transform("cpgs_w_padding", lambda r: F.array_join(F.transform(r, lambda x: x.cast("string")), ",")), ";").alias("matrix")
    texts = {"cpg_cov": 1, "cpg_fm": 1000, "read_fm": 1000, "cpg_dist": 1, "cpg_directional_fm": 10000}
    return df.select(*[c for c in df.columns if c not in texts and c != "cpgs_w_padding"], *[ints(c, k).alias(c) for c, k in texts.items()], matrix)


@query("build_features", _features_sql(), "kept_cpgs", "reads", "unique_labels", "dir", "group_counts", "halves", "rcalls")
def _(spark, sf):
    return shown(features(spark, sf))


# --- sequence models


@query("flatten_observations", f"SELECT {K}, row_number() OVER (PARTITION BY {K} ORDER BY pos) - 1 AS idx, x FROM dir", "dir")
def _(spark, sf):
    return hmm.flatten_observations(ad.sequences(spark, sf), "cpg_directional_fm", rg.K)


#: A fixed model of three states for decoding.
MODEL = {"k": 3, "start": [0.5, 0.3, 0.2], "trans": [[0.8, 0.15, 0.05], [0.1, 0.8, 0.1], [0.05, 0.15, 0.8]], "mean": [0.1, 0.4, 0.7], "var": [0.02, 0.02, 0.03]}


def _viterbi_sql() -> str:
    """Decoding by a recursive table: best log-probability of each state, and the path that led there."""
    import math

    m = MODEL
    emit = [f"({-0.5 * math.log(2 * math.pi * m['var'][j])!r} - (x - {m['mean'][j]}) * (x - {m['mean'][j]}) / {2 * m['var'][j]!r})" for j in range(3)]
    base = ", ".join(f"{math.log(m['start'][j])!r} + {emit[j]} AS v{j}, '{j}' AS p{j}" for j in range(3))
    cand = lambda i, j: f"v{i} + {math.log(m['trans'][i][j])!r}"
    best = lambda j: f"greatest({', '.join(cand(i, j) for i in range(3))})"
    path = lambda j: "CASE " + " ".join(f"WHEN {cand(i, j)} = {best(j)} THEN p{i}" for i in range(3)) + f" END || ',{j}'"
    step = ", ".join(f"{best(j)} + {emit[j]}, {path(j)}" for j in range(3))
    return f"""SELECT {K}, CASE WHEN v0 = greatest(v0, v1, v2) THEN p0 WHEN v1 = greatest(v0, v1, v2) THEN p1 ELSE p2 END AS path FROM (
      WITH RECURSIVE o AS (SELECT {K}, x, row_number() OVER (PARTITION BY {K} ORDER BY pos) AS i, count(*) OVER (PARTITION BY {K}) AS n FROM dir),
      w AS (SELECT {K}, i, n, {base} FROM o WHERE i = 1 UNION ALL SELECT {', '.join('w.' + c for c in K.split(', '))}, o.i, w.n, {step} FROM w JOIN o USING ({K}) WHERE o.i = w.i + 1)
      SELECT * FROM w WHERE i = n)"""


@query("hmm_decode", _viterbi_sql(), "dir")
def _(spark, sf):
    return hmm.hmm_decode(ad.sequences(spark, sf), "cpg_directional_fm", MODEL).select(*rg.K, ints("hidden_states").alias("path"))


def _state_sql() -> str:
    cols = []
    for i in range(3):
        cols.append(f"count(*) FILTER (WHERE s = {i}) AS state_{i}_count, {even_sql(f'(count(*) FILTER (WHERE s = {i}) / count(*))', 4)} AS state_{i}_prop")
        for j in range(3):
            here, left = f"count(*) FILTER (WHERE s = {i} AND nx = {j})", f"count(*) FILTER (WHERE s = {i} AND nx IS NOT NULL)"
            cols.append(f"{here} AS trans_{i}_{j}_count, CASE WHEN {left} = 0 THEN 0 ELSE {even_sql(f'({here} / {left})', 4)} END AS trans_{i}_{j}_prob")
    cols.append("CAST(max(CASE WHEN i = 1 THEN s END) AS INTEGER) AS start_state, CAST(max(CASE WHEN nx IS NULL THEN s END) AS INTEGER) AS end_state, count(*) FILTER (WHERE nx <> s) AS n_changes")
    entropy = " + ".join(f"CASE WHEN count(*) FILTER (WHERE s = {i}) = 0 THEN 0 ELSE -(count(*) FILTER (WHERE s = {i}) / count(*)) * ln(count(*) FILTER (WHERE s = {i}) / count(*)) END" for i in range(3))
    cols.append(f"{even_sql(f'({entropy})', 4)} AS state_entropy")
    dwell = ", ".join(f"{even_sql(f'coalesce(avg(n) FILTER (WHERE s = {i}), 0)', 4)} AS dwell_{i}_mean, {even_sql(f'coalesce(var_pop(n) FILTER (WHERE s = {i}), 0)', 4)} AS dwell_{i}_var" for i in range(3))
    runs = f"SELECT {K}, s, count(*) AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY {K}, s ORDER BY i) AS g FROM states) GROUP BY {K}, s, g"
    return f"SELECT * FROM (SELECT {K}, {', '.join(cols)} FROM (SELECT *, lead(s) OVER (PARTITION BY {K} ORDER BY i) AS nx FROM states) GROUP BY {K}) JOIN (SELECT {K}, {dwell} FROM ({runs}) GROUP BY {K}) USING ({K})"


query("hmm_state_features", _state_sql(), "states")(lambda spark, sf: hmm.hmm_state_features(ad.states(spark, sf), "states", 3).drop("states", "label", "cpg_directional_fm"))


def training_table(spark, sf) -> DataFrame:
    """Features, labels and state features of the regions that have a sequence, with the dataset."""
    df = features(spark, sf).where("cpg_directional_fm IS NOT NULL")
    return hmm.hmm_features_table(df.withColumn("states", ad.cuts("cpg_directional_fm")), "states", 3, CFG).drop("states")


@query("hmm_features_table", f"SELECT *, {_DATASET} AS dataset FROM ({_features_sql()}) JOIN ({_state_sql()}) USING ({K})", "kept_cpgs", "reads", "unique_labels", "dir", "group_counts", "halves", "rcalls", "states")
def _(spark, sf):
    return shown(training_table(spark, sf))


def training_sequences(spark, sf) -> DataFrame:
    return rp.split_by_sample_list(ad.sequences(spark, sf), CFG.datasets).where("dataset = 'TRAINING'").select("cpg_directional_fm").persist()


def _fitted(variational: bool):
    def run(spark, sf):
        df = training_sequences(spark, sf)
        m = hmm.hmm_fit(df, "cpg_directional_fm", CFG.states, CFG.iterations, CFG.restarts, variational=variational)
        df.unpersist()
        rows = [(i, float(m["mean"][i]), float(m["var"][i]), float(m["start"][i])) for i in range(CFG.states)]
        return spark.createDataFrame(rows, "state int, mean double, variance double, start double")

    return run


query("hmm_fit")(_fitted(False))
query("hmm_fit_variational")(_fitted(True))


def _score_sql() -> str:
    """The forward pass by a recursive table: each state's share and the log-likelihood so far."""
    import math

    m = MODEL
    density = [f"(exp(-(x - {m['mean'][j]}) * (x - {m['mean'][j]}) / {2 * m['var'][j]!r}) / {math.sqrt(2 * math.pi * m['var'][j])!r})" for j in range(3)]
    base = ", ".join(f"{m['start'][j]} * {density[j]} AS r{j}" for j in range(3))
    step = ", ".join(f"({' + '.join(f'a{i} * {m['trans'][i][j]}' for i in range(3))}) * {density[j]} AS r{j}" for j in range(3))
    scaled = "r0 / (r0 + r1 + r2) AS a0, r1 / (r0 + r1 + r2) AS a1, r2 / (r0 + r1 + r2) AS a2"
    keys = ", ".join("w." + c for c in K.split(", "))
    return f"""SELECT {R('sum(ll)', 4)} AS loglik, CAST(sum(n) AS BIGINT) AS n FROM (
      WITH RECURSIVE o AS (SELECT {K}, x, row_number() OVER (PARTITION BY {K} ORDER BY pos) AS i, count(*) OVER (PARTITION BY {K}) AS n FROM dir),
      w AS (SELECT {K}, i, n, {scaled}, ln(r0 + r1 + r2) AS ll FROM (SELECT *, {base} FROM o WHERE i = 1)
        UNION ALL SELECT {K}, i, n, {scaled}, ll + ln(r0 + r1 + r2) FROM (SELECT {keys}, o.i, w.n, ll, {step} FROM w JOIN o USING ({K}) WHERE o.i = w.i + 1))
      SELECT ll, n FROM w WHERE i = n)"""


@query("hmm_score", _score_sql(), "dir")
def _(spark, sf):
    return hmm.hmm_score(ad.sequences(spark, sf), "cpg_directional_fm", MODEL).select(half_away(F.col("loglik"), 4).alias("loglik"), "n")


@query("hmm_model_selection")
def _(spark, sf):
    df = training_sequences(spark, sf)
    out = hmm.hmm_model_selection(df, "cpg_directional_fm", list(range(1, 11)), CFG.iterations, CFG.restarts)
    df.unpersist()
    return out


@query("hmm_run_log")
def _(spark, sf):
    df = training_sequences(spark, sf)
    m = hmm.hmm_fit(df, "cpg_directional_fm", CFG.states, CFG.iterations, CFG.restarts)
    df.unpersist()
    path = io.scratch(spark)
    for _ in range(2):  # a second try of a run adds no row
        io.append_table(hmm.hmm_run_log(spark, m), path, f"hmm of {m['k']} states")
    return io.read_appended(spark, path)


@query("pad_sequences", f"SELECT {K}, string_agg(CAST(CAST(round(coalesce(x, 0) * 10000) AS BIGINT) AS VARCHAR), ',' ORDER BY j) AS padded FROM (SELECT DISTINCT {K}, unnest(range(1, 11)) AS j FROM dir) LEFT JOIN (SELECT {K}, x, row_number() OVER (PARTITION BY {K} ORDER BY pos) AS j FROM dir) USING ({K}, j) GROUP BY {K}", "dir")
def _(spark, sf):
    return fe.pad_sequences(ad.sequences(spark, sf), "cpg_directional_fm", 10).select(*rg.K, ints("padded", 10000).alias("padded"))


# --- learning and evaluation

LABEL = "asm_not_corrected"
#: Columns of the training table that are no features: keys, labels, counts of the region, arrays.
APART = [*rg.K, "dataset", "region_nb_cpg", "nb_cpg_found", "nb_reads", "approx_asm", "asm", LABEL, *fe.ARRAYS, "cpg_directional_fm", "cpgs_w_padding"]


def labelled_rows(spark, sf) -> DataFrame:
    return training_table(spark, sf).where(F.col(LABEL).isNotNull())


def learning_rows(spark, sf) -> tuple[DataFrame, list[str]]:
    """The labelled rows of the training table, as a table, and its features: all columns but those apart and those that define the label."""
    rows = labelled_rows(spark, sf)
    feats = [c for c in rows.columns if c not in APART and c not in learn.LEAKS]
    return ad.kept(rows.select(*rg.K, "dataset", LABEL, *feats)), feats


def of(rows: DataFrame, *datasets: str) -> DataFrame:
    return rows.where(F.col("dataset").isin(*datasets))


_LEARNED = f"({_features_sql()}) JOIN ({_state_sql()}) USING ({K}) WHERE {LABEL} IS NOT NULL"
_LEARN_CTES = ("kept_cpgs", "reads", "unique_labels", "dir", "group_counts", "halves", "rcalls", "states")


@query("training_support", f"SELECT {_DATASET} AS dataset, {LABEL} AS label, count(*) AS n FROM {_LEARNED} GROUP BY ALL", *_LEARN_CTES)
def _(spark, sf):
    # no table of features between: Spark leaves out the columns that a count of the same rows doesn't need
    return labelled_rows(spark, sf).groupBy("dataset", F.col(LABEL).alias("label")).agg(F.count("*").alias("n"))


def report_of(df: DataFrame) -> DataFrame:
    return rp.classification_report(rp.confusion_matrix(df, LABEL, "pred"))


@query("rf_fit")
def _(spark, sf):
    rows, feats = learning_rows(spark, sf)
    return report_of(learn.predicted(learn.rf_fit(of(rows, "TRAINING"), feats, LABEL), of(rows, "TESTING")))


@query("gbt_fit")
def _(spark, sf):
    rows, feats = learning_rows(spark, sf)
    model = learn.gbt_fit(of(rows, "TRAINING"), feats, LABEL, {"n_estimators": 20, "max_depth": 3, "reg_alpha": 0.01}, ad.kept)
    return report_of(model.predicted(of(rows, "TESTING")))


@query("lr_fit")
def _(spark, sf):
    """The whole grid of strengths and penalties, each point with its report on the validation rows."""
    rows, feats = learning_rows(spark, sf)
    found = learn.lr_search(of(rows, "TRAINING"), of(rows, "VALIDATION"), feats, LABEL, CFG.lr_strengths, CFG.lr_penalties)
    io.discard(rows)
    return spark.createDataFrame([(c, p, float(f1), int(m.passes), sum(1 for b in m.coefficients[1:] if b)) for (c, p), m, f1 in found], "c double, penalty string, sum_f1 double, passes int, n_features int")


def searched(rows: DataFrame, feats: list[str], kind: str) -> list[tuple[dict, float]]:
    return learn.random_search(of(rows, "TRAINING"), of(rows, "VALIDATION"), kind, feats, LABEL, learn.GRIDS[kind], CFG.draws, threads=8, keep=ad.kept)


@query("random_search")
def _(spark, sf):
    rows, feats = learning_rows(spark, sf)
    found = [(k, str(sorted(p.items())), float(s)) for k in ("rf", "gbt") for p, s in searched(rows, feats, k)]
    io.discard(rows)
    return spark.createDataFrame(found, "model string, params string, sum_f1 double")


@query("refit_and_test")
def _(spark, sf):
    """One row a model of the table of results: the best point found, refitted, its confusion and report on the test rows."""
    rows, feats = learning_rows(spark, sf)
    path = io.scratch(spark)

    def refitted(k: str) -> DataFrame:
        best = searched(rows, feats, k)[0][0]
        return learn.refit_and_test(of(rows, "TRAINING", "VALIDATION"), of(rows, "TESTING"), k, feats, LABEL, best, keep=ad.kept, path=io.scratch(spark))[1]

    # a boosted model is refitted tree after tree, so forests grow beside it
    with ThreadPoolExecutor(2) as pool:
        for k, row in zip(("gbt", "rf"), pool.map(refitted, ("gbt", "rf"))):
            io.append_table(row, path, f"{k} with {CFG.draws} draws")
    io.discard(rows)
    return io.read_appended(spark, path)


_CM = "SELECT count(*) FILTER (WHERE quality = 0 AND toxic = 0) AS tn, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS fp, count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS fn, count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tp FROM labels"


@query("confusion_matrix", _CM)
def _(spark, sf):
    return rp.confusion_matrix(ad.table(spark, sf, "labels"), "quality", "toxic")


def _report_sql(cm: str) -> str:
    r = lambda a, b: f"(CASE WHEN {b} = 0 THEN 0 ELSE {a} / ({b}) END)"
    q = f"SELECT *, {r('tn', 'tn + fn')} AS p0, {r('tn', 'tn + fp')} AS r0, {r('tp', 'tp + fp')} AS p1, {r('tp', 'tp + fn')} AS r1, tn + fp AS s0, tp + fn AS s1, tn + fp + tp + fn AS s FROM (SELECT tn::DOUBLE AS tn, fp::DOUBLE AS fp, fn::DOUBLE AS fn, tp::DOUBLE AS tp FROM ({cm}))"
    q = f"SELECT *, {r('p0 * r0 * 2', 'p0 + r0')} AS f0, {r('p1 * r1 * 2', 'p1 + r1')} AS f1, {r('(tn + tp)', 's')} AS acc FROM ({q})"
    w = lambda a, b: r(f"({a} * s0 + {b} * s1)", "s")
    rows = [("0", "p0", "r0", "f0", "s0"), ("1", "p1", "r1", "f1", "s1"), ("accuracy", "acc", "acc", "acc", "s"), ("macro avg", "(p0 + p1) / 2", "(r0 + r1) / 2", "(f0 + f1) / 2", "s"), ("weighted avg", w("p0", "p1"), w("r0", "r1"), w("f0", "f1"), "s"), ("sum f1", "NULL::DOUBLE", "NULL::DOUBLE", "f0 + f1", "s")]
    return " UNION ALL ".join(f"SELECT '{n}' AS class, {R(p, 3)} AS precision, {R(rc, 3)} AS recall, {R(f, 3)} AS f1, CAST({s} AS BIGINT) AS support FROM ({q})" for n, p, rc, f, s in rows)


@query("classification_report", _report_sql(_CM))
def _(spark, sf):
    return rp.classification_report(rp.confusion_matrix(ad.table(spark, sf, "labels"), "quality", "toxic"))


BASE_LABELS = ["asm", "asm_not_corrected"]


def _base(label: str) -> str:
    of = lambda a, b: f"count(*) FILTER (WHERE {label} = {a} AND approx_asm = {b})"
    return f"SELECT {of(0, 0)} AS tn, {of(0, 1)} AS fp, {of(1, 0)} AS fn, {of(1, 1)} AS tp FROM unique_labels JOIN ({_APPROX}) USING ({K}) WHERE sample = 'S2'"


@query("baseline_eval", " UNION ALL ".join(f"SELECT '{c}' AS label, * FROM ({_report_sql(_base(c))})" for c in BASE_LABELS), "unique_labels", "group_counts")
def _(spark, sf):
    df = rp.split_by_sample_list(rg.unique_label_group(ad.labels(spark, sf)), CFG.datasets).where("dataset = 'TESTING'").select(*rg.K, *BASE_LABELS)
    df = df.join(st.approx_asm(ad.halves(spark, sf), CFG).select(*rg.K, "approx_asm"), rg.K)
    return rp.baseline_eval(df, BASE_LABELS, "approx_asm")


_COMPARE = f"SELECT count(*) AS n_loci, count(label) AS n_evaluated, count(*) FILTER (WHERE label = 1) AS n_evaluated_positive, count(predicted) AS n_modelled, count(*) FILTER (WHERE predicted IS NOT NULL AND label IS NULL) AS n_model_only, count(*) FILTER (WHERE predicted = 1 AND label IS NULL) AS n_model_only_positive FROM (SELECT CASE WHEN locus % 3 = 0 THEN max_label END AS label, CASE WHEN max_score IS NOT NULL THEN CAST(max_score > 15 AS INTEGER) END AS predicted FROM ({_LOCUS}))"


@query("locus_comparison_metrics", _COMPARE, "regions_cpg")
def _(spark, sf):
    df = ge.locus_right_range_join(scored(spark, sf), loci(spark, sf), TILE)
    df = df.select("locus", F.when(F.col("locus") % 3 == 0, F.col("max_label")).alias("label"), F.when(F.col("max_score").isNotNull(), (F.col("max_score") > 15).cast("int")).alias("predicted"))
    return rp.locus_comparison_metrics(df)
