"""The given tables as the inputs of the operators, in Spark and as SQL.

An order is a sequencing read, an order line one call of a site, 150 orders one
tile of 250 positions; every fourth tile has a planted difference of alleles.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.exprs import fisher_p, half_away, half_away_sql
from ..operators import features as fe
from ..operators import genome as ge
from ..operators import regions as rg
from ..operators import stats as st
from ..sources import io

CFG = Config(block=2_000)
TILE, BLOCK = CFG.tile, CFG.block


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: A table between two stages that several branches read; what a returned DataFrame reads can't be deleted before it is.
kept = io.kept


def calls(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").selectExpr(
        "concat('S', l_orderkey % 3) AS sample",
        "cast((l_orderkey div 150) % 22 + 1 AS int) AS chr",
        "((l_orderkey div 150) div 22) * 250 + 1 + 30 * l_linenumber AS pos",
        "l_orderkey AS read_id",
        "CASE WHEN l_orderkey % 10 = 0 THEN NULL WHEN (l_orderkey div 3) % 2 = 0 THEN 'REF' ELSE 'ALT' END AS allele",
        "1 AS cov",
        "CASE WHEN round(l_discount * 100) <= CASE WHEN (l_orderkey div 150) % 4 <> 0 THEN 5 WHEN (l_orderkey div 3) % 2 = 0 THEN 2 ELSE 7 END THEN 1 ELSE 0 END AS meth",
        "l_orderkey div 150 AS tile",
    )


#: Calls that a task sorts and compares.
TASK_CALLS = 1 << 18


def call_partitions(spark, sf) -> int:
    """Partitions of ``TASK_CALLS`` calls each, those of a shuffle at least; the number of calls stands in the files' footers."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table(spark, sf, "lineitem").count() // TASK_CALLS))


def lengths(spark, sf) -> DataFrame:
    return calls(spark, sf).groupBy("chr").agg((F.max("pos") + 20).alias("chr_length"))


def offsets(spark, sf) -> DataFrame:
    return ge.chr_offsets(lengths(spark, sf))


def tiles(spark, sf) -> DataFrame:
    return ge.tile_genome(offsets(spark, sf), TILE, BLOCK)


def regions(spark, sf) -> DataFrame:
    return ge.range_join_count_cpg(tiles(spark, sf), calls(spark, sf).select("chr", "pos").distinct(), CFG.min_ref_cpg, TILE)


def region_calls(spark, sf, partitions: int | None = None) -> DataFrame:
    return ge.point_in_region_join(calls(spark, sf), regions(spark, sf), TILE, partitions=partitions)


def blacklist(spark, sf) -> DataFrame:
    return table(spark, sf, "supplier").selectExpr("cast(s_suppkey % 22 + 1 AS int) AS chr", "s_suppkey * 7 AS chr_start", "s_suppkey * 7 + CASE WHEN s_suppkey % 2 = 0 THEN 30 ELSE 600 END AS chr_end")


def stored_calls(spark, sf) -> DataFrame:
    """The calls of regions as a table in buckets by region, for sites, reads and labels alike: it is joined and written once."""
    return io.bucketed(region_calls(spark, sf).select(*rg.K, "region_nb_cpg", "pos", "read_id", "allele", "cov", "meth", "tile"), rg.K)


def genotyped(spark, sf) -> DataFrame:
    return genotyped_of(region_calls(spark, sf))


def genotyped_of(calls: DataFrame) -> DataFrame:
    rows = calls.where("allele IS NOT NULL").withColumn("snp_pos", F.col("region_inf") + 100)
    names = F.when(F.col("tile") % 5 == 0, F.array(F.concat(F.lit("rs"), "tile"), F.concat(F.lit("rt"), "tile"))).otherwise(F.array(F.concat(F.lit("rs"), "tile")))
    return rows.withColumn("snp_id", F.explode(names))


def dealt_genotyped(spark, sf) -> DataFrame:
    """``genotyped`` by SNP in partitions by the number of calls: groupings and joins by SNP need no exchange, and a task's share doesn't grow with the input."""
    n = call_partitions(spark, sf)
    return genotyped_of(region_calls(spark, sf, n)).repartition(n, *rg.SNP)


def snp_cpg(spark, sf) -> DataFrame:
    return allele_counts(genotyped(spark, sf))


def allele_counts(calls: DataFrame) -> DataFrame:
    of = lambda a, c: F.sum(F.when(F.col("allele") == a, F.col(c)).otherwise(0))
    rows = calls.groupBy(*rg.SNP, "pos").agg(of("REF", "cov").alias("ref_cov"), of("REF", "meth").alias("ref_meth"), of("ALT", "cov").alias("alt_cov"), of("ALT", "meth").alias("alt_meth"))
    p = fisher_p(F.col("ref_meth"), F.col("ref_cov") - F.col("ref_meth"), F.col("alt_meth"), F.col("alt_cov") - F.col("alt_meth"))
    return rows.withColumn("fisher_pvalue", half_away(p, 6))


#: Coverage limits of a single allele's sites in these tables.
LO, HI = 3, 60


def cpg_w_snp(spark, sf) -> DataFrame:
    return rg.region_snp_cpg_nest(snp_cpg(spark, sf), LO, HI, CFG.min_cpg)


def allele_reads(spark, sf) -> DataFrame:
    return rg.read_allele_methylation(genotyped(spark, sf))


def regions_and_snps(spark, sf, rows: DataFrame | None = None) -> DataFrame:
    """Both branches start from the genotyped calls, a table in buckets by the join's keys, so that nothing after it is shuffled.

    Those of ``stored_calls`` are in buckets by region: only the two nested branches, a row a region and SNP, meet by an exchange.
    """
    if rows is None:
        rows = io.bucketed(genotyped(spark, sf).select(*rg.SNP, "pos", "read_id", "allele", "cov", "meth"), rg.SNP)
    else:
        rows = genotyped_of(rows)
    sites = rg.region_snp_cpg_nest(allele_counts(rows), LO, HI, CFG.min_cpg)
    return rg.join_snp_arrays(sites, rg.reads_allele_pivot(rg.read_allele_methylation(rows)))


def cpgs(spark, sf) -> DataFrame:
    return rg.cpg_fm_cov(region_calls(spark, sf), CFG.min_cov, CFG.max_cov)


def nested_cpgs(spark, sf) -> DataFrame:
    return rg.region_cpgs_nest(cpgs(spark, sf), CFG.min_cpg)


def reads(spark, sf) -> DataFrame:
    return rg.read_methylation_arrays(region_calls(spark, sf))


def regions_w_arrays(spark, sf, rows: DataFrame | None = None) -> DataFrame:
    """Sites and reads start from the calls of regions, a table in buckets by region, so that nothing after it is shuffled."""
    if rows is None:
        rows = io.bucketed(region_calls(spark, sf).select(*rg.K, "region_nb_cpg", "pos", "read_id", "cov", "meth"), rg.K)
    sites = rg.region_cpgs_nest(rg.cpg_fm_cov(rows, CFG.min_cov, CFG.max_cov), CFG.min_cpg)
    return rg.join_cpg_read_arrays(sites, rg.region_reads_nest(rg.read_methylation_arrays(rows)))


def labels(spark, sf, rows: DataFrame | None = None) -> DataFrame:
    return st.evaluate_asm(regions_and_snps(spark, sf, rows), CFG, kept)


def region_labels(spark, sf, rows: DataFrame | None = None) -> DataFrame:
    """The labels in buckets by region: their grouping and their join with regions need no exchange."""
    return rg.unique_label_group(io.bucketed(labels(spark, sf, rows), rg.K))


def labelled_regions(spark, sf) -> DataFrame:
    """Nested regions with their labels, both from one table of calls."""
    rows = stored_calls(spark, sf)
    return rg.label_left_join(regions_w_arrays(spark, sf, rows), region_labels(spark, sf, rows))


def extremes_of(nested: DataFrame) -> DataFrame:
    return fe.read_extremes_topk(fe.explode_reads(nested), CFG.read_share, CFG.extreme_reads, CFG.min_reads)


def extremes(spark, sf) -> DataFrame:
    return extremes_of(regions_w_arrays(spark, sf))


def halves(spark, sf) -> DataFrame:
    return fe.read_split_halves(extremes(spark, sf))


def planted(df: DataFrame) -> DataFrame:
    """df of regions with label: 1 where the tables have a planted difference."""
    return df.withColumn("label", (((F.col("region_inf") - 1) / TILE * 22 + F.col("chr") - 1).cast("long") % 4 == 0).cast("int"))


def sequences(spark, sf) -> DataFrame:
    return planted(st.directional_fm_sequence(st.cpg_group_counts(halves(spark, sf))))


def cuts(arr: str):
    """States by fixed cuts: 0 below 0.2, 1 below 0.5, else 2."""
    return F.transform(arr, lambda x: F.when(x < 0.2, 0).when(x < 0.5, 1).otherwise(2))


def states(spark, sf) -> DataFrame:
    return sequences(spark, sf).withColumn("states", cuts("cpg_directional_fm"))


# --- the same as SQL

K = "sample, chr, region_inf, region_sup, clustering_index"
SNP = K + ", snp_id, snp_pos"


def fisher_sql(source: str, a: str, b: str, c: str, d: str) -> str:
    """SELECT source.*, p: the exact test, by a sum over the tables of the same margins."""
    return f"""
    SELECT q.* EXCLUDE (a_, b_, c_, d_), CASE WHEN a_ + b_ = 0 OR c_ + d_ = 0 OR a_ + c_ = 0 OR b_ + d_ = 0 THEN 1.0 ELSE least(1.0, (
      SELECT sum(e) FROM (
        SELECT exp(lgamma(a_+b_+1) + lgamma(c_+d_+1) + lgamma(a_+c_+1) + lgamma(b_+d_+1) - lgamma(a_+b_+c_+d_+1)
          - lgamma(x+1) - lgamma(a_+b_-x+1) - lgamma(a_+c_-x+1) - lgamma(d_-a_+x+1)) AS e, x
        FROM (SELECT unnest(range(greatest(0, a_-d_), least(a_+b_, a_+c_) + 1)) AS x))
      WHERE e <= (1 + 1e-7) * exp(lgamma(a_+b_+1) + lgamma(c_+d_+1) + lgamma(a_+c_+1) + lgamma(b_+d_+1) - lgamma(a_+b_+c_+d_+1)
          - lgamma(a_+1) - lgamma(b_+1) - lgamma(c_+1) - lgamma(d_+1)))) END AS p
    FROM (SELECT *, CAST({a} AS BIGINT) AS a_, CAST({b} AS BIGINT) AS b_, CAST({c} AS BIGINT) AS c_, CAST({d} AS BIGINT) AS d_ FROM {source}) q"""


def rank_p_sql(source: str, n1: str, n2: str, u: str, ties: str) -> str:
    """SELECT source.*, p: the two-sided rank-sum test, stated apart from the library.

    The normal tail is Simpson's rule over the density; without ties, and with
    eight values or fewer in a group, the orders with each statistic are counted
    by sums over lists, one factor of their generating function after another.
    """
    return f"""
    SELECT q.* EXCLUDE (n1_, n2_, u_, t_, m_, small, spread, z), CASE WHEN n1_ = 0 OR n2_ = 0 THEN NULL WHEN small THEN least(1e0, 2 * tail) WHEN NOT spread > 1e-12 THEN 1e0
      ELSE least(1e0, greatest(0e0, 1 - 2 * z / 3000 / sqrt(2 * pi()) * list_sum(list_transform(range(1001), lambda i: CASE WHEN i = 0 OR i = 1000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(z * i / 1000, 2) / 2))))) END AS p
    FROM (SELECT *, greatest(0e0, (abs(u_ - n1_ * n2_ / 2) - 0.5) / sqrt(spread)) AS z FROM (
      SELECT *, t_ = 0 AND least(n1_, n2_) BETWEEN 1 AND 8 AS small, CAST(least(u_, n1_ * n2_ - u_) AS BIGINT) AS m_, n1_ * n2_ / 12 * (n1_ + n2_ + 1 - CASE WHEN n1_ + n2_ > 1 THEN t_ / ((n1_ + n2_) * (n1_ + n2_ - 1)) ELSE 2 END) AS spread
      FROM (SELECT *, CAST({n1} AS DOUBLE) AS n1_, CAST({n2} AS DOUBLE) AS n2_, CAST({u} AS DOUBLE) AS u_, CAST({ties} AS DOUBLE) AS t_ FROM {source}))) q
    LEFT JOIN (
      WITH RECURSIVE w AS (
        SELECT a, b, m, 0 AS i, 1e0 AS orders, list_transform(range(m + 1), lambda k: CASE WHEN k = 0 THEN 1e0 ELSE 0e0 END) AS c FROM (
          SELECT DISTINCT CAST(least({n1}, {n2}) AS BIGINT) AS a, CAST(greatest({n1}, {n2}) AS BIGINT) AS b, CAST(least({u}, {n1} * {n2} - {u}) AS BIGINT) AS m FROM {source} WHERE {ties} = 0 AND least({n1}, {n2}) BETWEEN 1 AND 8)
        UNION ALL
        SELECT a, b, m, i + 1, orders * (b + i + 1) / (i + 1), list_transform(range(m + 1), lambda k: list_sum(list_transform(range(0, k // (i + 1) + 1), lambda j: c[k - j * (i + 1) + 1] - CASE WHEN k - j * (i + 1) >= b + i + 1 THEN c[k - j * (i + 1) - b - i] ELSE 0 END)))
        FROM w WHERE i < a)
      SELECT a, b, m, list_sum(c) / orders AS tail FROM w WHERE i = a) e ON q.small AND e.a = least(q.n1_, q.n2_) AND e.b = greatest(q.n1_, q.n2_) AND e.m = q.m_"""


def even_sql(x: str, digits: int) -> str:
    return f"round_even({x} * 1e{digits}, 0) / 1e{digits}"


R = half_away_sql

CTES: dict[str, str] = {
    "calls": """SELECT 'S' || (l_orderkey % 3) AS sample, (l_orderkey // 150) % 22 + 1 AS chr, ((l_orderkey // 150) // 22) * 250 + 1 + 30 * l_linenumber AS pos,
      l_orderkey AS read_id, CASE WHEN l_orderkey % 10 = 0 THEN NULL WHEN (l_orderkey // 3) % 2 = 0 THEN 'REF' ELSE 'ALT' END AS allele, 1 AS cov,
      CASE WHEN round(l_discount * 100) <= CASE WHEN (l_orderkey // 150) % 4 <> 0 THEN 5 WHEN (l_orderkey // 3) % 2 = 0 THEN 2 ELSE 7 END THEN 1 ELSE 0 END AS meth,
      l_orderkey // 150 AS tile FROM lineitem""",
    "lengths": "SELECT chr, max(pos) + 20 AS chr_length FROM calls GROUP BY chr",
    "offsets": "SELECT chr, chr_length, CAST(coalesce(sum(chr_length) OVER (ORDER BY chr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS absolute_nucleotide_pos FROM lengths",
    "tiles": f"""SELECT chr, region_inf, region_sup, (region_inf + region_sup) // 2 AS region_center, (o + (region_inf + region_sup) // 2) // {BLOCK} AS clustering_index
      FROM (SELECT chr, absolute_nucleotide_pos AS o, i AS region_inf, least(i + {TILE - 1}, chr_length) AS region_sup FROM (SELECT *, unnest(range(1, chr_length + 1, {TILE})) AS i FROM offsets))""",
    "regions": f"""SELECT t.*, n AS region_nb_cpg FROM tiles t JOIN (SELECT t.chr, t.region_inf, count(*) AS n FROM tiles t JOIN (SELECT DISTINCT chr, pos FROM calls) c
      ON t.chr = c.chr AND c.pos BETWEEN t.region_inf AND t.region_sup GROUP BY ALL) USING (chr, region_inf) WHERE n >= {CFG.min_ref_cpg}""",
    "rcalls": "SELECT c.*, r.region_inf, r.region_sup, r.region_nb_cpg, r.clustering_index FROM calls c JOIN regions r ON c.chr = r.chr AND c.pos BETWEEN r.region_inf AND r.region_sup",
    "blacklist": "SELECT s_suppkey % 22 + 1 AS chr, s_suppkey * 7 AS chr_start, s_suppkey * 7 + CASE WHEN s_suppkey % 2 = 0 THEN 30 ELSE 600 END AS chr_end FROM supplier",
    "genotyped": """SELECT *, region_inf + 100 AS snp_pos, 'rs' || tile AS snp_id FROM rcalls WHERE allele IS NOT NULL
      UNION ALL SELECT *, region_inf + 100, 'rt' || tile FROM rcalls WHERE allele IS NOT NULL AND tile % 5 = 0""",
    "snp_counts": f"""SELECT {SNP}, pos, sum(cov) FILTER (WHERE allele = 'REF') AS rc, sum(meth) FILTER (WHERE allele = 'REF') AS rm, sum(cov) FILTER (WHERE allele = 'ALT') AS ac, sum(meth) FILTER (WHERE allele = 'ALT') AS am FROM genotyped GROUP BY ALL""",
    "snp_filled": f"SELECT {SNP}, pos, coalesce(rc, 0)::BIGINT AS ref_cov, coalesce(rm, 0)::BIGINT AS ref_meth, coalesce(ac, 0)::BIGINT AS alt_cov, coalesce(am, 0)::BIGINT AS alt_meth FROM snp_counts",
    "snp_cpg": f"SELECT * EXCLUDE p, {R('p', 6)} AS fisher_pvalue FROM ({fisher_sql('snp_filled', 'ref_meth', 'ref_cov - ref_meth', 'alt_meth', 'alt_cov - alt_meth')})",
    "cpg_w": f"""SELECT *, {R('alt_meth / alt_cov - ref_meth / ref_cov', 5)} AS effect, count(*) OVER (PARTITION BY {SNP}) AS nb FROM snp_cpg
      WHERE ref_cov >= {LO} AND ref_cov < {HI} AND alt_cov >= {LO} AND alt_cov < {HI}""",
    "cpg_w_snp": f"SELECT * FROM cpg_w WHERE nb >= {CFG.min_cpg}",
    "allele_reads": f"SELECT {SNP}, read_id, allele, {R('sum(meth) / sum(cov)', 5)} AS methyl_perc FROM genotyped GROUP BY {SNP}, read_id, allele",
    "snp_regions": f"SELECT {SNP}, any_value(nb) AS nb_cpg_found_w_snp FROM cpg_w_snp GROUP BY {SNP}",
    "mw_values": f"SELECT {SNP}, methyl_perc AS v, count(*) FILTER (WHERE allele = 'REF') AS a, count(*) FILTER (WHERE allele = 'ALT') AS b FROM allele_reads JOIN snp_regions USING ({SNP}) GROUP BY {SNP}, methyl_perc",
    "mw_sums": f"""SELECT {SNP}, sum(a) AS n1, sum(b) AS n2, sum(a * (below + b / 2.0)) AS u, sum((a + b) * (a + b) * (a + b) - (a + b)) AS ties
      FROM (SELECT *, coalesce(sum(b) OVER (PARTITION BY {SNP} ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM mw_values) GROUP BY {SNP}""",
    "mw": f"""SELECT {SNP}, e AS read_asm_effect, {R('p', 5)} AS wilcoxon_pvalue FROM ({rank_p_sql('mw_sums', 'n1', 'n2', 'u', 'ties')})
      JOIN (SELECT {SNP}, {R(R("avg(methyl_perc) FILTER (WHERE allele = 'ALT') - avg(methyl_perc) FILTER (WHERE allele = 'REF')", 9), 5)} AS e FROM allele_reads GROUP BY {SNP}) USING ({SNP})""",
    "bh_ranks": "SELECT sample, wilcoxon_pvalue AS p, sum(count(*)) OVER (PARTITION BY sample) * wilcoxon_pvalue / sum(count(*)) OVER (PARTITION BY sample ORDER BY wilcoxon_pvalue ROWS UNBOUNDED PRECEDING) AS raw FROM mw WHERE wilcoxon_pvalue IS NOT NULL GROUP BY sample, wilcoxon_pvalue",
    "bh": f"SELECT sample, p, {R('least(1e0, min(raw) OVER (PARTITION BY sample ORDER BY p DESC ROWS UNBOUNDED PRECEDING))', 5)} AS corrected_wilcoxon_pvalue FROM bh_ranks",
    "tested": "SELECT mw.*, corrected_wilcoxon_pvalue FROM mw LEFT JOIN bh ON mw.sample = bh.sample AND mw.wilcoxon_pvalue = bh.p",
    "sig_sites": f"""SELECT {SNP}, pos, CASE WHEN fisher_pvalue < 0.05 AND CASE WHEN read_asm_effect > 0 THEN effect > 0 ELSE effect < 0 END THEN 1 ELSE 0 END AS good,
      row_number() OVER (PARTITION BY {SNP} ORDER BY pos) AS i FROM cpg_w_snp JOIN tested USING ({SNP})""",
    "runs": f"""SELECT {SNP}, max(total) AS total_sig_cpgs, max(CASE WHEN good = 1 THEN n ELSE 0 END) AS consecutive_sig_cpgs FROM (
      SELECT {SNP}, good, g, count(*) AS n, sum(sum(good)) OVER (PARTITION BY {SNP}) AS total FROM (SELECT *, i - row_number() OVER (PARTITION BY {SNP}, good ORDER BY pos) AS g FROM sig_sites) GROUP BY {SNP}, good, g) GROUP BY {SNP}""",
    "evaluated": f"""SELECT {SNP}, read_asm_effect, wilcoxon_pvalue, corrected_wilcoxon_pvalue, CAST(total_sig_cpgs AS BIGINT) AS total_sig_cpgs, CAST(consecutive_sig_cpgs AS BIGINT) AS consecutive_sig_cpgs,
      CASE WHEN corrected_wilcoxon_pvalue <= 0.05 AND abs(read_asm_effect) >= 0.2 AND consecutive_sig_cpgs >= 2 AND total_sig_cpgs >= 3 THEN 1 ELSE 0 END AS asm,
      CASE WHEN wilcoxon_pvalue <= 0.05 AND abs(read_asm_effect) >= 0.2 AND consecutive_sig_cpgs >= 2 AND total_sig_cpgs >= 3 THEN 1 ELSE 0 END AS asm_not_corrected
      FROM tested JOIN runs USING ({SNP})""",
    "unique_labels": f"""SELECT {K}, any_value(read_asm_effect) AS read_asm_effect, any_value(wilcoxon_pvalue) AS wilcoxon_pvalue, any_value(corrected_wilcoxon_pvalue) AS corrected_wilcoxon_pvalue,
      any_value(total_sig_cpgs) AS total_sig_cpgs, any_value(consecutive_sig_cpgs) AS consecutive_sig_cpgs, any_value(asm) AS asm, any_value(asm_not_corrected) AS asm_not_corrected FROM evaluated GROUP BY {K} HAVING count(*) = 1""",
    "cpgs": f"SELECT {K}, region_nb_cpg, pos, CAST(sum(cov) AS BIGINT) AS cov, {R('sum(meth) / sum(cov)', 3)} AS fm FROM rcalls GROUP BY {K}, region_nb_cpg, pos HAVING sum(cov) BETWEEN {CFG.min_cov} AND {CFG.max_cov}",
    "regions_cpg": f"SELECT {K}, region_nb_cpg, count(*) AS nb_cpg_found FROM cpgs GROUP BY ALL HAVING count(*) >= {CFG.min_cpg}",
    "kept_cpgs": f"SELECT cpgs.*, nb_cpg_found FROM cpgs JOIN regions_cpg USING ({K}, region_nb_cpg)",
    "reads": f"SELECT {K}, read_id, {R('sum(meth) / sum(cov)', 3)} AS fm, count(*) AS n FROM rcalls GROUP BY {K}, read_id",
    "ranked": f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY fm DESC, read_id) AS rank_desc, count(*) OVER (PARTITION BY {K}) AS n_ok
      FROM reads JOIN regions_cpg USING ({K}) WHERE n >= ceil(0.5 * nb_cpg_found)) WHERE n_ok >= 20 AND (rank_desc <= 10 OR rank_desc > n_ok - 10)""",
    "halves": f"""SELECT *, CASE WHEN row_number() OVER (PARTITION BY {K} ORDER BY rank_desc) <= ceil(count(*) OVER (PARTITION BY {K}) / 2.0) THEN 'high' ELSE 'low' END AS grp FROM ranked""",
    "group_counts": f"""SELECT {K}, pos - region_inf + 1 AS pos, CAST(coalesce(sum(meth) FILTER (WHERE grp = 'high'), 0) AS BIGINT) AS high_meth, count(*) FILTER (WHERE grp = 'high') AS high_cov,
      CAST(coalesce(sum(meth) FILTER (WHERE grp = 'low'), 0) AS BIGINT) AS low_meth, count(*) FILTER (WHERE grp = 'low') AS low_cov FROM rcalls JOIN (SELECT {K}, read_id, grp FROM halves) USING ({K}, read_id) GROUP BY ALL""",
    "dir": f"SELECT {K}, pos, CASE WHEN high_cov = 0 OR low_cov = 0 THEN 0.0 ELSE {even_sql('(high_meth / high_cov - low_meth / low_cov)', 4)} END AS x FROM group_counts",
    "states": f"""SELECT {K}, pos, x, CASE WHEN x < 0.2 THEN 0 WHEN x < 0.5 THEN 1 ELSE 2 END AS s, row_number() OVER (PARTITION BY {K} ORDER BY pos) AS i,
      CASE WHEN ((region_inf - 1) // {TILE} * 22 + chr - 1) % 4 = 0 THEN 1 ELSE 0 END AS label FROM dir""",
}

_NEEDS = {k: [n for n in CTES if n != k and re.search(rf"\b{n}\b", v)] for k, v in CTES.items()}


def with_ctes(body: str, *names: str) -> str:
    """body behind the common tables that it names, and those that they need."""
    wanted: set[str] = set()

    def take(n: str) -> None:
        if n not in wanted:
            wanted.add(n)
            for m in _NEEDS[n]:
                take(m)

    for n in names:
        take(n)
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n]})" for n in CTES if n in wanted) + "\n" + body
