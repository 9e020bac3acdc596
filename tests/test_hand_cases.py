"""Cases worked out by hand, properties, and fixed-against-source semantics."""

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from regionflow.config import AUTOSOME_LENGTHS, Config
from regionflow.functions import exprs as ex
from regionflow.operators import features as fe
from regionflow.operators import genome as ge
from regionflow.operators import hmm
from regionflow.operators import regions as rg
from regionflow.operators import reports as rp
from regionflow.operators import stats as st
from regionflow.sources import io

KEY = "'S0' AS sample, 1 AS chr, 1L AS region_inf, 250L AS region_sup, 0 AS clustering_index"
SNP = KEY + ", 'rs1' AS snp_id, 101L AS snp_pos"


@pytest.mark.parametrize("table,p", [((8, 2, 1, 5), 0.034965), ((3, 0, 0, 3), 0.1), ((10, 0, 0, 10), 1.0825e-05), ((0, 0, 3, 4), 1.0), ((0, 5, 0, 4), 1.0)])
def test_fisher(spark, table, p):
    df = spark.createDataFrame([table], "a long, b long, c long, d long")
    assert st.fisher_exact(df, "a", "b", "c", "d").first()["fisher_pvalue"] == pytest.approx(p, rel=1e-4)


def test_normal_tail(spark):
    zs = [0.0, 0.5, 1.96, 3.0, 7.0, 7.5, 20.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double").withColumn("p", ex.norm_sf(F.col("z")))
    for r in df.collect():
        assert r["p"] == pytest.approx(0.5 * math.erfc(r["z"] / math.sqrt(2)), rel=1e-9, abs=1e-15)


def test_run_and_sign(spark):
    sites = ", ".join(f"named_struct('pos', {i}L, 'effect', {-0.5 if i != 3 else 0.5}D, 'fisher_pvalue', 0.01D)" for i in range(1, 7))
    df = spark.sql(f"SELECT array({sites}) AS c, 0D AS e")
    df = st.max_consecutive_run(st.sig_cpg_count(df, "c", "e", 0.05), "c", "e", 0.05)
    assert tuple(df.select("total_sig_cpgs", "consecutive_sig_cpgs").first()) == (5, 3)


def test_bh(spark):
    df = spark.createDataFrame([("a", p) for p in (0.01, 0.02, 0.03, 0.04)] + [("b", None), ("b", 0.5)], "sample string, p double")
    got = {(r["sample"], r["p"]): r["corrected_wilcoxon_pvalue"] for r in st.bh_adjust(df, "p").collect()}
    assert [got["a", p] for p in (0.01, 0.02, 0.03, 0.04)] == [0.04] * 4 and got["b", None] is None and got["b", 0.5] == 0.5


def reads_of(spark, ref, alt):
    one = [f"named_struct('ref', {x}D, 'alt', cast(null AS double))" for x in ref] + [f"named_struct('ref', cast(null AS double), 'alt', {x}D)" for x in alt]
    return spark.sql(f"SELECT {SNP}, array({', '.join(one)}) AS reads_w_snp")


def test_rank_sum(spark):
    assert st.mann_whitney(reads_of(spark, [0.5] * 4, [0.5] * 4)).first()["wilcoxon_pvalue"] == 1.0
    # 3 against 3, fully apart: 2 of 20 orders
    assert st.mann_whitney(reads_of(spark, [0.1, 0.2, 0.3], [0.7, 0.8, 0.9])).first()["wilcoxon_pvalue"] == 0.1
    row = st.mann_whitney(reads_of(spark, [0.1, 0.2], [])).first()
    assert row["wilcoxon_pvalue"] is None and row["read_asm_effect"] is None


@pytest.mark.parametrize("n1,n2", [(3, 3), (3, 41), (5, 60), (3, 100), (2, 60), (8, 200), (1, 1), (100, 3), (8, 8)])
def test_exact_rank_sums(spark, n1, n2):
    """Against the number of subsets of each rank sum, by whole numbers; the group of n1 stands apart, and in the middle."""
    ways = [[0] * (n1 * n2 + 1) for _ in range(n1 + 1)]
    ways[0][0] = 1
    for rank in range(n1 + n2):  # choose ranks for the first group; its statistic is the sum of (rank - place)
        for k in range(min(rank + 1, n1), 0, -1):
            shift = rank - (k - 1)
            if shift <= n1 * n2:
                ways[k] = [w + (ways[k - 1][u - shift] if u >= shift else 0) for u, w in enumerate(ways[k])]
    total = math.comb(n1 + n2, n1)
    assert sum(ways[n1]) == total
    for u in (0, 1, n1 * n2 // 3, n1 * n2 // 2, n1 * n2):
        p = min(1.0, 2 * sum(ways[n1][: min(u, n1 * n2 - u) + 1]) / total)
        got = spark.createDataFrame([(n1, n2, float(u))], "n1 long, n2 long, u double").select(st.exact_p(F.col("n1"), F.col("n2"), F.col("u"))).first()[0]
        assert got == pytest.approx(p, rel=1e-12)


def test_small_against_large_groups(spark):
    for n2, p in ((41, 0.00015), (100, 0.00001)):
        row = st.mann_whitney(reads_of(spark, [0.01, 0.02, 0.03], [0.1 + i / 1000 for i in range(n2)])).first()
        assert row["wilcoxon_pvalue"] == p


def test_exact_tails_are_counted_once_for_equal_sizes(spark):
    """3,000 groups of 8 against 600; a fold over each one's orders took minutes."""
    began = time.time()
    one = F.transform(F.sequence(F.lit(1), F.lit(608)), lambda i: F.struct(F.when(i % 76 == 0, i / 1000.0).alias("ref"), F.when(i % 76 != 0, i / 1000.0).alias("alt")))
    rows = st.tested(spark.range(3000).select(F.col("id"), F.when(F.col("id") >= 0, one).alias("r")), "r").groupBy("wilcoxon_pvalue").count().collect()
    assert len(rows) == 1 and rows[0]["count"] == 3000 and 0.5 < rows[0]["wilcoxon_pvalue"] < 1
    assert time.time() - began < 20


def test_rank_tests_of_null_and_empty_lists(spark):
    df = spark.sql(f"SELECT {SNP}, cast(r AS array<struct<ref: double, alt: double>>) AS reads_w_snp FROM VALUES (null), (array()), (array(null)), (array(named_struct('ref', 1D, 'alt', null), null, named_struct('ref', null, 'alt', 0.5D))) t(r)")
    got = sorted(((r["read_asm_effect"], r["wilcoxon_pvalue"]) for r in st.mann_whitney(df).collect()), key=repr)
    assert got == [(-0.5, 1.0)] + [(None, None)] * 3


def test_tiles(spark):
    df = spark.createDataFrame([(1, 601), (2, 250)], "chr int, chr_length long")
    tiles = ge.tile_genome(ge.chr_offsets(df), 250, 800)
    assert [tuple(r)[:3] for r in tiles.orderBy("chr", "region_inf").collect()] == [(1, 1, 250), (1, 251, 500), (1, 501, 601), (2, 1, 250)]
    assert tiles.agg(F.sum(F.col("region_sup") - F.col("region_inf") + 1)).first()[0] == 851
    assert sum(-(-n // 250) for n in AUTOSOME_LENGTHS) == 11_524_145 and sum(AUTOSOME_LENGTHS) == 2_881_033_286


def test_intervals(spark):
    regions = spark.createDataFrame([(1, 1, 250), (1, 251, 500), (1, 501, 750), (2, 1, 250)], "chr int, region_inf long, region_sup long")
    bad = spark.createDataFrame([(1, 240, 510)], "chr int, chr_start long, chr_end long")
    hit = lambda only: sorted(r["region_inf"] for r in ge.interval_overlap_join(regions, bad, 250, only).collect())
    assert hit(False) == [1, 251, 501] and hit(True) == [1, 501]
    assert [(r["chr"], r["region_inf"]) for r in ge.anti_join_blacklist(regions, bad, 250).collect()] == [(2, 1)]


def test_half_open_and_chromosome_key(spark):
    regions = spark.createDataFrame([(1, 1, 250, 3, 0)], "chr int, region_inf long, region_sup long, region_nb_cpg long, clustering_index int")
    calls = spark.createDataFrame([(1, 250), (1, 249), (2, 10)], "chr int, pos long")
    assert ge.point_in_region_join(calls, regions, 250).count() == 2
    assert ge.point_in_region_join(calls, regions, 250, half_open=True).count() == 1


def test_halves_and_matrix(spark):
    rows = [(f"r{i}", 1.0 - i / 10, [1, 2, 3], [1, 0, 1], i + 1) for i in range(5)]
    df = spark.createDataFrame(rows, "read_id string, fm double, cpg_pos array<int>, cpg_meth array<int>, rank_desc int").selectExpr(*KEY.split(", "), "*")
    got = [r["grp"] for r in fe.read_split_halves(df).orderBy("rank_desc").collect()]
    assert got == ["high"] * 3 + ["low"] * 2
    m = fe.cpg_read_matrix(df, 10, 20).first()["cpgs_w_padding"]
    assert len(m) == 10 and all(len(r) == 20 for r in m)
    # 3 sites: 4 rows before and 3 after; 5 reads: 8 columns before and 7 after
    assert [sum(r) > 0 for r in m] == [False] * 4 + [True] * 3 + [False] * 3
    assert m[4] == [0] * 8 + [2] * 5 + [0] * 7 and m[5] == [0] * 8 + [1] * 5 + [0] * 7
    wide = [("r", 1.0, list(range(1, 14)), [1] * 13, 1)]
    df = spark.createDataFrame(wide, "read_id string, fm double, cpg_pos array<int>, cpg_meth array<int>, rank_desc int").selectExpr(*KEY.split(", "), "*")
    assert len(fe.cpg_read_matrix(df, 10, 20).first()["cpgs_w_padding"]) == 10


def test_distances_and_density(spark):
    df = spark.sql("SELECT array(named_struct('pos', 10L, 'cov', 1, 'fm', 0.5D), named_struct('pos', 17L, 'cov', 1, 'fm', 0.5D), named_struct('pos', 30L, 'cov', 1, 'fm', 0.5D)) AS cpgs, array(0.5D) AS x")
    assert fe.cpg_distances(df).first()["cpg_dist"] == [7.0, 13.0]
    kd = fe.with_density(df, "x", ex.kernel_grid(0, 1, 0.1), 0.1).first()["x_kd"]
    assert kd[5] == 3.9894 and all(v >= 0 for v in kd)
    one = fe.array_mean_std(df, "x").first()
    assert one["mean_x"] == 0.5 and one["std_x"] is None
    assert len(ex.kernel_grid(0, 200, 10)) == 21


def test_state_features(spark):
    r = hmm.hmm_state_features(spark.sql("SELECT array(0, 0, 1) AS s"), "s", 2).first()
    assert (r["state_0_count"], r["state_1_count"], r["trans_0_0_count"], r["trans_0_1_count"], r["n_changes"]) == (2, 1, 1, 1, 1)
    assert (r["dwell_0_mean"], r["dwell_1_mean"], r["state_entropy"], r["start_state"], r["end_state"]) == (2.0, 1.0, 0.6365, 0, 1)
    empty = hmm.hmm_state_features(spark.sql("SELECT cast(array() AS array<int>) AS s"), "s", 2).first()
    assert empty["state_0_count"] == 0 and empty["state_entropy"] == 0.0 and empty["start_state"] is None
    assert len(hmm.hmm_state_features(spark.sql("SELECT array(0) AS s"), "s", 4).columns) - 1 == 52


def test_hmm_recovers_planted_states(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    seqs = []
    for _ in range(40):
        s, x = int(rng.integers(2)), []
        for _ in range(25):
            x.append(float(rng.normal((0.0, 5.0)[s], 0.5)))
            s = s if rng.random() < 0.9 else 1 - s
        seqs.append((x,))
    df = spark.createDataFrame(seqs, "x array<double>")
    m = hmm.hmm_fit(df, "x", 2, 12, 2)
    assert m["mean"] == pytest.approx([0.0, 5.0], abs=0.2) and m["trans"][0][0] == pytest.approx(0.9, abs=0.06)
    assert all(b >= a - 1e-6 for a, b in zip(m["path"], m["path"][1:]))
    assert hmm.hmm_score(df, "x", m).first()["loglik"] == pytest.approx(m["loglik"], abs=1e-6)
    got = hmm.hmm_decode(df, "x", m).collect()
    assert all((s == 1) == (x > 2.5) for r in got for x, s in zip(r["x"], r["hidden_states"]))


def test_class_weights_and_report(spark):
    df = spark.createDataFrame([(0,)] * 30 + [(1,)] * 10, "y int").withColumn("p", F.col("y"))
    assert tuple(rp.class_weights(df, "y").first()) == (0.67, 2.0, 3.0)
    cm = rp.confusion_matrix(df, "y", "p")
    assert sum(cm.first()) == 40 and rp.classification_report(cm).where("class = 'sum f1'").first()["f1"] == 2.0


def test_chunks_are_disjoint_and_complete(spark):
    df = spark.range(500)
    got = [r["id"] for i in range(7) for r in rp.hash_chunk(df, "id", 7, i).collect()]
    assert sorted(got) == list(range(500))


def test_sampling(spark):
    df = spark.range(100).withColumn("y", (F.col("id") % 5 == 0).cast("int"))
    assert [r["count"] for r in rp.balanced_downsample(df, "y", "id").groupBy("y").count().collect()] == [20, 20]
    assert [r["count"] for r in rp.random_oversample(df, "y", "id").groupBy("y").count().collect()] == [80, 80]


def test_coverage_bounds(spark):
    calls = spark.sql("SELECT 'a' AS sample, 1 AS chr, id AS pos, cast(id AS int) AS cov FROM range(9, 13)")
    assert sorted(r["pos"] for r in rg.cpg_coverage_having(calls, 10, 12).collect()) == [10, 11, 12]
    both = spark.sql("SELECT cast(id AS int) AS ref_cov, 10 AS alt_cov FROM range(9, 13)")
    assert sorted(r["ref_cov"] for r in rg.coverage_filter(both, 10, 12).collect()) == [10, 11]


def test_empty_tables(spark):
    none = spark.sql(f"SELECT {SNP}, array(named_struct('ref', 1D, 'alt', 1D)) AS reads_w_snp").limit(0)
    assert st.mann_whitney(none).count() == 0
    assert rp.label_counts_pct(spark.createDataFrame([], "y int"), "y").count() == 2
    assert rp.class_weights(spark.createDataFrame([], "y int"), "y").first()["w0"] is None


def test_text_round_trips(spark, tmp_path):
    df = spark.sql("SELECT 1 AS id, array(1.5D, -2D) AS x UNION ALL SELECT 2, array()")
    back = io.array_text(io.array_text(df, "x", to="text"), "x")
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    (tmp_path / "a.bed").write_text("chr1\t5\t9\tlow\ta\tb\nchrX\t1\t2\tlow\ta\tb\n")
    assert [tuple(r) for r in io.bed_intervals(spark, str(tmp_path / "a.bed")).collect()] == [(1, 5, 9, "low")]
    assert io.bed_intervals(spark, str(tmp_path / "a.bed"), header=True).count() == 0


def test_decision_never_passes_on_null(spark):
    df = spark.sql("SELECT cast(null AS double) AS p, 0.5D AS read_asm_effect, 5 AS consecutive_sig_cpgs, 5 AS total_sig_cpgs")
    assert st.asm_decision(df, "p", Config()).first()["asm"] == 0


def test_fisher_of_deep_tables(spark):
    from fractions import Fraction
    from math import comb

    tables = [(400, 300, 350, 350), (1200, 900, 1100, 1000), (3, 2000, 15, 1990), (1001, 0, 0, 1)]
    # small ones, and ones on both sides of the end of the listed factorials
    rng = random.Random(31)
    tables += [tuple(rng.randint(0, most) for _ in range(4)) for most in (2, 6, 16, 33) for _ in range(60)]
    tables = [t for t in tables if sum(t)]
    got = spark.createDataFrame(tables, "a int, b int, c int, d int").select("a", "b", "c", "d", ex.fisher_p(*map(F.col, "abcd")).alias("p")).collect()
    for a, b, c, d, p in got:
        ways = [comb(a + b, x) * comb(c + d, a + c - x) for x in range(max(0, a - d), min(a + b, a + c) + 1)]
        exact = float(Fraction(sum(w for w in ways if w <= ways[a - max(0, a - d)]), comb(a + b + c + d, a + c)))
        assert abs(p - exact) < 1e-8 * exact + 1e-12


def test_every_sequence_of_a_reference_has_its_offset(spark):
    offsets = spark.range(1500).selectExpr("CAST(id AS INT) AS chr", "id * 10 AS absolute_nucleotide_pos")
    calls = spark.range(1500).selectExpr("CAST(id AS INT) AS chr", "5L AS pos")
    assert ge.join_chr_offset(calls, offsets).where("absolute_nucleotide_pos = chr * 10").count() == 1500


def test_model_selection_and_run_log(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    seqs = [([float(rng.normal((0.0, 4.0)[(t // 6) % 2], 0.4)) for t in range(24)],) for _ in range(30)] + [([],), (None,)]
    df = spark.createDataFrame(seqs, "x array<double>")
    rows = {r["k"]: r for r in hmm.hmm_model_selection(df, "x", [1, 2, 3], 10, 2).collect()}
    assert min(rows, key=lambda k: rows[k]["bic"]) == 2
    for k, r in rows.items():
        free = k - 1 + k * (k - 1) + 2 * k
        assert r["aic"] == pytest.approx(2 * free - 2 * r["loglik"]) and r["bic"] == pytest.approx(free * math.log(720) - 2 * r["loglik"])
    m = hmm.hmm_fit(df, "x", 2, 10, 2)
    log = hmm.hmm_run_log(spark, m).first()
    assert (log["k"], log["restarts"], log["n"]) == (2, 2, 720) and log["bic"] == pytest.approx(rows[2]["bic"]) and log["iterations"] == len(m["path"])


def plain_pass(x, p):
    """Likelihood and sums of one sequence by all paths of states."""
    import itertools

    import numpy as np

    k, n = len(p["mean"]), len(x)
    dens = lambda j, v: math.exp(-((v - p["mean"][j]) ** 2) / 2 / p["var"][j]) / math.sqrt(2 * math.pi * p["var"][j])
    total, sums = 0.0, np.zeros(k + k * k + 3 * k)
    for path in itertools.product(range(k), repeat=n):
        w = p["start"][path[0]] * math.prod(dens(s, v) for s, v in zip(path, x)) * math.prod(p["trans"][a][b] for a, b in zip(path, path[1:]))
        one = np.zeros_like(sums)
        one[path[0]] += 1
        for a, b in zip(path, path[1:]):
            one[k + a * k + b] += 1
        for s, v in zip(path, x):
            one[k + k * k + s] += 1
            one[2 * k + k * k + s] += v
            one[3 * k + k * k + s] += v * v
        total, sums = total + w, sums + w * one
    return np.r_[math.log(total), sums / total]


def test_passes_against_all_paths():
    import numpy as np

    models = [{"start": [0.6, 0.4], "trans": [[0.7, 0.3], [0.2, 0.8]], "mean": [0.0, 1.0], "var": [0.5, 1.5]}, {"start": [0.1, 0.9], "trans": [[0.5, 0.5], [0.9, 0.1]], "mean": [2.0, -1.0], "var": [1.0, 0.3]}]
    seqs = [[0.3], [0.1, 1.2, -0.4], [1.0, 1.1, 0.2], [0.5, 0.6, 0.7, 0.8, 0.9]]
    got = sum(hmm.expected_sums(x, hmm.stacked(models)) for x in hmm.by_length([*seqs, [], None], 4))
    for m, row in zip(models, got):
        assert row == pytest.approx(sum(plain_pass(x, m) for x in seqs), rel=1e-9)
