"""Every registered query against the SQL that states it, on the smallest tables."""

import decimal
import math
import os

import duckdb
import pytest

from regionflow.plans import queries as q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables aren't here")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return float(v) if isinstance(v, (bool, int, decimal.Decimal)) else v


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_query(spark, db, name):
    df = q.QUERIES[name](spark, SF)
    cur = db.execute(q.SQL[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(df.columns)
    want = sorted((tuple(plain(r[cols.index(c)]) for c in sorted(cols)) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in sorted(cols)) for r in df.collect()), key=repr) == want


def support(spark):
    return {(r["dataset"], r["label"]): r["n"] for r in q.QUERIES["training_support"](spark, SF).collect()}


def test_features_are_all_columns_but_those_that_define_the_label(spark):
    rows, feats = q.learning_rows(spark, SF)
    assert not {*q.learn.LEAKS, *q.APART} & set(feats) and len(feats) == 129
    assert {"mean_cpg_fm", "std_cpg_dist", "cpg_cov_kd_20", "read_fm_kd_0", "chr_22", "reads_asm_effect", "state_0_count", "trans_2_1_prob", "dwell_1_var", "state_entropy"} <= set(feats)
    assert rows.where(f"{q.LABEL} IS NULL").count() == 0


@pytest.mark.parametrize("name", ["rf_fit", "gbt_fit"])
def test_fits_report_on_all_test_rows(spark, name):
    got = {r["class"]: r for r in q.QUERIES[name](spark, SF).collect()}
    n = support(spark)
    assert [got[c]["support"] for c in ("0", "1")] == [n.get(("TESTING", c), 0) for c in (0, 1)]


def test_logistic_grid_is_fitted_whole(spark):
    got = q.QUERIES["lr_fit"](spark, SF).collect()
    assert {(r["c"], r["penalty"]) for r in got} == {(c, p) for c in (0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 1000.0) for p in ("l1", "l2")}


def test_search_and_refit(spark, monkeypatch):
    monkeypatch.setattr(q.learn, "GRIDS", {"rf": {"n_estimators": [2, 4], "max_depth": [1, 2]}, "gbt": {"n_estimators": [1, 2], "max_depth": [1, 2]}})
    found = q.QUERIES["random_search"](spark, SF).collect()
    for kind in ("rf", "gbt"):
        own = [r for r in found if r["model"] == kind]
        assert len({r["params"] for r in own}) == 4 and [r["sum_f1"] for r in own] == sorted((r["sum_f1"] for r in own), reverse=True)
    rows = {r["model"]: r for r in q.QUERIES["refit_and_test"](spark, SF).collect()}
    n = support(spark)
    for kind, r in rows.items():
        assert r["tn"] + r["fp"] + r["fn"] + r["tp"] == sum(v for (d, _), v in n.items() if d == "TESTING") and r["run_id"].startswith(kind)
    assert set(rows) == {"rf", "gbt"}


def test_small_groups_reach_the_exact_branch(spark, db):
    rows = db.execute(f"SELECT n1, n2 FROM ({q._SMALL}) WHERE ties = 0 AND least(n1, n2) BETWEEN 1 AND 8").fetchall()
    assert any(b > 41 for _, b in rows) and any(b > 100 for _, b in rows) and len(rows) > 50


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 30
    assert set(e.oracle_sql()) <= set(e.queries())


def test_sequence_models_run_with_the_settings_of_the_library(spark, monkeypatch):
    ran = []

    def fits(df, arr, ks, n_iter, restarts, *rest):
        ran.append((list(ks), n_iter, restarts, *rest[1:2]))
        return [{"k": k, "restarts": restarts, "start": [0.0] * k, "mean": [0.0] * k, "var": [1.0] * k, "loglik": 0.0, "n": 9, "path": [0.0]} for k in ks]

    monkeypatch.setattr(q.hmm, "hmm_fits", fits)
    got = {n: q.QUERIES[n](spark, SF).collect() for n in ("hmm_model_selection", "hmm_fit", "hmm_run_log", "hmm_fit_variational")}
    own = (q.CFG.iterations, q.CFG.restarts)
    assert q.CFG.draws == 50
    assert ran == [(list(range(1, 11)), *own)] + [([q.CFG.states], *own, False)] * 2 + [([q.CFG.states], *own, True)]
    assert [r["k"] for r in got["hmm_model_selection"]] == list(range(1, 11)) and len(got["hmm_fit"]) == q.CFG.states


def test_the_run_log_names_the_restarts_that_ran(spark):
    df = spark.createDataFrame([([0.1, 0.9, 0.2, 0.8],)], "x array<double>")
    assert q.hmm.hmm_run_log(spark, q.hmm.hmm_fit(df, "x", 2, 2, 1)).first()["restarts"] == 1


def test_a_site_at_the_limit_of_p_is_not_significant_in_either_engine(spark, db):
    """2 of 4 against 0 of 12, and the tables that mirror it, have an exact p of 1/20."""
    tables = [(2, 4, 0, 12), (2, 4, 12, 12), (0, 12, 2, 4), (12, 12, 2, 4)]
    reads = [("S0", 1, i * 250 + 1, i * 250 + 250, 0, g, [5], [int(j < m)]) for i, (hm, hc, lm, lc) in enumerate(tables) for g, m, n in (("high", hm, hc), ("low", lm, lc)) for j in range(n)]
    df = spark.createDataFrame(reads, "sample string, chr int, region_inf long, region_sup long, clustering_index int, grp string, cpg_pos array<int>, cpg_meth array<int>")
    assert [r["total_sig_cpgs"] for r in q.st.approx_asm(df, q.CFG).collect()] == [0] * 4
    rows = ", ".join(f"('S0', 1, {i}, {i}, 0, 5, {hm}, {hc}, {lm}, {lc})" for i, (hm, hc, lm, lc) in enumerate(tables))
    sql = f"WITH group_counts({q.K}, pos, high_meth, high_cov, low_meth, low_cov) AS (VALUES {rows}) {q._APPROX}"
    got = [r[0] for r in db.execute(f"SELECT total_sig_cpgs FROM ({sql})").fetchall()]
    assert got == [0] * 4


def test_the_support_of_learning_rows_computes_no_features(spark, monkeypatch):
    """It counts the rows of the training table; densities are neither written nor in its plan."""
    written, own = [], q.ad.kept
    monkeypatch.setattr(q.ad, "kept", lambda df: written.append(df.columns) or own(df))
    got = q.QUERIES["training_support"](spark, SF)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert written and not any("cpg_fm_kd_0" in c for c in written) and "cpg_fm_kd_0" not in plan and "cpgs_w_padding" not in plan
    monkeypatch.undo()
    rows = q.learning_rows(spark, SF)[0].groupBy("dataset", q.LABEL).count().collect()
    assert {(r["dataset"], r["label"]): r["n"] for r in got.collect()} == {(r["dataset"], r[q.LABEL]): r["count"] for r in rows}
